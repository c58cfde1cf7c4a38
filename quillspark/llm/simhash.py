"""SimHash near-duplicates, found with a hierarchical index over fingerprints in Gray order.

Distinct fingerprints are put in the order of their Gray rank. A group of neighbours in this order shares
most bits; the shared bits are factored into the group's node as a mask and a pattern, and groups of groups
likewise. A search sums, from the root down, the bits in which the query differs from each node's pattern
and drops the whole group once the sum passes the limit.

The top of the index is made of Spark groups: a node stands for the fingerprints that share their first
bits (in Gray order a contiguous range), and every fingerprint is sent only to the nodes that its bits can
still reach. Nodes with too many fingerprints are divided by the next bits, as often as needed. Below, each
node is one task's small index.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stored, unused
from quillspark.llm.components import connected_components

LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
STEP = 8


def text_fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint: a bit is set if it is set in over half the XXH64 of the word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()
    if not words:
        return 0
    whole = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(whole, seed)
    ends = list(accumulate([len(w) + 1 for w in words], initial=0))
    each = np.array([hashed(whole[a : b - 1], seed) for a, b in zip(ends, ends[width:], strict=False)], dtype="<u8")
    bits = np.zeros(64, np.int64)
    for part in np.array_split(each, max(1, len(each) // 4096)):
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(each), bitorder="little").view("<u8")[0])


def fingerprint_column(text, width: int = 3, seed: int = 42):
    """text_fingerprint as a column of signed longs."""

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        found = np.fromiter((text_fingerprint(t, width, seed) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(found.view(np.int64))

    return fingerprints(text)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each 64-bit word in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """A hierarchical index over fingerprints (uint64): the lowest level has them in Gray order."""

    def __init__(self, fingerprints: np.ndarray, fan: int = 16):
        self.order = np.argsort(gray_rank(fingerprints), kind="stable")
        self.leaves, self.fan, self.levels = fingerprints[self.order], fan, []
        every, some = self.leaves, self.leaves
        while len(every) > fan:
            starts = np.arange(0, len(every), fan)
            every, some = np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(some, starts)
            mask = ~(every ^ some)
            self.levels.append((mask, every & mask))
        self.levels.reverse()

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query position, fingerprint position) that differ in at most limit bits."""
        top = len(self.levels[0][0]) if self.levels else len(self.leaves)
        q, node = np.repeat(np.arange(len(queries)), top), np.tile(np.arange(top), len(queries))
        for depth, (mask, pattern) in enumerate(self.levels):
            keep = np.bitwise_count((queries[q] ^ pattern[node]) & mask[node]) <= limit
            q, node = q[keep], node[keep]
            below = len(self.levels[depth + 1][0]) if depth + 1 < len(self.levels) else len(self.leaves)
            q, node = np.repeat(q, self.fan), (node[:, None] * self.fan + np.arange(self.fan)).ravel()
            inside = node < below
            q, node = q[inside], node[inside]
        keep = np.bitwise_count(queries[q] ^ self.leaves[node]) <= limit
        return q[keep], self.order[node[keep]]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links a-b: joins what they join, with less than one edge a node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    edges = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (rx := root(x)) != (ry := root(y)):
            parent[max(rx, ry)] = min(rx, ry)
            edges.append((x, y))
    return edges


def _links_in_node(limit: int, block: int = 2048):
    def found(rows: pd.DataFrame) -> pd.DataFrame:
        prints, ids, inside = rows["fp"].to_numpy().view(np.uint64), rows["rep"].to_numpy(), rows["inside"].to_numpy()
        index, own = GrayIndex(prints[inside]), ids[inside]
        # Members are in every block of a node's visitors, and search for one another in the first.
        asking = np.flatnonzero(rows["asks"].to_numpy())
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(asking), block):
            some = asking[at : at + block]
            q, f = index.search(prints[some], limit)
            pairs = np.array(_forest(np.concatenate([a, ids[some[q]]]), np.concatenate([b, own[f]])), np.int64).reshape(-1, 2)
            a, b = pairs[:, 0], pairs[:, 1]
        return pd.DataFrame({"a": a, "b": b})

    return found


def _in_blocks(work: DataFrame, most: int) -> DataFrame:
    """work (node, fp, rep, inside) for nodes with members, dealt into blocks of at most some `most` visitors.

    A node's visitors can outnumber its members without bound; each block has all its members and a share of them.
    """
    sizes = work.groupBy("node").agg(F.count_if("inside").alias("members"), F.count("*").alias("all"))
    blocks = sizes.where("members > 0").select(F.col("node").alias("_node"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("members")) / most)).cast("int").alias("blocks"))
    work = work.join(blocks, F.col("node") == F.col("_node"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    block = F.explode(F.when(F.col("inside"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))).alias("block")
    work = work.select("node", "fp", "rep", "inside", block)
    return work.withColumn("asks", ~F.col("inside") | (F.col("block") == 0))


def _masks(limit: int) -> list[list[int]]:
    """By number of differing bits, the masks over one step's bits."""
    by = [[m for m in range(1 << STEP) if m.bit_count() == n] for n in range(limit + 1)]
    return by


def link_fingerprints(prints: DataFrame, limit: int = 2, node_size: int = 4096) -> DataFrame:
    """Edges (a, b) between the rep of fingerprints (fp, rep: long, distinct) that join all within limit bits.

    Every pair within the limit meets in exactly one node; of the pairs found in a node a spanning forest is
    returned, which has the same components. Nodes over node_size are divided by their next bits; visitors of a
    node come in blocks of some eight times node_size, so no group of one task is much larger. At limit 2 a
    fingerprint visits some 18 nodes of 8 bits, 69 of 16 or 150 of 24.
    """
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for ms in _masks(limit)[: n + 1] for m in ms]) for n in range(limit + 1)])

    def bits(depth: int):
        return F.shiftrightunsigned("fp", 64 - depth - STEP).bitwiseAND(F.lit((1 << STEP) - 1).cast("long"))

    def spread(rows: DataFrame, depth: int) -> DataFrame:
        """Send each row of (node, fp, rep, inside, left) to the children that its remaining bits reach."""
        rows = rows.withColumn("own", bits(depth)).withColumn("mask", F.explode(masks[F.col("left")]))
        rows = rows.withColumn("child", F.col("own").bitwiseXOR(F.col("mask")))
        # Of two children of one node the lower one's members visit the upper one, so a pair meets once.
        rows = rows.where("not inside or child >= own")
        return rows.select(
            F.shiftleft("node", STEP).bitwiseOR(F.col("child")).alias("node"), "fp", "rep",
            (F.col("inside") & (F.col("mask") == 0)).alias("inside"), (F.col("left") - F.bit_count("mask")).cast("int").alias("left"),
        )

    work = prints.select(F.lit(0).cast("long").alias("node"), "fp", "rep", F.lit(True).alias("inside"), F.lit(limit).alias("left"))
    edges = None
    for depth in range(0, 64, STEP):
        work = spread(work, depth)
        if depth + STEP < 64:
            members = prints.groupBy(F.shiftrightunsigned("fp", 64 - depth - STEP).alias("node")).count()
            large = members.where(F.col("count") > node_size).select("node")
            split = not large.isEmpty()
        else:
            split = False
        ready = work.join(large, "node", "left_anti") if split else work
        found = _in_blocks(ready, 8 * node_size).groupBy("node", "block").applyInPandas(_links_in_node(limit), "a long, b long")
        edges = found if edges is None else edges.union(found)
        if not split:
            return edges
        work = stored(work.join(large, "node", "left_semi"), "nodes")
    return edges


def linked_rows(docs: DataFrame, limit: int = 2, width: int = 3, seed: int = 42, node_size: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, text_hash) for every row of docs, and (fp, root) for the fingerprints that have links.

    root is the smallest fingerprint (as a signed number) that links lead to; one without links is its own root.
    Both tables are stored. Texts that share a fingerprint are one node of the search, so copies cost one row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text"), width, seed).alias("fp"), F.xxhash64("text").alias("text_hash"))
    rows = stored(rows, "fingerprints")
    prints = stored(rows.select("fp", F.col("fp").alias("rep")).distinct(), "prints")
    parts = connected_components(link_fingerprints(prints, limit, node_size))
    return rows, stored(parts.select(F.col("node").alias("fp"), F.col("component").alias("root")), "roots")


def simhash_components(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id long, text string).

    Fingerprints are linked at limit or fewer differing bits (options: those of linked_rows); component_id is the
    smallest doc_id that links lead to, also by rows without an id. Null and empty texts have fingerprint zero and
    are linked like others; a null doc_id keeps its row but never names a component (a component of such rows alone
    has a null id). Repeated rows give repeated rows, and rows of one doc_id with unlike texts are each a node of
    their own. Texts of any length are read whole. An empty table gives an empty table. Other columns, whatever
    their names, are neither read nor returned.
    """
    rows, roots = linked_rows(docs, **options)
    # The smallest id by fingerprint, and of the fingerprints that have links by component.
    named = rows.groupBy("fp").agg(F.min("doc_id").alias("own"))
    least = roots.join(named, "fp").groupBy("root").agg(F.min("own").alias("component_id"))
    linked = roots.join(stored(least, "least"), "root").select("fp", "component_id", F.lit(True).alias("linked"))
    every = named.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("own")).alias("component_id"))
    return rows.join(stored(every, "named"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with all columns, less every row but one of each component of near-duplicates.

    The row with the smallest doc_id stays (one without an id only where none has one), of those with the same id
    the one whose text has the smallest hash, and of rows that repeat both the one whose columns, as JSON, come
    first. Unlike texts of one doc_id are in components of their own, and all stay. Null and empty texts are one
    component.
    """
    rows, roots = linked_rows(docs, **options)
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    kinds = stored(rows.groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("copies")).withColumn("key", key), "kinds")
    # A fingerprint without links keeps its smallest row; of the others the component's smallest decides.
    best = kinds.groupBy("fp").agg(F.min("key").alias("own"))
    linked = roots.join(best, "fp")
    first = stored(linked.groupBy("root").agg(F.min("own").alias("first")), "first")
    linked = linked.join(first, "root").select("fp", "first")
    best = stored(best.join(linked, "fp", "left").select("fp", F.coalesce("first", "own").alias("first")), "best")
    # Few rows go as a rule, so those are named, and not the many that stay.
    gone = stored(kinds.join(best, "fp").where("key <> first").select("doc_id", "text_hash").distinct(), "gone")
    out = _against(docs, gone, "left_anti")
    repeated = stored(kinds.join(best, "fp").where("key = first AND copies > 1").select("doc_id", "text_hash"), "repeated")
    if repeated.isEmpty():
        return out
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = _against(out, repeated, "inner").groupBy(F.col("doc_id"), F.xxhash64("text")).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return _against(out, repeated, "left_anti").union(once.select("row.*"))


def _against(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs' columns of the rows that have, or have not, one of keys (doc_id, text_hash)."""
    k = keys.select(F.col("doc_id").alias(i := unused("id", docs)), F.col("text_hash").alias(h := unused("hash", docs)))
    joined = docs.join(k, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), how)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
