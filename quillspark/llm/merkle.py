"""Merkle manifest of a dataset: digests of rows, of each group of rows and of the whole, with a proof for every row."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import numbered, stored

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64


def leaf_digest(columns: list[Column]) -> Column:
    """sha256 (hex) of columns one after the other: `-` for null, else the UTF-8 byte count, `:` and the value as text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


# Matrices of digests: one row of 64 hex bytes for each node.


def matrix(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests).hex().encode(), np.uint8).reshape(-1, HEX)


def _hashed(rows) -> np.ndarray:
    return np.frombuffer("".join([sha256(r).hexdigest() for r in rows]).encode(), np.uint8).reshape(-1, HEX)


def parents(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The next level: every run of fanout rows of the matrix is a row of the reshaped one; the last run may be shorter."""
    full = len(nodes) // fanout
    whole = nodes[: full * fanout].reshape(full, fanout * HEX)
    return _hashed([*whole, nodes[full * fanout :]] if len(nodes) % fanout else whole)


def tree(nodes: np.ndarray, fanout: int, depth: int | None) -> list[np.ndarray]:
    """All levels from nodes on: depth of them above, or (None) as many as it takes to reach one node."""
    levels = [nodes]
    while len(levels) <= depth if depth is not None else len(levels[-1]) > 1:
        levels.append(parents(levels[-1], fanout))
    return levels


def sibling_places(n: int, level: int, width: int, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the siblings of leaves 0 to n - 1 stand at a level of width nodes, and which of these places exist."""
    own = np.arange(n) // fanout**level
    place = own % fanout
    others = np.arange(fanout - 1)
    at = (own - place)[:, None] + others + (others >= place[:, None])
    return np.minimum(at, width - 1), at < width


def proof_digests(levels: list[np.ndarray], fanout: int, above: bytes) -> list[str]:
    """For each leaf the sha256 of its siblings, level by level, and then of above, those of the levels over this block."""
    n = len(levels[0])
    cells, there = [np.empty((n, 0, HEX), np.uint8)], [np.empty((n, 0), bool)]
    for level, nodes in enumerate(levels[:-1]):
        at, exists = sibling_places(n, level, len(nodes), fanout)
        cells.append(nodes[at])
        there.append(exists)
    cells, there = np.concatenate(cells, axis=1), np.concatenate(there, axis=1)
    return [sha256((c if all_of_them else c[t]).tobytes() + above).hexdigest() for c, t, all_of_them in zip(cells, there, there.all(axis=1), strict=True)]


def folded(received: np.ndarray, levels: list[np.ndarray], fanout: int, path: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The root that each leaf as received gives with the siblings of levels and then of path: (left ones, right ones) a level."""
    n = len(received)
    for level, nodes in enumerate(levels[:-1]):
        own = np.arange(n) // fanout**level
        place = own % fanout
        first = own - place
        runs = nodes[np.minimum(first[:, None] + np.arange(fanout), len(nodes) - 1)]
        runs[np.arange(n), place] = received
        there = np.minimum(len(nodes) - first, fanout)
        received = _hashed([run[:k] for run, k in zip(runs, there, strict=True)])
    for left, right in path:
        received = _hashed([left + r.tobytes() + right for r in received])
    return received


# Trees in Spark: tables of nodes (name, pos, rows, digest), cut into aligned blocks of fanout ** depth nodes.


@dataclass
class Manifest:
    """levels[0] has the leaves (name, id, pos, rows, digest, received); levels[i] one node for each block of levels[i - 1].

    The last level has one node a group, its subroot. upper is the same over subroots, and root the digest (hex) of all.
    """

    levels: list[DataFrame]
    upper: list[DataFrame]
    root: str | None
    fanout: int
    depth: int

    @property
    def block(self) -> int:
        return self.fanout**self.depth


def _block_levels(table: pa.Table, fanout: int, depth: int) -> list[np.ndarray]:
    table = table.sort_by("pos")
    alone = table.column("rows")[0].as_py() <= fanout**depth
    return tree(matrix(table.column("digest").to_pylist()), fanout, None if alone else depth)


def _levels(nodes: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    block = fanout**depth
    schema = "name string, pos long, rows long, digest binary"

    def root_of(key, table):
        top = _block_levels(table, fanout, depth)[-1][0].tobytes()
        above = -(-table.column("rows")[0].as_py() // block)
        return pa.table({"name": [key[0].as_py()], "pos": [key[1].as_py()], "rows": [above], "digest": [bytes.fromhex(top.decode())]})

    out = [nodes]
    while True:
        blocks = out[-1].select("name", "pos", "rows", "digest", F.expr(f"pos div {block}").alias("block"))
        out.append(stored(blocks.groupBy("name", "block").applyInArrow(root_of, schema), "merkle"))
        if (out[-1].agg(F.max("rows")).first()[0] or 1) <= 1:
            return out


def build(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str | None = "source", received: Column | None = None, fanout: int = 3, depth: int = 7) -> Manifest:
    """The manifest of docs: leaves are digests of columns, ordered by key inside each group (None: a single one).

    Every fanout neighbours are hashed to one node, level by level, until one is left; a last run may be shorter.
    Groups' roots, null first and then by their names' bytes, are hashed likewise. received: a leaf's digest (hex)
    as someone else has it, to be checked against the manifest; null is the leaf itself.

    Leaves are numbered by a range sort and cut into blocks of fanout ** depth, whatever the size of a group, so a
    task holds one block; a level of blocks is stored for each further `depth` levels of the tree.
    """
    name = F.lit("") if group is None else F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    own = docs.select(
        name.alias("name"), F.col(key).alias("id"), F.unhex(leaf_digest([F.col(c) for c in columns])).alias("digest"),
        F.unhex(F.lit(None).cast("string") if received is None else received).alias("received"), F.monotonically_increasing_id().alias("spot"),
    )
    levels = _levels(numbered(stored(own, "leaves"), ["name"], ["id", "digest", "spot"]).drop("spot"), fanout, depth)
    tops = levels[-1].select(F.lit("").alias("name"), F.col("name").alias("group"), "digest")
    upper = _levels(numbered(tops, ["name"], ["group"]), fanout, depth)
    top = upper[-1].first()
    return Manifest(levels, upper, bytes(top["digest"]).hex() if top else None, fanout, depth)


_PATH = "array<struct<left:binary,right:binary>>"


def _descend(nodes: DataFrame, paths: DataFrame, m: Manifest, extra: list[str]) -> DataFrame:
    """(name, pos, path, subroot, *extra) of nodes from the (name, pos, path, subroot) of their blocks."""
    fanout, depth = m.fanout, m.depth
    kept = ", ".join(f"{c} {dict(nodes.dtypes)[c]}" for c in extra)

    def of_block(table, block):
        table = table.sort_by("pos")
        levels = _block_levels(table, fanout, depth)
        above, rows = block.column("path")[0].as_py(), []
        for i in range(len(table)):
            path = []
            for level, nodes in enumerate(levels[:-1]):
                own = i // fanout**level
                first = own - own % fanout
                path.append({"left": nodes[first:own].tobytes(), "right": nodes[own + 1 : first + fanout].tobytes()})
            rows.append(path + above)
        out = {"name": table.column("name"), "pos": table.column("pos"), "path": pa.array(rows, pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())])))}
        return pa.table(out | {"subroot": pa.array([block.column("subroot")[0].as_py()] * len(table), pa.binary())} | {c: table.column(c) for c in extra})

    blocks = nodes.select(*dict.fromkeys(["name", "pos", "rows", "digest", *extra]), F.expr(f"pos div {m.block}").alias("block"))
    schema = f"name string, pos long, path {_PATH}, subroot binary{', ' + kept if kept else ''}"
    return stored(blocks.groupBy("name", "block").cogroup(paths.groupBy("name", "pos")).applyInArrow(of_block, schema), "paths")


def proofs(m: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for every leaf; digests are hex.

    proof_sha256: of the leaf's siblings, level by level from its own to the root, left to right. folded_root: what
    the leaf as received gives with these siblings; verified: whether that is the root.
    """
    # The root has no siblings; from there each block hands its own on to the nodes under it.
    paths = m.upper[-1].select("name", "pos", F.array().cast(_PATH).alias("path"), F.lit(None).cast("binary").alias("subroot"))
    for at in range(len(m.upper) - 2, -1, -1):
        paths = _descend(m.upper[at], paths, m, ["group", "digest"] if at == 0 else [])
    paths = paths.select(F.col("group").alias("name"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"))
    for nodes in m.levels[-2:0:-1]:
        paths = _descend(nodes, paths, m, [])
    fanout, depth, root = m.fanout, m.depth, m.root
    kind = m.levels[0].schema["id"].dataType.simpleString()

    def of_block(table, block):
        table = table.sort_by("pos")
        levels = _block_levels(table, fanout, depth)
        path = [(p["left"], p["right"]) for p in block.column("path")[0].as_py()]
        leaves = table.column("digest").to_pylist()
        received = matrix([r if r is not None else own for r, own in zip(table.column("received").to_pylist(), leaves, strict=True)])
        roots = [r.tobytes().decode() for r in folded(received, levels, fanout, path)]
        proven = proof_digests(levels, fanout, b"".join(left + right for left, right in path))
        n, subroot = len(table), block.column("subroot")[0].as_py().hex()
        return pa.table({
            "id": table.column("id"), "leaf": [x.hex() for x in leaves], "subroot": [subroot] * n, "root": [root] * n,
            "proof_sha256": proven, "folded_root": roots, "verified": [r == root for r in roots],
        })

    leaves = m.levels[0].select("name", "id", "pos", "rows", "digest", "received", F.expr(f"pos div {m.block}").alias("block"))
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return leaves.groupBy("name", "block").cogroup(paths.groupBy("name", "pos")).applyInArrow(of_block, schema)


def changed_blocks(old: Manifest, new: Manifest) -> DataFrame:
    """(name, block, state) of the blocks of leaves that differ between two manifests of one shape: changed, added or removed.

    name is the group's, with `+` before it, or empty for null. Whole blocks are compared, so a row that came or
    went also changes the blocks behind it in its group.
    """
    if (old.fanout, old.depth) != (new.fanout, new.depth):
        raise ValueError("manifests of different fanout or depth")
    a, b = (m.levels[1].select("name", F.col("pos").alias("block"), F.col("digest").alias(c), F.lit(True).alias(f"in_{c}")) for m, c in ((old, "old"), (new, "new")))
    both = a.join(b, ["name", "block"], "full")
    state = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("name", "block", state.alias("state")).where("state is not null")


def tampered_manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs (see build and proofs).

    As received, the texts of rows whose crc32 of the decimal doc_id is even have lost their line feeds; these alone
    can fail, and do unless there was none. Null texts stay null. A null doc_id comes first in its source and is
    never tampered with; rows of one source and doc_id are ordered by their leaves, and equal ones each are a leaf.
    Texts of any length are hashed whole. An empty table gives an empty table. Other columns, whatever their names,
    are neither read nor returned.
    """
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    parts = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in columns]
    touched = even & F.contains(F.col("text"), F.lit("\n"))
    m = build(docs, columns, received=F.when(touched, leaf_digest(parts)))
    return proofs(m).withColumnRenamed("id", "doc_id")
