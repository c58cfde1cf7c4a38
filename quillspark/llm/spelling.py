"""Spelling variants: words one edit apart, by merging light subtrees of their trie, and the word that each is a variant of."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import numbered, stored

#: Runs of these letters are words; A-Z are lower-cased first.
LETTERS = "a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAST_ALL = "\U0010ffff"
Edge = tuple[int, str]


def word_counts(docs: DataFrame, min_chars: int = 7, min_count: int = 2, every: int = 31) -> DataFrame:
    """(word, n) of docs (doc_id, text): runs of letters, lower-cased from A-Z alone, counted over all whole texts.

    With h the crc32 of `<doc_id>:<run>` (no doc_id: the empty text), a run whose h `every` divides loses its
    character number h % length. Words of at least min_chars characters and min_count occurrences are returned.
    Counts are combined before the shuffle, so a word of any frequency is one row of each task.
    """
    low = F.translate("text", UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    lost = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.left("run", lost), F.substring("run", lost + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# The trie of a sorted block of words. Nodes that other blocks share, "outer" ones, lie on the paths of its first and last word.


def shared(a: str, b: str, start: int = 0) -> int:
    """How many characters a and b begin with alike; start of them are known to be."""
    most = min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    return start


def _keys(word: str, upto: int) -> list[bytes]:
    """A digest of each beginning of word, of 0 to upto characters."""
    state = blake2b(digest_size=16)
    out = [state.digest()]
    for ch in word[:upto]:
        state.update(ch.encode())
        out.append(state.copy().digest())
    return out


def _outer(words: list[str], before: str | None, after: str | None) -> tuple[int, int]:
    """The deepest outer nodes on the paths of the first and the last word; -1: none."""
    return -1 if before is None else shared(before, words[0]), -1 if after is None else shared(words[-1], after)


def outer_children(words: list[str], before: str | None, after: str | None) -> list[tuple[bytes, str | None, int]]:
    """(node, next character, words of this block under it) for all outer nodes; a node without words below it has one row of None."""
    rows, seen = [], set()
    for word, deepest in zip((words[0], words[-1]), _outer(words, before, after), strict=True):
        for depth, key in enumerate(_keys(word, deepest) if deepest >= 0 else ()):
            if key not in seen:
                seen.add(key)
                at, children = bisect_right(words, word[:depth]), []
                end = bisect_right(words, word[:depth] + PAST_ALL, at)
                while at < end:
                    stop = bisect_right(words, words[at][: depth + 1] + PAST_ALL, at, end)
                    children.append((key, words[at][depth], stop - at))
                    at = stop
                rows += children or [(key, None, 0)]
    return rows


def light_edges(words: list[str], before: str | None = None, after: str | None = None, heavy: dict[bytes, str] | None = None) -> Iterator[tuple[str, tuple[Edge, ...]]]:
    """Each word with its light edges (depth, the node's heavy character), from the root down.

    words are sorted and distinct; before and after are their neighbours outside the block, heavy the choice for
    outer nodes. A node's heavy child has most words, of equal ones the smallest character; where a word ends is
    never the heavy child. A word has log2 of all words + 1 light edges at most.
    """
    d0, d1 = _outer(words, before, after)
    first = [heavy[k] for k in _keys(words[0], d0)] if d0 >= 0 else []
    last = [heavy[k] for k in _keys(words[-1], d1)] if d1 >= 0 else []
    stack: list[tuple[int, int, int, tuple[Edge, ...]]] = [(0, len(words), 0, ())]
    while stack:
        lo, hi, depth, edges = stack.pop()
        word = words[lo]
        # What is known of the path's outer nodes: the longer of the two lists, as they agree where both apply.
        outer = max(first if lo == 0 else [], last if hi == len(words) else [], key=len)
        branch = shared(word, words[hi - 1], depth) if hi - lo > 1 else len(word)
        for d in range(depth, min(branch, len(outer))):
            if outer[d] != word[d]:
                edges += ((d, outer[d]),)
        if hi - lo == 1:
            yield word, edges + (((branch, outer[branch]),) if branch < len(outer) else ())
            continue
        children, at = [], lo + (len(word) == branch)
        while at < hi:
            end = bisect_right(words, words[at][: branch + 1] + PAST_ALL, at, hi)
            children.append((at, end))
            at = end
        most = outer[branch] if branch < len(outer) else words[max(children, key=lambda c: c[1] - c[0])[0]][branch]
        light = edges + ((branch, most),)
        if len(word) == branch:
            yield word, light
        stack += [(a, b, branch + 1, edges if words[a][branch] == most else light) for a, b in children]


def terminals(word: str, edges: tuple[Edge, ...]) -> Iterator[tuple[str, int, str]]:
    """(kind, depth, form): where a word comes to lie when the light subtree that it is in is merged at a light edge.

    r: its first character is replaced by the heavy one. s: that character is skipped (unless the next one is
    alike, when a deeper node does it). i: the heavy child skips its character, so the word is under it as a whole.
    """
    for d, most in edges:
        yield "i", d, word[:d] + most + word[d:]
        if d < len(word):
            yield "r", d, word[:d] + most + word[d + 1 :]
            if word[d + 1 : d + 2] != word[d]:
                yield "s", d, word[:d] + word[d + 1 :]


# In Spark.


def _block(table) -> tuple[list[str], dict[str, int], str | None, str | None]:
    """The sorted words of a block, their counts, and the words before and after it."""
    rows = sorted(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), table.column("side").to_pylist(), strict=True))
    own = {w: n for w, n, side in rows if side == 0}
    beside = {side: w for w, _, side in rows if side}
    return list(own), own, beside.get(-1), beside.get(1)


def merged_terminals(words: DataFrame, block_words: int = 20_000) -> DataFrame:
    """(kind, depth, form, word, n) for each light edge of words (word, n): see terminals.

    Words are sorted by range and cut into blocks of block_words, each one task's trie. Blocks share the nodes on
    their edges, whose children are counted over all blocks first, so every block takes the same one as heavy.
    """
    block = F.expr(f"pos div {block_words}")
    at, last = F.col("pos") % block_words, F.col("pos") == F.col("rows") - 1
    spots = F.array(
        F.struct(block.alias("block"), F.lit(0).alias("side")),
        F.when((at == 0) & (block > 0), F.struct((block - 1).alias("block"), F.lit(1).alias("side"))),
        F.when((at == block_words - 1) & ~last, F.struct((block + 1).alias("block"), F.lit(-1).alias("side"))),
    )
    blocks = numbered(words.select("word", "n"), [], ["word"]).select("word", "n", F.inline(F.array_compact(spots)))

    def counted(key, table):
        rows = outer_children(*[_block(table)[i] for i in (0, 2, 3)])
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return pa.table({"block": pa.array([key[0].as_py()] * len(rows), pa.int64()), "node": pa.array(columns[0], pa.binary()), "child": pa.array(columns[1], pa.string()), "n": pa.array(columns[2], pa.int64())})

    outer = stored(blocks.groupBy("block").applyInArrow(counted, "block long, node binary, child string, n long"), "outer")
    sizes = outer.where("child is not null").groupBy("node", "child").agg(F.sum("n").alias("n"))
    chosen = sizes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "child"))["child"].alias("heavy"))
    known = outer.select("block", "node").distinct().join(chosen, "node")

    def emitted(table, nodes):
        words, counts, before, after = _block(table)
        heavy = dict(zip(nodes.column("node").to_pylist(), nodes.column("heavy").to_pylist(), strict=True))
        rows = [(*t, word, counts[word]) for word, edges in light_edges(words, before, after, heavy) for t in terminals(word, edges)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64())
        return pa.table({c: pa.array(v, k) for c, v, k in zip(("kind", "depth", "form", "word", "n"), columns, kinds, strict=True)})

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(emitted, "kind string, depth int, form string, word string, n long")


def _weight(n: str, word: str):
    """Orders words by count, most frequent first, and then by their characters."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def near_words(words: DataFrame, block_words: int = 20_000) -> DataFrame:
    """(word, n_near, best) of the words (word, n) that have others one edit away: how many, and the first by (less = -n, word).

    Terminals that coincide are such pairs, each found once: merged words that meet a word of the trie, and
    words of one node whose replaced forms meet. Of the latter there are as many as the alphabet has letters at
    most, and only their number and their first two are needed.
    """
    merged = stored(merged_terminals(words, block_words), "terminals")
    met = stored(merged.join(words.select(F.col("word").alias("form"), F.col("n").alias("form_n")), "form").select("form", "form_n", "word", "n"), "met")
    one = F.lit(1).cast("long").alias("k")
    rows = met.select("word", one, _weight("form_n", "form").alias("best"))
    rows = rows.unionByName(met.select(F.col("form").alias("word"), one, _weight("n", "word").alias("best")))
    light = merged.where("kind = 'r'").groupBy("depth", "form").agg(F.array_sort(F.collect_list(_weight("n", "word"))).alias("m")).where(F.size("m") > 1)
    light = light.select("m", F.explode("m").alias("own"))
    other = F.when(F.col("own") == F.col("m")[0], F.col("m")[1]).otherwise(F.col("m")[0])
    rows = rows.unionByName(light.select("own.word", (F.size("m") - 1).cast("long").alias("k"), other.alias("best")))
    return rows.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def spelling_groups(words: DataFrame, ratio: int = 10, block_words: int = 20_000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of words (word, n: distinct words and their counts).

    form: the near word of largest n (ties: the first by its characters), if it has ratio times the word's n or
    more, else null; form_n is its n. root: the last word along forms. Counts grow by ratio with each step, so
    pointers are doubled a few times until all are at their roots.
    """
    words = stored(words.select("word", "n"), "words")
    near = near_words(words, block_words)
    found = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f"),
        ).select("word", "n", "n_near", "f.form", "f.form_n"), "near",
    )
    steps = max(1, int(math.log(found.agg(F.max("n")).first()[0] or 1, ratio)) + 1)
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = stored(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, ratio: int = 10, block_words: int = 20_000) -> DataFrame:
    """spelling_groups of the word_counts of docs (doc_id, text).

    Null and empty texts have no words; a null doc_id counts as the empty text; repeated rows count each time;
    texts and words of any length are read whole. An empty table gives an empty one. Other columns, whatever
    their names, are neither read nor returned.
    """
    return spelling_groups(word_counts(docs), ratio, block_words)
