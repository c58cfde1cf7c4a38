"""The Merkle manifest against the contract written out for one row at a time."""

import zlib
from hashlib import sha256

import pytest

from quillspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, digest string, block long, spot string, _at int, path string, rows int"
EXTRA = ["n", "d", 1, "s", 2, "p", 3]


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute_tree(nodes, fanout=3):
    """Root of nodes, and for each its siblings as (left, right) level by level."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, own in enumerate(at):
            first = own - own % fanout
            run = level[first : first + fanout]
            paths[i].append((run[: own - first], run[own - first + 1 :]))
        level = [H(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [a // fanout for a in at]
    return level[0], paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        own = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = own, *brute_tree([leaf(r) for r in own])
    root, upper = brute_tree([trees[s][1] for s in order])
    out = []
    for source, above in zip(order, upper, strict=True):
        own, subroot, paths = trees[source]
        for row, path in zip(own, paths, strict=True):
            received = row
            if row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                received = (row[0], row[1].replace("\n", ""), *row[2:])
            h = leaf(received)
            for left, right in path + above:
                h = H(*left, h, *right)
            out.append((row[0], leaf(row), subroot, root, H(*(d for left, right in path + above for d in left + right)), h, h == root))
    return out


def sample():
    sources = [None, "", "b", "a", "é", "Z"]
    rows = [(i, None if i % 11 == 0 else "" if i % 7 == 0 else f"line {i}\nnext\n" + "x" * (i % 5), "en" if i % 3 else None, sources[0 if i % 13 == 0 else 2 if i % 3 else i % 6], i if i % 4 else None) for i in range(160)]
    return [*rows, rows[20], rows[20], (20, "other\ntext", "fr", rows[20][3], 1), (None, "no\nid", None, "a", None), (999, "lone", "en", "only", 4), (1000, "long\n" * 200_000, "en", "b", 5)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_manifest_against_brute_force(spark, depth):
    rows = sample()
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    touched = merkle.F.crc32(merkle.F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    lost = [merkle.F.replace("text", merkle.F.lit("\n"), merkle.F.lit("")) if c == "text" else merkle.F.col(c) for c in merkle.COLUMNS]
    made = merkle.build(docs, received=merkle.F.when(touched & merkle.F.col("text").isNotNull(), merkle.leaf_digest(lost)), depth=depth)
    assert rows_of(merkle.proofs(made)) == sorted(brute(rows), key=repr)
    if depth == 7:
        assert rows_of(merkle.tampered_manifest(docs)) == sorted(brute(rows), key=repr)


def test_manifest_of_few_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.tampered_manifest(none).count() == 0 and merkle.build(none).root is None
    one = [(7, "a\nb", "en", "s", 3)]
    assert rows_of(merkle.tampered_manifest(spark.createDataFrame([(*one[0], *EXTRA)], SCHEMA))) == brute(one)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_levels_and_places(fanout):
    nodes = [H(str(i)) for i in range(23)]
    levels = merkle.tree(merkle.matrix([bytes.fromhex(n) for n in nodes]), fanout, None)
    root, paths = brute_tree(nodes, fanout)
    assert levels[-1].tobytes().decode() == root
    assert merkle.proof_digests(levels, fanout, b"!") == [H(*(d for left, right in p for d in left + right), "!") for p in paths]
    assert {r.tobytes().decode() for r in merkle.folded(levels[0], levels, fanout, [])} == {root}


def test_changed_blocks(spark):
    rows = [(i, f"t{i}", "en", "a" if i < 90 else "b", i) for i in range(100)]
    old = merkle.build(spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA), depth=2)
    new = [*rows[:40], (40, "changed", "en", "a", 40), *rows[41:90], (500, "new", "en", "c", 1)]
    new = merkle.build(spark.createDataFrame([(*r, *EXTRA) for r in new], SCHEMA), depth=2)
    assert rows_of(merkle.changed_blocks(old, new)) == [("+a", 4, "changed"), ("+b", 0, "removed"), ("+b", 1, "removed"), ("+c", 0, "added")]
    assert merkle.changed_blocks(old, old).count() == 0
