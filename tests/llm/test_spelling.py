"""Spelling variants against all pairs and the contract written out."""

import random
import re
import zlib
from collections import Counter

import pytest

from quillspark.llm import spelling

SCHEMA = "doc_id long, text string, n long, word string, form string, block long, pos long, rows int, id string, run string"
EXTRA = [1, "w", "f", 2, 3, 4, "i", "r"]


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def brute_groups(counts, ratio=10):
    near = {w: [] for w in counts}
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for w in counts:
        for n in (len(w), len(w) + 1):
            for other in by_length.get(n, ()):
                if is_near(w, other) and (n != len(w) or w < other):
                    near[w].append(other)
                    near[other].append(w)
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best and counts[best] >= ratio * counts[w] else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return sorted(((w, forms[w], root(w), counts[w], len(near[w]), counts.get(forms[w])) for w in counts), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def family(rng, letters, n):
    """Words that are many edits of few: long paths, repeated letters, beginnings of one another."""
    words = set()
    while len(words) < n:
        w = rng.choice(sorted(words)) if words and rng.random() < 0.8 else "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :] or "a", w[:i] + rng.choice(letters) + w[i + 1 :]])
        words.add(w)
    return sorted(words)


@pytest.mark.parametrize("seed", range(6))
def test_terminals_give_each_pair_once_in_any_cut(seed):
    rng = random.Random(seed)
    words = family(rng, "abé"[: 2 + seed % 2], 120)
    size = rng.choice([1, 2, 7, 50, 500])
    blocks = [words[i : i + size] for i in range(0, len(words), size)]
    edges = [(b, words[i * size - 1] if i else None, words[(i + 1) * size] if (i + 1) * size < len(words) else None) for i, b in enumerate(blocks)]
    children = {}
    for b, before, after in edges:
        for node, child, n in spelling.outer_children(b, before, after):
            if child is not None:
                children.setdefault(node, Counter())[child] += n
    heavy = {node: min(c, key=lambda x: (-c[x], x)) for node, c in children.items()}
    met, light, most = Counter(), {}, 0
    for b, before, after in edges:
        for word, path in spelling.light_edges(b, before, after, heavy):
            most = max(most, len(path))
            for kind, depth, form in spelling.terminals(word, path):
                if form in set(words):
                    met[tuple(sorted((word, form)))] += 1
                if kind == "r":
                    light.setdefault((depth, form), []).append(word)
    for group in light.values():
        met.update(tuple(sorted((a, b))) for i, a in enumerate(group) for b in group[i + 1 :])
    wanted = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if is_near(a, b)}
    assert met == Counter(wanted) and most <= len(words).bit_length() + 1


@pytest.mark.parametrize("block_words", [3, 40, 20_000])
def test_groups_against_all_pairs(spark, block_words):
    rng = random.Random(9)
    words = family(rng, "abc", 260)
    counts = {w: int(10 ** rng.uniform(0.4, 5)) for w in words}
    counts |= {"x" * 3000: 500, "x" * 3001: 7, "x" * 2999 + "y": 50}
    # A chain whose counts grow by ten with each step.
    counts |= {"zzzz" + "q" * i: 2 * 10**i for i in range(9)}
    found = spelling.spelling_groups(spark.createDataFrame(sorted(counts.items()), "word string, n long"), block_words=block_words)
    assert rows_of(found) == brute_groups(counts)


def test_variants_of_texts(spark):
    rng = random.Random(4)
    vocabulary = ["computer", "Computer", "computers", "komputer", "ÉCOLIERS", "écoliers", "écolier", "straßenbahn", "strassenbahn", "letters", "lettersx", "abcdefg", "×÷×÷×÷×"]
    rows = [(i, " ".join(rng.choices(vocabulary, [200, 90, 8, 4, 3, 60, 5, 70, 6, 90, 5, 3, 2], k=90)) + " under7 x1y2zzzzzzzz") for i in range(60)]
    rows += [(None, "computer letters letters"), (70, None), (71, ""), (72, "a" * 50_000 + " " + "a" * 50_000), rows[3], rows[3], (rows[3][0], "letters-letters_letters9letters")]
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    counts = brute_counts(rows)
    assert sorted(map(tuple, spelling.word_counts(docs).collect())) == sorted(counts.items())
    assert rows_of(spelling.spelling_variants(docs)) == brute_groups(counts)
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
