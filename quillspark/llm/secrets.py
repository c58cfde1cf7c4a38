"""Secret scans: patterns, and guess costs of values that stand in credential contexts."""

from __future__ import annotations

import re
from math import inf, log10

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import stored, unused

KINDS = ("assign", "access", "hex", "guess")
#: Fixed patterns. The assignment's second group has 12 characters or more; the others are as long as they say.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Wider contexts in which a value is judged by the cost of guessing it.
KEYWORD = r"(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth(?:orization)?|bearer|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret)"
KEYWORD_ALONE = re.compile(KEYWORD + r"[.,:;!?]*", re.I | re.A)
HEAD = re.compile(r"(?<![A-Za-z])" + KEYWORD + r"(?:[\"']?[\x20\t]*(?::=|=>|[:=]|\bis\b)[\x20\t]*|\x20+)", re.I | re.A)
#: A value in quotes ends at the closing one of its line; any other at white space, and what closes a sentence is not judged.
QUOTED = {q: re.compile(rf"{q}((?:\\.|[^{q}\\\n])*){q}") for q in "\"'"}
UNQUOTED = re.compile(r"\S*")
PROSE = re.compile(r"[^\W\d_]+[.,:;!?]*")
CLOSING = ".,:;!?"
WORD_CHARS = (3, 20)
#: Rows of the keyboard, which walks follow.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "01234567890")
NEXT_KEYS = {a + b for row in KEYBOARD for s in (row, row[::-1]) for a, b in zip(s, s[1:], strict=False)}
LEET = str.maketrans("@4310$5!7", "aaeiossit")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d")
DATES = re.compile(rf"(?=({DATE.pattern}))")
LETTER_RUN = re.compile(r"[^\W\d_]{3,}")
SPLIT_COST = log10(2.0)
MIN_VALUE = 6


def _charset_cost(ch: str) -> float:
    return log10(10 if ch.isdigit() else 26 if ch.islower() else 52 if ch.isalpha() else 95)


def _low(value: str) -> str:
    """value in lower case, of the same length."""
    return value.lower() if len(value.lower()) == len(value) else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def segments(value: str, limit: float = inf, ranks: dict[str, int] | None = None) -> list[tuple[int, int, str, float]]:
    """The parts of value that are cheaper to guess than by brute force: (start, end, kind, log10 of guesses).

    ranks: the place of each word in the order in which it is guessed. Words and dates at any place; the rest of a
    walk along the keyboard and of a repetition from any place in it, so that the parts of a value's end are those
    of the value. With a limit, repeats whose unit alone costs that much are left out: every character costs 1 or more.
    """
    n, low, ranks = len(value), _low(value), ranks or {}
    found = []
    for form, extra in ((low, 0.0), (low.translate(LEET), log10(4.0))):
        if extra and form == low:
            break
        for i, j, word in _letters(form):
            if rank := ranks.get(word):
                own = value[i:j]
                cased = 0.0 if own == low[i:j] else log10(2.0) if own.istitle() or own.isupper() else log10(2.0) * (j - i)
                found.append((i, j, "word", log10(rank + 1) + cased + extra))
    for m in DATES.finditer(value):
        i, j = m.span(1)
        found.append((i, j, "date", log10(365 * 120) if j - i > 4 else log10(120)))
    i = 0
    while i < n:
        j = i + 1
        while j < n and low[j - 1] + low[j] in NEXT_KEYS:
            j += 1
        found += [(k, j, "walk", log10(len(NEXT_KEYS)) + log10(j - k)) for k in range(i, j - 2)]
        i = j
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    sums = np.concatenate([[0.0], np.cumsum([_charset_cost(c) for c in value])])
    for width in range(1, int(min(n // 2, limit)) + 1):
        unlike = np.where(codes[:-width] == codes[width:], n, np.arange(n - width))
        alike = np.minimum(np.minimum.accumulate(unlike[::-1])[::-1], n - width) - np.arange(n - width)
        for i in np.flatnonzero((alike >= width) & (width * (1 + alike // width) >= 3)).tolist():
            times = 1 + int(alike[i]) // width
            found.append((i, i + times * width, "repeat", float(sums[i + width] - sums[i]) + log10(times)))
    return found


def _letters(form: str):
    """All runs of WORD_CHARS letters in form, at any place: (start, end, run)."""
    for m in LETTER_RUN.finditer(form):
        for i in range(m.start(), m.end() - WORD_CHARS[0] + 1):
            for j in range(i + WORD_CHARS[0], min(m.end(), i + WORD_CHARS[1]) + 1):
                yield i, j, form[i:j]


def possible_words(value: str) -> set[str]:
    """The words that segments would look up in ranks."""
    low = _low(value)
    return {w for form in {low, low.translate(LEET)} for _, _, w in _letters(form)}


def suffix_costs(value: str, limit: float = inf, ranks: dict[str, int] | None = None) -> list[float]:
    """For each place of value, log10 of the guesses for the cheapest segmentation of what follows it, into words, dates, repeats, walks and brute force.

    A part after the first also pays for where it begins. With a limit, costs of limit or more may come out too high.
    """
    by_start: dict[int, list[tuple[int, float]]] = {}
    for i, j, _, cost in segments(value, limit, ranks):
        by_start.setdefault(i, []).append((j, cost))
    n = len(value)
    best, brute = [0.0] * (n + 1), [inf] * (n + 1)  # from here on: by any first part; by a brute-force one
    for i in range(n - 1, -1, -1):
        after = min(brute[i + 1], best[i + 1] + SPLIT_COST) if i + 1 < n else 0.0
        brute[i] = least = _charset_cost(value[i]) + after
        for j, own in by_start.get(i, ()):
            least = min(least, own + (best[j] + SPLIT_COST if j < n else 0.0))
        best[i] = least
    return best


def guess_cost(value: str, limit: float = inf, ranks: dict[str, int] | None = None) -> float:
    """The cost of the whole value; see suffix_costs."""
    return suffix_costs(value, limit, ranks)[0]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns in a text, in code points, by start and then kind."""
    base = [("hex", *m.span()) for m in HEX.finditer(text)]
    base += [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    if ":" in text or "=" in text:
        base += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    return sorted(base, key=_order)


def credential_runs(text: str) -> list[tuple[int, str, list[int]]]:
    """(start, run, offsets): runs of a text that hold the values of credential contexts, from each of offsets to the run's end.

    A run between white space is one, however many keywords stand in it, so that it is judged once; a value in
    quotes is one of its own. Values of under MIN_VALUE characters, keywords alone and, unless `:`, `=` or an arrow
    stands before them, words of letters alone are no candidates.
    """
    runs: list[tuple[int, str, list[int]]] = []
    open_run, end = None, -1
    for m in HEAD.finditer(text):
        start, quote = m.end(), text[m.end() : m.end() + 1]
        explicit = ":" in m[0] or "=" in m[0]
        quoted = QUOTED[quote].match(text, start) if quote in QUOTED else None
        if quoted:
            start, stop = quoted.span(1)
        else:
            start += quote in QUOTED
            if start >= end:
                open_run, end = None, UNQUOTED.match(text, start).end()
            stop = end
        if stop - start < MIN_VALUE or KEYWORD_ALONE.fullmatch(text, start, stop) or (not explicit and PROSE.fullmatch(text, start, stop)):
            continue
        if quoted:
            runs.append((start, text[start:stop], [0]))
        elif open_run is None:
            open_run = (start, text[start:stop], [0])
            runs.append(open_run)
        elif open_run[0] + open_run[2][-1] != start:
            open_run[2].append(start - open_run[0])
    return runs


def dear_offsets(run: str, offsets: list[int], min_cost: float, ranks: dict[str, int]) -> list[int]:
    """The offsets from which the run costs min_cost or more; punctuation that closes it is not judged."""
    costs = suffix_costs(run.rstrip(CLOSING), min_cost, ranks)
    return [o for o in offsets if o < len(costs) and costs[o] >= min_cost]


def guess_spans(runs: list[tuple[int, int, list[int]]]) -> list[tuple[str, int, int]]:
    """Spans of (start, length, dear offsets) of a text's runs: from left to right, without those that begin inside a span taken before."""
    spans, at = [], 0
    for start, end in sorted((start + o, start + length) for start, length, offsets in runs for o in offsets):
        if start >= at:
            spans.append(("guess", start, end))
            at = end
    return spans


def scan(text: str | None, min_cost: float = 9.0, ranks: dict[str, int] | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base, added) spans of one text by given ranks of words."""
    text = text or ""
    return base_spans(text), guess_spans([(start, len(run), dear_offsets(run, offsets, min_cost, ranks or {})) for start, run, offsets in credential_runs(text)])


def _order(span: tuple[str, int, int]) -> tuple:
    return span[1], KINDS.index(span[0]), span[2]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# In Spark.

_SCAN = "base array<struct<kind:string,start:int,end:int>>, runs array<struct<start:int,run:string,offsets:array<int>>>"


def _scanned(texts: DataFrame, *kept: str) -> DataFrame:
    """(*kept, digest, base, runs) for every row of texts (*kept, text), stored: the only time that texts go to Python."""

    @F.pandas_udf(_SCAN)
    def scans(column: pd.Series) -> pd.DataFrame:
        base = [[{"kind": k, "start": a, "end": b} for k, a, b in base_spans(t or "")] for t in column]
        runs = [[{"start": a, "run": r, "offsets": o} for a, r, o in credential_runs(t or "")] for t in column]
        return pd.DataFrame({"base": pd.Series(base, dtype="object"), "runs": pd.Series(runs, dtype="object")})

    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return stored(texts.select(*kept, digest.alias("digest"), scans(F.col("text")).alias("s")).select(*kept, "digest", "s.*"), "scans")


def word_ranks(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, words: map of word to rank) for those of runs (run, times: how often it occurs) that hold words of docs (text).

    A word is a run of WORD_CHARS letters that occurs in docs outside of runs; its rank is one more than the number
    of words that occur more often there, so it is known from all texts. Words are joined by shuffle to what the
    runs hold; no dictionary is sent anywhere.
    """
    split = lambda column: F.explode(F.split(F.lower(column), r"\P{L}+")).alias("word")
    fits = F.length("word").between(*WORD_CHARS)
    all_words = docs.where("text is not null").select(split("text")).where(fits).groupBy("word").agg(F.count("*").alias("n"))
    inside = runs.select("times", split("run")).where(fits).groupBy("word").agg(F.sum("times").alias("n_inside"))
    counted = stored(all_words.join(inside, "word", "left").select("word", (F.col("n") - F.coalesce("n_inside", F.lit(0))).alias("n")).where("n > 0"), "words")
    # Words of one count share a rank; there are far fewer counts than words.
    steps = counted.groupBy("n").agg(F.count("*").alias("words"))
    above = F.coalesce(F.sum("words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = steps.select("n", (above + 1).alias("rank"))

    @F.pandas_udf("array<string>")
    def looked_up(column: pd.Series) -> pd.Series:
        return pd.Series([sorted(possible_words(r)) for r in column], dtype="object")

    held = runs.select("run").distinct().select("run", F.explode(looked_up("run")).alias("word"))
    known = held.join(counted, "word").join(ranked, "n")
    return known.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("word", "rank"))).alias("words"))


def _added(docs: DataFrame, scans: DataFrame, min_cost: float, words: list[str] | None) -> DataFrame:
    """(digest, added: array of (start, end)) of the scans that have guess spans, by the words of docs or a given list, most frequent first."""
    some = scans.where(F.size("runs") > 0)
    # A text's copies have one digest and are looked at once; equal runs with equal offsets are judged once.
    texts = some.groupBy("digest").agg(F.first("runs").alias("runs"), F.count("*").alias("times"))
    spot = F.md5(F.concat_ws(" ", F.array_join(F.col("offsets").cast("array<string>"), ","), "run"))
    places = stored(texts.select("digest", "times", F.inline("runs")).withColumn("spot", spot), "runs")
    runs = places.groupBy("spot").agg(F.first("run").alias("run"), F.first("offsets").alias("offsets"))
    if words is None:
        # Occurrences inside are counted with the copies of their texts.
        runs = runs.join(word_ranks(docs, places), "run", "left")
        fixed = None
    else:
        runs = runs.withColumn("words", F.lit(None).cast("map<string,long>"))
        fixed = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}

    @F.pandas_udf("array<int>")
    def judged(run: pd.Series, offsets: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series([dear_offsets(r, list(o), min_cost, fixed if fixed is not None else dict(w or {})) for r, o, w in zip(run, offsets, ranks, strict=True)], dtype="object")

    dear = runs.select("spot", judged("run", "offsets", "words").alias("dear")).where(F.size("dear") > 0)
    met = places.join(dear, "spot").select("digest", "start", (F.col("start") + F.length("run")).alias("end"), F.explode("dear").alias("offset"))
    spans = met.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct((F.col("start") + F.col("offset")).alias("start"), "end"))).alias("all"))
    # From left to right, without those that begin inside a span taken before; see guess_spans.
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("taken"))
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.array_append(acc["taken"], s).alias("taken"))).otherwise(acc)
    return spans.select("digest", F.aggregate("all", begun, step)["taken"].alias("added"))


def find_secrets(docs: DataFrame, min_cost: float = 9.0, words: list[str] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs (doc_id, text).

    Base spans are whole matches of the patterns, leftmost and not overlapping within a kind; n_ counts and
    base_sha256 are of these. The method adds `guess` spans: values in a credential context (see credential_runs)
    whose cheapest guess costs 10 ** min_cost guesses or more, words by their ranks among all words that docs hold
    outside of such values (see word_ranks), or in `words`, most frequent first. A value in quotes ends at the
    closing one, any other at white space. spans has all, by start and then kind, and spans of one start by kind as
    listed in KINDS. Null is the empty text, which has no spans; texts and values of any length are read whole;
    repeated rows give repeated rows, and an empty table an empty one. Other columns, whatever their names, are
    neither read nor returned.
    """
    base = _scanned(docs.select("doc_id", "text"), "doc_id")
    added = F.transform(F.coalesce("added", F.array().cast("array<struct<start:int,end:int>>")), lambda s: F.struct(F.lit("guess").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    key = lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))
    listed = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, key)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    rows = base.join(_added(docs, base, min_cost, words), "digest", "left")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS[:3]]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", added)).alias("spans"))


def redact(docs: DataFrame, mask: str = "*", min_cost: float = 9.0, words: list[str] | None = None) -> DataFrame:
    """docs with all columns, every character inside a span of find_secrets replaced by mask; null texts stay null."""
    digest, added = unused("digest", docs), unused("added", docs)
    keyed = docs.withColumn(digest, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    spans = _added(docs, _scanned(docs.select("text")), min_cost, words)
    joined = keyed.join(spans.select(F.col("digest").alias(digest), F.col("added").alias(added)), digest, "left")

    @F.pandas_udf("string")
    def masked(texts: pd.Series, extra: pd.Series) -> pd.Series:
        def of(text: str | None, own) -> str | None:
            if text is None:
                return None
            chars = list(text)
            for a, b in [*((a, b) for _, a, b in base_spans(text)), *((s["start"], s["end"]) for s in (own if own is not None else ()))]:
                chars[a:b] = mask * (b - a)
            return "".join(chars)

        return pd.Series([of(t, x) for t, x in zip(texts, extra, strict=True)], dtype="object")

    return joined.withColumn("text", masked(F.col("text"), F.col(added))).select(docs.columns)
