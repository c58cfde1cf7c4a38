"""Toxicity scores from a logistic model that is regularised by counterfactuals.

In the labelled texts identity terms are swapped for others of their kind, and the model pays for every
change of score that a swap makes. What a text says about a group then counts, and not which group it names.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fold_bucket, stored

WORD = re.compile(r"[^\W\d_]+")
#: Identity terms by kind; a term is swapped for the next of its kind.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("african", "european", "american", "chinese", "indian", "mexican"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
SWAPS = {term: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, term in enumerate(kind)}


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings of 4, 5 and 6 letters, by which inflected forms agree."""
    hashes = [crc32(word.encode())] + [crc32(b"^" + word[:n].encode()) for n in (4, 5, 6) if len(word) >= n]
    return [h - (1 << 32) if h >> 31 else h for h in hashes]


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def swapped_words(words: set[str]) -> set[str]:
    return {SWAPS.get(w, w) for w in words}


def _features_column(text, swapped: bool):
    @F.pandas_udf("array<int>")
    def features(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[int] | None:
            words = text_words(text)
            if swapped:
                if words.isdisjoint(SWAPS):
                    return None
                words = swapped_words(words)
            return sorted({f for w in words for f in word_features(w)})

        return pd.Series([of(t) for t in texts])

    return features(text)


class ToxicityModel:
    """Weights by feature; score(text) is a probability."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self, cached_words: int = 500_000):
        weights, known, kept = self.weights, {}, {}

        def score(text: str | None) -> float:
            found: set[int] = set()
            for word in text_words(text):
                use = known.get(word)
                if use is None:
                    if len(known) >= cached_words:
                        known.clear()
                    hits = tuple(f for f in word_features(word) if f in weights)
                    use = known[word] = kept.setdefault(hits, hits)
                if use:
                    found.update(use)
            z = self.bias + sum(weights[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

        return score


def fit(labels: np.ndarray, weights: np.ndarray, entries: tuple[np.ndarray, np.ndarray], swaps: tuple[np.ndarray, np.ndarray, np.ndarray], n_features: int, l2: float, penalty: float, toxic_weight: float = 2.0, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Weights of features and bias that minimise log-loss (toxic rows weigh toxic_weight) + l2 |w|^2 / 2 + penalty * mean squared score change under swaps.

    labels and weights: of each row, which stands for so many equal ones. entries: (row, feature) of each set
    feature. swaps: (row, feature, +1 or -1) of each feature that a row's swapped text gains or loses.
    Accelerated gradient descent, each weight's step by the bound of its curvature.
    """
    rows, cols = entries
    swap, swap_col, sign = swaps
    n_rows, total, toxic_total = len(labels), weights.sum(), (weights * labels).sum()
    bias = float(np.log((toxic_total + 1) / (total - toxic_total + 10)))
    if not n_rows or not n_features:
        return np.zeros(n_features), bias
    swapped_total = max(1.0, weights[np.unique(swap)].sum())
    # Starts from each feature's log-odds, a quarter as a word comes with up to four features: a mark that few texts
    # have keeps its say then, where descent from zero would let the common marks explain their texts alone.
    seen, toxic = np.bincount(cols, weights=weights[rows], minlength=n_features), np.bincount(cols, weights=(weights * labels)[rows], minlength=n_features)
    w = (np.log((toxic + 0.5) / (toxic_total + 1)) - np.log((seen - toxic + 0.5) / (total - toxic_total + 1))) / 4
    size = np.bincount(rows, minlength=n_rows)
    each = np.where(labels > 0, toxic_weight, 1.0) * weights / total
    # The loss's curvature is at most diagonal: a column's bound is the sum of its rows' sizes.
    bound = 0.25 * np.bincount(cols, weights=(each * (size + 1.0))[rows], minlength=n_features) + l2
    moved = np.bincount(swap, minlength=n_rows)
    share = weights / swapped_total
    bound += 2 * penalty * np.bincount(swap_col, weights=(share * moved)[swap], minlength=n_features)
    step, bias_step = 1 / bound, 1 / (0.25 * (each * (size + 1)).sum())
    v, vb = w.copy(), bias
    for t in range(1, rounds + 1):
        z = np.bincount(rows, weights=v[cols], minlength=n_rows) + vb
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) * each
        grad = np.bincount(cols, weights=err[rows], minlength=n_features) + l2 * v
        if len(swap):
            change = share * np.bincount(swap, weights=sign * v[swap_col], minlength=n_rows)
            grad += 2 * penalty * np.bincount(swap_col, weights=sign * change[swap], minlength=n_features)
        w_next, b_next = v - step * grad, vb - bias_step * err.sum()
        m = (t - 1) / (t + 2)
        v, vb = w_next + m * (w_next - w), b_next + m * (b_next - bias)
        w, bias = w_next, b_next
    return w, float(bias)


def sample_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(toxic, features, swapped, copies): at most max_rows unlike rows, by labelled ids of the smallest hashes.

    An id with several labels counts as toxic if one says so. Rows that agree in all of (toxic, features, swapped)
    are one row with their number; swapped is what a text's features are after the swap, or null where it has none.
    """
    asked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    asked = asked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    found = docs.select("doc_id", "text").join(F.broadcast(asked), F.col("doc_id") == F.col("id"))
    kept = found.select("toxic", _features_column(F.col("text"), False).alias("features"), _features_column(F.col("text"), True).alias("swapped"))
    alike = kept.groupBy("toxic", "features", "swapped").agg(F.count("*").alias("copies"))
    # Ids that occur in many documents could give more; what the driver sees stays under max_rows.
    return alike.orderBy(F.xxhash64("features", "swapped"), "toxic", "features").limit(max_rows)


def chosen_features(rows: DataFrame, min_gain: float) -> list[int]:
    """The features whose presence tells at least min_gain of the label, by the G statistic halved, which chance seldom reaches."""
    n, n_toxic = rows.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("toxic") * F.col("copies")), F.lit(0))).first()
    counts = rows.select("toxic", "copies", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("copies").alias("n"), F.sum(F.col("toxic") * F.col("copies")).alias("a"))

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, all_n = F.col("a").cast("double"), F.col("n").cast("double")
    share = n_toxic / max(1, n)
    g = part(a, all_n * share) + part(all_n - a, all_n * (1 - share)) + part(n_toxic - a, (n - all_n) * share) + part(n - n_toxic - all_n + a, (n - all_n) * (1 - share))
    return sorted(r["feature"] for r in counts.where(g >= min_gain).select("feature").collect())


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8192, min_gain: float = 14.0, l2: float = 2e-6, penalty: float = 1.0) -> ToxicityModel:
    """Fit on docs (doc_id, text) joined to labels (doc_id, toxic 0/1).

    Learns from a bounded sample, that of sample_rows, and from every feature that chosen_features finds in it;
    texts never reach the driver, only which of these features the rows have. A repeated row is learned from as
    often as it occurs.
    """
    rows = stored(sample_rows(docs, labels, max_rows), "toxicity")
    kept = chosen_features(rows, min_gain)
    known = F.array(*[F.lit(f) for f in kept]).cast("array<int>")

    def among(column: str):
        return F.array_sort(F.array_intersect(F.col(column), known))

    few = rows.select("toxic", "copies", among("features").alias("x"), among("swapped").alias("y"))
    few = few.groupBy("toxic", "x", "y").agg(F.sum("copies").alias("copies")).toPandas()
    few = few.iloc[np.lexsort((few["y"].map(str), few["x"].map(str), few["toxic"]))] if len(few) else few
    at = {f: i for i, f in enumerate(kept)}
    direct, turned = [], []
    for i, (x, y) in enumerate(zip(few["x"], few["y"], strict=True)):
        direct += [(i, at[f]) for f in x]
        # A swap's change: what the swapped text has and the text has not, and the other way round.
        if y is not None:
            turned += [(i, at[f], 1.0) for f in sorted(set(y) - set(x))] + [(i, at[f], -1.0) for f in sorted(set(x) - set(y))]
    entries = np.array(direct, np.int64).reshape(-1, 2).T
    swaps = np.array(turned, np.float64).reshape(-1, 3).T
    w, bias = fit(few["toxic"].to_numpy(np.float64), few["copies"].to_numpy(np.float64), (entries[0], entries[1]), (swaps[0].astype(np.int64), swaps[1].astype(np.int64), swaps[2]), len(kept), l2, penalty)
    return ToxicityModel({f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-9}, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text).

    Labels are learned from rows whose crc32(doc_id) modulo 5 is not 0 alone. Null and empty texts get the
    score of a text without features; without any label every text gets the prior, which is under 0.5.
    Repeated rows give repeated rows; a null doc_id is not held out and has no label. Texts of any length are
    read whole. Equal texts get equal scores, and a score of exactly 0.5 is predicted toxic. An empty table
    gives an empty table. Other columns, whatever their names, are neither read nor returned.
    """
    held_out = F.coalesce(fold_bucket("doc_id", 5) == 0, F.lit(False))
    model = train(docs, labels.where(fold_bucket("doc_id", 5) != 0), **options)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        score = model.scorer()
        return pd.Series([score(t) for t in texts], dtype="float64")

    scored = docs.select("doc_id", held_out.alias("held_out"), scores(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
