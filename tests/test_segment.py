"""The most probable segmentation against every other one, and the tokenizer inside retrieval."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.segment import Graph, segmented, segmenter
from quillspark.operators import retrieval


def every_cut(run):
    for mask in range(1 << max(0, len(run) - 1)):
        words, at = [], 0
        for i in range(1, len(run) + 1):
            if i == len(run) or mask >> (i - 1) & 1:
                words.append(run[at:i])
                at = i
        yield words


def test_path_is_the_best_of_all():
    rng = random.Random(1)
    for _ in range(120):
        counts = {"".join(rng.choice("甲乙丙") for _ in range(rng.randrange(1, 4))): rng.choice([1, 2, 5, 40]) for _ in range(8)}
        total, run = sum(counts.values()), "".join(rng.choice("甲乙丙丁") for _ in range(rng.randrange(1, 9)))
        scored = {}
        for words in every_cut(run):
            if all(w in counts or len(w) == 1 for w in words):
                score = round(sum(math.log(counts.get(w, 1)) - math.log(total) for w in words), 7)
                scored.setdefault(score, []).append(words)
        best = scored[max(scored)]
        assert Graph(counts).path(run) == max(best, key=lambda ws: [len(w) for w in ws]), (counts, run)


def test_words_of_mixed_texts(spark):
    counts = spark.createDataFrame([("研究", 50), ("研究生", 40), ("生命", 30), ("命", 1), ("起源", 20), ("办法", 9), ("管理", 9), ("管理办法", 5), ("转专业", 8), ("专业", 30), (None, 3)], "word string, n long")
    texts = ["研究生命起源", "转专业管理办法，2025年6月报名！", "GPA_4 研究生?", "", None, "，！"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    plain, search = segmenter(counts, search=False), segmenter(counts)
    rows = {r["i"]: (r["p"], r["s"]) for r in df.select("i", plain(F.col("t")).alias("p"), search(F.col("t")).alias("s")).collect()}
    assert rows[0][0] == ["研究", "生命", "起源"]
    assert rows[1][0] == ["转专业", "管理办法", "2025", "年", "6", "月", "报", "名"]
    assert rows[1][1] == ["专业", "转专业", "管理", "办法", "管理办法", "2025", "年", "6", "月", "报", "名"]
    assert rows[2][1] == ["GPA", "_", "4", "研究", "研究生"] or rows[2][1] == ["GPA", "4", "研究", "研究生"]
    assert rows[3] == rows[4] == rows[5] == ([], [])
    with pytest.raises(ValueError, match="dictionary"):
        segmenter(counts, max_words=3)


def test_questions_meet_documents_by_segmented_words(spark):
    counts = spark.createDataFrame([("奖学金", 20), ("申请", 30), ("宿舍", 20), ("报修", 9), ("流程", 9)], "word string, n long")
    docs = spark.createDataFrame([(1, "奖学金申请流程"), (2, "宿舍报修流程"), (3, "食堂")], "id long, t string")
    asked = spark.createDataFrame([(7, "怎么申请奖学金"), (8, "宿舍报修")], "query_id long, question string")
    cut = segmenter(counts)
    terms = retrieval.term_table(docs, "id", "t", cut)
    n, mean = retrieval.corpus_size(docs, "t", cut)
    found = retrieval.bm25(asked, terms, "id", n, mean, tokenize=cut).collect()
    assert {(r["query_id"], r["id"]) for r in found if r["pos"] == 1} == {(7, 1), (8, 2)}


def test_a_dictionary_of_any_size_stays_in_its_table(spark):
    # Over a million words, which no task may hold.
    other = spark.range(1_000_001).select(F.concat(F.lit("x"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("word"), F.lit(1).cast("long").alias("n"))
    few = {"the": 900, "he": 30, "cat": 20, "at": 50, "a": 70, "cats": 3}
    counts = other.unionByName(spark.createDataFrame(list(few.items()), "word string, n long"))
    runs = ["thecatsat", "hexatz", "q", "xbcdcat", "catcatcat"]
    df = spark.createDataFrame([(r,) for r in runs + ["", None, "q"]], "run string")
    found = {r["run"]: r["words"] for r in segmented(df, "run", counts).collect()}
    whole = Graph({**few, **{"x" + str(i).translate(str.maketrans("0123456789", "abcdefghij")): 1 for i in range(1_000_001)}})
    assert found == {r: whole.path(r) for r in runs}
