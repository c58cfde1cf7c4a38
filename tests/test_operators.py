import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import chunking, text
from quillspark.functions.embedding import hash_embedder, keyword_score
from quillspark.operators import containment, dialogue, entities, fuzzy, governance, index, pages, ratings, retrieval, usage


def ranking(spark, *ids, q=1):
    return spark.createDataFrame([(q, i, n + 1) for n, i in enumerate(ids)], "query_id int, id string, pos int")


def test_fusion(spark):
    fused = lambda *r: [x["id"] for x in retrieval.fuse([ranking(spark, *i) for i in r], "id").orderBy("pos").collect()]
    assert fused("abc", "acb")[0] == "a"
    assert sorted(fused("a", "b")) == ["a", "b"] and fused("a", "b")[0] == "a"
    assert fused("", "") == []
    assert set(fused("abcd", "dcba")) == set(fused("dcba", "abcd"))


@pytest.mark.parametrize(
    ("scores", "k", "extra", "files"),
    [
        ([(0.99, "a"), (0.98, "a"), (0.97, "b"), (0.96, "c"), (0.95, "c")], 2, 5, ["a", "b", "c"]),
        ([(0.99, "a"), (0.98, "a"), (0.001, "b")], 2, 5, ["a", "a"]),
        ([(0.9, f"f{i}") for i in range(10)], 2, 3, ["f0", "f1", "f2", "f3", "f4"]),
        ([(0.9, None), (0.8, "a"), (0.7, "")], 2, 3, ["a", None]),
    ],
)
def test_coverage(spark, scores, k, extra, files):
    rows = spark.createDataFrame([(1, i + 1, s, f) for i, (s, f) in enumerate(scores)], "query_id int, pos int, score double, file string")
    assert [r["file"] for r in retrieval.coverage(rows, "file", k, 0.5, extra).orderBy("place").collect()] == files


def test_thresholds_and_carried_rows(spark):
    questions = spark.createDataFrame([(1, "alpha beta"), (2, "zeta eta")], "query_id int, question string")
    chunks = spark.createDataFrame([("a", "alpha beta", "f"), ("b", "none", "g"), ("c", "alpha", "h"), ("d", "nil", "i")], "id string, text string, file string")
    channel = ranking(spark, "a", "b", "d").union(ranking(spark, "b", "d", q=2))
    found = retrieval.hybrid(questions, [channel], chunks, "id", "file", keyword_score, ranking(spark, "c", "d").select("query_id", "id"))
    assert [(r["query_id"], r["id"]) for r in found.orderBy("query_id", "place").collect()] == [(1, "a"), (1, "c")]
    alone = retrieval.hybrid(questions, [ranking(spark, "b")], chunks, "id", "file", keyword_score)
    assert [(r["id"], r["score"]) for r in alone.collect()] == [("b", None)]


def test_bm25_scores_only_documents_with_a_term(spark):
    docs = spark.createDataFrame([(1, "red red fox"), (2, "blue fox"), (3, "green hen"), (4, "a b c")], "id int, text string")
    q = spark.createDataFrame([(1, "red")], "query_id int, question string")
    n, mean = retrieval.corpus_size(docs, "text")
    assert [r["id"] for r in retrieval.bm25(q, retrieval.term_table(docs, "id", "text"), "id", n, mean).collect()] == [1]


def test_weights_grow_with_votes_and_shrink_with_age(spark):
    year, now = 31557600, 100 * 31557600
    rows = spark.createDataFrame([(-50, now - year), (0, now - year), (50, now - year), (50, now - 3 * year), (0, now + 9)], "v int, t long")
    w = [r["w"] for r in rows.select(ratings.comment_weight(F.col("v"), F.col("t"), now).alias("w")).collect()]
    assert w[0] < w[1] < w[2] and w[3] < w[2] and w[4] == 1.0


def test_cards_take_the_first_comments_before_clusters(spark):
    rows = spark.createDataFrame([(1, "a", float(-i), i) for i in range(70)] + [(1, "b", -69.5, 99)], "t int, c string, w double, id int")
    top = ratings.top_comments(rows, "t", "c", "w", ["id"])
    assert {r["cluster"] for r in top.collect()} == {"a"} and top.count() == 3


def test_comment_quality(spark):
    texts = ["", "!!", "好", "fine words", "idiot", "idiot bad exam", "idiot abc", "idiot and so much more"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(ratings.comment_quality(F.col("t")).alias("q"))
    assert [r["q"] for r in rows.collect()] == [1, 1, 0, 0, 1, 0, 1, 2]


def test_slang_takes_the_longest_term(spark):
    slang = {"ads": ["Advanced"], "ds": ["Structures"]}
    found = lambda t: spark.range(1).select(entities.expand_slang(F.lit(t), slang, ["Advanced", "Structures"]).alias("x")).first()["x"]
    assert found("take ads") == ["Advanced"] and found("ds and ads") == ["Advanced", "Structures"] and found("none") == []


def test_contained_names_of_every_shape(spark):
    texts = spark.createDataFrame([(1, "we saw the red fox run"), (2, "abcdefghijklmnop"), (3, None), (4, "")], "id int, t string")
    names = spark.createDataFrame([("the red fox",), ("fox",), ("cdef",), ("defghijklmnop",), ("missing red cat",), ("",), (None,)], "n string")
    found = {(r["id"], r["name"]) for r in entities.contained_names(texts, "id", "t", names, "n").collect()}
    assert found == {(1, "the red fox"), (1, "fox"), (2, "cdef"), (2, "defghijklmnop")}


@pytest.mark.parametrize("limits", [{}, {"part_chars": 12}, {"most_parts": 0}])
def test_names_in_texts_against_all_pairs(spark, limits):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("ab c课é") for _ in range(n))
    names, other = ({make(rng.randrange(1, 7)) for _ in range(25)} for _ in range(2))
    rows = [(i, make(rng.randrange(0, 30)), make(12)) for i in range(80)] + [(90, None, "a"), (91, "", None)]
    texts = spark.createDataFrame(rows, "id int, t string, u string")
    sides = {"t": spark.createDataFrame([(n,) for n in [*names, None, ""]], "n string"), "u": spark.createDataFrame([(n,) for n in other], "name string")}
    found = sorted(map(tuple, containment.names_in_texts(texts, "id", sides, **limits).collect()))
    want = [(i, f, n) for i, t, u in rows for f, text, known in (("t", t, names), ("u", u, other)) for n in known if text and n in text]
    assert found == sorted(want)
    longest = sorted(map(tuple, containment.names_in_texts(texts, "id", sides, ("t",), **limits).collect()))
    best = {}
    for i, f, n in want:
        if f == "t":
            best[i] = min(best.get(i, n), n, key=lambda x: (-len(x), x))
    assert longest == sorted([(i, "t", n) for i, n in best.items()] + [w for w in want if w[1] == "u"])
    assert containment.names_in_texts(texts, "id", {"t": sides["t"].limit(0)}, **limits).count() == 0


def test_detection_of_people_and_courses(spark):
    people = spark.createDataFrame([(1, "林青", "linqing", "lq"), (2, "林青", "linqing", "lq"), (3, "赵云飞", "zhaoyunfei", "zyf"), (4, "云飞", "yunfei", "yf")], "id int, name string, py string, init string")
    teaches = spark.createDataFrame([(1, "博弈论"), (2, "高等博弈论"), (3, "几何"), (4, "微分几何")], "id int, course string")
    asked = {
        1: ("林青的博弈论讲得怎么样", ("林青", "博弈论", [1, 2])),
        2: ("赵云飞的微分几何怎么样", ("赵云飞", "几何", [3])),  # a course of the person before a longer one of another
        3: ("林青老师住在哪里", None),  # no intent
        4: ("转专业怎么样", None),  # no one
        5: ("zyf 教得怎么样", ("赵云飞", None, [3, 4])),
        6: ("wf 和 yf 怎么样 ads", None),  # a course's slang: initials do not count
        7: ("云飞的博弈论怎么样", ("云飞", "博弈论", [4])),  # no course of their own: any
        8: (None, None),
    }
    texts = spark.createDataFrame([(k, q) for k, (q, _) in asked.items()], "k int, q string")
    slang = entities.expand_slang(F.coalesce("q", F.lit("")), {"ads": ["高等博弈论"]}, ["高等博弈论"])
    found = entities.detect(texts, "k", "q", dialogue.has_intent(F.col("q"), ["怎么样", "好不好"]), people, "id", "name", "py", "init", teaches, "course", slang)
    assert {r["k"]: (r["name"], r["course"], r["candidates"]) for r in found.collect()} == {k: want for k, (_, want) in asked.items() if want}
    named = entities.by_prefix(texts, "k", "q", teaches, "course", slang=slang).where("k in (6, 7)")
    assert sorted(map(tuple, named.collect())) == [(6, "高等博弈论", True), (7, "博弈论", True)]


def test_usage_counts_fill_days(spark):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", 7, False), ("2024-01-01 11:00:00", 7, False), ("2024-01-03 09:00:00", None, True)], "t string, user_id int, bad boolean")
    out = usage.daily_counts(rows.withColumn("ts", F.col("t").cast("timestamp")), F.col("bad")).orderBy("day").collect()
    assert [(r["total"], r["uncovered"], r["dau"]) for r in out] == [(2, 0, 1), (0, 0, 0), (1, 1, 0)]


def test_null_feedback_is_not_negative(spark):
    rows = spark.createDataFrame([(1, None), (1, 0), (1, 1), (0, None)], "covered int, feedback int")
    assert rows.where(usage.is_uncovered("covered", "feedback")).count() == 2


def test_lockout_refuses_until_the_lock_ends(spark):
    tries = [(0, False), (1, False), (2, False), (3, True), (902, True), (903, False)]
    rows = spark.createDataFrame([("u", i, at, ok) for i, (at, ok) in enumerate(tries)], "user string, event_id long, at long, ok boolean")
    out = usage.lockouts(rows, "user", 3, 900).orderBy("event_id")
    assert [r["outcome"] for r in out.collect()] == ["failed", "failed", "locked", "refused", "passed", "failed"]


def test_lockouts_of_long_histories_and_nulls(spark):
    tries = [("a", i, 2 * i, False) for i in range(30_000)] + [(None, 90_000, 5, False), (None, 90_001, None, True), ("b", 90_002, 1, None)]
    rows = spark.createDataFrame(tries, "user string, event_id long, at long, ok boolean").repartition(7)
    out = {r["event_id"]: r["outcome"] for r in usage.lockouts(rows, "user", 5, 900).collect()}
    expected, failures, until = {}, 0, 0
    for _, i, at, _ in tries[:30_000]:
        if at < until:
            expected[i] = "refused"
        else:
            failures += 1
            expected[i] = "failed" if failures < 5 else "locked"
            failures, until = (0, at + 900) if failures == 5 else (failures, until)
    assert out == expected | {90_000: "failed", 90_001: "passed", 90_002: "failed"}


def test_fuzzy_matches_of_few_names(spark):
    known = ["linear algebra", "linear analysis", "organic chemistry", "physics", "abc", "abd"]
    texts = ["liner algebra", "organic chemistr", "abx", "zz", None, "", "nothing like it", "physics", "physics"]
    names = spark.createDataFrame([(n,) for n in [*known, "physics", None]], "n string")
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, asked string")
    found = {r["id"]: r["match"] for r in fuzzy.fuzzy_matches(rows, "id", "asked", names, "n", cutoff=0.6).collect()}
    assert found == {0: "linear algebra", 1: "organic chemistry", 2: "abd", 3: None, 4: None, 5: None, 6: None, 7: "physics", 8: "physics"}
    assert fuzzy.fuzzy_matches(rows, "id", "asked", names.limit(0), "n").where("match is not null").count() == 0


def test_places_run_through_all_ranges(spark):
    rows = spark.createDataFrame([(1, 4.5, 2), (2, 4.5, 3), (3, 9.0, 0), (4, 4.1, 1), (5, None, 0), (6, -2.5, 7), (7, 4.5, 3), (8, None, 2)], "id int, rating double, rating_count int")
    assert [r["id"] for r in ratings.rated_first(rows, "id").orderBy("place").collect()] == [2, 7, 1, 4, 6, 8, 3, 5]
    assert sorted(r["place"] for r in ratings.rated_first(rows, "id").collect()) == list(range(1, 9))


@pytest.mark.parametrize(("scores", "median"), [([0.1, 0.4, 0.2, 0.3], 0.3), ([0.5, 0.1, 0.9], 0.5), ([], None)])
def test_upper_median_of_first_scores(spark, scores, median):
    rankings = spark.createDataFrame([(q, "d", s, 1) for q, s in enumerate(scores)], "query_id int, id string, score double, pos int")
    questions = spark.createDataFrame([(q,) for q in range(5)], "query_id int")
    expected = spark.createDataFrame([(0, "d")], "query_id int, id string")
    assert retrieval.evaluate(rankings, expected, questions, "id").first()["upper_median"] == median


def test_publish_gate(spark):
    rows = spark.createDataFrame([(True, "verified"), (True, "needs_review"), (False, "rejected"), (None, "verified")], "valid boolean, s string")
    gate = lambda flag: rows.where(governance.publishable(F.col("valid"), F.col("s"), flag)).count()
    assert (gate(False), gate(True)) == (1, 2)


def test_a_bad_document_stops_the_load(spark):
    rows = spark.createDataFrame([([],), (["broken"],)], "errors array<string>")
    with pytest.raises(ValueError, match="broken"):
        governance.require_no_errors(rows, "errors")


def test_missing_fields_are_told_alone(spark):
    rows = spark.createDataFrame([(None, "x")], "title string, doc_id string")
    found = rows.select(governance.validation_errors(["title", "doc_id", "maintainer"], rows.columns).alias("e")).first()["e"]
    assert found == ["missing title", "missing maintainer"]


def test_incremental_index_equals_a_rebuild(spark, tmp_path):
    old = spark.createDataFrame([("a", "1", "a::0"), ("b", "1", "b::0"), ("b", "1", "b::1"), ("c", "1", "c::0")], "file string, digest string, id string")
    new = spark.createDataFrame([("a", "1", "a::0"), ("b", "2", "b::0"), ("d", "1", "d::0")], "file string, digest string, id string")
    states = index.diff(new.select("file", "digest").distinct(), old.select("file", "digest").distinct(), "file", "digest")
    assert {r["file"]: r["state"] for r in states.collect()} == {"a": "unchanged", "b": "updated", "c": "removed", "d": "new"}
    merged = index.merge(old, new, "file", "id", states)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, new.collect()))
    table = index.VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    assert (table.write(old), table.write(merged)) == (1, 2)
    assert table.read().count() == 3 and table.read(1).count() == 4


def test_labelled_fields_keep_the_first_value(spark):
    html = "<dt>Tel</dt><dd>1</dd><dt>Who</dt><dd>a|b</dd><dt>Tel</dt><dd>2</dd>"
    fields = pages.labelled_fields(F.lit(html), "<dt>.*?</dd>", "<dt>(.*?)</dt>", "<dd>(.*?)</dd>")
    row = spark.range(1).select(fields.alias("f"), pages.field_lines(fields, ["Who"]).alias("l")).first()
    assert row["f"] == {"Tel": "1", "Who": "a|b"} and row["l"] == ["Who: a\\|b", "Tel: 1"]


def test_rows_of_boxes(spark):
    boxes = F.array(*[F.struct(F.lit(float(p)).alias("position"), F.lit(10.0).alias("height")) for p in (0, 2, 20, 21, 60)])
    assert spark.range(1).select(pages.gap_rows(boxes).alias("r")).first()["r"] == [0, 0, 1, 1, 2]


def test_courses_are_found_at_any_place(spark):
    names = ["数据结构基础", "C++", "C++ primer", "red rose", "高数", "organic chemistry"]
    asked = {
        1: ("请问数据结构基础怎么样", {("数据结构基础", True)}),
        2: ("这门数据结构好吗", {("数据结构基础", False)}),
        3: ("is C++ hard", {("C++", True)}),
        4: ("a red tulip", {("red rose", False)}),
        5: ("想学高数和red rose", {("高数", True), ("red rose", True)}),
        6: ("inorganics please", {("organic chemistry", False)}),
        7: ("what is for lunch", set()),
    }
    questions = spark.createDataFrame([(k, q) for k, (q, _) in asked.items()], "id long, q string")
    courses = spark.createDataFrame([(n,) for n in names], "c string")
    out = {k: set() for k in asked}
    for r in entities.by_prefix(questions, "id", "q", courses, "c").collect():
        out[r["id"]].add((r["course"], r["exact"]))
    assert out == {k: want for k, (_, want) in asked.items()}


def test_intents_are_found_inside_runs_of_letters(spark):
    texts = spark.createDataFrame([("这门课怎么样",), ("怎么样?",), ("这门课",), (None,)], "t string")
    intent = dialogue.has_intent(texts["t"], ["怎么样", "推荐"])
    assert [r[0] for r in texts.select(intent).collect()] == [True, True, False, False]


def test_slang_is_taken_longest_first_and_then_by_place(spark):
    slang, known = {"ds": ["A"], "ads": ["B", "C"], "fds": ["D", "gone"], "os": ["E"]}, ["A", "B", "C", "D", "E"]
    texts = spark.createDataFrame([("fds ads ds",), ("os ds",), ("nothing",), ("adsads",)], "t string")
    out = [r[0] for r in texts.select(entities.expand_slang(F.col("t"), slang, known)).collect()]
    assert out == [["D", "B", "C", "A"], ["E", "A"], [], ["B", "C", "B", "C"]]


def test_people_in_texts(spark):
    people = spark.createDataFrame([(1, "李明", "liming", "lm"), (2, "李明华", "liminghua", "lmh"), (3, "王芳", "wangfang", "wf"), (4, "李雷", "lilei", "ll"), (5, "王芳", "wangfang", "wf")], "id int, name string, py string, init string")
    asked = {1: "李明华怎么样", 2: "李老师好吗", 3: "liming ok?", 4: "wf的课", 5: "wf的课 ads", 6: "王芳", 7: "无"}
    texts = spark.createDataFrame(list(asked.items()), "k int, t string")
    out = {}
    for r in entities.match_in_text(texts, "k", "t", people, "id", "name", "py", "init", ~F.col("t").contains("ads")).collect():
        out.setdefault(r["k"], set()).add((r["id"], r["step"]))
    assert out == {1: {(2, "name")}, 2: {(1, "surname"), (2, "surname"), (4, "surname")}, 3: {(1, "py")}, 4: {(3, "init"), (5, "init")}, 6: {(3, "name"), (5, "name")}}


def test_the_chain_ends_with_the_closest_names(spark):
    names = spark.createDataFrame([(n, i) for i, n in enumerate(["anderson", "andersen", "andersson", "peters", "zu"])], "term string, id long")
    asked = spark.createDataFrame([(1, "peters"), (2, "andersonn"), (3, "qqqqqq"), (4, "zx"), (5, None)], "k int, q string")
    out = sorted(map(tuple, entities.resolve(asked, "k", [("name", "q", names)], ("q", names), top=2).collect()), key=repr)
    assert out == [(1, 3, "name"), (2, 0, "fuzzy"), (2, 2, "fuzzy"), (3, None, "none"), (4, None, "none"), (5, None, "none")]


@pytest.mark.parametrize("cutoff", [0.5, 0.7, 0.9])
def test_the_letter_filter_loses_no_pair(spark, cutoff):
    import difflib

    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("aabbcdefgé课😀") for _ in range(n))
    names = {make(rng.randrange(1, 14)) for _ in range(90)}
    asked = {make(rng.randrange(3, 14)) for _ in range(60)} | {n[1:] + "x" for n in list(names)[:20] if len(n) > 4}
    found = {(r["asked"], r["name"]) for r in fuzzy.candidates(spark.createDataFrame([(x,) for x in asked], "asked string"), spark.createDataFrame([(x,) for x in names], "name string"), cutoff).collect()}
    close = {(a, n) for a in asked for n in names if difflib.SequenceMatcher(None, n, a).ratio() >= cutoff}
    quick = {(a, n) for a in asked for n in names if difflib.SequenceMatcher(None, n, a).quick_ratio() >= cutoff}
    assert close <= found and len(close) >= 5
    assert {p for p in found if "😀" not in "".join(p)} == {p for p in quick if "😀" not in "".join(p)}
    assert len(found) < {0.5: 0.7, 0.7: 0.3, 0.9: 0.03}[cutoff] * len(asked) * len(names)


def test_fuzzy_matches_of_a_whole_table(spark):
    import difflib

    rng = random.Random(8)
    names = ["".join(rng.choice("abcde") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    asked = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(80)] + [None]
    table = spark.createDataFrame(list(enumerate(asked)), "k int, q string")
    found = fuzzy.fuzzy_matches(table, "k", "q", spark.createDataFrame([(n,) for n in names], "n string"), "n")
    want = {}
    for k, q in enumerate(asked):
        near = [(difflib.SequenceMatcher(None, n, q).ratio(), n) for n in set(names)] if q and len(q) >= 3 else []
        want[k] = (max(near)[1], round(max(near)[0], 6)) if near and max(near)[0] >= 0.7 else (None, None)
    assert {r["k"]: (r["match"], r["ratio"]) for r in found.collect()} == want


def test_a_stream_goes_on_and_rewrites_what_it_touches(spark, tmp_path):
    table = index.BucketedTable(spark, str(tmp_path / "t"), "k", 8)
    assert table.read() is None

    def arrive(rows):
        spark.createDataFrame(rows, "k long, v string, seq int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        index.upsert_stream(spark.readStream.schema("k long, v string, seq int").parquet(str(tmp_path / "in")), table, "seq", str(tmp_path / "state"))
        return table.paths(), {r["k"]: r["v"] for r in table.read().collect()}

    first, rows = arrive([(k, "a", k) for k in range(40)] + [(3, "late", 99)])
    assert rows == {k: "late" if k == 3 else "a" for k in range(40)}
    second, rows = arrive([(5, "b", 0), (100, "new", 1)])
    assert rows == {**{k: "a" for k in range(40)}, 3: "late", 5: "b", 100: "new"}
    assert 1 <= sum(first.get(b) != path for b, path in second.items()) <= 2
    again, rows_again = arrive([])
    assert again == second and rows_again == rows


def test_a_change_stream_replaces_and_removes_whole_groups(spark, tmp_path):
    schema = "file string, n int, text string, seq int, gone boolean"
    table = index.BucketedTable(spark, str(tmp_path / "t"), "file", 4)

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        index.change_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table, "seq", "gone", str(tmp_path / "state"))
        held = table.read()
        return [] if held is None else sorted(map(tuple, held.select("file", "n", "text").collect()))

    chunks = lambda file, texts, seq: [(file, i, t, seq, False) for i, t in enumerate(texts)]
    gone = lambda file, seq: (file, None, None, seq, True)
    held = arrive([*chunks("a", "xyz", 1), *chunks("b", "pq", 1), *chunks("c", "k", 1), *chunks("d", "old", 1), *chunks("d", "n", 2), gone("e", 1)])
    assert held == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 0, "p"), ("b", 1, "q"), ("c", 0, "k"), ("d", 0, "n")]
    held = arrive([*chunks("a", "w", 3), gone("b", 3), *chunks("c", "m", 3), gone("c", 4), *chunks("e", "new", 3)])
    assert held == [("a", 0, "w"), ("d", 0, "n"), ("e", 0, "n"), ("e", 1, "e"), ("e", 2, "w")]
    before = table.names.versions()
    again = spark.createDataFrame(chunks("a", "again", 9), schema).drop("seq", "gone")
    assert not table.apply(again, None, 1) and table.names.versions() == before
    assert arrive([gone(f, 5) for f in "ade"]) == [] and table.paths() == {}
    assert arrive(chunks("b", "r", 6)) == [("b", 0, "r")]
    assert table.clean() == 0 and table.clean(0) > 4 and sorted(map(tuple, table.read().collect())) == [("b", 0, "r")]
    assert arrive(chunks("b", "s", 7)) == [("b", 0, "s")]


def test_scores_do_not_depend_on_how_common_terms_are_looked_up(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [" ".join(rng.choice(vocabulary[: 1 + int(rng.paretovariate(0.5))] or vocabulary) for _ in range(rng.randrange(1, 40))) for _ in range(150)] + ["选课系统怎么用", None, ""]
    asked = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 12))) for _ in range(25)] + ["选课", ""]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, question string")
    for tokenize in (text.tokens, text.cjk_bigrams):
        terms = retrieval.term_table(table, "doc_id", "text", tokenize)
        n, mean = retrieval.corpus_size(table, "text", tokenize)
        found = [sorted(map(tuple, retrieval.bm25(queries, terms, "doc_id", n, mean, 5, tokenize, common).collect())) for common in (0.0, 0.02, 0.2, 1.0)]
        assert found[0] == found[1] == found[2] == found[3]
        held = {(r[0], r[1]) for r in found[0]}
        assert ((25, 150) in held) == (tokenize is text.cjk_bigrams)


def test_the_index_follows_its_files(spark, tmp_path):
    from quillspark.plans import retrieval as plans

    folder = str(tmp_path)
    docs = [(i, f"w{i % 7} common {'x ' * (i % 3)}", f"s{i % 2}") for i in range(40)]
    spark.createDataFrame([(i, f"w{i} common") for i in range(7)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    def put(rows):
        spark.createDataFrame(rows, "doc_id long, text string, source string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        n, mean = retrieval.corpus_size(plans.passages(spark, folder), "text")
        terms = retrieval.term_table(plans.passages(spark, folder), "doc_id", "text")
        want = retrieval.bm25(plans.questions(spark, folder), terms, "doc_id", n, mean)
        found = plans.bm25_topk(spark, folder)
        assert sorted((r["query_id"], r["doc_id"], r["pos"]) for r in found.collect()) == sorted((r["query_id"], r["doc_id"], r["pos"]) for r in want.collect())
        return {r["doc_id"] for r in found.collect()}

    assert put(docs) == set(range(40))
    assert put([*docs[::2], (100, "", "s")]) == set(range(0, 40, 2))


def test_hash_embedding_of_a_whole_table(spark):
    from hashlib import blake2b

    texts = ["The quick brown fox", "", None, "a", "fox fox 狐狸"]
    for t, v in zip(texts, (r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(hash_embedder(F.col("t"))).collect()), strict=True):
        want = [0.0] * 384
        for w in re.findall(r"\w+", (t or "").lower()):
            for f in [w, *(w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1))]:
                h = int.from_bytes(blake2b(f.encode(), digest_size=8).digest(), "little")
                want[h % 384] += -1.0 if h >> 63 else 1.0
        size = sum(x * x for x in want) ** 0.5
        assert v == pytest.approx([x / size if size else 0.0 for x in want])


def test_list_pages_of_a_service_site(spark):
    faq = """约有 <span> 31</span> 项<em>问</em> <div class="ts">Lost <b>card</b>?</div><h4 id="7_x" docNo='7' class="da_high_content">
      <div class="expand-btn" onclick="f(7)">展开</div> Go to the <font color='red'>desk</font>. <div class="close-btn">收起</div></h4>
      <tr><td><b>咨询电话:</b></td><td>111</td></tr><tr><td><b>科 室:</b></td><td>Cards &amp; keys</td></tr>
      <em>问</em><div class="ts"> </div><em>问</em><div class="ts">Open when?</div>"""
    guide = """<div class="T3" id="data_Z1">Leave early 点击详情</div><td><b>受理时间:</b>May</td><td><b>咨询电话:</b>222 </td><td><b>受理机构：</b>Office</td>
      <div id="data_A22">Come back</div><td><b>受理时间:</b>June</td>"""
    norm = """<a href="x" id="norm_file_9" title="Rules T">Rules <i>A</i></a><b>【发文号】</b>No. 1
      | <b>【施行日期】</b>2026-07-10 | rest <a id="norm_file_10" title="Named"> </a> <b>【发文号】</b>No. 2 | <b>【施行日期】</b>2025-01-02 |"""
    info = """<a href="http://a.b/c" dataSource = "w">News <font color='red'>now</font></a><div class="limit-lines3">Short.</div><h3>发布时间： 2025-10-29 | 信息来源： Desk </h3>
      <a href="/local" dataSource="w">Not a link</a><div class="limit-lines3">x</div>发布时间： 2025-10-30 | 信息来源： Other<"""
    table = spark.createDataFrame([(1, faq), (2, guide), (3, norm), (4, info), (5, ""), (6, None)], "k int, h string")
    rows = lambda df: [tuple(r)[2:] for r in df.orderBy("k", "n").collect()]
    assert rows(pages.faq_items(table, "k", "h")) == [("7", "Lost card?", "Go to the desk.", "111", "", "Cards & keys"), ("", "Open when?", "", "", "", "")]
    # The first entry has no phone of its own kind after it but its own, the second takes none from before.
    assert rows(pages.guide_items(table, "k", "h")) == [("Leave early", {"受理时间": "May", "咨询电话": "222", "受理机构": "Office"}, "222"), ("Come back", {"受理时间": "June"}, "")]
    assert rows(pages.norm_items(table, "k", "h", "http://s"))[0] == ("9", "Rules A", "No. 1", "2026-07-10", "http://s/search/normFileView.do?docNo=9", "http://s/tool/downNormFile.do?docNo=9")
    assert [r[1] for r in rows(pages.norm_items(table, "k", "h", ""))] == ["Rules A", "Named"]
    assert rows(pages.info_items(table, "k", "h")) == [("News now", "http://a.b/c", "Short.", "2025-10-29", "Desk")]
    assert [r[0] for r in table.orderBy("k").select(pages.total_hits(F.col("h"))).collect()] == [31, 0, 0, 0, 0, 0]
    detail = spark.createDataFrame([("<li><span >【拟文部门】</span>Office</li><li><span>【时效性】</span>in force</li>",)], "h string")
    assert detail.select(pages.norm_detail(F.col("h"))).first()[0] == {"拟文部门": "Office", "时效性": "in force"}


def test_chunk_records_carry_metadata(spark):
    docs = spark.createDataFrame([("a.md", "## H\nbody", "T", "FAQ", ["x", "y" * 98, "z"], 2, None)], "file string, body string, title string, category string, tags array<string>, schema_version int, checked string")
    r = chunking.chunk_records(docs, "file", "body", "title", "category", F.col("tags"), ["schema_version", "tags", "checked", "file"]).first()
    assert r["id"] == "a.md::0" and r["text"] == "标题：T\n分类：FAQ\n检索标签：x\n\n## H\nbody"
    assert (r["schema_version"], r["tags"], r["checked"], r["file"]) == (2, "x、" + "y" * 98 + "、z", "", "a.md")


def test_titles_and_headings(spark):
    row = spark.createDataFrame([("x" * 130, "intro\n## First [a](b) <i>c</i> #\n# Second", "no heading", None)], "t string, m string, n string, z string")
    heads = [text.first_heading(F.col(c), F.lit("none")) for c in "mnz"]
    assert tuple(row.select(text.short_title(F.col("t")), *heads).first()) == ("x" * 119 + "…", "First a c", "none", "none")
