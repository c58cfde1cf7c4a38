"""Queries on rows that the test tables hold too rarely to tell a difference, against their SQL."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_oracles import norm

from quillspark.plans.registry import ORACLES, QUERIES


def both(spark, folder, name, **tables):
    """A query's rows and its SQL's, over the tables given as columns."""
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    found = sorted(([norm(r[c]) for c in columns] for r in df.collect()), key=repr)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    return found, sorted(([norm(dict(zip(names, r, strict=True))[c]) for c in columns] for r in cursor.fetchall()), key=repr)


def events(rows):
    """Events (event_id, microseconds, event_type, value) of one user."""
    start = datetime.datetime(2024, 1, 1)
    ids, at, kinds, values = zip(*rows, strict=True)
    times = pa.array([start + datetime.timedelta(microseconds=m) for m in at], pa.timestamp("us"))
    return {"event_id": list(ids), "ts": times, "user_id": [1] * len(ids), "event_type": list(kinds), "value": list(values)}


SECOND = 1_000_000


@pytest.mark.parametrize("name", ["code_lifetimes", "stream_code_lifetimes"])
def test_codes_by_the_nearest_second(spark, tmp_path, name):
    # In the order of whole seconds the wrong try at 9.9 would come before the code of the second it is nearest to.
    rows = [(1, 10 * SECOND, "signup", 1.0), (2, 9 * SECOND + 900_000, "error", 1.0), (3, 21609 * SECOND + 700_000, "signup", 2.0)]
    found, expected = both(spark, tmp_path, name, events=events(rows))
    assert found == expected and [r[1] for r in found] == ["sent", "accepted", "sent"]


@pytest.mark.parametrize("name", ["lockout_fold", "stream_lockouts"])
def test_locks_by_the_nearest_second(spark, tmp_path, name):
    # The third failure locks from the second it is nearest to, so the purchase an hour behind it still is refused.
    rows = [(1, 0, "error", 1.0), (2, 10 * SECOND, "error", 1.0), (3, 20 * SECOND + 600_000, "error", 1.0), (4, 3620 * SECOND + 400_000, "purchase", 1.0), (5, 3621 * SECOND, "purchase", 1.0)]
    found, expected = both(spark, tmp_path, name, events=events(rows))
    assert found == expected and [r[1] for r in found] == ["failed", "failed", "locked", "refused", "passed"]


@pytest.mark.parametrize("name", ["gap_sessions"])
def test_sessions_by_the_nearest_second(spark, tmp_path, name):
    rows = [(1, 0, "view", 1.0), (2, 21600 * SECOND + 500_001, "view", 1.0), (3, 43201 * SECOND + 400_000, "view", 1.0), (4, 64801 * SECOND + 500_000, "view", 1.0)]
    found, expected = both(spark, tmp_path, name, events=events(rows))
    assert found == expected and len(found) == 3


def test_dates_of_links_behind_other_numbers(spark, tmp_path):
    pages = {"page_id": [620, 621, 13], "url": ["https://a.example/de/8036", "https://a.example/8036/1399", "https://a.example/de/2024"], "html": ["", "", ""]}
    found, expected = both(spark, tmp_path, "page_urls", pages=pages)
    assert found == expected and "2024-04-26" in found[0] + found[1] + found[2]


@pytest.mark.parametrize("name", ["page_markdown", "page_lines"])
def test_references_without_a_semicolon_stay(spark, tmp_path, name):
    html = '<html><body><h1>a &amp; b&amp</h1><p>x &lt y &lt; &ampz; &quot</p></body></html>'
    found, expected = both(spark, tmp_path, name, pages={"page_id": [1], "url": ["https://a.example/x"], "html": [html]})
    assert found == expected


def test_only_weak_questions_meet_the_documents(spark):
    from quillspark.operators import retrieval
    from quillspark.plans import retrieval as plans

    folder = "/root/testdata/sf0.001"
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, question string")
    hits = spark.createDataFrame([(1, 0.2), (1, 0.29), (2, 0.1), (2, 0.3)], "query_id long, score double")
    assert sorted(map(tuple, retrieval.weak_queries(hits, queries, 0.3).collect())) == [(1, "a"), (3, "c")]
    every = plans.questions(spark, folder)
    one = every.orderBy("query_id").limit(1)
    found = plans._by_length(spark, folder, asked=one).collect()
    assert found and {r["query_id"] for r in found} == {one.first()["query_id"]}


@pytest.mark.parametrize(("block", "again"), [(8192, []), (7, []), (8192, [(3, "w1 w2"), (4, "w1")])])
def test_scores_without_an_index_are_those_with_one(spark, tmp_path, block, again):
    import random

    from quillspark.operators import retrieval

    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words[: 1 + int(rng.paretovariate(0.5))]) for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    rows = [*enumerate([*texts, *[texts[3]] * 60, None, "", "狐 狸"]), *again]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    asked = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(25)] + [texts[3], "狐", "none", ""]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, question string")
    index = retrieval.write_index(docs, "doc_id", "text", str(tmp_path))
    want = sorted(map(tuple, retrieval.bm25(queries, index, "doc_id", n=5).collect()))
    found = sorted(map(tuple, retrieval.scan_bm25(queries, docs, "doc_id", "text", 5, block=block).collect()))
    assert found == want and len(found) > 100


@pytest.mark.parametrize("most", [1, 300, 10**6])
def test_best_scores_in_pieces_of_any_size(most):
    import numpy as np

    from quillspark.operators import retrieval

    rng = np.random.default_rng(2)
    words = [[f"w{i}" for i in rng.integers(0, 30, rng.integers(0, 20))] for _ in range(90)]
    words += [words[1]] * 30
    keys = rng.permutation(120).tolist()
    batches = [pa.RecordBatch.from_pydict({"key": keys[at : at + 50], "length": [len(w) for w in words[at : at + 50]], "words": pa.array(words[at : at + 50], pa.list_(pa.string()))}) for at in range(0, 120, 50)]
    rows = sorted({(f"w{t}", q) for t, q in rng.integers(0, 20, (90, 2)).tolist()})
    wanted = pa.table({"query_id": [q for _, q in rows], "term": [t for t, _ in rows], "weight": rng.normal(1, 1, len(rows))})
    weight = {(t, q): w for (t, q), w in zip(rows, wanted.column("weight").to_pylist(), strict=True)}
    mean = sum(map(len, words)) / 120
    score = lambda q, w: round(sum(weight[t, q] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in set(w) if (t, q) in weight), 9)
    best = lambda hits: sorted(hits, key=lambda h: (-h[1], h[0]))[:6]
    out = [(r["query_id"], r["key"], round(r["score"], 9)) for b in retrieval._best_scores(iter(batches), "key", *retrieval._weights(wanted), mean, 6, most) for r in b.to_pylist()]
    for q in {q for _, q in rows}:
        assert best([h[1:] for h in out if h[0] == q]) == best([(k, s) for k, w in zip(keys, words, strict=True) if (s := score(q, w)) > 0])


def test_word_channel_shuffles_no_texts_or_postings(spark):
    from quillspark.operators import retrieval
    from quillspark.plans import retrieval as plans

    folder = "/root/testdata/sf0.001"
    plan = retrieval.scan_bm25(plans.questions(spark, folder), plans.passages(spark, folder), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("MapInArrow")
    for name in ("hybrid_plain", "hybrid_search", "expanded_hybrid"):
        joins = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in joins and "SortMergeJoin" not in joins


def test_a_start_stands_for_its_names(spark):
    from quillspark.operators import entities

    kept = []

    def keep(df):
        kept.append(df)
        return df

    courses = spark.createDataFrame([(f"data {i:02d}",) for i in range(20)] + [(f"many {i:02d}",) for i in range(21)] + [("Bolt",), ("bolt",), ("cut",), ("",), (None,)], "c string")
    asked = spark.createDataFrame([(1, "of data"), (1, "of data"), (2, "too many"), (3, "a BOLT of data"), (4, "data 07 and cut"), (5, None), (6, "sl"), (7, "bol")], "k int, q string")
    slang = entities.expand_slang(F.coalesce("q", F.lit("")), {"sl": ["data 01", "none"]}, ["data 01", "none"])
    out = entities.by_prefix(asked, "k", "q", courses, "c", slang=slang, keep=keep)
    assert sorted(map(tuple, out.collect())) == [(1, "data 00", False), (3, "Bolt", True), (3, "bolt", True), (4, "cut", True), (4, "data 07", True), (6, "data 01", True)]
    forms = {r["name"]: (r["n"], r["best"] and r["best"]["course"]) for r in kept[0].collect()}
    assert forms["data"] == (20, "data 00") and forms["many"] == (21, "many 00") and len(forms) == 20 + 21 + 5


@pytest.mark.parametrize("name", ["courses_asked", "prefix_course_match"])
def test_hits_are_not_dealt_out_by_the_few_names(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == plan.count("BroadcastHashJoin") > 0 and "Window" not in plan


@pytest.mark.parametrize("limits", [{}, {"most_lengths": 0}, {"part_chars": 100}, {"part_chars": 3}, {"part_chars": 300, "most_lengths": 2}])
def test_many_names_of_few_starts(spark, limits):
    from quillspark.operators import containment

    names = [f"Supplier#{i:05d}" for i in range(60)] + [f"q{i}z" for i in range(0, 120, 3)] + ["q", "课é", "课é𝄞x", "lier#0000"]
    rows = [(1, "q12z or Supplier#00012q"), (2, "Supplier#000"), (3, "a 课é𝄞x课é q3zq3z"), (4, None), (5, ""), (6, "Supplier#00059")]
    texts = spark.createDataFrame(rows, "id int, t string")
    for longest in ((), ("t",)):
        found = containment.names_in_texts(texts, "id", {"t": spark.createDataFrame([(n,) for n in names], "n string")}, longest, **{"part_chars": 200} | limits)
        want = [(i, "t", n) for i, t in rows for n in names if t and n in t]
        if longest:
            want = [(i, "t", min((n for j, _, n in want if j == i), key=lambda n: (-len(n), n))) for i in sorted({w[0] for w in want})]
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_texts_are_read_once_for_many_names(spark):
    from quillspark.operators import containment

    texts = spark.createDataFrame([(1, "Supplier#00012")], "id int, t string")
    names = spark.range(2000).select(F.format_string("Supplier#%05d", "id").alias("n"))
    plan = containment.names_in_texts(texts, "id", {"t": names}, part_chars=1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Supplier" in containment._starts(names.select(F.lit("t").alias("field"), F.col("n").alias("name")), 1000, 32)["t"].popitem()[0]


def test_courses_held_are_looked_up_among_those_of_candidates(spark):
    from quillspark.operators import entities

    teaches = spark.range(3000).select(F.col("id").cast("int").alias("t"), F.lit("algebra").alias("c")).union(spark.createDataFrame([(1, "topology"), (2, "top"), (2, "top")], "t int, c string"))
    texts = spark.createDataFrame([(1, "topology by 2"), (2, "topology by 5"), (3, "nothing")], "k int, q string")
    candidates = spark.createDataFrame([(1, 2, "name"), (1, 2, "pinyin"), (2, 5, "name"), (3, 1, "name")], "k int, t int, step string")
    found = entities.course_in_text(texts, "k", "q", candidates, teaches, "t", "c")
    assert sorted(map(tuple, found.collect())) == [(1, "top", True), (2, "topology", False)]
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert len(joins) == 2 and all("LeftOuter" in j for j in joins)
