"""The corpus pipeline, stage by stage and as a whole against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_llm_operators import PROSE, brute_components, brute_contamination, brute_shards, slow_fingerprint

import corpus_pipeline
from quillspark.llm import langid
from quillspark.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    assert counts[1] > 0.95 * counts[0]


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    items = [(f"i{n}", " ".join(rng.choice(PROSE["en"]) for _ in range(20))) for n in range(3)]
    data = []
    for i in range(400):
        lang = rng.choice(list(PROSE))
        text = " ".join(rng.choice(PROSE[lang]) for _ in range(rng.randrange(20, 70)))
        data.append((i, text, lang, rng.choice(["s0", "s0", "s1"]), 0))
    data += [(500 + n, data[n][1], data[n][2], "s0", 0) for n in range(25)]  # copies
    data += [(600 + n, data[40 + n][1] + " " + items[n % 3][1], data[40 + n][2], "s1", 0) for n in range(8)]  # passages
    data += [(700, None, "en", "s0", 0), (701, "", "en", "s0", 0), (702, "12 34 !!", "fr", "s0", 0), (703, data[0][1], "en", None, 0), data[5], (None, data[6][1] + " x", "en", "s1", 0)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # Language: the rule of test_languages, over dictionaries of the learned rows.
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    identify = langid.identifier(langid.learn_dictionaries(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")))
    told = lambda t: (x := identify(t))[0] != "und" and x[1] >= 0.005
    left = [r for r in data if told(r[1])]
    # Near-duplicates: the smallest id of each component stays, rows without one only if alone.
    prints = [slow_fingerprint(r[1]) for r in left]
    parts = {}
    for r, c in zip(left, brute_components(range(len(left)), prints), strict=True):
        parts.setdefault(c, []).append(r)
    left = [min(part, key=lambda r: (r[0] is None, r[0] or 0)) for part in parts.values()]
    left = [r for r in left if not brute_contamination(r[1], items)[4]]
    # Copies at the hash of the id.
    n = Counter(r[3] for r in left)
    weight = {s: math.sqrt(c) for s, c in n.items()}
    mixed = []
    for r in left:
        rate = len(left) * weight[r[3]] / sum(weight.values()) / n[r[3]]
        u = int(hashlib.md5(f"8:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        cdf = p
        while cdf <= u:
            k += 1
            p *= rate / k
            cdf += p
        mixed += [r] * k
    assert 300 < len(mixed) < 500
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows_of = lambda found: Counter(r[:3] for r in found)
    assert rows_of(map(tuple, ((r["doc_id"], r["size"], r["text_crc32"]) for r in out))) == rows_of((r[0], len(r[1].encode()) + 8, zlib.crc32(r[1].encode())) for r in mixed)
    want = brute_shards([r[1] for r in mixed], [r[0] for r in mixed], 24, 4096)
    # No text has more copies than a shard has room for; copies of one row may change places within their shard.
    assert max(Counter(r[1] for r in mixed).values()) <= 8
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in out) == sum((Counter({k[:4]: n}) for k, n in want.items()), Counter())
    assert Counter((r["shard"], r["slot"]) for r in out) == sum((Counter({k[3:]: n}) for k, n in want.items()), Counter())


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_awkward_tables(spark, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(30)
    assert stage(spark, docs.limit(0), DATA).count() == 0
    same = docs.limit(1)
    nulls = docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars")).limit(2)
    more = docs.union(same).union(same).union(nulls)
    for c in ("copy", "mix_key", "_found", "_gone", "_bad", "found", "hash", "id", "_draw", "of_source", "digest", "piece"):
        more = more.withColumn(c, F.lit(c))
    out = stage(spark, more, DATA)
    assert out.count() > 0 and (out.columns == more.columns or "shard" in out.columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    found = [r.asDict() for r in QUERIES[name](spark, DATA).collect()]
    plain = lambda rows: sorted(repr(sorted((k, round(v, 5) if isinstance(v, float) else v) for k, v in r.items())) for r in rows)
    assert plain(found) == plain(want)
