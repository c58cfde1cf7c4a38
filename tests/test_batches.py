"""Batches for a model, table functions and counts taken by writes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import table_functions
from quillspark.functions.markup import markdown
from quillspark.operators import batches
from quillspark.sources.sinks import counted_write


def rows(rng):
    out = [("hot", i, "h" * rng.randrange(0, 300)) for i in range(900)] + [(f"k{i % 40}", 1000 + i, "x" * rng.choice([0, 1, 90, 200])) for i in range(300)]
    return [*out, (None, 5000, None), (None, 5001, "a\nb"), ("lone", 5002, "")]


@pytest.mark.parametrize("part_chars", [10_000, 10_000_000])
def test_no_batch_is_over_its_budget(spark, part_chars):
    data = rows(random.Random(1))
    df = spark.createDataFrame(data, "key string, id long, text string")
    made = batches.batches(df, "key", "id", "text", 1000, 12, 100, part_chars).collect()
    assert sorted(i for b in made for i in b["ids"]) == sorted(i for _, i, _ in data)
    known = {i: (k, (t or "")[:100]) for k, i, t in data}
    for b in made:
        assert len(b["ids"]) <= 12 and sum(map(len, b["excerpts"])) <= 1000
        assert [known[i] for i in b["ids"]] == [(b["key"], x) for x in b["excerpts"]]
    assert (len({b["part"] for b in made if b["key"] == "hot"}) > 4) == (part_chars == 10_000)
    # As many batches as it takes, and not many more: neighbours of one window hold over max_rows rows together.
    size = sum(len((t or "")[:100]) for k, _, t in data if k == "hot")
    assert len([b for b in made if b["key"] == "hot"]) <= 2 + 900 / 12 + 2 * size / 900 + len({b["part"] for b in made})
    with pytest.raises(ValueError, match="excerpt"):
        batches.batches(df, "key", "id", "text", 100, 1, 90)


def test_answers_come_back_by_id(spark):
    df = spark.createDataFrame([("a", i, f"text {i}\nmore") for i in range(8)] + [("b", 20, "fails"), ("c", 30, "prose")], "key string, id long, text string")

    def model(prompts):
        out = []
        for p in prompts:
            ids = [int(x.split("]")[0]) for x in p.split("- [")[1:]]
            if 20 in ids:
                out.append("[{broken")
            elif 30 in ids:
                out.append("I cannot say.")
            else:
                assert p.startswith("Judge:\n- [") and "\nmore" not in p
                out.append("Sure: " + json.dumps([{"id": i, "keep": i % 2 == 0} for i in ids] + [{"id": ids[0], "keep": "later"}, {"id": 999, "keep": True}, {"keep": False}]) + " done")
        return out

    made = batches.batches(df, "key", "id", "text", 400, 3, 50)
    found = {r["id"]: json.loads(r["answer"])["keep"] for r in batches.asked(made, "id", "Judge:", model).collect()}
    assert found == {i: "true" if i % 2 == 0 else "false" for i in range(8)}

    def down(prompts):
        raise RuntimeError("no model")

    assert batches.asked(made, "id", "Judge:", down).count() == 0


def test_table_functions(spark):
    table_functions.register(spark)
    pages = ["<h1>t</h1><p>a<br>b<ul><li>x</ul><table><tr><td>c</table><hr>", None, "", "<p>one"]
    spark.createDataFrame(list(enumerate(pages)), "id int, html string").createOrReplaceTempView("some_pages")
    found = [tuple(r) for r in spark.sql("SELECT id, l.* FROM some_pages, LATERAL markdown_lines(html, 'http://s/') l ORDER BY id, n").collect()]
    lines = markdown(pages[0], "http://s/").split("\n")
    assert [r[3] for r in found if r[0] == 0] == lines
    assert [r[2] for r in found if r[0] == 0] == ["heading", "text", "text", "item", "table", "table", "rule"]
    assert [r for r in found if r[0]] == [(3, 0, "text", "one")]
    text = "一句话。第二句！" * 9 + "x" * 70
    spark.createDataFrame([(1, text), (2, None)], "id int, t string").createOrReplaceTempView("some_texts")
    pieces = spark.sql("SELECT id, p.* FROM some_texts, LATERAL cut_paragraph(t, 30) p ORDER BY n").collect()
    assert "".join(r["piece"] for r in pieces) == text and all(len(r["piece"]) <= 30 and text[r["start"] :].startswith(r["piece"]) for r in pieces)
    assert pieces[0]["piece"].endswith(("。", "！"))
    for bad in ("cut_paragraph(t, 0)", "cut_paragraph(t, id)", "markdown_lines(id, t)"):
        with pytest.raises(Exception, match="has to be"):
            spark.sql(f"SELECT * FROM some_texts, LATERAL {bad}").collect()


def test_counts_come_from_the_write(spark, tmp_path):
    scans = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(i):
        scans.add(1)
        return i

    df = spark.range(100).select(seen("id").alias("i"))
    counts = counted_write(df, lambda d: d.write.parquet(str(tmp_path / "t")), n=F.count("*"), even=F.count_if(F.col("i") % 2 == 0), most=F.max("i"))
    assert counts == {"n": 100, "even": 50, "most": 99} and scans.value == 100
    assert spark.read.parquet(str(tmp_path / "t")).count() == 100
