import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import files, sinks


def test_markdown_with_front_matter(spark, tmp_path):
    (tmp_path / "FAQ").mkdir()
    (tmp_path / "notes").mkdir()
    (tmp_path / "FAQ/a.md").write_text("---\ntitle: A 题\ntags: [x, y]\nvalid: true\n---\nbody\n---\nmore\n", encoding="utf-8-sig")
    (tmp_path / "FAQ/b.md").write_text("---\ntitle: [broken\n---\nbody\n")
    (tmp_path / "FAQ/c.md").write_bytes(b"\xff\xfe bad")
    (tmp_path / "notes/d.md").write_text("no block")
    found = files.markdown_files(spark, str(tmp_path))
    assert sorted(r["path"] for r in files.published(found).collect()) == ["FAQ/a.md", "FAQ/b.md", "FAQ/c.md"]
    assert files.ignored_count(found).first()["ignored"] == 1
    rows = {r["path"]: r for r in files.front_matter(found).collect()}
    assert rows["FAQ/a.md"]["meta"] == {"title": "A 题", "tags": "[x, y]", "valid": "true"} and rows["FAQ/a.md"]["body"] == "body\n---\nmore\n"
    assert "front matter" in rows["FAQ/b.md"]["error"] and rows["FAQ/c.md"]["error"] == "not UTF-8"
    assert rows["notes/d.md"]["meta"] == {} and rows["notes/d.md"]["body"] == "no block"
    tags = files.front_matter(found).where("path = 'FAQ/a.md'").select(files.flow_list(F.col("meta")["tags"]).alias("t")).first()["t"]
    assert tags == ["x", "y"]


def test_rating_files(spark, tmp_path):
    (tmp_path / "teachers.csv").write_text("id,name,hot\n1,A,\n2,B,7\n")
    assert [r["hot"] for r in files.header_csv(spark, str(tmp_path / "teachers.csv"), ["hot"]).collect()] == [0.0, 7.0]
    (tmp_path / "comment_Physics.csv").write_text("id,teacher,x,time,net,up,down,content\n5,1,,2020-01-01 00:00:00,3,4,1,good\n6,1,,never,1,1,0,ok\n7,1\n")
    rows = files.comment_csvs(spark, str(tmp_path / "comment_*.csv")).orderBy("id").collect()
    assert [(r["college"], r["id"], r["published_at"], r["net"]) for r in rows] == [("Physics", 5, 1577836800, 3), ("Physics", 6, 0, 1)]
    (tmp_path / "gpa.json").write_text(json.dumps({"A": [["Maths", "4.5", "500+", "0.2"], ["Art"]]}))
    rows = files.grade_file(spark, str(tmp_path / "gpa.json")).orderBy("course").collect()
    assert [(r["course"], r["gpa"], r["samples"]) for r in rows] == [("Art", None, None), ("Maths", 4.5, "500+")]


def test_small_files(spark, tmp_path):
    (tmp_path / "slang.json").write_text(json.dumps({"ds": {"type": "course", "value": ["Data", "Structures"]}, "zjg": {"type": "rag", "value": "campus"}}))
    rows = {r["term"]: r["names"] for r in files.slang_file(spark, str(tmp_path / "slang.json")).collect()}
    assert rows == {"ds": ["Data", "Structures"], "zjg": ["campus"]}
    (tmp_path / "bad.json").write_text("{")
    assert files.slang_file(spark, str(tmp_path / "bad.json")).count() == 0 and files.slang_file(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "keep").write_text("a/b.md\n\n c.md | d/c.md \n")
    assert [tuple(r) for r in files.keep_list(spark, str(tmp_path / "keep")).collect()] == [("a/b.md", None), ("c.md", "d/c.md")]
    (tmp_path / "reg.yaml").write_text("sources:\n- {name: a, enabled: true}\n- {name: b, enabled: false}\n")
    with pytest.raises(ValueError, match="list_url"):
        files.registry(spark, str(tmp_path / "reg.yaml"))


def test_fetch_failures_are_nulls(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError
        return url.encode()

    urls = spark.createDataFrame([("good",), ("bad",), (None,)], "url string")
    assert [r["content"] for r in files.fetched(urls, "url", fetch).collect()] == [bytearray(b"good"), None, None]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 1), ("s2", 2)], "source string, v int")
    path = str(tmp_path / "out")
    assert sinks.overwrite_sources(rows, path) and not sinks.overwrite_sources(rows.limit(0), path)
    assert sinks.overwrite_sources(rows.where("v = 1").withColumn("v", F.lit(9)), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("source", "v").collect()) == [("s1", 9), ("s2", 2)]
    text = rows.select(sinks.markdown_text({"source": F.col("source"), "none": F.lit(None)}, F.lit("body")).alias("t")).first()["t"]
    assert text == "---\nsource: s1\n---\nbody"


def test_targets_of_a_keep_list(spark):
    lines = [("zx-a/FAQ/x.md", None), ("zx-a/y.md", "通知/办公室"), ("zx-a/z.md", "zx-a/政策/z\u200b2.md"), ("other/FAQ/w.md", None), ("zx-a/v.md", None)]
    keep = spark.createDataFrame(lines, "src string, dst string")
    out = [tuple(r) for r in files.kept_targets(keep, "zx-", ["FAQ", "政策", "通知"]).collect()]
    assert out == [("zx-a/FAQ/x.md", "FAQ/x.md", "FAQ", False, True), ("zx-a/y.md", "通知/办公室/y.md", "通知", True, True), ("zx-a/z.md", "政策/z2.md", "政策", True, True), ("zx-a/v.md", "v.md", "v.md", False, False)]


def test_review_queue(spark):
    rows = [("FAQ/a.md", {"review_status": "needs_review"}), ("staging/b.md", {"review_status": "needs_review"}), ("FAQ/c.md", {"review_status": "verified"}), ("政策/d.md", {"review_status": "needs_review"}), ("FAQ/e.md", {})]
    docs = spark.createDataFrame(rows, "path string, meta map<string,string>")
    assert [r["path"] for r in files.review_queue(docs).collect()] == ["FAQ/a.md", "政策/d.md"]
    assert [r["path"] for r in files.review_queue(docs, "FAQ/").collect()] == ["FAQ/a.md"]


def test_listed_urls(spark):
    site = {"h/list.htm": ["h/p/1", "h/x", "h/p/2"], "h/list2.htm": ["h/p/2", "h/p/3"], "h/list3.htm": [], "h/list4.htm": ["h/p/9"], "h/plain": ["h/p/7"]}
    sources = spark.createDataFrame([("a", "h/list.htm", "h/p/", 9), ("b", "h/plain", "h/p/", 5), ("c", "h/none.htm", "h/p/", 2), ("d", "h/list.htm", "h/p/", None)], "name string, list string, pattern string, pages int")
    out = {}
    for r in files.listed_urls(sources, "name", "list", "pattern", "pages", lambda u: site[u]).orderBy("place").collect():
        out.setdefault(r["source"], []).append(r["url"])
    assert out == {"a": ["h/p/1", "h/p/2", "h/p/3"], "b": ["h/p/7"], "d": ["h/p/1", "h/p/2"]}


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"source": "s", "fetched_at": "2024", "errors": [], "results": {"u1": {"status": "new", "doc_id": "d1", "chars": 5}, "u2": {"status": "same"}}}))
    assert sorted(tuple(r) for r in files.manifest(spark, str(tmp_path / "m.json")).collect()) == [("s", "u1", "new", "d1", 5), ("s", "u2", "same", None, None)]


def test_publication_and_export(spark):
    docs = spark.createDataFrame([("b", "needs_review")], "body string, review_status string")
    assert tuple(sinks.rewritten_on_publish(docs, checked="2024-01-01", maintainer="me").select("body", "review_status", "valid", "last_checked_at", "maintainer").first()) == ("b", "verified", True, "2024-01-01", "me")
    notes = spark.createDataFrame([(2, "Q2", ["c"], []), (1, "Q1", ["a", "b"], ["s1", "s2"])], "n int, q string, p array<string>, s array<string>")
    assert sinks.faq_markdown(notes, "n", "q", "p", "s").first()["text"] == "## 1. Q1\n- a\n- b\n\nSources: s1 · s2\n\n## 2. Q2\n- c"
