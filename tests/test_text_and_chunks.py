import random
import re

from pyspark.sql import functions as F

from quillspark.functions import chunking, text
from quillspark.functions import embedding
from quillspark.functions.embedding import hash_embedding, hash_features, reranker


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def chunked(spark, text, *more):
    return spark.createDataFrame([(text,)], "t string").select(chunking.chunk_column(F.col("t"), *more)).first()[0]


def test_headings_keep_the_preamble_and_every_section(spark):
    parts = chunked(spark, "before\n## A\na\n## B\nb\n### C\nc")
    assert [p.split("\n")[0] for p in parts] == ["before", "## A", "## B", "### C"]
    assert chunked(spark, None) == chunked(spark, " \n\t") == []


def test_long_sections_repeat_their_heading_as_continued(spark):
    chunks = chunked(spark, "## Head\n" + "\n\n".join(c * 300 for c in "abc"))
    assert chunks == ["## Head\n" + "a" * 300, "## Head（续）\n" + "b" * 300, "## Head（续）\n" + "c" * 300]


def test_long_tables_repeat_their_head_and_lose_no_row(spark):
    table = "\n".join(["| k | v |", "|---|---|", *(f"| row{i:02d} | {'x' * 20} |" for i in range(39))])
    chunks = chunked(spark, "## T\nintro\n" + table)
    assert len(chunks) > 2 and all("| k | v |\n|---|---|" in c for c in chunks)
    assert all(sum(f"row{i:02d}" in c for c in chunks) == 1 for i in range(39))
    wide = table.replace("| k | v |", "| k | " + "v" * 200 + " |")
    assert sum("vvv" in c for c in chunked(spark, "## T\n" + wide)) == 1


def test_a_section_of_one_long_line_keeps_its_content(spark):
    line = "## " + "w" * 700
    assert "".join(chunked(spark, line)).replace("\n", "") == line


def test_full_stops_of_latin_script_do_not_end_sentences():
    assert chunking.short_lines("a." * 100, 50) == ["a." * 25] * 4
    assert chunking.short_lines("句。" * 30, 50) == ["句。" * 25, "句。" * 5]
    assert chunking.short_lines("ab!" + "c" * 12 + "!de!", 5) == ["ab!", "ccccc", "ccccc", "cc!", "de!"]


def test_pieces_of_long_paragraphs():
    rng = random.Random(3)
    for n in range(200):
        limit = rng.choice([30, 90, 200])
        lines = ["".join(rng.choice("abc def!。") for _ in range(rng.choice([0, 5, 20, 70, 300]))) for _ in range(rng.randrange(1, 30))]
        if n % 3 == 0:
            lines[1:1] = ["| a | b |", "| --- | :-: |"]
        pieces = [p.split("\n") for p in chunking.divide_paragraph("\n".join(lines), limit)]
        whole = [x for line in lines for x in (chunking.short_lines(line, limit) if len(line) > limit else [line])]
        assert all(len(x) <= limit for x in whole) and "".join(whole) == "".join(lines)
        at, before = 0, None
        for piece in pieces:
            # What is repeated stands first: the table's head, or as many of two lines as 80 characters hold.
            if before is None:
                again = []
            elif n % 3 == 0:
                again = ["| a | b |", "| --- | :-: |"]
            else:
                again = max((before[-k:] if k else [] for k in range(3)), key=lambda x: len(x) if sum(map(len, x)) <= 80 else -1)
            assert piece[: len(again)] == again
            new = piece[len(again) :]
            assert new and new == whole[at : at + len(new)]
            at += len(new)
            # A piece is as long as it may be: over the limit only by a single new line, and the next line did not fit.
            size = len("\n".join(piece))
            assert size <= limit or len(new) == 1
            assert at == len(whole) or size + 1 + len(whole[at]) > limit
            before = piece
        assert at == len(whole)


def test_chunks_of_all_documents_lose_nothing(spark):
    docs = [" ".join(f"w{i * k}" for i in range(k * 40)) + ("\n\n" if k % 2 else "\n") + "## H\n" + "x. y! " * k * 30 for k in range(8)] + ["", None]
    table = spark.createDataFrame(list(enumerate(docs)), "id int, t string")
    for r in table.select("t", chunking.chunk_column(F.col("t"), 200).alias("c")).collect():
        want = re.sub(r"\s+|## H", "", r["t"] or "")
        got = re.sub(r"\s+|## H(（续）)?", "", "".join(r["c"]))
        assert got == want and all(c.strip() == c for c in r["c"])


def test_packing_matches_the_python_chunker(spark):
    body = "\n\n".join("p" * n for n in (100, 200, 100, 340, 10, 10))
    packed = one(spark, chunking.pack(chunking.paragraphs(F.col("t")), 350), t=body)
    assert packed == ["\n\n".join(["p" * 100, "p" * 200]), "p" * 100, "p" * 340, "\n\n".join(["p" * 10] * 2)]


def test_citations(spark):
    r = lambda t, n: tuple(one(spark, text.renumber_citations(F.col("t"), F.col("n")), t=t, n=n))
    assert r("C[3] A[1] C[3]", 3) == ("C[1] A[2] C[1]", [3, 1])
    assert r("see [9]", 3) == ("see [9]", [])
    assert r("a [1] in [2025]", 0) == ("a  in [2025]", [])
    assert one(spark, text.strip_citations(F.col("t")), t="x[2] y[2025]") == "x y[2025]"


def test_small_cleaners(spark):
    assert one(spark, text.snippet(F.col("t")), t="《T》\n## a  b | c") == "a b c"
    assert one(spark, text.clean_title(F.col("t")), t="Rules（2024年5月1日修订）  x") == "Rules x"
    assert one(spark, text.publish_date(F.lit("t"), F.col("u")), u="http://x/2024/0931/") == "2024-09-31"
    assert one(spark, text.publish_date(F.lit("t"), F.col("u")), u="http://x/2024/1301/") == "unknown"
    assert one(spark, text.strip_tags(F.col("t")), t="选<b>课</b>&nbsp;&amp;lt; c") == "选课 < c"
    assert one(spark, text.without_zero_width(F.col("t")), t="a\u200bb\ufeffc") == "abc"
    assert one(spark, text.promote_headings(F.col("t")), t="一、总则\n二、很长。\n三") == "## 总则\n二、很长。\n三"
    assert one(spark, text.join_cut(F.array(F.lit("aa"), F.lit("bb"), F.lit("cc")), "、", 6)) == "aa、bb"
    assert one(spark, text.safe_filename(F.col("t")), t='a/b:"c"') == "a_b_c_"
    assert one(spark, text.turn_summary(F.col("t")), t="One! Two? Three.[1]") == ["One!", "Two?"]
    assert one(spark, text.acceptable_rewrite(F.lit("abc"), F.col("t")), t="x" * 61) == "abc"
    assert one(spark, text.cjk_bigrams(F.col("t")), t="ab 选课表 c") == ["ab", "选课", "课表", "c"]


def test_hash_embedding_has_length_one_and_is_stable():
    assert hash_features("Ab c") == ["ab", "ab", "c"]
    v = hash_embedding("the quick brown fox")
    assert len(v) == 384 and abs(sum(x * x for x in v) - 1) < 1e-9 and v == hash_embedding("THE quick brown fox")
    assert hash_embedding(None) == [0.0] * 384


def test_a_reranker_that_fails_to_load_gives_nulls(spark):
    def load():
        raise OSError("no model")

    assert spark.range(2).select(reranker(load)(F.lit("q"), F.lit("t")).alias("s")).where("s IS NULL").count() == 2


def test_kept_digests_have_a_bound(monkeypatch):
    monkeypatch.setattr(embedding, "MOST_KNOWN", 50)
    known = {}
    text = " ".join(f"word{i}" for i in range(500))
    assert embedding.hash_embedding(text, known=known) == embedding.hash_embedding(text) and len(known) <= 50
