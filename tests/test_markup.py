"""HTML to Markdown: what a page means in spite of missing tags, element by element, and random nests against a rendering of their own."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import markup
from quillspark.functions.text import strip_tags

BASE = "https://site.example/dir/page.htm"


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        ("<h1> A\n title </h1><h3>b<i>c</i></h3>", "# A title\n### bc"),
        ("<p>one<p>two<div>loose<p>three</div><p> </p>", "one\ntwo\nthree"),
        ("<p>a<br>b\n  c &amp; d&nbsp;</p>", "a\nb c & d"),
        ("<p>see <a href='x.html'>the <b>page</b></a>, <a href='/f/Form.DOCX?v=1'> form </a>, <a href='/n.pdf'></a>, <a href='mailto:a@b'>mail</a> <a>none</a></p>", "see [the page](https://site.example/dir/x.html), [附件：form](https://site.example/f/Form.DOCX?v=1), [附件：文件](https://site.example/n.pdf), mail none"),
        ("<a href='x'></a><a href='y'>y</a><a></a>", "[https://site.example/dir/x](https://site.example/dir/x)\n[y](https://site.example/dir/y)"),
        ("<p>i <img src='i.png' alt=' pic '> <img src='j.png'> <img alt='k'></p><img src='l.png' alt='l'><img>", "i ![图片：pic](https://site.example/dir/i.png)  [图片：k]\n![图片](https://site.example/dir/l.png)\n[图片]"),
        ("<ul><li>one<li>two <ul><li>in<ol><li>deep</ol></ul> after<li></ul><ol><li><p>x<p>y</ol>", "- one\n- two after\n  - in\n    1. deep\n1. xy"),
        ("<table><tr><th>a|b<td>c<tr><td>1<br>2<td><table><tr><td>in</table></table><hr>", "| a\\|b | c |\n| --- | --- |\n| 1 2 | in |\n---"),
        ("<table><thead><tr><td>h<tbody><tr><td>v</table><table></table>", "| h |\n| --- |\n| v |"),
        ("<iframe src='/v?x=1&file=%2Fdoc%2Fa.pdf'></iframe><div class='q wp_pdf_player' pdfsrc='b.pdf'></div><iframe></iframe>", "@PDFIFRAME@ https://site.example/doc/a.pdf\n@PDFIFRAME@ https://site.example/dir/b.pdf"),
        ("<script>if (a<b) '<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes<script>x</script></p></div></p>", "yes"),
        ("<body class=x><p>a</b></i></p></body><p>tail", "a\ntail"),
        ("no tags at all", ""),
        ("", ""),
        ("<p>broken <a href='http://[bad'>l</a> <b>", "broken l"),
    ],
)
def test_elements(html, wanted):
    assert markup.markdown(html, BASE, "body") == wanted


def test_selectors_and_depth():
    page = "<body><nav><p>n</nav><div id=main class='a b'><p>m</div><div class=c><p>c</div></body>"
    assert [markup.markdown(page, BASE, s) for s in ("#main", ".b", "div.c", "nav", "#gone")] == ["m", "m", "c", "n", "n\nm\nc"]
    deep = "<div>" * 5000 + "<p>in</p>" + "</div>" * 5000 + "<p>out"
    assert markup.markdown(deep, BASE) == "in\nout"
    assert markup.markdown("<ul><li>x" * 3000, BASE).count("x") == 3000
    assert markup.markdown(None, BASE) is None


def nest(rng, depth=0):
    """A random piece of HTML, with end tags left out where that is allowed, and the lines it means."""
    kind = rng.choice(["p", "h2", "ul", "ol", "div", "table"] if depth < 3 else ["p", "h2"])
    word = lambda: "".join(rng.choice("abc") for _ in range(3))
    end = lambda tag: "" if rng.random() < 0.5 else f"</{tag}>"
    if kind == "p":
        w = word()
        return f"<p>{w} <b>x</b>{end('p')}", [f"{w} x"]
    if kind == "h2":
        w = word()
        return f"<h2>{w}</h2>", [f"## {w}"]
    if kind == "div":
        parts = [nest(rng, depth + 1) for _ in range(rng.randrange(4))]
        return "<div>" + "".join(h for h, _ in parts) + "</div>", [x for _, lines in parts for x in lines]
    if kind == "table":
        width, rows = rng.randrange(1, 4), [[word() for _ in range(3)] for _ in range(rng.randrange(1, 4))]
        html = "<table>" + "".join(f"<tr>{''.join(f'<td>{c}' + end('td') for c in r[:width])}{end('tr')}" for r in rows) + "</table>"
        lines = ["| " + " | ".join(r[:width]) + " |" for r in rows]
        return html, ["\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])]

    def listed(tag, level):
        html, lines = f"<{tag}>", []
        for _ in range(rng.randrange(1, 4)):
            w = word()
            html += f"<li>{w}"
            lines.append("  " * level + ("- " if tag == "ul" else "1. ") + w)
            if level < 2 and rng.random() < 0.4:
                inner, more = listed(rng.choice(["ul", "ol"]), level + 1)
                html, lines = html + inner, lines + more
            html += end("li")
        return html + f"</{tag}>", lines

    return listed(kind, 0)


def test_random_pages_in_a_table(spark):
    rng = random.Random(6)
    pages = [[nest(rng) for _ in range(rng.randrange(1, 7))] for _ in range(300)]
    rows = [(i, "".join(h for h, _ in parts), "\n".join(x for _, lines in parts for x in lines)) for i, parts in enumerate(pages)]
    df = spark.createDataFrame([*rows, (-1, None, None)], "i long, html string, wanted string")
    out = df.select("wanted", markup.html_markdown(F.col("html"), F.lit(None).cast("string")).alias("got")).collect()
    assert all(r["got"] == r["wanted"] for r in out)


def test_tags_leave_no_gap_and_entities_are_resolved_in_order(spark):
    df = spark.createDataFrame([("<b>a</b>b &amp;lt; <",), ("x&nbsp;<i>\n</i> y",)], "h string")
    assert [r[0] for r in df.select(strip_tags(F.col("h"))).collect()] == ["ab < <", "x y"]
