"""The paged source over a folder of stored pages: what is read, what fails, and what is fetched twice."""

from collections import Counter
from pathlib import Path

import pytest

from quillspark.sources.paged import paged_source


def site(folder, n, missing=()):
    """n pages of which some are missing; every fetch leaves a line in a log."""
    for i in range(1, n + 1):
        if i not in missing:
            (folder / f"{i}.html").write_text(f"about <span>{n * 3 - 1}</span> items, page {i}")

    def fetch(url):
        with open(folder / "log", "a") as log:
            log.write(url.rsplit("/", 1)[1] + "\n")
        path = Path(url)
        if not path.exists() and path.stem == "5":
            return None
        return path.read_bytes()

    return fetch


def fetches(folder):
    log = folder / "log"
    return Counter(log.read_text().split()) if log.exists() else Counter()


def test_pages_are_read_and_failures_are_null(spark, tmp_path):
    spark.dataSource.register(paged_source(site(tmp_path, 11, missing=(4, 5)), "stored"))
    load = lambda **o: spark.read.format("stored").options(url=f"{tmp_path}/{{page}}.html", pagesPerTask=3, **o).load()
    rows = {r["page"]: r["content"] for r in load(pages=11).collect()}
    assert set(rows) == set(range(1, 12)) and {p for p, c in rows.items() if c is None} == {4, 5}
    assert rows[11].endswith(b"page 11") and load(pages=11).rdd.getNumPartitions() == 4
    assert fetches(tmp_path)["4.html"] == 2 and fetches(tmp_path)["3.html"] == 1
    assert load(total=r"<span>(\d+)", size=3).count() == 11
    assert load(total=r"nothing (\d+)").count() == 0
    with pytest.raises(Exception, match="page"):
        spark.read.format("stored").options(url="x", pages=1).load().collect()


def test_a_stopped_stream_fetches_no_page_again(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    fetch, got = site(pages, 10, missing=(7,)), {}
    spark.dataSource.register(paged_source(fetch, "stored"))

    def run(fails_at=None):
        def sink(df, batch_id):
            rows = [(r["page"], r["content"] is None) for r in df.collect()]
            if batch_id == fails_at:
                raise RuntimeError("down")
            got[batch_id] = rows

        source = spark.readStream.format("stored").options(url=f"{pages}/{{page}}.html", total=r"<span>(\d+)", size=3, pagesPerBatch=3, pagesPerTask=2).load()
        query = source.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="down"):
        run(2)
    assert [p for b in sorted(got) for p, _ in sorted(got[b])] == [1, 2, 3, 4, 5, 6]
    run()
    assert sorted(r for b in got.values() for r in b) == [(p, p == 7) for p in range(1, 11)]
    times = fetches(pages)
    assert all(times[f"{p}.html"] == 1 for p in (2, 3, 4, 5, 6, 10)) and times["7.html"] == 4 and times["8.html"] == 2
    site(pages, 13)
    run()
    assert sorted(r for b in got.values() for r in b)[-3:] == [(11, False), (12, False), (13, False)]
    assert all(fetches(pages)[f"{p}.html"] == times[f"{p}.html"] for p in range(2, 11))
