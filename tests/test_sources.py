"""Pages, files, sinks and streams."""

import time

from pyspark.sql import functions as F

from reelsignals.operators import runs as N
from reelsignals.operators import signals as T
from reelsignals.sources import files, pages, sinks
from reelsignals.streaming import progress as GP
from reelsignals.streaming import trends as GT

HTML = """<html><body><div class="trending-item big"><h2>First &amp; <b>best</b></h2><span class='count'>1.2M</span>
<a href="/tag/a">#one #two</a></div><p>gap<div class="other"></div><div class="trending-item"><h2> </h2></div></body></html>"""


CARD = pages.element(pages.word("data-e2e", "trending-item"), pages.word("class", "trending-item"))
FIELDS = {
    "title": (pages.element(pages.tag("h2"), pages.word("class", "title")), None),
    "engagement": (pages.element(pages.word("class", "count"), pages.word("class", "engagement")), None),
    "hashtag": (pages.element(pages.holds("href", "tag", "a"), pages.word("class", "hashtag")), None),
    "url": (pages.element(pages.tag("a")), "href"),
}


def test_layout_and_fallback(spark):
    empty = "<html><body>none</body></html>"
    d = spark.createDataFrame([(1, "https://a.example/one", empty), (2, "https://a.example/two", HTML), (3, "https://a.example/three", HTML), (4, "https://a.example/one", None)],
                              "page_id int, url string, html string")
    items = pages.crawl_items(d, "tiktok", ["https://a.example/one", "https://a.example/two", "https://a.example/three"], CARD, FIELDS)
    assert [(r.title, r.engagement, r.hashtags, r.url) for r in T.normalize_crawled(items).collect()] == [("First &best", 1.2e6, ["one", "two"], "/tag/a")]


def test_element_forms(spark):
    d = spark.createDataFrame([(1, "<body><!-- <p>no</p> --><script>'<p>no</p>'</script><DIV class='a trend-x b'><P>one</P></DIV><p id=z>two</p><i>open <p data-k='x y'>th<b>r</b>ee</p></body>")],
                              "page_id int, html string")
    get = lambda *forms: pages.extract_pages(d, pages.element(pages.tag("body")), {"x": (pages.element(*forms), None)}).first().x
    assert get(pages.tag("p")) == "one"
    assert get(pages.word("id", "z")) == "two" and get(pages.word("data-k", "y", "p")) == "three"
    assert get(pages.word("class", "trend")) is None and get(pages.word("class", "trend-x")) == "one" and get(pages.holds("class", "trend")) == "one"
    assert get(pages.tag("i"), pages.tag("u")) is None and get(pages.tag("u"), pages.tag("b")) == "r"
    many = pages.extract_pages(d, pages.element(pages.tag("p")), {"x": (pages.element(pages.tag("p")), None)}).orderBy("item_idx").collect()
    assert [(r.item_idx, r.x) for r in many] == [(0, "one"), (1, "two"), (2, "three")]


def test_file_listing_and_sinks(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.MP4").write_bytes(b"0" * 2048)
    (tmp_path / "a" / "y.txt").write_text("no")
    inv = N.video_inventory(files.list_files(spark, str(tmp_path))).collect()
    assert [(r.name, r.length) for r in inv] == [("x.MP4", 2048)]
    d = spark.createDataFrame([(c, i, f"line {i}") for c in (1, 2) for i in range(20)], "clip int, i int, t string")
    sinks.write_caption_files(d, str(tmp_path / "out"), "clip", "i", "t")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "clip=1").glob("*.txt")))
    assert text.splitlines() == [f"line {i}" for i in range(20)]
    sinks.write_json(d, str(tmp_path / "js"), ["clip"])
    assert spark.read.json(str(tmp_path / "js")).count() == 40


def test_running_scores_use_earlier_batches(spark, tmp_path):
    for n, vals in enumerate(([1.0, 3.0], [2.0, 6.0])):
        spark.createDataFrame([("p", n, v) for v in vals], "platform string, n_file int, velocity double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    s = GT.file_stream(spark, str(tmp_path / "in"), "platform string, n_file int, velocity double", files_per_trigger=1)
    GT.running_scores(spark, s, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination(120)
    got = {(r.n_file, r.velocity): r.z for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, 1.0): 0.0, (0, 3.0): 0.0, (1, 2.0): 0.0, (1, 6.0): 4.0}
    end = max((tmp_path / "state").iterdir(), key=lambda p: int(p.name))
    m = spark.read.parquet(str(end)).collect()[0]
    assert (m.n, m.mean) == (4, 3.0) and abs(m.m2 - 14.0) < 1e-9


def test_watchdog_reports_silent_run(spark, tmp_path):
    shape = "run_id bigint, seq bigint, type string, stage string"
    spark.createDataFrame([(1, 1, "stage_start", "Export"), (2, 2, "stage_complete", "Quality Assurance")], shape).write.parquet(str(tmp_path / "in"))
    s = GP.watchdog_stream(GT.file_stream(spark, str(tmp_path / "in"), shape), timeout_ms=1500)
    q = s.writeStream.outputMode("update").format("memory").queryName("stalled").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("stalled").count() == 0:
            time.sleep(0.5)
        assert [(r.run_id, r.state) for r in spark.table("stalled").collect()] == [(1, "error")]
    finally:
        q.stop()


def test_breakouts(spark):
    s = spark.createDataFrame([(i, t) for i, t in enumerate(["Big AI news", "cats", "AIRPORT", "news at ten"])], "arrival_idx int, title string")
    k = spark.createDataFrame([("ai",), ("News",), ("",)], "keyword string")
    got = T.flag_breakouts(s, k).orderBy("arrival_idx").select("google_breakout").collect()
    assert got == [(True,), (False,), (True,), (True,)]
    assert s.where(F.col("arrival_idx") < 0).count() == 0
