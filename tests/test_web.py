from pyspark.sql import functions as F

from lectern.sources import web


def test_fetch_once_with_retries(spark):
    df = spark.createDataFrame([("https://a.example/1", "x"), ("https://a.example/1", "y"), ("https://a.example/busy", "z"), ("https://b.example/bad", "z"), (None, "z")], "url string, status string")

    def get(url):
        if "bad" in url:
            raise OSError
        return (503, "", "") if "busy" in url else (200, "text/html", f"<p>{url}")

    got = {r.url: (r.status, r.tries) for r in web.fetch(df, get, wait=lambda s: None).collect()}
    assert got == {"https://a.example/1": (200, 1), "https://a.example/busy": (503, 3), "https://b.example/bad": (599, 3)}


def test_absolute(spark):
    rows = [("https://a.example/p/q?x", "/r", "https://a.example/r"), ("https://a.example/p/q", "r", "https://a.example/p/r"), ("https://a.example", "r", "https://a.example/r"), ("https://a.example/p/", "//b.example/c", "https://b.example/c"), ("https://a.example/p", "http://c.example", "http://c.example")]
    df = spark.createDataFrame(rows, "base string, href string, want string")
    for r in df.withColumn("got", web.absolute(F.col("base"), F.col("href"))).collect():
        assert r.got == r.want


def test_result_links(spark):
    html = '<a href="//s.example/l/?uddg=https%3A%2F%2Funi.example%2Fai&rut=1">x</a><a href="?uddg=https%3A%2F%2Fother.example">y</a>'
    got = spark.createDataFrame([(html, "uni.example")], "h string, d string").select(web.result_links(F.col("h"), F.col("d")).alias("v")).first().v
    assert got == ["https://uni.example/ai"]


def test_links_and_crawl(spark):
    page = lambda *links: "".join(f'<a class="x" href="{u}">{t}</a>' for u, t in links)
    pages = spark.createDataFrame(
        [("https://u.example/", page(("/teaching", "teaching ai"), ("/policy/ai-guidance", "AI policy"), ("https://x.example/ai", "AI"), ("/food", "menu"))), ("https://u.example/teaching", page(("/teaching/ai", "ai"), ("/policy/ai-guidance", "AI policy"))), ("https://u.example/policy/ai-guidance", page(("/deep/ai", "ai")))], "url string, html string"
    )
    links = web.scored_links(pages, ["ai", "policy", "guidance"])
    got = {(r.url, r.hop) for r in web.crawl(spark.createDataFrame([("https://u.example/",)], "url string"), links).collect()}
    assert got == {("https://u.example/teaching", 1), ("https://u.example/policy/ai-guidance", 1), ("https://u.example/teaching/ai", 2)}


def test_new_and_pending(spark):
    hits = spark.createDataFrame([("i", "q1", "u1", 1), ("i", "q2", "u1", 2), ("i", "q2", "u2", 3), ("i", "q3", "u2", 4)], "institution_id string, query string, url string, place int")
    assert {(r.query, r.n_new) for r in web.new_by_query(hits).collect()} == {("q1", 1), ("q2", 1), ("q3", 0)}
    all_, done = spark.createDataFrame([("a",), ("b",), ("c",)], "institution_id string"), spark.createDataFrame([("a",)], "institution_id string")
    assert {r[0] for r in web.pending(all_, done).collect()} == {"b", "c"}
    assert {r[0] for r in web.pending(all_, done, limit=2).collect()} == {"b"}
