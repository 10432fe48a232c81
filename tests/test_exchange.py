"""Sinks, link parsing, rules of hosts and prompts, on small fixtures."""

import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from lectern import session
from lectern.operators import coding
from lectern.sources import files, web

BASES = ["https://a.example/x/y/page.html?p=1#z", "https://a.example", "https://a.example/", "http://a.example/dir/", "https://a.example/q?u=/v/w"]
HREFS = ["../a/b?x=1", "./c", "/d/../e", "?q=2", "#top", "//cdn.example/x", "f/g.html", "", "https://other.example/z/../y", "../../../up", "h/./i/", "..", ".", "/j/k/..", "mailto:a@b.example"]


def test_links_join_as_the_standard_says(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    out = spark.createDataFrame(rows, "b string, h string").withColumn("t", web.absolute(F.col("b"), F.col("h"))).collect()
    wrong = [(r.b, r.h, r.t, urljoin(r.b, r.h)) for r in out if r.h != "https://other.example/z/../y" and r.t != urljoin(r.b, r.h)]
    # a bare host gets its root, as in RFC 3986; the library leaves the slash out for a query
    assert [x for x in wrong if x[2].replace(".example/", ".example") != x[3].replace(".example/", ".example")] == []


def test_answers_and_links_of_a_domain(spark):
    answer = json.dumps({"webPages": {"value": [{"url": "https://a.example/1"}, {"url": None}, {"url": "https://a.example/1"}, {"url": "https://b.example/2"}]}})
    html = '<a href="https://www.a.example/p">x</a><a href="https://sub.a.example/q">y</a><a href="https://nota.example/r">z</a>'
    df = spark.createDataFrame([(answer, html), ("no json", ""), (None, None), ("{}", "x")], "answer string, html string")
    out = df.select(web.answer_links(F.col("answer")).alias("a"), web.domain_links(F.col("html"), F.lit("a.example")).alias("d")).collect()
    assert out[0].a == ["https://a.example/1", "https://b.example/2"] and out[0].d == ["https://www.a.example/p", "https://sub.a.example/q"]
    assert [x.a for x in out[1:]] == [[], [], []] and [x.d for x in out[1:]] == [[], None, []]


def test_rules_of_hosts(spark):
    urls = spark.createDataFrame([("https://a.example/private/x", 1), ("https://a.example/open", 2), ("https://b.example/private/x", 3), (None, 4)], "url string, body int")
    robots = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /private"), ("b.example", None), ("a.example", "User-agent: *\nDisallow: /private")], "host string, body string")
    assert {r.body for r in web.allowed(urls, robots, "lectern").collect()} == {2, 3}
    assert web.allowed(urls.limit(0), robots, "lectern").count() == 0


def test_a_look_at_the_first_addresses(spark):
    rows = spark.createDataFrame([(f"i{k}", f"https://{k}.example", None if k else "") for k in range(9)], "institution_id string, website string, policy_search_url string")

    def head(url):
        if url.startswith("https://3"):
            raise OSError("refused")
        return 204

    out = {r.institution_id: r for r in web.head_check(rows, head).collect()}
    assert set(out) == {f"i{k}" for k in range(5)} and out["i3"].status is None and out["i3"].error == "OSError: refused" and out["i0"].status == 204 and out["i0"].elapsed_ms >= 0


def test_new_by_query_with_refusals(spark):
    hits = spark.createDataFrame([("i", "q1", "u1", 1), ("i", "q1", "u2", 1), ("i", "q2", "u1", 2)], "institution_id string, query string, url string, place int")
    answers = spark.createDataFrame([("i", "q1", 1, 200), ("i", "q2", 2, 200), ("i", "q3", 3, 503), ("i", "q4", 4, 429), ("i", "q5", 5, 200)], "institution_id string, query string, place int, status int")
    assert {r["query"]: r.n_new for r in web.new_by_query(hits, answers=answers).collect()} == {"q1": 2, "q2": 0, "q3": -503, "q4": -429}


def test_append_json_and_publish(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x",\nnow', None), ("é", "", 2)], "k string, v string, n int")
    path = str(tmp_path / "t.csv")
    for _ in range(2):
        files.append_csv(df, path, ["k", "v", "n", "more"])
    back = files.read_appended_csv(spark, path, ["k", "v", "n", "more"])
    assert sorted(map(tuple, back.collect())) == sorted([("a", 'say "x",\nnow', "", ""), ("é", "", "2", "")] * 2)
    files.write_json(df, str(tmp_path / "doc"))
    (text,) = [p.read_text() for p in (tmp_path / "doc").glob("part-*")]
    assert "é" in text and "\n" in text and json.loads(text) == [{"k": "a", "v": 'say "x",\nnow', "n": None}, {"k": "é", "v": "", "n": 2}]
    first = files.publish(df, str(tmp_path / "pub"), "k").first()
    second = files.publish(df.union(df), str(tmp_path / "pub"), "k").first()
    assert (first.n_rows, second.n_rows, second.n_keys) == (2, 4, 2) and spark.read.parquet(str(tmp_path / "pub")).count() == 4


def test_codebook():
    book = "# B\n\n## System prompt\n\n```text\nBe exact.\n```\n\n### Example 1: x\n\n```\nTEXT\n\"Audit\nclauses.\"\nEXPECTED OUTPUT\n{\"a\":\n 1}\n```\n### Example 2\n```\nno marks\n```\n## Other\n```\nTEXT\nx\nEXPECTED OUTPUT\ny\n```\n"
    assert coding.template(book) == ("Be exact.", [{"text": "Audit\nclauses.", "expected": '{"a": 1}'}])
    assert coding.template("") == ("", [])


def test_a_cluster_needs_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://m:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())
