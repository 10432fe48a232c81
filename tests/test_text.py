"""Text functions and the chunker against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking, coding


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "s string").select(f(F.col("s")).alias("v")).first().v


@pytest.mark.parametrize(("text", "lang"), [("", "und"), ("plain words", "und"), ("Prüfung", "de"), ("mañana", "es"), ("coração", "pt"), ("où là", "fr"), ("学" * 31, "zh"), ("かな" * 20, "ja"), ("한글" * 20, "ko"), ("学" * 30, "und"), (None, "und")])
def test_language(spark, text, lang):
    assert value(spark, text, T.detect_language) == lang


def test_tokens(spark):
    assert value(spark, "one two three four", lambda c: T.approx_tokens(c, F.lit("en"))) == 5
    assert value(spark, "学生 uses GPT模型", lambda c: T.approx_tokens(c, F.lit("zh"))) == 6
    assert value(spark, " \n", T.word_count) == 0


def test_html(spark):
    html = '<html><head><TITLE> A b </TITLE><style>x</style><script>var a="<p>";</script></head><body><nav>N</nav><p>Hi\n there</p><a class="k" href="/ai-policy">AI policy</a><footer>F</footer></body></html>'
    assert value(spark, html, T.html_text) == "A b N Hi there AI policy F"
    assert value(spark, html, lambda c: T.html_text(c, furniture=True)) == "A b Hi there AI policy"
    assert value(spark, html, T.html_title) == "A b" and value(spark, "<p>x</p>", T.html_title) is None
    assert [tuple(a) for a in value(spark, html, T.anchors)] == [("/ai-policy", "AI policy")]
    assert value(spark, '<meta http-equiv="x" content="text/html; charset=GBK">', T.html_charset) == "gbk" and value(spark, "", T.html_charset) == "utf-8"


def test_urls(spark):
    assert value(spark, "https://user:pw@WWW.Uni.example:8080/a?b", T.host) == "uni.example"
    assert value(spark, "https://a.example/", T.probe_urls)[0] == "https://a.example/genai-policy"
    assert value(spark, 'x href="https://a.example/p&amp;q" href="https://a.example/p&amp;q" href="http://b.example/r?s"', T.absolute_links) == ["https://a.example/p&q"]
    assert value(spark, "fr+ de+", T.secondary_languages) == ["fr", "de"]
    assert value(spark, "KI Leitlinie，学生、x", T.query_tokens) == ["ki", "leitlinie", "学生"]


@pytest.mark.parametrize("n", [2, 7, 8, 16])
def test_hash_shards(spark, n):
    import hashlib

    for s in ("", "abc", "学"):
        digest = hashlib.sha256(s.encode()).hexdigest()
        assert value(spark, s, lambda c: T.hex_mod(F.sha2(c, 256), n)) == int(digest, 16) % n


def packed(spark, blocks):
    units = [(h, f"{h}{k}", n, n > 750, k == len(own) - 1) for h, own in blocks for k, n in enumerate(own)]
    df = spark.createDataFrame([(units,)], f"u array<{chunking.UNIT}>")
    return [(c.heading, c.tokens) for c in df.select(chunking.pack(F.col("u")).alias("c")).first().c]


@pytest.mark.parametrize(
    ("blocks", "chunks"),
    [
        ([("A", [100, 50, 200, 300, 400, 90, 30])], [("A", 350), ("A", 300), ("A", 520)]), ([("A", [300]), ("B", [50])], [("A", 350)]), ([("A", [50])], []), ([("A", [50]), ("B", [200])], [("B", 200)]), ([("A", [100, 450])], [("A", 550)]), ([("A", [200, 900, 40])], [("A", 200), ("A", 940)]),
    ],
)
def test_packer(spark, blocks, chunks):
    assert packed(spark, blocks) == chunks


def naive_pack(blocks, target=500, least=120):
    out = []
    for h, own in blocks:
        buf = 0
        for n in own:
            if n > 750:
                if buf:
                    out.append([h, buf])
                    buf = 0
                out.append([h, n])
            elif buf + n > target and buf >= least:
                out.append([h, buf])
                buf = n
            else:
                buf += n
        if buf >= least:
            out.append([h, buf])
        elif buf and out:
            out[-1][1] += buf
    return [tuple(x) for x in out]


def test_packer_against_a_loop(spark):
    rng = random.Random(5)
    for _ in range(6):
        blocks = [(chr(65 + k), [rng.choice([5, 30, 90, 130, 300, 480, 760]) for _ in range(rng.randint(1, 7))]) for k in range(rng.randint(1, 5))]
        assert packed(spark, blocks) == naive_pack(blocks)


def test_pack_documents(spark):
    para = "word " * 200
    text = f"# One\n\n{para}\n\n{para}\n\n## Two\n{para}"
    rows = [(1, text, "en", 0), (2, None, "en", 0), (3, "", None, 0), (4, "short", "en", 0), (5, f"{'Long sentence here. ' * 300}", "en", 0), (1, text, "en", 0)]
    df = spark.createDataFrame(rows, "id long, text string, lang string, seq int")
    got = chunking.pack_documents(df, "id", "text", "lang").orderBy("id", "seq").collect()
    assert [(r.seq, r.heading, r.tokens) for r in got if r.id == 1] == [(0, "One", 260), (0, "One", 260), (1, "One", 260), (1, "One", 260), (2, "Two", 260), (2, "Two", 260)]
    assert {r.id for r in got} == {1, 5} and all(r.tokens <= 750 for r in got)
    assert " ".join(r.text for r in got if r.id == 5).split() == rows[4][1].split()
    assert chunking.pack_documents(df.limit(0), "id", "text", "lang").count() == 0


def test_heading_blocks(spark):
    df = spark.createDataFrame([(1, "intro\n# A\n\nbody\n\n## Empty\n# B #x\nlast", "x"), (2, None, "x")], "id long, text string, body string")
    got = [(r.block_no, r.heading, r.body) for r in chunking.heading_blocks(df, "id", "text").collect()]
    assert got == [(0, "", "intro"), (1, "A", "body"), (2, "B #x", "last")]


def test_terms(spark):
    assert value(spark, "We use ChatGPT", T.any_term) and not value(spark, "none", T.any_term) and not value(spark, None, T.any_term)
    dense = lambda c: T.keyword_dense(c, F.array(F.lit("Student"), F.lit("policy")), F.lit(2))
    assert value(spark, "student policy on GenAI", dense) and not value(spark, "student policy", dense) and not value(spark, None, dense)


def test_template_and_coder(spark):
    book = '## System prompt\n\n```\nBe exact.\n```\n\n### Example 1 - x\n\n```\nTEXT\n"Audit clauses."\n\nEXPECTED OUTPUT\n{"a": 1}\n```\n'
    assert coding.template(book) == ("Be exact.", [{"text": "Audit clauses.", "expected": '{"a": 1}'}])
    df = spark.createDataFrame([("c1", "supplier contracts", 1), ("c2", None, 1)], "chunk_id string, text string, raw int")
    got = {r.chunk_id: r.raw for r in coding.code_passages(df).collect()}
    assert re.search(r'"T7_vendor_governance": 1', got["c1"]) and '"T7_vendor_governance": 0' in got["c2"]


def test_prompt(spark):
    df = spark.createDataFrame([("c1", None, "NA", "elite", None, "en", "x" * 7000), ("c2", "U", None, None, "Scope", None, None)], "chunk_id string, institution_name string, region string, tier string, section_header string, language_declared string, text string")
    a, b = (r.p.split("\n") for r in df.select(coding.prompt([{"text": "y" * 700, "expected": "{}"}]).alias("p")).collect())
    assert a[3:7] == ["EXAMPLE 1", "Text: " + "y" * 600, "Expected: {}", ""] and a[7:9] == ["NOW CODE THE FOLLOWING:", "University: ? (NA, tier elite)"] and a[-3] == "x" * 6000
    assert b[8:14] == ["University: U (?, tier ?)", "Document section: Scope", "Original language: ?", "Chunk ID: c2", "", "Text:"] and b[-1] == "JSON output only:"
