"""Queries on documents, passages, pages and coder responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import CORE_TERMS, PROBE_PATHS, THEMES, USES, institutions, sql
from ..functions import text as T
from ..operators import chunking
from ..operators.coding import prompt, template
from ..session import spread, table
from .catalog import query

#: Words in a URL that make it worth keeping, by language.
URL_WORDS = {"en": ("policy", "guidance", "guideline", "integrity"), "de": ("leitlinie", "richtlinie"), "zh": ("zhengce", "guiding"), "es": ("politica", "guia"), "pt": ("orientacoes", "guia"), "fr": ("charte", "usage")}
#: Words whose density marks a passage of the language.
TERMS = {"en": ("policy", "student", "assessment", "integrity", "guidance"), "de": ("prüfung", "studierende", "richtlinie"), "fr": ("étudiants", "charte", "évaluation"), "es": ("estudiantes", "evaluación", "política"), "pt": ("estudantes", "avaliação", "orientações"), "zh": ("学生", "评审", "课程"), "ja": ("学生", "指針", "課題"), "ko": ("학생", "과제", "지침")}
QUERIES = {"en": ("generative AI policy", "ChatGPT guidance", "AI academic integrity"), "de": ("KI Leitlinie", "ChatGPT Prüfung"), "fr": ("charte IA", "usage IA générative"), "es": ("política IA generativa", "guía ChatGPT"), "pt": ("orientações IA", "guia ChatGPT"), "zh": ("生成式人工智能 规定", "人工智能 指南"), "ja": ("生成AI 指針", "生成AI 利用"), "ko": ("생성형 AI 지침", "생성 AI 활용")}
WIDE = T.WIDE
WS = r"[ \t\r\n\f\x0b]+"
_arr = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_cls = lambda c, chars: f"length(regexp_replace({c}, '[^{chars}]', '', 'g'))"
_words = lambda c: f"len(regexp_extract_all({c}, '[^ \\t\\r\\n\\f\\x0b]+'))"
_tokens = lambda c, lang: f"CASE WHEN {lang} LIKE 'zh%' OR {lang} IN ('ja', 'ko') THEN {_cls(c, WIDE)} + len(regexp_extract_all({c}, '[A-Za-z]+')) ELSE CAST(floor({_words(c)} * 1.3) AS INTEGER) END"


def docs(spark, d) -> DataFrame:
    return spread(table(spark, d, "policy_documents"))


def by_lang(lang: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in lists.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), lang), F.array().cast("array<string>"))


_s = "trim(left(text, 2000), ' ')"
_has = lambda chars: f"regexp_matches({_s}, '[{chars}]')"


@query(
    rf"""SELECT policy_doc_id, CASE WHEN coalesce(length({_s}), 0) = 0 THEN 'und' WHEN {_cls(_s, r'\x{4E00}-\x{9FFF}')} > 30 THEN 'zh' WHEN {_cls(_s, r'\x{3040}-\x{30FF}')} > 30 THEN 'ja' WHEN {_cls(_s, r'\x{AC00}-\x{D7AF}')} > 30 THEN 'ko'
    WHEN {_has('äöüÄÖÜß')} THEN 'de' WHEN {_has('ñáéíóúü¿¡')} THEN 'es' WHEN {_has('ãõçáéíóúâêô')} THEN 'pt' WHEN {_has('àâçéèêëîïôûùü')} THEN 'fr' ELSE 'und' END AS lang FROM policy_documents"""
)
def language_script_detect(spark, d):
    return docs(spark, d).select("policy_doc_id", T.detect_language(F.col("text")).alias("lang"))


@query(
    rf"""SELECT policy_doc_id, round(s, 9) AS score, s > 0.05 AS flagged FROM (SELECT policy_doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 1.0::DOUBLE ELSE {_cls('text', r'\x01-\x1F\x7F-\x9F\x{E000}-\x{F8FF}\x{FFFD}')}::DOUBLE / length(text) END AS s FROM policy_documents)"""
)
def mojibake_score(spark, d):
    s = T.damage_score(F.col("text"))
    return docs(spark, d).select("policy_doc_id", F.round(s, 9).alias("score"), (s > 0.05).alias("flagged"))


@query(rf"SELECT policy_doc_id, CAST(length(text) AS INTEGER) AS n_chars, CAST({_words('text')} AS INTEGER) AS n_words, CAST({_tokens('text', 'coalesce(language_detected, $$und$$)')} AS INTEGER) AS tokens FROM policy_documents WHERE text IS NOT NULL")
def approx_tokens(spark, d):
    c = F.col("text")
    return docs(spark, d).where(c.isNotNull()).select("policy_doc_id", F.length(c).alias("n_chars"), T.word_count(c).alias("n_words"), T.approx_tokens(c, F.coalesce("language_detected", F.lit("und"))).cast("int").alias("tokens"))


_TRIM = r"'^[ \t\r\n\f\x0b]+|[ \t\r\n\f\x0b]+$', '', 'g'"
_BLOCKS = rf"""WITH l AS (SELECT policy_doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM policy_documents WHERE text IS NOT NULL),
h AS (SELECT *, regexp_extract(line, '{chunking.HEADING}', 1) AS head FROM l),
g AS (SELECT *, sum(CASE WHEN length(head) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY policy_doc_id ORDER BY n) AS k FROM h),
b AS (SELECT policy_doc_id, k, coalesce(max(CASE WHEN length(head) > 0 THEN head END), '') AS heading, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE length(head) = 0), ''), {_TRIM}) AS body FROM g GROUP BY ALL)"""


@query(_BLOCKS + " SELECT policy_doc_id, CAST(row_number() OVER (PARTITION BY policy_doc_id ORDER BY k) - 1 AS INTEGER) AS block_no, heading, md5(body) AS body_md5 FROM b WHERE body <> ''")
def heading_blocks(spark, d):
    return chunking.heading_blocks(docs(spark, d), "policy_doc_id", "text").select("policy_doc_id", "block_no", "heading", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query(
    r"""SELECT policy_doc_id, CAST(len(s) AS INTEGER) AS n_sentences, CAST(list_max([length(x) FOR x IN s]) AS INTEGER) AS longest FROM (
    SELECT policy_doc_id, list_filter(string_split(regexp_replace(text, '([.!?。！？])[ \t\r\n\f\x0b]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM policy_documents WHERE text IS NOT NULL)"""
)
def sentence_split(spark, d):
    s = T.sentences(F.col("text"))
    return docs(spark, d).where("text is not null").select("policy_doc_id", F.size(s).alias("n_sentences"), F.array_max(F.transform(s, F.length)).alias("longest"))


_SENTENCES = r"list_filter(string_split(regexp_replace({c}, '([.!?。！？])[ \t\r\n\f\x0b]+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_JOIN = "CASE WHEN acc.b = '' THEN x.s ELSE acc.b || ' ' || x.s END"
_fits = f"(acc.b = '' OR {_tokens('(' + _JOIN + ')', 'x.lang')} <= {chunking.MOST})"
#: A paragraph too long, its sentences joined up to the limit: what a fold over them has closed, and what is left open.
_PIECES = f"""list_reduce([{{'o': []::VARCHAR[], 'b': '', 's': y, 'lang': lang}} FOR y IN {_SENTENCES.format(c='p')}],
    lambda acc, x: {{'o': CASE WHEN {_fits} THEN acc.o ELSE list_append(acc.o, acc.b) END, 'b': CASE WHEN {_fits} THEN {_JOIN} ELSE x.s END, 's': '', 'lang': x.lang}}, {{'o': []::VARCHAR[], 'b': '', 's': '', 'lang': lang}})"""
_chunk = lambda h, parts, t: f"{{'h': {h}, 'parts': {parts}, 't': {t}}}"
_none = "[]::STRUCT(h VARCHAR, parts VARCHAR[], t INTEGER)[]"
_full = f"(acc.n + x.t > {chunking.TARGET} AND acc.n >= {chunking.LEAST})"
_flushed = f"list_append(acc.o, {_chunk('x.h', 'acc.b', 'acc.n')})"
_joined = f"""{{'o': CASE WHEN x.a THEN list_append(CASE WHEN acc.n > 0 THEN {_flushed} ELSE acc.o END, {_chunk('x.h', '[x.s]', 'x.t')}) WHEN {_full} THEN {_flushed} ELSE acc.o END,
    'b': CASE WHEN x.a THEN []::VARCHAR[] WHEN {_full} THEN [x.s] ELSE list_append(acc.b, x.s) END, 'n': CASE WHEN x.a THEN 0 WHEN {_full} THEN x.t ELSE acc.n + x.t END}}"""
_closed = f"CASE WHEN s.n >= {chunking.LEAST} THEN list_append(s.o, {_chunk('x.h', 's.b', 's.n')}) WHEN s.n > 0 AND len(s.o) > 0 THEN list_append(s.o[:-2], {_chunk('s.o[-1].h', 's.o[-1].parts || s.b', 's.o[-1].t + s.n')}) ELSE s.o END"
_unit = lambda o, b, n, rest: f"{{'o': {o}, 'b': {b}, 'n': {n}, {rest}}}"
_same = "'h': x.h, 's': x.s, 't': x.t, 'a': x.a, 'l': x.l"


@query(
    _BLOCKS
    + rf""",
lg AS (SELECT b.policy_doc_id, k, heading, body, coalesce(d.language_detected, 'und') AS lang FROM b JOIN policy_documents d USING (policy_doc_id) WHERE body <> ''),
pp AS (SELECT policy_doc_id, k, heading, lang, unnest(ps) AS p, generate_subscripts(ps, 1) AS j FROM (SELECT *, [regexp_replace(y, {_TRIM}) FOR y IN string_split_regex(body, '\n[ \t\r\f\x0b]*\n[ \t\r\f\x0b\n]*') IF regexp_replace(y, {_TRIM}) <> ''] AS ps FROM lg)),
pt AS (SELECT *, {_tokens('p', 'lang')} AS t FROM pp),
pl AS (SELECT policy_doc_id, k, heading, lang, j, t > {chunking.MOST} AS alone, p, CASE WHEN t > {chunking.MOST} THEN {_PIECES} END AS f FROM pt),
us AS (SELECT policy_doc_id, k, heading, lang, j, alone, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT *, CASE WHEN NOT alone THEN [p] WHEN f.b = '' THEN f.o ELSE list_append(f.o, f.b) END AS ss FROM pl)),
uf AS (SELECT *, CAST({_tokens('s', 'lang')} AS INTEGER) AS t, lead(k) OVER (PARTITION BY policy_doc_id ORDER BY k, j, i) IS DISTINCT FROM k AS l FROM us),
ul AS (SELECT policy_doc_id, list({_unit(_none, '[]::VARCHAR[]', '0', "'h': heading, 's': s, 't': t, 'a': alone, 'l': l")} ORDER BY k, j, i) AS u FROM uf GROUP BY policy_doc_id),
uo AS (SELECT policy_doc_id, list_reduce(u, lambda acc, x: list_transform([{_joined}], lambda s: {_unit(f'CASE WHEN x.l THEN {_closed} ELSE s.o END', 'CASE WHEN x.l THEN []::VARCHAR[] ELSE s.b END', 'CASE WHEN x.l THEN 0 ELSE s.n END', _same)})[1],
    {_unit(_none, '[]::VARCHAR[]', '0', "'h': '', 's': '', 't': 0, 'a': false, 'l': false")}).o AS o FROM ul)
SELECT policy_doc_id, CAST(seq - 1 AS INTEGER) AS seq, c.h AS heading, CAST(len(c.parts) AS INTEGER) AS n_parts, c.t AS tokens, md5(array_to_string(c.parts, chr(10) || chr(10))) AS text_md5 FROM (SELECT policy_doc_id, unnest(o) AS c, generate_subscripts(o, 1) AS seq FROM uo)"""
)
def pack_chunks(spark, d):
    """Greedy chunks of all documents; held against a plain loop in the tests as well."""
    return chunking.pack_documents(docs(spark, d), "policy_doc_id", "text", "language_detected").select("policy_doc_id", "seq", "heading", "n_parts", "tokens", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_core = "(" + " OR ".join(f"contains(lower(text), '{t}')" for t in CORE_TERMS) + ")"


@query(f"SELECT policy_doc_id, coalesce({_core}, false) AS core FROM policy_documents")
def core_term_filter(spark, d):
    return docs(spark, d).select("policy_doc_id", T.any_term(F.col("text")).alias("core"))


_hits = " ".join(f"WHEN '{k}' THEN len(list_filter({_arr(v)}, lambda t: contains(lower(text), t)))" for k, v in TERMS.items())


@query(f"SELECT policy_doc_id, CAST(coalesce(CASE language_detected {_hits} ELSE 0 END, 0) AS INTEGER) AS n_terms, coalesce(coalesce(CASE language_detected {_hits} ELSE 0 END, 0) >= 2 AND {_core}, false) AS passes FROM policy_documents")
def keyword_density(spark, d):
    terms = by_lang(F.col("language_detected"), TERMS)
    return docs(spark, d).select("policy_doc_id", F.coalesce(F.when(F.col("text").isNotNull(), T.distinct_terms(F.col("text"), terms)), F.lit(0)).alias("n_terms"), T.keyword_dense(F.col("text"), terms, F.lit(2)).alias("passes"))


_url_words = sorted({w for v in URL_WORDS.values() for w in v})


@query(f"""SELECT policy_doc_id, coalesce({' OR '.join(f"contains(lower(url), '{w}')" for w in _url_words)}, false) AS url_passes, coalesce(extension = 'pdf' AND ({' OR '.join(f"contains(lower(url), '{w}')" for w in [*_url_words, 'ai'])}), false) AS pdf_passes FROM policy_documents""")
def url_keywords(spark, d):
    u = F.col("url")
    return docs(spark, d).select("policy_doc_id", T.any_term(u, _url_words).alias("url_passes"), F.coalesce((F.col("extension") == "pdf") & T.any_term(u, [*_url_words, "ai"]), F.lit(False)).alias("pdf_passes"))


_CHUNKS = "(SELECT DISTINCT chunk_id, institution_id, region, text, approx_tokens, n_words, sha256_chunk FROM policy_chunks)"


def chunks(spark, d) -> DataFrame:
    """Passages without identical repeats."""
    return table(spark, d, "policy_chunks").select("chunk_id", "institution_id", "region", "text", "approx_tokens", "n_words", "sha256_chunk").distinct()


@query(f"SELECT * EXCLUDE (r) FROM (SELECT institution_id, chunk_id, sha256_chunk, approx_tokens, CAST(row_number() OVER (PARTITION BY institution_id ORDER BY approx_tokens DESC NULLS LAST, chunk_id, sha256_chunk) AS INTEGER) AS rank_, 0 AS r FROM {_CHUNKS}) WHERE rank_ <= 12")
def chunk_cap_topk(spark, d):
    """The twelve largest passages of an institution; Spark cuts each partition to twelve before it shuffles."""
    w = Window.partitionBy("institution_id").orderBy(F.desc_nulls_last("approx_tokens"), "chunk_id", "sha256_chunk")
    return chunks(spark, d).select("institution_id", "chunk_id", "sha256_chunk", "approx_tokens", F.row_number().over(w).alias("rank_")).where("rank_ <= 12")


_mod = lambda c, n: f"list_reduce([strpos('0123456789abcdef', x) - 1 FOR x IN string_split({c}, '') IF x <> ''], lambda a, h: (a * 16 + h) % {n}, 0)"


@query(f"SELECT chunk_id, sha256(coalesce(text, '')) AS sha, CAST({_mod('sha256(coalesce(text, $$$$))', 8)} AS INTEGER) AS shard8, CAST({_mod('sha256(coalesce(text, $$$$))', 7)} AS INTEGER) AS shard7 FROM {_CHUNKS}")
def shard_assignment(spark, d):
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    return chunks(spark, d).select("chunk_id", sha.alias("sha"), T.hex_mod(sha, 8).alias("shard8"), T.hex_mod(sha, 7).alias("shard7"))


@query(f"SELECT CAST({_mod('sha256(coalesce(text, $$$$))', 8)} AS INTEGER) AS shard, count(*) AS n_chunks, count(DISTINCT institution_id) AS n_institutions, count(DISTINCT region) AS n_regions FROM {_CHUNKS} GROUP BY ALL")
def shard_balance(spark, d):
    shard = T.hex_mod(F.sha2(F.coalesce("text", F.lit("")), 256), 8)
    return chunks(spark, d).groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("institution_id").alias("n_institutions"), F.countDistinct("region").alias("n_regions"))


@query("SELECT policy_doc_id, printf('%s_%s_%03d', coalesce(institution_id, ''), left(coalesce(nullif(sha256, ''), sha256(url)), 8), 0) AS first_chunk_id, left(sha256(url), 32) AS cache_key, coalesce(nullif(sha256, ''), sha256(url)) AS archive_id FROM policy_documents")
def chunk_ids(spark, d):
    archive = T.archive_id(F.col("sha256"), F.lit(None).cast("string"), F.col("url"))
    return docs(spark, d).select("policy_doc_id", T.chunk_id(F.coalesce("institution_id", F.lit("")), archive, F.lit(0)).alias("first_chunk_id"), F.substring(F.sha2("url", 256), 1, 32).alias("cache_key"), archive.alias("archive_id"))


def pages(spark, d) -> DataFrame:
    """Documents as raw pages."""
    html = F.concat(
        F.lit('<html><head><META http-equiv="x" content="text/html; charset=UTF-8"><title> '), F.coalesce("title", F.lit("")), F.lit('</title><style>p { margin: 0 }</style><script>var a = "<p>";</script></head><body><nav><a href="/home">Home</a></nav><p>'),
        F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("</p><p>")), F.lit('</p><a class="x" href="'), F.coalesce("url", F.lit("")), F.lit('&amp;v=1">'), F.coalesce("title", F.lit("policy")), F.lit('</a> <a href="https://other.example/ai-policy">AI policy</a><footer>Imprint</footer></body></html>'),
    )
    return docs(spark, d).select("policy_doc_id", "url", html.alias("html"))


_PAGES = """pages AS (SELECT policy_doc_id, url, '<html><head><META http-equiv="x" content="text/html; charset=UTF-8"><title> ' || coalesce(title, '') || '</title><style>p { margin: 0 }</style><script>var a = "<p>";</script></head><body><nav><a href="/home">Home</a></nav><p>' ||
replace(coalesce(text, ''), chr(10), '</p><p>') || '</p><a class="x" href="' || coalesce(url, '') || '&amp;v=1">' || coalesce(title, 'policy') || '</a> <a href="https://other.example/ai-policy">AI policy</a><footer>Imprint</footer></body></html>' AS html FROM policy_documents)"""
_strip = lambda c, blocks: (lambda x: f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'gs'), '{WS}', ' ', 'g'), ' ')")(__import__("functools").reduce(lambda a, b: f"regexp_replace({a}, '<{b}[^>]*>.*?</{b}>', ' ', 'gis')", blocks, c))


@query(f"WITH {_PAGES} SELECT policy_doc_id, md5({_strip('html', ['script', 'style'])}) AS text_md5, md5({_strip('html', ['script', 'style', 'nav', 'footer'])}) AS main_md5 FROM pages")
def html_to_text(spark, d):
    md5 = lambda c: F.md5(c.cast("binary"))
    return pages(spark, d).select("policy_doc_id", md5(T.html_text(F.col("html"))).alias("text_md5"), md5(T.html_text(F.col("html"), furniture=True)).alias("main_md5"))


@query(f"""WITH {_PAGES} SELECT policy_doc_id, nullif(trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), ' '), '') AS title, coalesce(nullif(lower(regexp_extract(left(html, 4096), '<meta[^>]+charset=["'']?([A-Za-z0-9_-]+)', 1, 'i')), ''), 'utf-8') AS charset FROM pages""")
def html_title_charset(spark, d):
    return pages(spark, d).select("policy_doc_id", T.html_title(F.col("html")).alias("title"), T.html_charset(F.col("html")).alias("charset"))


_A = r"""'<a\s+[^>]*href="([^"#?]+)"[^>]*>([^<]{1,200})</a>'"""
_score = lambda c: " + ".join(f"CAST(contains({c}, '{w}') AS INTEGER)" for w in ("policy", "ai", "guid", "integrity"))


@query(
    f"""WITH {_PAGES}, a AS (SELECT policy_doc_id, unnest(regexp_extract_all(html, {_A}, 1, 'i')) AS href, unnest(regexp_extract_all(html, {_A}, 2, 'i')) AS label FROM pages),
    s AS (SELECT policy_doc_id, href, label, {_score("lower(regexp_replace(href, '^[a-z]+://[^/]*', '') || ' ' || label)")} AS score FROM a)
    SELECT policy_doc_id, href, label, CAST(score AS INTEGER) AS score FROM s WHERE score > 0 AND length(href) <= 300"""
)
def anchor_links_scored(spark, d):
    a = pages(spark, d).select("policy_doc_id", F.explode(T.anchors(F.col("html"))).alias("x")).select("policy_doc_id", F.col("x").getField("href").alias("href"), F.col("x").getField("label").alias("label"))
    target = F.lower(F.concat(F.regexp_replace("href", "^[a-z]+://[^/]*", ""), F.lit(" "), F.col("label")))
    score = sum((F.contains(target, F.lit(w)).cast("int") for w in ("policy", "ai", "guid", "integrity")), F.lit(0))
    return a.withColumn("score", score).where("score > 0 and length(href) <= 300")


@query(
    f"""WITH {_PAGES}, a AS (SELECT policy_doc_id, unnest(regexp_extract_all(html, {_A}, 1, 'i')) AS href, unnest(regexp_extract_all(html, {_A}, 2, 'i')) AS label FROM pages),
    s AS (SELECT DISTINCT policy_doc_id, href, label, {_score("lower(regexp_replace(href, '^[a-z]+://[^/]*', '') || ' ' || label)")} AS score FROM a)
    SELECT policy_doc_id, href, label, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY policy_doc_id ORDER BY score DESC, href, label) AS INTEGER) AS place FROM s WHERE score > 0 AND length(href) <= 300 QUALIFY place <= 20"""
)
def top_links(spark, d):
    """The twenty best links of a page, each once."""
    w = Window.partitionBy("policy_doc_id").orderBy(F.desc("score"), "href", "label")
    return anchor_links_scored(spark, d).distinct().withColumn("place", F.row_number().over(w)).where("place <= 20")


_HOST = lambda c: rf"regexp_replace(lower(regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\.', '')"


@query(
    f"""WITH {_PAGES}, l AS (SELECT policy_doc_id, {_HOST('url')} AS base, unnest(list_distinct([replace(u, '&amp;', '&') FOR u IN regexp_extract_all(html, 'href="(https?://[^"#?]+)"', 1)])) AS link FROM pages)
    SELECT policy_doc_id, link, {_HOST('link')} = base OR {_HOST('link')} LIKE '%.' || base AS onsite FROM l WHERE base <> ''"""
)
def onsite_links(spark, d):
    l = pages(spark, d).select("policy_doc_id", T.host(F.col("url")).alias("base"), F.explode(T.absolute_links(F.col("html"))).alias("link")).where("base <> ''")
    h = T.host(F.col("link"))
    return l.select("policy_doc_id", "link", ((h == F.col("base")) | h.endswith(F.concat(F.lit("."), F.col("base")))).alias("onsite"))


@query(f"SELECT {_HOST('url')} AS host, count(*) AS n_docs, count(DISTINCT institution_id) AS n_institutions FROM policy_documents WHERE url IS NOT NULL GROUP BY ALL")
def url_host(spark, d):
    return docs(spark, d).where("url is not null").groupBy(T.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("institution_id").alias("n_institutions"))


_LIT = lambda m: "MAP {" + ", ".join(f"'{k}': {_arr(v)}" for k, v in m.items()) + "}"


@query(
    sql(
        f"""SELECT institution_id, lang, query, CAST(row_number() OVER (PARTITION BY institution_id ORDER BY lp, qp) AS INTEGER) AS place FROM (
    SELECT institution_id, lang, lp, unnest(qs) AS query, generate_subscripts(qs, 1) AS qp, nl FROM (
    SELECT institution_id, lang, lp, nl, coalesce({_LIT(QUERIES)}[lang], []) AS qs FROM (
    SELECT institution_id, unnest(langs) AS lang, generate_subscripts(langs, 1) AS lp, len(langs) AS nl FROM (
    SELECT institution_id, list_concat([first_], [x FOR x IN list_distinct_ordered IF x <> first_]) AS langs FROM (
    SELECT institution_id, coalesce(language_primary, '') AS first_, [trim(x, ' ') FOR x IN string_split(coalesce(language_secondary, ''), '+') IF trim(x, ' ') <> ''] AS list_distinct_ordered FROM inst))))) WHERE qp <= greatest(2, 6 // nl)"""
    )
)
def lang_query_plan(spark, d):
    """Search queries of an institution: its languages in order, of each a share of six queries, two at least."""
    first = F.coalesce("language_primary", F.lit(""))
    langs = F.concat(F.array(first), F.filter(T.secondary_languages(F.coalesce("language_secondary", F.lit(""))), lambda x: x != first))
    rows = institutions(spark, d).select("institution_id", langs.alias("langs")).select("institution_id", F.size("langs").alias("nl"), F.posexplode("langs").alias("lp", "lang"))
    rows = rows.select("institution_id", "nl", "lp", "lang", F.posexplode(by_lang(F.col("lang"), QUERIES)).alias("qp", "query")).where(F.col("qp") < F.greatest(F.lit(2), F.floor(F.lit(6) / F.col("nl"))))
    return rows.select("institution_id", "lang", "query", F.row_number().over(Window.partitionBy("institution_id").orderBy("lp", "qp")).alias("place"))


def _first_five() -> str:
    from .catalog import oracle_of

    return f"SELECT institution_id, string_agg(query, '; ' ORDER BY place) AS queries, CAST(max(place) AS INTEGER) AS n FROM ({oracle_of('lang_query_plan')}) WHERE place <= 5 GROUP BY ALL"


@query(_first_five())
def first_queries(spark, d):
    """The first five queries of an institution, in order."""
    rows = lang_query_plan(spark, d).where("place <= 5").groupBy("institution_id").agg(F.sort_array(F.collect_list(F.struct("place", "query"))).alias("q"))
    return rows.select("institution_id", F.array_join("q.query", "; ").alias("queries"), F.size("q").alias("n"))


_probe = _arr(PROBE_PATHS)


@query(
    sql(
        f"""SELECT institution_id, url, CAST(source AS INTEGER) AS source, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY institution_id, url ORDER BY source, place) AS k FROM (
        SELECT institution_id, policy_search_url AS url, 0 AS source, 0 AS place FROM institutions WHERE institution_id IN (SELECT institution_id FROM inst) AND length(policy_search_url) > 0
        UNION ALL SELECT institution_id, regexp_replace(website, '/+$', '') || unnest({_probe}), 1, generate_subscripts({_probe}, 1) - 1 FROM inst WHERE website LIKE 'http%'
        UNION ALL SELECT institution_id, url, 2, 0 FROM archive_sidecars WHERE institution_id IN (SELECT institution_id FROM inst) AND url IS NOT NULL)) WHERE k = 1"""
    )
)
def candidate_union_dedupe(spark, d):
    """Candidate URLs of an institution: known ones, probed paths, archived ones; each once, where it comes first.

    ``source`` and ``place`` give the order. A rank over all would put a large institution into one task.
    """
    inst = institutions(spark, d)
    ids = inst.select("institution_id")
    seeds = table(spark, d, "institutions").where(F.length("policy_search_url") > 0).join(ids, "institution_id", "left_semi").select("institution_id", F.col("policy_search_url").alias("url"), F.lit(0).alias("source"), F.lit(0).alias("place"))
    probed = inst.where(F.col("website").startswith("http")).select("institution_id", F.posexplode(T.probe_urls(F.col("website"))).alias("place", "url")).select("institution_id", "url", F.lit(1).alias("source"), "place")
    archived = table(spark, d, "archive_sidecars").where("url is not null").join(ids, "institution_id", "left_semi").select("institution_id", "url", F.lit(2).alias("source"), F.lit(0).alias("place"))
    first = seeds.unionByName(probed).unionByName(archived).groupBy("institution_id", "url").agg(F.min(F.struct("source", "place")).alias("x"))
    return first.select("institution_id", "url", "x.source", "x.place")


# --- coder responses --------------------------------------------------------------------------------------------


def responses(spark, d) -> DataFrame:
    """Raw answers: fenced JSON of good codings, the raw text of failed ones."""
    part = lambda group, names: F.concat(*[x for k, n in enumerate(names) for x in (F.lit(("," if k else "") + f'"{n}":'), F.coalesce(F.col(f"{group}.{n}").cast("string"), F.lit("null")))])
    body = F.concat(F.lit('Here it is:\n```json\n{"themes":{'), part("themes", THEMES), F.lit('},"sentiment":{'), part("sentiment", USES), F.lit('},"confidence":"'), F.coalesce("confidence", F.lit("?")), F.lit('"}\n```'))
    return table(spark, d, "coded_chunks").select("chunk_id", "model_name", F.when(F.col("ok") & F.col("themes").isNotNull(), body).otherwise(F.coalesce("error_info.raw", F.lit(""))).alias("raw")).distinct()


_part = lambda group, names: " || ".join(f"""'{"," if k else ""}"{n}":' || coalesce(CAST({group}.{n} AS VARCHAR), 'null')""" for k, n in enumerate(names))
_RESP = f"""r0 AS (SELECT DISTINCT chunk_id, model_name, CASE WHEN ok AND themes IS NOT NULL THEN 'Here it is:' || chr(10) || '```json' || chr(10) || '{{"themes":{{' || {_part('themes', THEMES)} || '}},"sentiment":{{' || {_part('sentiment', USES)} || '}},"confidence":"' || coalesce(confidence, '?') || '"}}' || chr(10) || '```' ELSE coalesce(error_info.raw, '') END AS raw FROM coded_chunks),
r1 AS (SELECT *, regexp_extract(raw, '\\{{.+\\}}', 0, 's') AS body FROM r0),
r2 AS MATERIALIZED (SELECT *, body <> '' AND json_valid(body) AS valid, CASE WHEN body <> '' AND json_valid(body) THEN body ELSE '{{}}' END AS j FROM r1)"""
_get = lambda p: f"json_extract_string(j, '$.{p}')"


@query(
    f"""WITH {_RESP} SELECT chunk_id, model_name, md5(raw) AS raw_md5, CASE WHEN NOT valid THEN 'json_parse_failed' WHEN json_type(j, '$.themes') IS DISTINCT FROM 'OBJECT' THEN 'missing_themes'
    {' '.join(f"WHEN coalesce({_get('themes.' + t)}, 'x') NOT IN ('0', '1') THEN 'bad_theme_value'" for t in THEMES)} WHEN json_type(j, '$.sentiment') IS DISTINCT FROM 'OBJECT' THEN 'missing_sentiment'
    {' '.join(f"WHEN coalesce({_get('sentiment.' + u)}, 'x') NOT IN ('-2', '-1', '0', '1', '2') THEN 'bad_sentiment_value'" for u in USES)} END AS error,
    CASE WHEN NOT valid OR json_type(j, '$.themes') IS DISTINCT FROM 'OBJECT' THEN NULL
    {' '.join(f"WHEN coalesce({_get('themes.' + t)}, 'x') NOT IN ('0', '1') THEN '{t}'" for t in THEMES)} WHEN json_type(j, '$.sentiment') IS DISTINCT FROM 'OBJECT' THEN NULL
    {' '.join(f"WHEN coalesce({_get('sentiment.' + u)}, 'x') NOT IN ('-2', '-1', '0', '1', '2') THEN '{u}'" for u in USES)} END AS key,
    CASE WHEN valid THEN coalesce({_get('notes')}, '') END AS notes, CASE WHEN valid THEN {_get('chunk_id')} IS DISTINCT FROM chunk_id END AS id_overridden,
    CASE WHEN valid THEN CASE WHEN {_get('confidence')} IN ('low', 'medium', 'high') THEN {_get('confidence')} ELSE 'medium' END END AS confidence FROM r2"""
)
def coder_json_validate(spark, d):
    """The first fault of every raw answer and the field it is in, null if it is good.

    Odd confidence becomes medium, missing notes become empty, and a chunk_id
    other than the passage's is overridden. Values other than plain integers
    are faults: nothing is left that could raise while it is checked.
    """
    rows = responses(spark, d).withColumn("body", F.regexp_extract("raw", r"(?s)\{.+\}", 0))
    rows = rows.withColumn("valid", (F.col("body") != "") & F.expr("try_parse_json(body) is not null"))
    get = lambda p: F.get_json_object("body", f"$.{p}")
    is_object = lambda p: F.coalesce(get(p).startswith("{"), F.lit(False))
    fault = lambda name, key=None: F.struct(F.lit(name).alias("error"), F.lit(key).cast("string").alias("key"))
    first = F.when(~F.col("valid"), fault("json_parse_failed")).when(~is_object("themes"), fault("missing_themes"))
    for t in THEMES:
        first = first.when(~F.coalesce(get(f"themes.{t}"), F.lit("x")).isin("0", "1"), fault("bad_theme_value", t))
    first = first.when(~is_object("sentiment"), fault("missing_sentiment"))
    for u in USES:
        first = first.when(~F.coalesce(get(f"sentiment.{u}"), F.lit("x")).isin("-2", "-1", "0", "1", "2"), fault("bad_sentiment_value", u))
    notes = F.when(F.col("valid"), F.coalesce(get("notes"), F.lit("")))
    overridden = F.when(F.col("valid"), ~get("chunk_id").eqNullSafe(F.col("chunk_id")))
    confidence = F.when(F.col("valid"), F.when(get("confidence").isin("low", "medium", "high"), get("confidence")).otherwise("medium"))
    return rows.select("chunk_id", "model_name", F.md5(F.col("raw").cast("binary")).alias("raw_md5"), first.alias("x"), notes.alias("notes"), overridden.alias("id_overridden"), confidence.alias("confidence")).select("chunk_id", "model_name", "raw_md5", "x.error", "x.key", "notes", "id_overridden", "confidence")


#: A codebook of two worked examples, as it is kept in a file.
CODEBOOK = """# Codebook

## System prompt
```
You are a careful coder.
```

### Example 1: a rule on disclosure
```
TEXT
"Students acknowledge every use of generative AI."
EXPECTED OUTPUT
{"themes": {"T5_disclosure": 1}, "confidence": "high"}
```

### Example 2: not about the topic
```
TEXT
Parking permits end in May.
EXPECTED OUTPUT
nothing to code
```
"""
_PROMPT = """concat_ws(chr(10), 'Below are 16 example codings, followed by the chunk you must code.', 'Output one JSON object only.', '',
'EXAMPLE 1', 'Text: Students acknowledge every use of generative AI.', 'Expected: {"themes": {"T5_disclosure": 1}, "confidence": "high"}', '', 'EXAMPLE 2', 'Text: Parking permits end in May.', 'Expected: nothing to code', '',
'NOW CODE THE FOLLOWING:', 'University: ' || coalesce(institution_name, '?') || ' (' || coalesce(region, '?') || ', tier ' || coalesce(tier, '?') || ')',
'Document section: ' || coalesce(section_header, 'unknown'), 'Original language: ' || coalesce(language_declared, '?'), 'Chunk ID: ' || coalesce(chunk_id, '?'), '', 'Text:', left(coalesce(text, ''), 6000), '', 'JSON output only:')"""


@query(f"SELECT chunk_id, md5({_PROMPT}) AS prompt_md5, CAST(length({_PROMPT}) AS INTEGER) AS n_chars FROM policy_chunks")
def prompt_build(spark, d):
    filled = prompt(template(CODEBOOK)[1])
    return table(spark, d, "policy_chunks").select("chunk_id", F.md5(filled.cast("binary")).alias("prompt_md5"), F.length(filled).alias("n_chars"))


@query(f"SELECT chunk_id, md5('<|im_start|>system' || chr(10) || 'You are a careful coder.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {_PROMPT} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS chat_md5 FROM policy_chunks")
def chat_template(spark, d):
    system, examples = template(CODEBOOK)
    chat = F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"), prompt(examples), F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    return table(spark, d, "policy_chunks").select("chunk_id", F.md5(chat.cast("binary")).alias("chat_md5"))
