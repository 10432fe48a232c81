"""What goes out and comes in again: files, shards, archives, published tables, and streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..domain import REGIONS, SQL_BASE, THEMES, USES, inst_theme, institutions, sql
from ..functions import text as T
from ..functions.special import Duck, Spark, normal_quantile
from ..session import shared_dir, stage, table
from ..sources import files, web
from ..streaming import ingest
from . import reports
from .agreement import ablation_kappa_rollup, expert_kappa
from .catalog import oracle_of, query
from .corpus import _COLS
from .inference import bh_fdr, holm_pairwise, region_sentiment, region_theme, theme_pairs, tost_theme, wilson_ci
from .resampling import stability_top
from .text import _mod


def place(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed with the session's staged tables."""
    from ..session import _remove_at_exit

    path = f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    _remove_at_exit(spark, path)
    return path


# --- files ----------------------------------------------------------------------------------------------------------

_cells = ", ".join(f"coalesce({c}, '') AS {c}" for c in _COLS)


@query(f"SELECT {_cells} FROM institutions")
def csv_roundtrip(spark, d):
    """The sampling frame as a CSV file, read strictly again: all cells strings, missing ones empty."""
    path = place(spark, "frame")
    files.write_csv(table(spark, d, "institutions"), path, list(_COLS))
    return files.read_csv(spark, path, list(_COLS), strict=True)


@query(f"SELECT region, tier, count(*) AS n FROM (SELECT {_cells} FROM institutions WHERE region IN ('NA', 'EU')) GROUP BY ALL")
def csv_append(spark, d):
    """Two regions appended to one CSV: the header is written once."""
    path, rows = place(spark, "appended"), table(spark, d, "institutions")
    for region in ("NA", "EU"):
        files.append_csv(rows.where(F.col("region") == region), path, list(_COLS))
    return files.read_appended_csv(spark, path, list(_COLS)).groupBy("region", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 0 AS n_rows, '' AS missing WHERE false UNION ALL SELECT 0, 'none'")
def csv_missing(spark, d):
    """A CSV that is not there has no rows."""
    none = files.read_csv(spark, f"{shared_dir(spark)}/lectern/no-such-file.csv", list(_COLS))
    return none.agg(F.count(F.lit(1)).cast("int").alias("n_rows")).select("n_rows", F.lit("none").alias("missing"))


_PASSAGES = "SELECT DISTINCT chunk_id, institution_id, text, approx_tokens FROM policy_chunks"


@query(f"SELECT CAST({_mod('sha256(coalesce(text, $$$$))', 8)} AS INTEGER) AS shard, count(*) AS n, count(DISTINCT chunk_id) AS n_ids, sum(length(text))::BIGINT AS n_chars FROM ({_PASSAGES}) GROUP BY ALL")
def shards_roundtrip(spark, d):
    """Passages as JSON lines in shards by the hash of their text, scanned again."""
    path = place(spark, "shards")
    rows = table(spark, d, "policy_chunks").select("chunk_id", "institution_id", "text", "approx_tokens").distinct()
    files.write_shards(rows, path, T.hex_mod(F.sha2(F.coalesce("text", F.lit("")), 256), 8))
    back = files.read_shards(spark, path, "chunk_id string, institution_id string, text string, approx_tokens int")
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("n_ids"), F.sum(F.length("text")).alias("n_chars"))


@query(
    f"""SELECT reader, n, n_bad FROM (SELECT 'keep' AS reader, count(*) AS n, sum(CAST(left(md5(chunk_id), 1) = '0' AS INTEGER))::BIGINT AS n_bad FROM ({_PASSAGES} WHERE chunk_id IS NOT NULL)
    UNION ALL SELECT 'drop', sum(CAST(left(md5(chunk_id), 1) <> '0' AS INTEGER))::BIGINT, 0 FROM ({_PASSAGES} WHERE chunk_id IS NOT NULL))"""
)
def jsonl_broken_lines(spark, d):
    """JSON lines some of which are cut off: kept with a report, or dropped in silence."""
    path, schema = place(spark, "lines"), "chunk_id string, institution_id string, text string, approx_tokens int"
    rows = table(spark, d, "policy_chunks").select("chunk_id", "institution_id", "text", "approx_tokens").distinct().where("chunk_id is not null")
    line = F.to_json(F.struct("chunk_id", "institution_id", "text", "approx_tokens"))
    rows.select(F.when(F.md5("chunk_id").startswith("0"), F.substring(line, 1, 12)).otherwise(line)).write.text(path)
    kept = stage(files.read_jsonl(spark, path, schema, bad="keep"), "kept-lines").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_corrupt").isNotNull().cast("bigint")).alias("n_bad"))
    dropped = files.read_jsonl(spark, path, schema, bad="drop").where("chunk_id is not null").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("n_bad"))
    return kept.select(F.lit("keep").alias("reader"), "*").unionByName(dropped.select(F.lit("drop").alias("reader"), "*"))


@query(sql("SELECT region, tier, count(*) AS n FROM inst GROUP BY ALL"))
def json_document(spark, d):
    """A report as JSON with a key a line, read as documents."""
    path = place(spark, "document")
    files.write_json(institutions(spark, d).groupBy("region", "tier").agg(F.count(F.lit(1)).alias("n")), path)
    return files.read_json(spark, path, "region string, tier string, n bigint")


@query("SELECT model_name AS condition, count(*) AS n, count(DISTINCT chunk_id) AS n_chunks FROM coded_chunks WHERE ok AND model_name IS NOT NULL GROUP BY ALL")
def conditions_scan(spark, d):
    """Codings in one folder a coder, scanned with the folder's name as their condition."""
    path = place(spark, "conditions")
    table(spark, d, "coded_chunks").where("ok and model_name is not null").select("chunk_id", F.col("model_name").alias("condition"), "ok").write.partitionBy("condition").json(path)
    back = files.read_conditions(spark, path, "chunk_id string, ok boolean", "*.json")
    return back.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("n_chunks"))


@query("SELECT coalesce(region, '') AS region, coalesce(institution_id, '') AS institution_id, CASE WHEN extension = 'pdf' THEN 'pdf' ELSE 'html' END AS kind, count(*) AS n_files, count(DISTINCT sha256(text)) AS n_contents, sum(octet_length(encode(text)))::BIGINT AS n_bytes FROM policy_documents WHERE length(text) > 0 AND ingested_at IS NOT NULL GROUP BY ALL")
def archive_roundtrip(spark, d):
    """Pages written as an archive of contents, sidecars and index, and joined again by file and hash."""
    path = place(spark, "archive")
    kind = F.when(F.col("extension") == "pdf", "application/pdf").otherwise("text/html")
    pages = table(spark, d, "policy_documents").where("length(text) > 0 and ingested_at is not null").select("region", "institution_id", "url", F.col("ingested_at").alias("accessed_at"), kind.alias("content_type"), F.col("text").cast("binary").alias("content"))
    files.write_archive(pages, path)
    back = lambda part: spark.read.option("basePath", f"{path}/{part}")
    side = back("sidecars").schema(f"{files.SIDECAR}, region string, institution_id string").json(f"{path}/sidecars")
    held = back("contents").schema("file string, sha256 string, content binary, region string, institution_id string").parquet(f"{path}/contents").select("sha256", F.octet_length("content").alias("length")).distinct()
    rows = side.join(held, (side.sha256 == held.sha256) & (side.size_bytes == held.length)).select("region", "institution_id", "extension", side.sha256, "size_bytes")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.groupBy(blank("region"), blank("institution_id"), F.col("extension").alias("kind")).agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("sha256").alias("n_contents"), F.sum("size_bytes").alias("n_bytes"))


@query("SELECT count(*) AS n_rows, count(DISTINCT chunk_id) AS n_keys FROM (SELECT DISTINCT chunk_id, model_name, seed, timestamp_utc FROM coded_chunks WHERE ok)")
def publish_manifest(spark, d):
    """A table published in one step, twice, and what its manifest says."""
    path = place(spark, "published")
    rows = table(spark, d, "coded_chunks").where("ok").select("chunk_id", "model_name", "seed", "timestamp_utc").distinct()
    files.publish(rows.limit(0), path, "chunk_id")
    return files.publish(rows, path, "chunk_id").select("n_rows", "n_keys")


@query("SELECT kind, name, seed, country FROM (SELECT 'coder' AS kind, model_name AS name, seed, NULL AS country FROM coder_roster UNION ALL SELECT 'institution', institution_id, NULL, country FROM institutions)")
def union_of_columns(spark, d):
    """Frames of different columns under one header."""
    coders = table(spark, d, "coder_roster").select(F.lit("coder").alias("kind"), F.col("model_name").alias("name"), "seed")
    return files.union_columns(coders, table(spark, d, "institutions").select(F.lit("institution").alias("kind"), F.col("institution_id").alias("name"), "country"))


@query("SELECT 'missing' AS side, 'stars' AS name UNION ALL SELECT 'extra', unnest(['coder_kind', 'seed'])")
def schema_drift(spark, d):
    """Columns that are required and missing, and columns beyond them."""
    missing, extra = files.column_drift(table(spark, d, "coder_roster"), ["model_name", "stars"])
    return spark.createDataFrame([("missing", x) for x in missing] + [("extra", x) for x in extra], "side string, name string")


# --- the frame, the archive and links --------------------------------------------------------------------------------


@query(sql("SELECT kind, value, count(*) AS n FROM (SELECT unnest(['region', 'tier', 'country', 'language']) AS kind, unnest([region, tier, coalesce(country, ''), coalesce(language_primary, '')]) AS value FROM inst) GROUP BY ALL"))
def frame_counts(spark, d):
    """Institutions by region, by tier, by country and by language, in one pass."""
    pair = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.coalesce(c, F.lit("")).alias("value"))
    return institutions(spark, d).select(F.explode(F.array(pair("region", "region"), pair("tier", "tier"), pair("country", "country"), pair("language", "language_primary"))).alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT count(*) AS n_institutions, sum(CAST(n_fetched > 0 AS INTEGER))::BIGINT AS n_archived, sum(CAST(n_fetched = 0 AS INTEGER))::BIGINT AS n_none, sum(n_untyped)::BIGINT AS n_errors FROM (SELECT i.institution_id, count(s.institution_id) AS n_fetched, sum(CASE WHEN s.institution_id IS NOT NULL AND s.content_type IS NULL THEN 1 ELSE 0 END) AS n_untyped FROM inst i LEFT JOIN archive_sidecars s USING (institution_id) GROUP BY ALL)"))
def scrape_totals(spark, d):
    """Institutions with and without archived pages, and fetches whose answer had no type."""
    per = table(spark, d, "archive_sidecars").groupBy("institution_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("content_type").isNull().cast("bigint")).alias("untyped"))
    both = institutions(spark, d).select("institution_id").join(per, "institution_id", "left").na.fill(0, ["n", "untyped"])
    return both.agg(F.count(F.lit(1)).alias("n_institutions"), F.sum((F.col("n") > 0).cast("bigint")).alias("n_archived"), F.sum((F.col("n") == 0).cast("bigint")).alias("n_none"), F.sum("untyped").alias("n_errors"))


@query(sql("SELECT s.institution_id, coalesce(i.name, s.institution_id) AS name, coalesce(i.region, 'unknown') AS region, coalesce(i.tier, 'unknown') AS tier, count(*) AS n FROM archive_sidecars s LEFT JOIN inst i USING (institution_id) GROUP BY ALL"))
def archive_with_frame(spark, d):
    """Archived fetches with their institution; one that the frame does not know gets a row of defaults."""
    n = table(spark, d, "archive_sidecars").groupBy("institution_id").agg(F.count(F.lit(1)).alias("n"))
    some = lambda c, other: F.coalesce(F.col(c), other).alias(c)
    return n.join(institutions(spark, d).select("institution_id", "name", "region", "tier"), "institution_id", "left").select("institution_id", some("name", F.col("institution_id")), some("region", F.lit("unknown")), some("tier", F.lit("unknown")), "n")


@query(sql("SELECT institution_id, CAST(len(urls) AS INTEGER) AS n_urls, urls[1] AS first_url FROM (SELECT institution_id, list_sort(list(DISTINCT url)) AS urls FROM (SELECT institution_id, url FROM archive_sidecars UNION ALL SELECT institution_id, policy_search_url FROM institutions) WHERE length(url) > 0 AND length(institution_id) > 0 GROUP BY ALL)"))
def seed_urls(spark, d):
    """All seed URLs of an institution, each once; a list of a few known addresses, not of its pages."""
    rows = table(spark, d, "archive_sidecars").select("institution_id", "url").unionByName(table(spark, d, "institutions").select("institution_id", F.col("policy_search_url").alias("url")))
    rows = rows.where("length(url) > 0 and length(institution_id) > 0").distinct()
    return rows.groupBy("institution_id").agg(F.count(F.lit(1)).cast("int").alias("n_urls"), F.min("url").alias("first_url"))


IDS = ("us001", "de001", "br001", "no-such-id")


@query(f"SELECT institution_id, count(*) AS n FROM policy_documents WHERE institution_id IN {IDS} GROUP BY ALL")
def documents_of_institutions(spark, d):
    """Documents of the institutions on a list; the filter reaches the scan."""
    return table(spark, d, "policy_documents").where(F.col("institution_id").isin(*IDS)).groupBy("institution_id").agg(F.count(F.lit(1)).alias("n"))


_LINKS = ["../a/b?x=1", "./c", "/d/../e", "?q=2", "#top", "//cdn.example/x", "f/g.html", "", "https://other.example/z"]


@query()
def joined_links(spark, d):
    """Links of every kind against each page's address; held against the standard library in the tests."""
    rows = table(spark, d, "policy_documents").where("url is not null").select("url").distinct()
    return rows.select("url", F.explode(F.array(*map(F.lit, _LINKS))).alias("href")).withColumn("target", web.absolute(F.col("url"), F.col("href")))


@query("SELECT institution_id, CAST(list_unique(urls) AS INTEGER) AS n_urls, list_min(urls) AS first_url FROM (SELECT institution_id, list(url) AS urls FROM archive_sidecars WHERE length(url) > 0 AND institution_id IS NOT NULL GROUP BY ALL)")
def search_answers(spark, d):
    """JSON answers of a search service, one an institution, and the links read out of them."""
    rows = table(spark, d, "archive_sidecars").where("length(url) > 0 and institution_id is not null").select("institution_id", "url").distinct()
    # an answer has as many hits as the service sends; here the stored ones
    answers = rows.groupBy("institution_id", F.expr("pmod(xxhash64(url), 64)").alias("page")).agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct("url")).alias("value")).alias("webPages"))).alias("answer"))
    return answers.select("institution_id", F.explode(web.answer_links(F.col("answer"))).alias("url")).groupBy("institution_id").agg(F.countDistinct("url").cast("int").alias("n_urls"), F.min("url").alias("first_url"))


@query(
    """WITH q AS (SELECT institution_id, url, extension, min(accessed_at) AS at_ FROM archive_sidecars WHERE institution_id IS NOT NULL AND url IS NOT NULL AND extension IS NOT NULL AND accessed_at IS NOT NULL GROUP BY ALL),
    f AS (SELECT institution_id, url, arg_min(extension, at_ || extension) AS extension FROM q GROUP BY ALL), n AS (SELECT institution_id, extension, count(*) AS n FROM f GROUP BY ALL),
    a AS (SELECT DISTINCT institution_id, extension, CASE WHEN extension = 'pdf' THEN 503 ELSE 200 END AS status FROM q)
    SELECT institution_id, extension AS query, CASE WHEN status <> 200 THEN -status ELSE coalesce(n, 0) END::BIGINT AS n_new FROM a LEFT JOIN n USING (institution_id, extension)"""
)
def new_urls_by_query(spark, d):
    """What each query of an institution adds; one that failed shows its negative status."""
    hits = table(spark, d, "archive_sidecars").where("institution_id is not null and url is not null and extension is not null and accessed_at is not null").select("institution_id", "url", F.col("extension").alias("query"), F.concat("accessed_at", "extension").alias("place"))
    answers = hits.groupBy("institution_id", "query").agg(F.min("place").alias("place")).withColumn("status", F.when(F.col("query") == "pdf", 503).otherwise(200))
    return web.new_by_query(hits, answers=answers)


@query("SELECT host, count(*) AS n, min(url) AS first_url FROM (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host, url FROM policy_documents WHERE url LIKE 'http%') GROUP BY ALL")
def wrapped_results(spark, d):
    """Pages of search results that wrap their targets, one a document, and the targets on the document's own host."""
    rows = table(spark, d, "policy_documents").where("url like 'http%'").select("url").distinct().withColumn("host", F.regexp_extract("url", "^https?://([^/]+)", 1))
    html = F.concat(*[x for u in (F.col("url"), F.lit("https://elsewhere.example/x"), F.col("url")) for x in (F.lit('<a href="/l/?kh=1&uddg='), F.url_encode(u), F.lit('">x</a>'))])
    found = rows.select("host", F.explode(web.result_links(html, F.col("host"))).alias("url"))
    return found.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("first_url"))


@query("SELECT policy_doc_id, md5(text) AS text_md5 FROM policy_documents WHERE text IS NOT NULL")
def decoded_pages(spark, d):
    """Bytes decoded by the charset that the page names: utf-8 where it names none."""
    from ..session import ship

    ship(spark)
    rows = table(spark, d, "policy_documents").where("text is not null").select("policy_doc_id", F.encode("text", "UTF-8").alias("content"))
    return files.decode_pages(rows).select("policy_doc_id", F.md5(F.col("html").cast("binary")).alias("text_md5"))


@query(
    """WITH l AS (SELECT 'p' || k AS source, 'p' || t AS url, t % 5 AS score FROM (SELECT n_nationkey AS k, unnest([2 * n_nationkey + 1, 2 * n_nationkey + 2]) AS t FROM nation)),
    h1 AS (SELECT url, max(score) AS score FROM l WHERE source IN ('p0', 'p3') GROUP BY url),
    h2 AS (SELECT url, max(score) AS score FROM l WHERE source IN (SELECT url FROM h1 WHERE score < 3) AND url NOT IN (SELECT url FROM h1) GROUP BY url)
    SELECT url, CAST(score AS INTEGER) AS score, 1 AS hop FROM h1 UNION ALL SELECT url, CAST(score AS INTEGER), 2 FROM h2"""
)
def crawl_hops(spark, d):
    """Two hops from two seeds over a stored graph of scored links."""
    k = F.col("n_nationkey").cast("int")
    links = table(spark, d, "nation").select(F.concat(F.lit("p"), k).alias("source"), F.explode(F.array(2 * k + 1, 2 * k + 2)).alias("t")).select("source", F.concat(F.lit("p"), "t").alias("url"), (F.col("t") % 5).alias("score"))
    return web.crawl(spark.createDataFrame([("p0",), ("p3",), ("p0",), (None,)], "url string"), links)


@query(sql("SELECT institution_id FROM (SELECT institution_id FROM inst ORDER BY institution_id LIMIT 50) WHERE institution_id NOT IN (SELECT institution_id FROM archive_sidecars WHERE institution_id IS NOT NULL AND content_type IS NULL)"))
def left_to_do(spark, d):
    """The first fifty institutions without those done already; the limit counts before they are taken out."""
    done = table(spark, d, "archive_sidecars").where("content_type is null")
    return web.pending(institutions(spark, d).select("institution_id"), done, limit=50)


@query("SELECT policy_doc_id, array_to_string(list_filter(regexp_split_to_array(lower(title), '[ \t\n\f\r\x0b,，、；]+'), lambda w: length(w) >= 2), '/') AS words FROM policy_documents WHERE title IS NOT NULL")
def title_words(spark, d):
    """The words of a title as a search query has them."""
    return table(spark, d, "policy_documents").where("title is not null").select("policy_doc_id", F.array_join(T.query_tokens(F.col("title")), "/").alias("words"))


_Q = [0.0, 0.001, 0.01, 0.025, 0.1, 0.3, 0.5, 0.8, 0.95, 0.975, 0.999, 1.0]


@query(f"SELECT p, round({normal_quantile(Duck, 'p')}, 9) AS z FROM (SELECT unnest({_Q})::DOUBLE AS p)")
def normal_quantiles(spark, d):
    """Quantiles of the normal distribution; none at 0 and 1."""
    return spark.createDataFrame([(p,) for p in _Q], "p double").select("p", F.round(F.expr(normal_quantile(Spark, "p")), 9).alias("z"))


_SEEDED = "s AS (SELECT i.institution_id, CASE WHEN bool_or(length(n.policy_search_url) > 0) THEN 'listed' WHEN bool_or(a.institution_id IS NOT NULL) THEN 'found' END AS protocol FROM inst i LEFT JOIN institutions n USING (institution_id) LEFT JOIN (SELECT DISTINCT institution_id FROM archive_sidecars) a USING (institution_id) GROUP BY ALL)"


@query(sql("SELECT protocol, theme, i.region, sum(v)::BIGINT AS x, count(*) AS n, round(sum(v)::DOUBLE / count(*), 9) AS prevalence FROM inst_theme i JOIN s USING (institution_id) WHERE protocol IS NOT NULL GROUP BY ALL", SQL_BASE.rstrip() + ",\n" + _SEEDED))
def seed_strata(spark, d):
    """Prevalence by how an institution's pages were come by: listed addresses, or found ones; with neither it has no stratum."""
    listed = table(spark, d, "institutions").where("length(policy_search_url) > 0").select("institution_id").distinct().withColumn("listed_", F.lit(True))
    found = table(spark, d, "archive_sidecars").select("institution_id").distinct().withColumn("found_", F.lit(True))
    st = institutions(spark, d).select("institution_id").join(listed, "institution_id", "left").join(found, "institution_id", "left")
    st = st.select("institution_id", F.when(F.col("listed_"), "listed").when(F.col("found_"), "found").alias("protocol")).where("protocol is not null")
    g = inst_theme(spark, d).join(st, "institution_id").groupBy("protocol", "theme", "region").agg(F.sum("v").cast("bigint").alias("x"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("prevalence", F.round(F.col("x").cast("double") / F.col("n"), 9))


@query(f"SELECT theme, region_a, region_b, CASE WHEN round(diff, 4) < 0 THEN '-' ELSE '+' END || printf('%.2f', abs(round(diff * 100, 2))) AS signed, printf('%.1f', round(p_low * 100, 1)) || '%' AS percent FROM ({oracle_of('tost_theme')})")
def number_formats(spark, d):
    """Signed numbers of two decimals and percentages of one."""
    diff = F.col("diff")
    signed = F.concat(F.when(F.round(diff, 4) < 0, "-").otherwise("+"), F.format_string("%.2f", F.abs(F.round(diff * 100, 2))))
    return tost_theme(spark, d).select("theme", "region_a", "region_b", signed.alias("signed"), F.concat(F.format_string("%.1f", F.round(F.col("p_low") * 100, 1)), F.lit("%")).alias("percent"))


@query("SELECT policy_doc_id, strftime(ingested_at, '%Y%m%dT%H%M%SZ') AS compact, strftime(ingested_at, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso, date_diff('millisecond', TIMESTAMP '2024-01-01', date_trunc('millisecond', ingested_at)) AS elapsed_ms FROM policy_documents WHERE ingested_at IS NOT NULL")
def timestamps(spark, d):
    """Times in both spellings, and milliseconds since a moment."""
    at = F.col("ingested_at")
    since = (F.unix_millis(at.cast("timestamp")) - F.unix_millis(F.to_timestamp(F.lit("2024-01-01"))))
    return table(spark, d, "policy_documents").where(at.isNotNull()).select("policy_doc_id", F.date_format(at, "yyyyMMdd'T'HHmmss'Z'").alias("compact"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), since.alias("elapsed_ms"))


# --- reports ----------------------------------------------------------------------------------------------------------


@query(f"SELECT count(*) AS n_tests, sum(reject)::BIGINT AS n_rejected, min(p) AS p_min, max(CASE WHEN reject = 1 THEN p END) AS p_rejected_max FROM ({oracle_of('bh_fdr')})")
def fdr_family(spark, d):
    """The family of tests in one row: its least p, and the largest that is rejected."""
    return bh_fdr(spark, d).agg(F.count(F.lit(1)).alias("n_tests"), F.sum("reject").cast("bigint").alias("n_rejected"), F.min("p").alias("p_min"), F.max(F.when(F.col("reject") == 1, F.col("p"))).alias("p_rejected_max"))


@query(f"SELECT condition, theme, kappa, CAST(row_number() OVER (ORDER BY coalesce(-kappa, 0), condition, theme) AS INTEGER) AS place FROM ({oracle_of('ablation_kappa_rollup')})")
def conditions_ranked(spark, d):
    """Conditions by falling kappa; one without a kappa counts as 0."""
    return ablation_kappa_rollup(spark, d).select("condition", "theme", "kappa", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.coalesce(-F.col("kappa"), F.lit(0.0)), "condition", "theme")).alias("place"))


def _lines(*parts: DataFrame) -> DataFrame:
    """Parts of a report (``k``, ``line``) one after the other: ``line_no``, ``line``."""
    out = None
    for at, part in enumerate(parts):
        part = part.select(F.lit(at).alias("at_"), "k", "line")
        out = part if out is None else out.unionByName(part)
    return out.select((F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("at_", "k")) - 1).alias("line_no"), "line")


def _fixed(spark: SparkSession, *lines: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "k int, line string")


def _crossed(df: DataFrame, row: str, cell, names: tuple[str, ...]) -> DataFrame:
    """A line a row of a table with a column a region; a cell without data reads NA."""
    wide = df.withColumn("cell", cell).groupBy(row).pivot("region", list(REGIONS)).agg(F.first("cell"))
    at = F.array_position(F.array(*map(F.lit, names)), F.col(row)).cast("int")
    return wide.select(at.alias("k"), F.concat(F.lit("| "), F.concat_ws(" | ", row, *[F.coalesce(F.col(f"`{r}`"), F.lit("NA")) for r in REGIONS]), F.lit(" |")).alias("line"))


_RULE = "|---|" + "---|" * len(REGIONS)
_ROW = " || ' | ' || ".join(f"coalesce(max(CASE WHEN region = '{r}' THEN cell END), 'NA')" for r in REGIONS)
_case = lambda c, names: "CASE " + c + " " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(names, 1)) + " END"


@query(
    f"""SELECT CAST(row_number() OVER (ORDER BY at_, k) - 1 AS INTEGER) AS line_no, line FROM (
    SELECT 0 AS at_, unnest([0, 1]) AS k, unnest(['# Summary', '']) AS line
    UNION ALL SELECT 1, 0, '- Family of tests: ' || n_tests || ', rejected: ' || n_rejected FROM (SELECT count(*) AS n_tests, sum(reject)::BIGINT AS n_rejected FROM ({oracle_of('bh_fdr')}))
    UNION ALL SELECT 2, unnest([0, 1, 2, 3, 4]), unnest(['', '## Theme prevalence by region', '', '| Theme | {" | ".join(REGIONS)} |', '{_RULE}'])
    UNION ALL SELECT 3, {_case('theme', THEMES)}, '| ' || theme || ' | ' || {_ROW} || ' |' FROM (SELECT theme, region, CASE WHEN n > 0 THEN x || '/' || n || ' (' || CAST(round(x * 100.0::DOUBLE / n) AS INTEGER) || '%)' END AS cell FROM ({oracle_of('region_theme_prevalence')})) GROUP BY theme
    UNION ALL SELECT 4, unnest([0, 1, 2, 3, 4]), unnest(['', '## Mean sentiment by region', '', '| Use | {" | ".join(REGIONS)} |', '{_RULE}'])
    UNION ALL SELECT 5, {_case('use', USES)}, '| ' || use || ' | ' || {_ROW} || ' |' FROM (SELECT use, region, CASE WHEN round(mean, 2) < 0 THEN '-' ELSE '+' END || printf('%.2f', abs(round(mean, 2))) || ' (n=' || n || ')' AS cell FROM ({oracle_of('region_sentiment')})) GROUP BY use)"""
)
def summary_report(spark, d):
    """The narrative report of the analysis as markdown lines."""
    percent = F.when(F.col("n") > 0, F.concat(F.col("x").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" ("), F.round(F.try_divide(F.col("x") * F.lit(100.0), F.col("n"))).cast("int").cast("string"), F.lit("%)")))
    mean = F.round("mean", 2)
    signed = F.concat(F.when(mean < 0, "-").otherwise("+"), F.format_string("%.2f", F.abs(mean)), F.lit(" (n="), F.col("n").cast("string"), F.lit(")"))
    family = fdr_family(spark, d).select(F.lit(0).alias("k"), F.concat(F.lit("- Family of tests: "), F.col("n_tests").cast("string"), F.lit(", rejected: "), F.col("n_rejected").cast("string")).alias("line"))
    head = lambda title, first: _fixed(spark, "", title, "", f"| {first} | {' | '.join(REGIONS)} |", _RULE)
    return _lines(
        _fixed(spark, "# Summary", ""), family, head("## Theme prevalence by region", "Theme"), _crossed(region_theme(spark, d), "theme", percent, THEMES),
        head("## Mean sentiment by region", "Use"), _crossed(region_sentiment(spark, d), "use", signed, USES),
    )


@query(
    f"""SELECT CAST(row_number() OVER (ORDER BY at_, k) - 1 AS INTEGER) AS line_no, line FROM (
    SELECT 0 AS at_, unnest([0, 1, 2, 3]) AS k, unnest(['# Sensitivity', '', '| Theme | Pair | Sign | Stability |', '|---|---|---|---|']) AS line
    UNION ALL SELECT 1, place, '| ' || theme || ' | ' || region_a || '-' || region_b || ' | ' || CASE full_sign WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '0' END || ' | ' || printf('%.3f', round(same_sign, 3)) || ' |' FROM ({oracle_of('stability_top')})
    UNION ALL SELECT 2, unnest([0, 1, 2]), unnest(['', '| Left out | Signs kept |', '|---|---|'])
    UNION ALL SELECT 3, {_case('dropped', REGIONS)}, '| ' || dropped || ' | ' || n_same || '/' || n || ' |' FROM ({oracle_of('leave_one_out_summary')}))"""
)
def sensitivity_report(spark, d):
    """The narrative report of resamples and left-out regions as markdown lines."""
    from .resampling import leave_one_out_summary

    sign = F.when(F.col("full_sign") == 1, "+").when(F.col("full_sign") == -1, "-").otherwise("0")
    stable = stability_top(spark, d).select(F.col("place").alias("k"), F.format_string("| %s | %s-%s | %s | %s |", "theme", "region_a", "region_b", sign, F.format_string("%.3f", F.round("same_sign", 3))).alias("line"))
    at = F.array_position(F.array(*map(F.lit, REGIONS)), F.col("dropped")).cast("int")
    left = leave_one_out_summary(spark, d).select(at.alias("k"), F.format_string("| %s | %s/%s |", "dropped", F.col("n_same").cast("string"), F.col("n").cast("string")).alias("line"))
    return _lines(_fixed(spark, "# Sensitivity", "", "| Theme | Pair | Sign | Stability |", "|---|---|---|---|"), stable, _fixed(spark, "", "| Left out | Signs kept |", "|---|---|"), left)


_word = lambda c: f"printf('%.3f', round({c}, 3))"
_num = lambda c: F.when(F.round(c, 3).isNotNull(), F.format_string("%.3f", F.round(c, 3)))


@query(f"SELECT theme AS metric, CAST(x AS VARCHAR) AS baseline, {_word('prevalence')} AS current, '[' || {_word('ci_low')} || ', ' || {_word('ci_high')} || ']' AS \"95% CI\" FROM ({oracle_of('wilson_ci')}) WHERE region = 'NA' AND n > 0")
def measurement_cells(spark, d):
    """The published table of measures, filled from the first region."""
    rows = wilson_ci(spark, d).where("region = 'NA' and n > 0")
    return reports.measurement_table(rows.select(F.col("theme").alias("metric"), F.col("x").cast("string").alias("baseline_value"), _num("prevalence").alias("current_value"), _num("ci_low").alias("ci_low"), _num("ci_high").alias("ci_high")))


@query(f"SELECT theme || '/' || region AS component, {_word('prevalence')} AS value, '[' || {_word('ci_low')} || ', ' || {_word('ci_high')} || ']' AS \"95% CI\", '<0.001' AS p FROM ({oracle_of('wilson_ci')}) WHERE n > 0")
def component_cells(spark, d):
    """The published table of components, filled from prevalences; the p-value is text, as it was written."""
    rows = wilson_ci(spark, d).where("n > 0")
    return reports.icc_table(rows.select(F.concat_ws("/", "theme", "region").alias("model_component"), _num("prevalence").alias("value"), _num("ci_low").alias("ci_low"), _num("ci_high").alias("ci_high"), F.lit("<0.001").alias("p_value")))


_pct = lambda x, n: f"printf('%.1f', round({x}::DOUBLE / {n}, 3) * 100) || '%'"


@query(sql(f"""SELECT theme, region_a || ' ' || x_a || '/' || n_a || ' (' || {_pct('x_a', 'n_a')} || ')' AS "region a", region_b || ' ' || x_b || '/' || n_b || ' (' || {_pct('x_b', 'n_b')} || ')' AS "region b", 'n/a' AS p FROM pairs WHERE n_a > 0 AND n_b > 0"""))
def regional_cells(spark, d):
    """The published table of regional contrasts."""
    share = lambda s: F.round(F.col(f"x_{s}").cast("double") / F.col(f"n_{s}"), 3).alias(f"prevalence_{s}")
    rows = theme_pairs(spark, d).where("n_a > 0 and n_b > 0")
    return reports.regional_table(rows.select("theme", "region_a", "n_a", F.col("x_a").alias("events_a"), share("a"), "region_b", "n_b", F.col("x_b").alias("events_b"), share("b"), F.lit("n/a").alias("p_value")))


@query(f"""SELECT theme, {_pct('x_early', 'n')} || ' (' || x_early || '/' || n || ')' AS "mid 2023", {_pct('x_late', 'n')} || ' (' || x_late || '/' || n || ')' AS "late 2025", '+' || printf('%.3f', round(shift_pp, 3)) || ' pp' AS shift, gained || '/' || lost AS p FROM ({oracle_of('temporal_drift')})""")
def temporal_cells(spark, d):
    """The published table of drift between two waves."""
    share = lambda x: F.round(F.col(x).cast("double") / F.col("n"), 3)
    rows = reports.temporal_drift(spark, d)
    wave = lambda w, x: (F.col("n").alias(f"{w}_n"), F.col(x).alias(f"{w}_events"), share(x).alias(f"{w}_prevalence"))
    return reports.temporal_table(rows.select("theme", *wave("mid_2023", "x_early"), *wave("late_2025", "x_late"), _num("shift_pp").alias("shift_pp"), F.concat_ws("/", "gained", "lost").alias("p_value")))


def _listed(title: str, head: tuple[str, ...]) -> tuple[str, ...]:
    return (f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head))


def _listed_sql(title: str, head: tuple[str, ...], cells: tuple[str, ...], order: str, source: str, where: str = "true") -> str:
    top = _listed(title, head)
    row = "'| ' || " + " || ' | ' || ".join(f"coalesce({c}, '')" for c in cells) + " || ' |'"
    return f"""SELECT CAST(row_number() OVER (ORDER BY at_, k) - 1 AS INTEGER) AS line_no, line FROM (SELECT 0 AS at_, unnest(range({len(top)})) AS k, unnest([{', '.join("'" + x + "'" for x in top)}]) AS line
    UNION ALL SELECT 1, row_number() OVER (ORDER BY {order}), {row} FROM ({source}) WHERE {where})"""


def _list(spark: SparkSession, title: str, head: tuple[str, ...], df: DataFrame, cells: tuple, order: list) -> DataFrame:
    """A report of one table: a line a row, in order; a cell without a value is empty."""
    k = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    body = df.select(k.alias("k"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |")).alias("line"))
    return _lines(_fixed(spark, *_listed(title, head)), body)


@query(_listed_sql("Experts", ("Dimension", "n", "Agreement", "Kappa"), ("theme", "CAST(n AS VARCHAR)", _word("agreement"), _word("kappa")), "theme", oracle_of("expert_kappa")))
def expert_report(spark, d):
    """Agreement with the experts as markdown lines."""
    return _list(spark, "Experts", ("Dimension", "n", "Agreement", "Kappa"), expert_kappa(spark, d), (F.col("theme"), F.col("n").cast("string"), _num("agreement"), _num("kappa")), ["theme"])


@query(_listed_sql("Conditions", ("Condition", "n", "Mean kappa"), ("condition", "CAST(n AS VARCHAR)", _word("kappa")), "coalesce(-kappa, 0), condition", oracle_of("ablation_kappa_rollup"), "theme = 'MEAN'"))
def conditions_report(spark, d):
    """Conditions by falling mean kappa as markdown lines."""
    rows = ablation_kappa_rollup(spark, d).where("theme = 'MEAN'")
    return _list(spark, "Conditions", ("Condition", "n", "Mean kappa"), rows, (F.col("condition"), F.col("n").cast("string"), _num("kappa")), [F.coalesce(-F.col("kappa"), F.lit(0.0)), "condition"])


@query(_listed_sql("Confirmatory tests", ("Theme", "Pair", "p", "Rejected"), ("theme", "region_a || '-' || region_b", "CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', round(p, 3)) END", "CASE reject WHEN 1 THEN 'yes' ELSE 'no' END"), "rk", oracle_of("holm_pairwise")))
def confirmatory_report(spark, d):
    """Step-down tests of all pairs as markdown lines, by rank."""
    p = F.when(F.col("p") < 0.001, "<0.001").otherwise(_num("p"))
    return _list(spark, "Confirmatory tests", ("Theme", "Pair", "p", "Rejected"), holm_pairwise(spark, d), (F.col("theme"), F.concat_ws("-", "region_a", "region_b"), p, F.when(F.col("reject") == 1, "yes").otherwise("no")), ["rk"])


@query(_listed_sql("Extended statistics", ("Theme", "x early", "x late", "Shift"), ("theme", "CAST(x_early AS VARCHAR)", "CAST(x_late AS VARCHAR)", _word("shift_pp") + " || ' pp'"), "theme", oracle_of("temporal_drift")))
def drift_report(spark, d):
    """Shifts between two waves as markdown lines."""
    return _list(spark, "Extended statistics", ("Theme", "x early", "x late", "Shift"), reports.temporal_drift(spark, d), (F.col("theme"), F.col("x_early").cast("string"), F.col("x_late").cast("string"), F.concat(_num("shift_pp"), F.lit(" pp"))), ["theme"])


# --- streams, run over what is there ------------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    reader, path = spark.readStream.schema(table(spark, d, name).schema), f"{d}/{name}.parquet"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    rows = reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    # event times need a zone
    return rows.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in rows.dtypes])


def _run(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream gives when it has seen all there is, as a table."""
    spark, path = stream.sparkSession, place(stream.sparkSession, name)
    out = f"{path}/out"

    def keep(batch: DataFrame, no: int) -> None:
        # in complete mode every batch is the whole result
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_hours(spark, d):
    """Events an hour and type, counted by a stream."""
    return _run(ingest.tumbling(_stream(spark, d, "events"), "ts", "1 hour", "1 day", "event_type"), "hours", "complete").select("event_type", "start", "n")


@query("SELECT s::TIMESTAMP AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events WHERE ts IS NOT NULL) GROUP BY ALL")
def stream_sliding_days(spark, d):
    """Events in windows of two days that begin every day."""
    return _run(ingest.sliding(_stream(spark, d, "events"), "ts", "2 days", "1 day", "1 day"), "sliding", "complete").select("start", "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_sessions(spark, d):
    """Sessions of a user: events less than an hour apart."""
    return _run(ingest.sessions(_stream(spark, d, "events").where("user_id is not null"), "ts", "1 hour", "1 day", "user_id"), "sessions", "complete").select("user_id", "start", "n")


@query("SELECT sha256, count(DISTINCT sha256) AS n FROM policy_documents WHERE sha256 IS NOT NULL AND ingested_at IS NOT NULL GROUP BY ALL")
def stream_new_documents(spark, d):
    """Each content hash once, as a stream of fetches sees it."""
    rows = _stream(spark, d, "policy_documents").select("sha256", F.col("ingested_at").cast("timestamp").alias("ingested_at")).where("ingested_at is not null")
    return _run(ingest.new_documents(rows), "new", "append").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT institution_id, count(*) AS n_fetches FROM archive_sidecars WHERE institution_id IS NOT NULL GROUP BY ALL")
def stream_ledger(spark, d):
    """The append-only ledger of fetches, written by a stream and counted."""
    path = place(spark, "ledger")
    rows = _stream(spark, d, "archive_sidecars").where("institution_id is not null").select("institution_id", "url", "accessed_at")
    ingest.append_ledger(rows, f"{path}/rows", f"{path}/state").start().awaitTermination()
    return spark.read.parquet(f"{path}/rows").groupBy("institution_id").agg(F.count(F.lit(1)).alias("n_fetches"))


@query(
    """WITH e AS (SELECT 'u' || user_id % 7 AS host, ts, event_type = 'error' AS bad FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL AND user_id IS NOT NULL),
    g AS (SELECT *, sum(CAST(NOT bad AS INTEGER)) OVER (PARTITION BY host ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
    r AS (SELECT *, sum(CAST(bad AS INTEGER)) OVER (PARTITION BY host, k ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT host, ts, CASE WHEN n = 0 THEN 3.0 ELSE least(60.0, 3 * pow(2, n - 1)) END::DOUBLE AS wait_s FROM r"""
)
def stream_pace(spark, d):
    """When each host may be asked again, errors counting as refusals."""
    from ..session import ship

    ship(spark)
    rows = _stream(spark, d, "events").where("ts is not null and event_type is not null").select(F.concat(F.lit("u"), F.col("user_id") % 7).alias("host"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"))
    return _run(ingest.paced(rows), "pace", "append")
