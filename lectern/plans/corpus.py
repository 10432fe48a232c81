"""Queries on the sampling frame, the archive and the extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..domain import OWNERSHIP, REGIONS, TARGET_PER_REGION, TARGET_PER_TIER, TIERS, grid, institutions, sql
from ..session import table
from .catalog import query

_in = lambda xs: ", ".join(f"'{x}'" for x in xs)
#: The columns of the sampling frame, in their order.
_COLS = ("institution_id", "name", "country", "country_code", "region", "tier", "qs_2026_rank", "arwu_2025_rank", "public_private", "language_primary", "language_secondary", "website", "policy_search_url", "ror_id", "notes")
_I = f"i0 AS (SELECT {', '.join(f'coalesce({c}, $$$$) AS {c}' for c in _COLS)} FROM institutions), i1 AS (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY {', '.join(_COLS)}) AS k FROM i0)"


@query(
    f"""WITH {_I} SELECT institution_id, rule, value, count(*) AS n FROM (
    SELECT institution_id, 'empty institution_id' AS rule, '' AS value FROM i1 WHERE institution_id = ''
    UNION ALL SELECT institution_id, 'duplicate institution_id', institution_id FROM i1 WHERE institution_id <> '' AND k > 1
    UNION ALL SELECT institution_id, 'bad region', region FROM i1 WHERE region NOT IN ({_in(REGIONS)})
    UNION ALL SELECT institution_id, 'bad tier', tier FROM i1 WHERE tier NOT IN ({_in(TIERS)})
    UNION ALL SELECT institution_id, 'bad public_private', public_private FROM i1 WHERE public_private NOT IN ({_in(OWNERSHIP)})
    UNION ALL SELECT institution_id, 'bad website', website FROM i1 WHERE website NOT LIKE 'http%') GROUP BY ALL"""
)
def institution_validation(spark, d):
    """The rules each row breaks; a null cell is read as an empty one."""
    rows = table(spark, d, "institutions").select(*[F.coalesce(c, F.lit("")).alias(c) for c in _COLS])
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("institution_id").orderBy(*_COLS)))
    rule = lambda broken, name, value: F.when(broken, F.struct(F.lit(name).alias("rule"), value.alias("value")))
    c = {x: F.col(x) for x in _COLS}
    rules = F.array(
        rule(c["institution_id"] == "", "empty institution_id", F.lit("")), rule((c["institution_id"] != "") & (F.col("k") > 1), "duplicate institution_id", c["institution_id"]), rule(~c["region"].isin(*REGIONS), "bad region", c["region"]),
        rule(~c["tier"].isin(*TIERS), "bad tier", c["tier"]), rule(~c["public_private"].isin(*OWNERSHIP), "bad public_private", c["public_private"]), rule(~c["website"].startswith("http"), "bad website", c["website"]),
    )
    broken = rows.select("institution_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("x"))
    return broken.groupBy("institution_id", "x.rule", "x.value").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT coalesce(region, '*') AS region, coalesce(tier, '*') AS tier, count(*) AS n FROM inst GROUP BY GROUPING SETS ((region, tier), (region), (tier), ())"))
def balance_by_region_tier(spark, d):
    return institutions(spark, d).cube("region", "tier").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("region", F.lit("*")).alias("region"), F.coalesce("tier", F.lit("*")).alias("tier"), "n")


_target = " ".join(f"WHEN '{t}' THEN {n}" for t, n in TARGET_PER_TIER.items())


@query(
    sql(
        f"""SELECT region, tier, coalesce(n, 0) AS n, CAST(target AS INTEGER) AS target, CAST(target - coalesce(n, 0) AS BIGINT) AS gap, CAST(coalesce(n, 0) = target AS INTEGER) AS ok, CAST(greatest(0, {TARGET_PER_REGION} - coalesce(sum(n) OVER (PARTITION BY region), 0)) AS BIGINT) AS region_short
    FROM (SELECT region, tier, CASE tier {_target} END AS target FROM regions CROSS JOIN (SELECT unnest([{_in(TIERS)}]) AS tier)) LEFT JOIN (SELECT region, tier, count(*) AS n FROM inst GROUP BY ALL) USING (region, tier)"""
    )
)
def balance_gap(spark, d):
    """What each cell of region and tier lacks to its target."""
    n = institutions(spark, d).groupBy("region", "tier").agg(F.count(F.lit(1)).alias("n"))
    target = F.element_at(F.create_map(*[F.lit(x) for t, k in TARGET_PER_TIER.items() for x in (t, k)]), F.col("tier"))
    full = grid(spark, region=REGIONS, tier=TIERS).join(n, ["region", "tier"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "target": target})
    whole = F.sum("n").over(Window.partitionBy("region"))
    return full.select("region", "tier", "n", "target", (F.col("target") - F.col("n")).alias("gap"), (F.col("n") == F.col("target")).cast("int").alias("ok"), F.greatest(F.lit(0), TARGET_PER_REGION - whole).cast("bigint").alias("region_short"))


@query(sql("SELECT country_code, count(*) AS n FROM inst GROUP BY ALL ORDER BY n DESC, country_code NULLS LAST LIMIT 10"))
def top_countries(spark, d):
    return institutions(spark, d).groupBy("country_code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("country_code")).limit(10)


@query(
    sql(
        """SELECT i.institution_id, count(s.institution_id) AS n_fetched, count(DISTINCT s.sha256) AS n_archived, sum(CASE WHEN lower(coalesce(s.content_type, '')) LIKE '%pdf%' OR s.extension = 'pdf' THEN 1 ELSE 0 END)::BIGINT AS n_pdf, coalesce(sum(s.size_bytes), 0)::BIGINT AS bytes FROM inst i LEFT JOIN archive_sidecars s USING (institution_id) GROUP BY ALL"""
    )
)
def scrape_funnel(spark, d):
    """Fetched, archived and pdf pages of every institution; 0 where nothing was fetched."""
    pdf = F.lower(F.coalesce("content_type", F.lit(""))).contains("pdf") | (F.col("extension") == "pdf")
    per = table(spark, d, "archive_sidecars").groupBy("institution_id").agg(F.count(F.lit(1)).alias("n_fetched"), F.countDistinct("sha256").alias("n_archived"), F.sum(F.when(pdf, 1).otherwise(0)).alias("n_pdf"), F.sum("size_bytes").alias("bytes"))
    joined = institutions(spark, d).select("institution_id").join(per, "institution_id", "left")
    return joined.select("institution_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_fetched", "n_archived", "n_pdf", "bytes")])


@query(sql("SELECT institution_id, region, country, tier, CASE WHEN institution_id IN (SELECT institution_id FROM policy_documents WHERE regexp_matches(text, '[^ \\t\\r\\n\\f]') AND institution_id IS NOT NULL) THEN 'ok' ELSE 'no_policy_found' END AS drop_reason FROM inst"))
def exclusion_ledger(spark, d):
    """Whether an institution has a policy: a document whose text is more than white space."""
    found = table(spark, d, "policy_documents").where(F.col("text").rlike(r"[^ \t\r\n\f]")).select("institution_id").distinct().withColumn("ok_", F.lit(True))
    return institutions(spark, d).join(found, "institution_id", "left").select("institution_id", "region", "country", "tier", F.when(F.col("ok_"), "ok").otherwise("no_policy_found").alias("drop_reason"))


@query("SELECT sha256, n_fetches, first_id FROM (SELECT sha256, count(*) AS n_fetches, min(policy_doc_id) AS first_id FROM policy_documents WHERE sha256 IS NOT NULL GROUP BY sha256)")
def dedupe_by_sha(spark, d):
    return table(spark, d, "policy_documents").where("sha256 is not null").groupBy("sha256").agg(F.count(F.lit(1)).alias("n_fetches"), F.min("policy_doc_id").alias("first_id"))


@query("SELECT sha256, min(policy_doc_id) AS policy_doc_id, count(*) AS n FROM policy_documents d WHERE NOT EXISTS (SELECT 1 FROM archive_sidecars s WHERE s.sha256 = d.sha256) GROUP BY sha256")
def documents_without_sidecar(spark, d):
    """Anti-join: documents whose hash the archive does not know."""
    known = table(spark, d, "archive_sidecars").select("sha256").where("sha256 is not null").distinct()
    return table(spark, d, "policy_documents").join(known, "sha256", "left_anti").groupBy("sha256").agg(F.min("policy_doc_id").alias("policy_doc_id"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT p.policy_doc_id, s.content_type, coalesce(s.size_bytes, p.size_bytes) AS size_bytes, coalesce(s.accessed_at, p.accessed_at) AS accessed_at FROM policy_documents p LEFT JOIN (SELECT sha256, accessed_at, max(content_type) AS content_type, max(size_bytes) AS size_bytes FROM archive_sidecars GROUP BY ALL) s ON s.sha256 = p.sha256 AND s.accessed_at = p.accessed_at"""
)
def sidecar_join(spark, d):
    """Documents with the sidecar of their fetch, of repeated ones one."""
    side = table(spark, d, "archive_sidecars").groupBy("sha256", "accessed_at").agg(F.max("content_type").alias("content_type"), F.max("size_bytes").alias("s_bytes"))
    docs = table(spark, d, "policy_documents").select("policy_doc_id", "sha256", "accessed_at", "size_bytes")
    return docs.join(side, ["sha256", "accessed_at"], "left").select("policy_doc_id", "content_type", F.coalesce("s_bytes", "size_bytes").alias("size_bytes"), "accessed_at")


@query(
    """SELECT extraction_method, count(*) AS n, sum(CASE WHEN coalesce(length(text), 0) = 0 THEN 1 ELSE 0 END)::BIGINT AS n_empty, sum(CASE WHEN mojibake_flagged THEN 1 ELSE 0 END)::BIGINT AS n_flagged,
    sum(CASE WHEN language_match = false AND text_length_chars > 200 THEN 1 ELSE 0 END)::BIGINT AS n_mismatch, CAST(floor(avg(coalesce(text_length_chars, 0))) AS BIGINT) AS mean_chars FROM policy_documents GROUP BY ALL"""
)
def extraction_report(spark, d):
    when = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return (
        table(spark, d, "policy_documents")
        .groupBy("extraction_method")
        .agg(F.count(F.lit(1)).alias("n"), when(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("n_empty"), when(F.col("mojibake_flagged")).alias("n_flagged"), when((~F.col("language_match")) & (F.col("text_length_chars") > 200)).alias("n_mismatch"), F.floor(F.avg(F.coalesce("text_length_chars", F.lit(0)))).alias("mean_chars"))
    )


@query("SELECT 'extension' AS kind, coalesce(extension, '') AS value, count(*) AS n FROM policy_documents GROUP BY ALL UNION ALL SELECT 'language', coalesce(language_detected, ''), count(*) FROM policy_documents GROUP BY ALL UNION ALL SELECT 'warning', coalesce(warning, ''), count(*) FROM policy_documents GROUP BY ALL")
def extraction_histograms(spark, d):
    """Three histograms in one pass: kind and value by grouping sets over exploded pairs."""
    pair = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.coalesce(c, F.lit("")).alias("value"))
    return table(spark, d, "policy_documents").select(F.explode(F.array(pair("extension", F.col("extension")), pair("language", F.col("language_detected")), pair("warning", F.col("warning")))).alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT CAST(ok AS BOOLEAN) AS ok, i.institution_id IS NOT NULL AS known, count(*) AS n, count(DISTINCT chunk_id) AS n_chunks FROM coded_chunks c LEFT JOIN inst i ON i.institution_id = c.institution_id GROUP BY ALL"))
def coding_join_report(spark, d):
    """Codings by validity and by whether their institution is known."""
    known = institutions(spark, d).select("institution_id", F.lit(True).alias("known_"))
    return table(spark, d, "coded_chunks").select("ok", "institution_id", "chunk_id").join(known, "institution_id", "left").groupBy("ok", F.coalesce("known_", F.lit(False)).alias("known")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("n_chunks"))


@query("SELECT error_info.error AS error, error_info.key AS key, count(*) AS n FROM coded_chunks WHERE NOT ok GROUP BY ALL")
def coding_errors(spark, d):
    return table(spark, d, "coded_chunks").where("not ok").groupBy(F.col("error_info.error").alias("error"), F.col("error_info.key").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r.coder_kind, count(*) AS n, count(DISTINCT c.model_name) AS n_coders, count(DISTINCT c.chunk_id) AS n_chunks FROM coded_chunks c JOIN (SELECT model_name, min(coder_kind) AS coder_kind FROM coder_roster GROUP BY model_name) r USING (model_name) GROUP BY ALL")
def coder_kinds(spark, d):
    roster = table(spark, d, "coder_roster").groupBy("model_name").agg(F.min("coder_kind").alias("coder_kind"))
    return table(spark, d, "coded_chunks").select("model_name", "chunk_id").join(roster, "model_name").groupBy("coder_kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("model_name").alias("n_coders"), F.countDistinct("chunk_id").alias("n_chunks"))


@query(
    sql(
        """SELECT institution_id, chunk_id, n_codings, cum FROM (SELECT institution_id, chunk_id, n_codings, CAST(sum(n_codings) OVER (PARTITION BY institution_id ORDER BY n_codings DESC, chunk_id) AS BIGINT) AS cum FROM (SELECT institution_id, chunk_id, count(*) AS n_codings FROM codings WHERE institution_id IS NOT NULL GROUP BY ALL)) WHERE cum - n_codings < 25"""
    )
)
def early_stop(spark, d):
    """Passages of an institution, most coded first, until 25 codings are gathered."""
    from ..domain import codings

    n = codings(spark, d).where("institution_id is not null").groupBy("institution_id", "chunk_id").agg(F.count(F.lit(1)).alias("n_codings"))
    # each passage has a coding at least, so that 25 passages are enough; Spark cuts to them before it shuffles
    n = n.withColumn("rk", F.row_number().over(Window.partitionBy("institution_id").orderBy(F.desc("n_codings"), "chunk_id"))).where("rk <= 25").drop("rk")
    cum = F.sum("n_codings").over(Window.partitionBy("institution_id").orderBy(F.desc("n_codings"), "chunk_id").rowsBetween(Window.unboundedPreceding, 0))
    return n.withColumn("cum", cum).where("cum - n_codings < 25")


@query("SELECT chunk_id, CASE WHEN bool_or(seed IS NULL) THEN 'human' ELSE 'model' END AS protocol, count(*) AS n FROM coded_chunks GROUP BY ALL")
def coding_protocol(spark, d):
    """An override: one human coding makes a passage's protocol human."""
    return table(spark, d, "coded_chunks").groupBy("chunk_id").agg(F.when(F.bool_or(F.col("seed").isNull()), "human").otherwise("model").alias("protocol"), F.count(F.lit(1)).alias("n"))
