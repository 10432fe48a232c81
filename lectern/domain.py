"""The study's constants and base frames.

An institution counts once: of the rows with its id those in an allowed region
and tier are valid, and of several the least stands for it. A coding counts if
it is ok, and of several by the same annotator and seed the latest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table

#: Fixed values. The order of regions gives the orientation of pairs and the reference level.
REGIONS = ("NA", "EU", "EA", "LA")
TIERS = ("elite", "upper", "mid", "regional")
OWNERSHIP = ("public", "private", "")
THEMES = ("T1_integration", "T2_multimodal", "T3_privacy", "T4_integrity", "T5_disclosure", "T6_equity", "T7_vendor_governance", "T8_pedagogical_redesign")
USES = ("assessment", "research", "teaching", "administration")
TARGET_PER_REGION, TARGET_TOTAL = 60, 240
TARGET_PER_TIER = {"elite": 15, "upper": 20, "mid": 15, "regional": 10}
EPS_THEME, EPS_SENTIMENT, ALPHA, FDR_Q, SEED = 0.10, 0.20, 0.05, 0.10, 11
PAIRS = tuple((a, b) for i, a in enumerate(REGIONS) for b in REGIONS[i + 1 :])
#: Coders compared with each other; every other coder is a condition held against the first.
PRIMARY, SECOND = "brimstone-32b", "cassel-70b"
#: Terms one of which a passage on generative AI holds.
CORE_TERMS = (
    "chatgpt", "generative ai", "genai", "large language model", "llm", "gpt-3", "gpt-4", "gpt-5", "claude", "gemini", "copilot",
    "生成式人工智能", "生成式ai", "大语言模型", "通用人工智能", "generative ki", "generative künstliche", "sprachmodell",
    "ia generativa", "inteligencia artificial generativa", "inteligência artificial generativa", "ia générative", "intelligence artificielle générative",
    "生成ai", "生成 ai", "생성형 ai", "생성 ai", "generatieve ai",
)
#: Paths under which a site may keep its policy.
PROBE_PATHS = (
    "/genai-policy", "/generative-ai-policy", "/ai-policy", "/academic-integrity/ai", "/ai-guidelines", "/ai-guidance",
    "/policies/ai", "/teaching-and-learning/ai", "/academic-integrity/generative-ai", "/chatgpt", "/ai-in-teaching", "/genai-guidance",
)


def grid(spark: SparkSession, **values: tuple[str, ...]) -> DataFrame:
    """All combinations of a few constants, made by exploding literals."""
    df = spark.range(1)
    for name, own in values.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, own))))
    return df.drop("id")


def institutions(spark: SparkSession, d: str) -> DataFrame:
    """The valid institutions, one row each."""
    rows = table(spark, d, "institutions").where(F.col("region").isin(*REGIONS) & F.col("tier").isin(*TIERS) & (F.length("institution_id") > 0))
    least = F.min(F.struct("region", "tier", "country", "country_code", "language_primary", "language_secondary", "name", "website"))
    return rows.groupBy("institution_id").agg(least.alias("x")).select("institution_id", "x.*")


def codings(spark: SparkSession, d: str, by_seed: bool = True) -> DataFrame:
    """The codings that count, flat: missing single values are 0. Without ``by_seed`` one a coder: of several seeds the last."""
    rows = table(spark, d, "coded_chunks").where("ok and themes is not null").withColumn("seed_", F.coalesce("seed", F.lit(-1)))
    first = ["timestamp_utc", "received_at"] if by_seed else ["timestamp_utc", "seed_", "received_at"]
    latest = F.max(F.struct(*first, "institution_id", "language_declared", "themes", "sentiment", "confidence"))
    keys = ["chunk_id", "model_name", *["seed"] * by_seed]
    rows = rows.groupBy(*keys).agg(latest.alias("x")).select(*keys, "x.*").drop("seed_")
    flat = [F.coalesce(F.col(f"themes.{t}"), F.lit(0)).alias(t) for t in THEMES] + [F.coalesce(F.col(f"sentiment.{u}"), F.lit(0)).alias(u) for u in USES]
    return rows.select(*keys, "institution_id", "language_declared", "timestamp_utc", "confidence", *flat)


def coded(spark: SparkSession, d: str, model: str = PRIMARY) -> DataFrame:
    """One coder's codings with region and tier of the institution; unknown institutions drop out."""
    own = codings(spark, d).where(F.col("model_name") == model)
    return own.join(institutions(spark, d).select("institution_id", "region", "tier", "country"), "institution_id")


def long(df: DataFrame, ids: list[str], values: tuple[str, ...], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, list(values), name, value)


def inst_theme(spark: SparkSession, d: str, model: str = PRIMARY) -> DataFrame:
    """Any-coded themes by institution, from one pass over the codings: ``theme``, ``v`` in 0, 1."""
    wide = coded(spark, d, model).groupBy("institution_id", "region", "tier", "country").agg(*[F.max(t).alias(t) for t in THEMES])
    return long(wide, ["institution_id", "region", "tier", "country"], THEMES, "theme", "v")


def inst_sentiment(spark: SparkSession, d: str, model: str = PRIMARY) -> DataFrame:
    """Mean sentiment by institution, silence counting 0: ``use``, ``mean``; from integer sums."""
    wide = coded(spark, d, model).groupBy("institution_id", "region").agg(F.count(F.lit(1)).alias("n_"), *[F.sum(u).alias(u) for u in USES])
    return long(wide, ["institution_id", "region", "n_"], USES, "use", "s_").select("institution_id", "region", "use", (F.col("s_") / F.col("n_")).alias("mean"))


def by_region(df: DataFrame, keys: list[str], *values: Column) -> DataFrame:
    """One row a key with a column map of region -> struct of the given aggregates."""
    rows = df.groupBy(*keys, "region").agg(*values)
    names = [c for c in rows.columns if c not in (*keys, "region")]
    return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("region", F.struct(*names)))).alias("m"))


def region_pairs(df: DataFrame, keys: list[str], fields: dict[str, str], pairs=PAIRS) -> DataFrame:
    """Region pairs of the map ``m``: ``region_a``, ``region_b`` and the fields of both sides, 0 where a region is missing."""
    exploded = df.withColumn("p", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])))
    side = lambda f, t, s: F.coalesce(F.expr(f"m[p.{s}].{f}"), F.lit(0).cast(t)).alias(f"{f}_{s}")
    return exploded.select(*keys, F.col("p.a").alias("region_a"), F.col("p.b").alias("region_b"), *[side(f, t, s) for f, t in fields.items() for s in "ab"])


# --- the same base frames in DuckDB's SQL -------------------------------------------------------------------------

_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_flat = ", ".join([f"coalesce(themes.{t}, 0) AS {t}" for t in THEMES] + [f"coalesce(sentiment.{u}, 0) AS {u}" for u in USES])

SQL_BASE = f"""
inst AS (SELECT institution_id, region, tier, country, country_code, language_primary, language_secondary, name, website FROM (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY region, tier, country NULLS FIRST, country_code NULLS FIRST, language_primary NULLS FIRST, language_secondary NULLS FIRST, name NULLS FIRST, website NULLS FIRST) AS rn
    FROM institutions WHERE region IN ({_list(REGIONS)}) AND tier IN ({_list(TIERS)}) AND length(institution_id) > 0) WHERE rn = 1),
codings AS (SELECT chunk_id, model_name, seed, institution_id, language_declared, timestamp_utc, confidence, {_flat} FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, model_name, seed ORDER BY timestamp_utc DESC NULLS LAST, received_at DESC NULLS LAST, institution_id DESC NULLS LAST, language_declared DESC NULLS LAST) AS rn
    FROM coded_chunks WHERE ok AND themes IS NOT NULL) WHERE rn = 1),
coded AS (SELECT c.*, i.region, i.tier, i.country FROM codings c JOIN inst i USING (institution_id) WHERE model_name = '{PRIMARY}'),
wide AS (SELECT institution_id, region, tier, country, {', '.join(f'max({t}) AS {t}' for t in THEMES)} FROM coded GROUP BY ALL),
inst_theme AS (UNPIVOT wide ON {', '.join(THEMES)} INTO NAME theme VALUE v),
swide AS (SELECT institution_id, region, {', '.join(f'sum({u})::DOUBLE / count(*) AS {u}' for u in USES)} FROM coded GROUP BY ALL),
inst_sent AS (UNPIVOT swide ON {', '.join(USES)} INTO NAME use VALUE mean),
regions AS (SELECT unnest([{_list(REGIONS)}]) AS region, unnest([1, 2, 3, 4]) AS ord),
themes_ AS (SELECT unnest([{_list(THEMES)}]) AS theme),
rt AS (SELECT t.theme, r.region, r.ord, coalesce(sum(v), 0)::BIGINT AS x, count(v) AS n FROM themes_ t CROSS JOIN regions r LEFT JOIN inst_theme i ON i.theme = t.theme AND i.region = r.region GROUP BY ALL),
pairs AS (SELECT a.theme, a.region AS region_a, b.region AS region_b, a.x AS x_a, b.x AS x_b, a.n AS n_a, b.n AS n_b FROM rt a JOIN rt b ON a.theme = b.theme AND a.ord < b.ord)
"""


def sql(query: str, base: str = SQL_BASE) -> str:
    """A query over the base frames."""
    return f"WITH {base.strip()}\n{query}"
