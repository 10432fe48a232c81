"""Waves in time and tables as markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domain import SQL_BASE, THEMES, coded, long, sql
from ..functions.special import Duck, chi2_upper
from ..operators import stats
from .catalog import query
from .inference import region_theme

#: Codings before this time are the first wave.
SPLIT = "2026-02-01T00:00:00Z"
R = 9


def waves(spark, d, split: str = SPLIT) -> DataFrame:
    """Any-coded themes of institutions coded in both waves: ``theme``, ``early``, ``late``."""
    late = F.col("timestamp_utc") >= split
    wide = coded(spark, d).groupBy("institution_id").agg(F.max(late.cast("int")).alias("has_late"), F.min(late.cast("int")).alias("all_late"), *[F.max(F.when(late == w, F.col(t))).alias(f"{t}_{int(w)}") for t in THEMES for w in (False, True)])
    both = wide.where("has_late = 1 and all_late = 0")
    return both.select("institution_id", F.explode(F.array(*[F.struct(F.lit(t).alias("theme"), F.col(f"{t}_0").alias("early"), F.col(f"{t}_1").alias("late")) for t in THEMES])).alias("x")).select("institution_id", "x.*")


_W = f"""wv AS (SELECT institution_id, timestamp_utc >= '{SPLIT}' AS late, {', '.join(f'max({t}) AS {t}' for t in THEMES)} FROM coded GROUP BY ALL),
wl AS (SELECT institution_id, late, theme, v FROM (UNPIVOT wv ON {', '.join(THEMES)} INTO NAME theme VALUE v)),
wb AS (SELECT e.theme, e.v AS early, l.v AS late FROM wl e JOIN wl l ON e.institution_id = l.institution_id AND e.theme = l.theme AND NOT e.late AND l.late),
wc AS (SELECT theme, count(*) AS n, sum(early)::BIGINT AS x_early, sum(late)::BIGINT AS x_late, sum(CASE WHEN early < late THEN 1 ELSE 0 END)::BIGINT AS gained, sum(CASE WHEN early > late THEN 1 ELSE 0 END)::BIGINT AS lost FROM wb GROUP BY ALL),
wm AS (SELECT *, (gained - lost)::DOUBLE * (gained - lost) / nullif(gained + lost, 0) AS mc FROM wc)"""


@query(
    sql(
        f"SELECT theme, n, x_early, x_late, round((x_late - x_early)::DOUBLE / n * 100, 9) AS shift_pp, gained, lost, CASE WHEN mc IS NULL THEN NULL ELSE round({chi2_upper(Duck, 1, 'mc')}, 9) END AS p_mcnemar FROM wm",
        SQL_BASE.rstrip() + ",\n" + _W,
    )
)
def temporal_drift(spark, d):
    """Shift of prevalence between two waves of the same institutions, with McNemar's test."""
    one = lambda c, a: F.sum(F.when(c, 1).otherwise(0)).cast("bigint").alias(a)
    g = waves(spark, d).groupBy("theme").agg(F.count(F.lit(1)).alias("n"), F.sum("early").cast("bigint").alias("x_early"), F.sum("late").cast("bigint").alias("x_late"), one(F.col("early") < F.col("late"), "gained"), one(F.col("early") > F.col("late"), "lost"))
    diff = (F.col("gained") - F.col("lost")).cast("double")
    g = g.withColumn("mc", diff * diff / F.nullif((F.col("gained") + F.col("lost")).cast("double"), F.lit(0.0)))
    return g.select("theme", "n", "x_early", "x_late", F.round((F.col("x_late") - F.col("x_early")).cast("double") / F.col("n") * 100, R).alias("shift_pp"), "gained", "lost", F.when(F.col("mc").isNotNull(), F.round(stats.p_chi2("mc", 1), R)).alias("p_mcnemar"))


def markdown(df: DataFrame, order: list[Column]) -> DataFrame:
    """A report table as markdown lines: ``line_no``, ``line``. Cells are padded to the widest of their column.

    A report is small; its rows are numbered in one partition.
    """
    cols = df.columns
    everything = Window.partitionBy(F.lit(1))
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols], F.row_number().over(everything.orderBy(*order)).alias("n_"))
    wide = rows.withColumns({f"w_{c}": F.greatest(F.lit(len(c)), F.max(F.length(c)).over(everything)) for c in cols})
    pad = lambda s, w: F.rpad(s, w, " ") if isinstance(w, int) else F.expr(f"rpad({s}, {w}, ' ')")
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = row([pad(f"`{c}`", f"`w_{c}`") for c in cols])
    head = row([pad(f"'{c}'", f"`w_{c}`") for c in cols])
    rule = row([F.expr(f"repeat('-', `w_{c}`)") for c in cols])
    lines = F.when(F.col("n_") == 1, F.array(F.struct(F.lit(0).alias("line_no"), head.alias("line")), F.struct(F.lit(1).alias("line_no"), rule.alias("line")), F.struct(F.lit(2).alias("line_no"), body.alias("line")))).otherwise(F.array(F.struct((F.col("n_") + 1).alias("line_no"), body.alias("line"))))
    return wide.select(F.explode(lines).alias("x")).select("x.*")


def percent(x: str, n: str) -> Column:
    """``49/60 (81.7%)``; null for n = 0."""
    return F.concat(F.col(x).cast("string"), F.lit("/"), F.col(n).cast("string"), F.lit(" ("), F.format_string("%.1f", F.round(F.try_divide(F.col(x).cast("double") * 100, F.col(n).cast("double")), 1)), F.lit("%)"))


@query(
    sql(
        """SELECT CAST(line_no AS INTEGER) AS line_no, line FROM (
        SELECT n + 1 AS line_no, '| ' || rpad(theme, w1, ' ') || ' | ' || rpad(region, w2, ' ') || ' | ' || rpad(prevalence, w3, ' ') || ' |' AS line FROM mw
        UNION ALL SELECT 0, '| ' || rpad('theme', w1, ' ') || ' | ' || rpad('region', w2, ' ') || ' | ' || rpad('prevalence', w3, ' ') || ' |' FROM mw WHERE n = 1
        UNION ALL SELECT 1, '| ' || repeat('-', w1) || ' | ' || repeat('-', w2) || ' | ' || repeat('-', w3) || ' |' FROM mw WHERE n = 1)""",
        SQL_BASE.rstrip()
        + """,
mt AS (SELECT theme, region, x || '/' || n || ' (' || printf('%.1f', round(x * 100.0::DOUBLE / n, 1)) || '%)' AS prevalence FROM rt WHERE n > 0),
mw AS (SELECT *, CAST(row_number() OVER (ORDER BY theme, region) AS INTEGER) AS n, CAST(greatest(5, max(length(theme)) OVER ()) AS INTEGER) AS w1, CAST(greatest(6, max(length(region)) OVER ()) AS INTEGER) AS w2, CAST(greatest(10, max(length(prevalence)) OVER ()) AS INTEGER) AS w3 FROM mt)""",
    )
)
def prevalence_markdown(spark, d):
    rows = region_theme(spark, d).where("n > 0").select("theme", "region", percent("x", "n").alias("prevalence"))
    return markdown(rows, [F.col("theme"), F.col("region")])


def _keyword_sql() -> str:
    from ..operators.coding import KEYWORDS

    has = lambda t: " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in KEYWORDS[t])
    return f"SELECT coalesce(region, '?') AS region, count(*) AS n_passages, {', '.join(f'sum(CAST({has(t)} AS INTEGER))::BIGINT AS {t}' for t in THEMES)} FROM (SELECT DISTINCT chunk_id, region, text FROM policy_chunks) GROUP BY ALL"


@query(_keyword_sql())
def keyword_codings(spark, d):
    """Passages coded by the coder that needs no model: how many passages of each region have each theme."""
    from ..operators.coding import code_passages
    from ..session import ship, table

    ship(spark)
    passages = table(spark, d, "policy_chunks").select("chunk_id", "region", "text").distinct().select(F.struct("chunk_id", F.coalesce("region", F.lit("?")).alias("region")).alias("passage"), "text")
    coded_ = code_passages(passages, id_col="passage")
    per = [F.sum(F.get_json_object("raw", f"$.themes.{t}").cast("bigint")).alias(t) for t in THEMES]
    return coded_.groupBy("passage.region").agg(F.count(F.lit(1)).alias("n_passages"), *per)


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY ALL")
def daily_events(spark, d):
    """The tumbling window of the stream over the whole table as a batch."""
    from ..session import table
    from ..streaming.ingest import tumbling

    return tumbling(table(spark, d, "events"), "ts", "1 day", "1 day", "event_type").select("event_type", "start", "n")


# --- published tables, cells as they were written ------------------------------------------------------------------


def interval(low: str, high: str) -> Column:
    """``[low, high]``."""
    return F.concat(F.lit("["), F.col(low).cast("string"), F.lit(", "), F.col(high).cast("string"), F.lit("]"))


def share(value: str) -> Column:
    """A proportion as a percentage with one decimal."""
    return F.concat(F.format_string("%.1f", F.col(value).cast("double") * 100), F.lit("%"))


def measurement_table(df: DataFrame) -> DataFrame:
    return df.select("metric", F.col("baseline_value").alias("baseline"), F.col("current_value").alias("current"), interval("ci_low", "ci_high").alias("95% CI"))


def icc_table(df: DataFrame) -> DataFrame:
    return df.select(F.col("model_component").alias("component"), "value", interval("ci_low", "ci_high").alias("95% CI"), F.col("p_value").alias("p"))


def regional_table(df: DataFrame) -> DataFrame:
    side = lambda s: F.concat(F.col(f"region_{s}"), F.lit(" "), F.col(f"events_{s}").cast("string"), F.lit("/"), F.col(f"n_{s}").cast("string"), F.lit(" ("), share(f"prevalence_{s}"), F.lit(")")).alias(f"region {s}")
    return df.select("theme", side("a"), side("b"), F.col("p_value").alias("p"))


def temporal_table(df: DataFrame) -> DataFrame:
    wave = lambda w: F.concat(share(f"{w}_prevalence"), F.lit(" ("), F.col(f"{w}_events").cast("string"), F.lit("/"), F.col(f"{w}_n").cast("string"), F.lit(")")).alias(w.replace("_", " "))
    return df.select("theme", wave("mid_2023"), wave("late_2025"), F.concat(F.lit("+"), F.col("shift_pp").cast("string"), F.lit(" pp")).alias("shift"), F.col("p_value").alias("p"))
