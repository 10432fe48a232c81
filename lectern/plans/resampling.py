"""Resampling by a hash instead of a random stream, so that SQL can repeat it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..domain import EPS_THEME, PAIRS, REGIONS, SEED, SQL_BASE, THEMES, by_region, inst_theme, region_pairs, sql
from .agreement import _BY, _q, by_chunk, paired
from .catalog import query
from .inference import region_theme, theme_pairs

#: Subsamples of institutions, and draws of a bootstrap.
RESAMPLES, DRAWS = 1000, 2000
R = 9
rnd = lambda c, a: F.round(c, R).alias(a)
#: Uniform in [0, 1) from a key, the same in Spark and DuckDB.
U_SPARK = "cast(conv(substr(md5(concat_ws(':', {seed}, {b}, {key})), 1, 8), 16, 10) as bigint) / 4294967296D"
U_DUCK = "('0x' || substr(md5(concat_ws(':', {seed}, {b}, {key})), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def over_cores(draws: DataFrame) -> DataFrame:
    """Few counts and many draws of each: spread by number of draw, as a plan by size would leave them to one core."""
    return draws.repartition(draws.sparkSession.sparkContext.defaultParallelism, "b")


def wide_themes(spark, d) -> DataFrame:
    return inst_theme(spark, d).groupBy("institution_id", "region").pivot("theme", list(THEMES)).agg(F.max("v"))


_WT = "wt AS (SELECT * FROM wide)"


def _resample_sql() -> str:
    u = U_DUCK.format(seed=SEED, b="b", key="institution_id")
    return _q(
        f"""rs0 AS (SELECT w.*, b, row_number() OVER (PARTITION BY b ORDER BY {u}, institution_id) AS k, count(*) OVER (PARTITION BY b) AS m FROM wide w CROSS JOIN (SELECT unnest(range({RESAMPLES})) AS b)),
rs1 AS (SELECT * FROM rs0 WHERE k <= round_even(0.8 * m, 0)),
rs2 AS (SELECT b, region, theme, sum(v)::DOUBLE / count(*) AS p FROM (UNPIVOT (SELECT b, region, {', '.join(THEMES)} FROM rs1) ON {', '.join(THEMES)} INTO NAME theme VALUE v) GROUP BY ALL),
rs3 AS (SELECT x.b, x.theme, x.region AS region_a, y.region AS region_b, x.p - y.p AS diff FROM rs2 x JOIN regions rx ON rx.region = x.region JOIN rs2 y ON x.b = y.b AND x.theme = y.theme JOIN regions ry ON ry.region = y.region AND rx.ord < ry.ord),
full_ AS (SELECT theme, region_a, region_b, x_a::DOUBLE / nullif(n_a, 0) - x_b::DOUBLE / nullif(n_b, 0) AS full_diff FROM pairs)""",
        f"""SELECT theme, region_a, region_b, round(any_value(full_diff), 9) AS full_diff, round(sum(CASE WHEN full_diff <> 0 AND sign(round(diff, 12)) = sign(round(full_diff, 12)) THEN 1 ELSE 0 END)::DOUBLE / {RESAMPLES}, 9) AS same_sign, round(quantile_cont(diff, 0.5), 9) AS median, round(quantile_cont(diff, 0.05), 9) AS p5, round(quantile_cont(diff, 0.95), 9) AS p95
        FROM rs3 JOIN full_ USING (theme, region_a, region_b) GROUP BY ALL""",
    )


@query(_resample_sql())
def resample_stability(spark, d):
    """Signs of region differences when four fifths of the institutions are drawn, by replicate.

    One pass draws for all themes. The institutions of a replicate are ranked by
    a hash; there are as many as in the sampling frame, not in the corpus.
    """
    rows = wide_themes(spark, d).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(RESAMPLES - 1))))
    u = F.expr(U_SPARK.format(seed=SEED, b="b", key="institution_id"))
    k = F.row_number().over(Window.partitionBy("b").orderBy(u, "institution_id"))
    m = F.count(F.lit(1)).over(Window.partitionBy("b"))
    drawn = rows.withColumns({"k": k, "m": m}).where(F.col("k") <= F.bround(0.8 * F.col("m"), 0))
    sums = drawn.groupBy("b", "region").agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in THEMES]).unpivot(["b", "region", "n"], list(THEMES), "theme", "x")
    diffs = region_pairs(by_region(sums, ["b", "theme"], F.max("x").alias("x"), F.max("n").alias("n")), ["b", "theme"], {"x": "bigint", "n": "bigint"}).where("n_a > 0 and n_b > 0")
    diffs = diffs.withColumn("diff", F.col("x_a").cast("double") / F.col("n_a") - F.col("x_b").cast("double") / F.col("n_b"))
    full = theme_pairs(spark, d).select("theme", "region_a", "region_b", (F.try_divide(F.col("x_a").cast("double"), F.col("n_a").cast("double")) - F.try_divide(F.col("x_b").cast("double"), F.col("n_b").cast("double"))).alias("full_diff"))
    both = diffs.join(full, ["theme", "region_a", "region_b"])
    same = (F.round("full_diff", 12) != 0) & (F.signum(F.round("diff", 12)) == F.signum(F.round("full_diff", 12)))
    q = F.percentile("diff", F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95)))
    out = both.groupBy("theme", "region_a", "region_b").agg(F.first("full_diff").alias("full_diff"), (F.sum(same.cast("int")).cast("double") / RESAMPLES).alias("same_sign"), q.alias("q"))
    return out.select("theme", "region_a", "region_b", rnd(F.col("full_diff"), "full_diff"), rnd(F.col("same_sign"), "same_sign"), rnd(F.col("q")[0], "median"), rnd(F.col("q")[1], "p5"), rnd(F.col("q")[2], "p95"))


_LOO = """lo AS (SELECT r.region AS dropped, t.theme, i.region, sum(v)::BIGINT AS x, count(*) AS n FROM inst_theme i JOIN regions r ON r.region <> i.region JOIN themes_ t USING (theme) GROUP BY ALL),
lp AS (SELECT d.region AS dropped, p.theme, p.region_a, p.region_b, a.x::DOUBLE / nullif(a.n, 0) - b.x::DOUBLE / nullif(b.n, 0) AS diff, p.x_a::DOUBLE / nullif(p.n_a, 0) - p.x_b::DOUBLE / nullif(p.n_b, 0) AS full_diff
    FROM pairs p JOIN regions d ON d.region <> p.region_a AND d.region <> p.region_b LEFT JOIN lo a ON a.dropped = d.region AND a.theme = p.theme AND a.region = p.region_a LEFT JOIN lo b ON b.dropped = d.region AND b.theme = p.theme AND b.region = p.region_b),
ls AS (SELECT *, CAST(coalesce(diff = 0 OR full_diff = 0 OR sign(diff) = sign(full_diff), true) AS INTEGER) AS same_sign FROM lp)"""


@query(_q(_LOO, "SELECT dropped, theme, region_a, region_b, round(diff, 9) AS diff, round(full_diff, 9) AS full_diff, same_sign FROM ls"))
def leave_one_region_out(spark, d):
    """Differences counted anew without each region in turn, and whether their sign is that of all regions; a difference of 0 or null keeps it."""
    rest = F.explode(F.filter(F.array(*map(F.lit, REGIONS)), lambda r: r != F.col("region")))
    rows = inst_theme(spark, d).groupBy("theme", "region").agg(F.sum("v").cast("bigint").alias("x"), F.count(F.lit(1)).alias("n")).withColumn("dropped", rest)
    diff = F.try_divide(F.col("x_a").cast("double"), F.col("n_a").cast("double")) - F.try_divide(F.col("x_b").cast("double"), F.col("n_b").cast("double"))
    left = region_pairs(by_region(rows, ["dropped", "theme"], F.max("x").alias("x"), F.max("n").alias("n")), ["dropped", "theme"], {"x": "bigint", "n": "bigint"})
    left = left.where("dropped <> region_a and dropped <> region_b").withColumn("diff", diff).drop("x_a", "x_b", "n_a", "n_b")
    dropped = F.explode(F.filter(F.array(*map(F.lit, REGIONS)), lambda r: (r != F.col("region_a")) & (r != F.col("region_b"))))
    full = theme_pairs(spark, d).withColumn("full_diff", diff).select(dropped.alias("dropped"), "theme", "region_a", "region_b", "full_diff")
    same = (F.col("diff") == 0) | (F.col("full_diff") == 0) | (F.signum("diff") == F.signum("full_diff"))
    both = full.join(left, ["dropped", "theme", "region_a", "region_b"], "left")
    return both.select("dropped", "theme", "region_a", "region_b", rnd(F.col("diff"), "diff"), rnd(F.col("full_diff"), "full_diff"), F.coalesce(same, F.lit(True)).cast("int").alias("same_sign"))


@query(_q(_LOO, "SELECT dropped, count(*) AS n, sum(same_sign)::BIGINT AS n_same, round(sum(same_sign)::DOUBLE / count(*), 9) AS ratio FROM ls GROUP BY ALL"))
def leave_one_out_summary(spark, d):
    """By dropped region the share of differences whose sign stays."""
    g = leave_one_region_out(spark, d).groupBy("dropped").agg(F.count(F.lit(1)).alias("n"), F.sum("same_sign").cast("bigint").alias("n_same"))
    return g.withColumn("ratio", F.round(F.col("n_same").cast("double") / F.col("n"), R))


@query(f"SELECT CAST(row_number() OVER (ORDER BY same_sign DESC, theme, region_a, region_b) AS INTEGER) AS place, theme, region_a, region_b, CAST(sign(full_diff) AS INTEGER) AS full_sign, same_sign FROM ({_resample_sql()}) QUALIFY place <= 12")
def stability_top(spark, d):
    """The twelve most stable differences of the resamples."""
    top = resample_stability(spark, d).orderBy(F.desc("same_sign"), "theme", "region_a", "region_b").limit(12)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("same_sign"), "theme", "region_a", "region_b"))).select("place", "theme", "region_a", "region_b", F.signum("full_diff").cast("int").alias("full_sign"), "same_sign")


@query(
    _q(
        """st AS (SELECT c.institution_id, c.region, CASE WHEN bool_or(c.language_declared IS DISTINCT FROM 'en') THEN 'other' ELSE 'en' END AS protocol FROM coded c GROUP BY ALL)""",
        "SELECT protocol, theme, i.region, sum(v)::BIGINT AS x, count(*) AS n, round(sum(v)::DOUBLE / count(*), 9) AS prevalence FROM inst_theme i JOIN st USING (institution_id) GROUP BY ALL",
    )
)
def protocol_strata(spark, d):
    """Prevalence by stratum of institutions: those all of whose passages are declared English, and the others."""
    from ..domain import coded

    st = coded(spark, d).groupBy("institution_id").agg(F.max((~F.col("language_declared").eqNullSafe("en")).cast("int")).alias("other_"))
    st = st.select("institution_id", F.when(F.col("other_") == 1, "other").otherwise("en").alias("protocol"))
    g = inst_theme(spark, d).join(st, "institution_id").groupBy("protocol", "theme", "region").agg(F.sum("v").cast("bigint").alias("x"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("prevalence", F.round(F.col("x").cast("double") / F.col("n"), R))


@query("SELECT language_detected, round(quantile_cont(text_length_chars, 0.025), 9) AS p2_5, round(quantile_cont(text_length_chars, 0.5), 9) AS p50, round(quantile_cont(text_length_chars, 0.975), 9) AS p97_5 FROM policy_documents GROUP BY ALL")
def percentile_ci(spark, d):
    """Percentiles by linear interpolation."""
    from ..session import table

    q = F.percentile("text_length_chars", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return table(spark, d, "policy_documents").groupBy("language_detected").agg(q.alias("q")).select("language_detected", *[rnd(F.col("q")[k], a) for k, a in enumerate(("p2_5", "p50", "p97_5"))])


@query(
    _q(
        _BY + f""",
ul AS (SELECT chunk_id, model_name, theme, y FROM (UNPIVOT (SELECT chunk_id, model_name, {', '.join(THEMES)} FROM bychunk) ON {', '.join(THEMES)} INTO NAME theme VALUE y)),
sc AS (SELECT chunk_id, theme, avg(y) AS p FROM ul WHERE model_name <> 'brimstone-32b' GROUP BY ALL),
au AS (SELECT theme, p, y FROM sc JOIN ul USING (chunk_id, theme) WHERE model_name = 'brimstone-32b'),
ar AS (SELECT *, rank() OVER (PARTITION BY theme ORDER BY round(p, 12)) + (count(*) OVER (PARTITION BY theme, round(p, 12)) - 1) / 2.0::DOUBLE AS rk FROM au)""",
        "SELECT theme, count(*) AS n, sum(y)::BIGINT AS n_pos, round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y)::DOUBLE * (count(*) - sum(y)), 0), 9) AS auroc, round(avg((p - y) * (p - y)), 9) AS brier FROM ar GROUP BY theme",
    )
)
def auroc_brier(spark, d):
    """How the other coders' mean vote on each theme ranks and scores the first coder's label; average ranks by value.

    Labels are counted by score first: a score has few distinct values, being a
    mean of a few dozen votes at most.
    """
    from ..domain import PRIMARY

    rows = by_chunk(spark, d)
    score = rows.where(F.col("model_name") != PRIMARY).groupBy("chunk_id").agg(*[F.avg(t).alias(f"p_{t}") for t in THEMES])
    both = rows.where(F.col("model_name") == PRIMARY).join(score, "chunk_id")
    both = both.select(F.explode(F.array(*[F.struct(F.lit(t).alias("theme"), F.col(t).alias("y"), F.col(f"p_{t}").alias("p")) for t in THEMES])).alias("x")).select("x.*")
    by_value = both.groupBy("theme", F.round("p", 12).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sq"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("theme").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = by_value.withColumn("rk", below + 1 + (F.col("n") - 1) / 2.0)
    out = ranks.groupBy("theme").agg(F.sum("n").alias("n"), F.sum("pos").cast("bigint").alias("n_pos"), F.sum(F.col("rk") * F.col("pos")).alias("s"), F.sum("sq").alias("sq"))
    auroc = (F.col("s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / F.nullif((F.col("n_pos") * (F.col("n") - F.col("n_pos"))).cast("double"), F.lit(0.0))
    return out.select("theme", "n", "n_pos", rnd(auroc, "auroc"), rnd(F.col("sq") / F.col("n"), "brier"))


def _boot_sql() -> str:
    u = U_DUCK.format(seed=SEED, b="b", key="concat_ws('/', theme, region)")
    return _q(
        f"""bk AS (SELECT theme, region, x, n, k, CASE WHEN x = 0 OR x = n THEN 0 WHEN k = 0 THEN n * ln(1 - x::DOUBLE / n) ELSE ln((n - k + 1)::DOUBLE / k) + ln(x::DOUBLE / (n - x)) END AS lr FROM (SELECT theme, region, x, n, unnest(range(n + 1)) AS k FROM rt WHERE n > 0)),
bm AS (SELECT theme, region, x, n, k, exp(sum(lr) OVER (PARTITION BY theme, region ORDER BY k ROWS UNBOUNDED PRECEDING)) AS pmf FROM bk),
bc AS (SELECT theme, region, any_value(x) AS x, any_value(n) AS n, list(cdf ORDER BY k) AS cdf FROM (SELECT *, sum(pmf) OVER (PARTITION BY theme, region ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf FROM bm) GROUP BY theme, region),
bu AS (SELECT *, {u} AS u FROM bc CROSS JOIN (SELECT unnest(range({DRAWS})) AS b)),
bp AS (SELECT theme, region, b, CASE WHEN x = 0 OR x = n THEN x ELSE least(n, len(list_filter(cdf, lambda c: c < u))) END::DOUBLE / n AS p FROM bu),
bd AS (SELECT x.theme, x.region AS region_a, y.region AS region_b, x.p - y.p AS diff FROM bp x JOIN regions rx ON rx.region = x.region JOIN bp y ON x.b = y.b AND x.theme = y.theme JOIN regions ry ON ry.region = y.region AND rx.ord < ry.ord)""",
        "SELECT theme, region_a, region_b, round(quantile_cont(diff, 0.025), 9) AS ci_low, round(quantile_cont(diff, 0.975), 9) AS ci_high FROM bd GROUP BY ALL",
    )


@query(_boot_sql())
def bootstrap_diff_prop(spark, d):
    """Parametric bootstrap of region differences: binomial draws from the counts by theme and region.

    A draw is one uniform number put through the inverse of the binomial's
    distribution, which is summed once a theme and region, in logarithms.
    """
    counts = region_theme(spark, d).where("n > 0").select("theme", "region", "x", "n")
    w = Window.partitionBy("theme", "region").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when((F.col("x") == 0) | (F.col("x") == F.col("n")), 0.0).when(F.col("k") == 0, F.col("n") * F.log(1 - F.col("x").cast("double") / F.col("n"))).otherwise(F.log((F.col("n") - F.col("k") + 1).cast("double") / F.col("k")) + F.log(F.col("x").cast("double") / (F.col("n") - F.col("x"))))
    rows = counts.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n").cast("int")))).withColumn("lr", step).withColumn("pmf", F.exp(F.sum("lr").over(w))).withColumn("c", F.sum("pmf").over(w))
    cdf = rows.groupBy("theme", "region", "x", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda s: s["c"]).alias("cdf"))
    drawn = over_cores(cdf.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))).withColumn("u", F.expr(U_SPARK.format(seed=SEED, b="b", key="concat_ws('/', theme, region)")))
    at = F.least(F.col("n"), F.size(F.filter("cdf", lambda c: c < F.col("u"))).cast("bigint"))
    p = drawn.select("theme", "region", "b", "n", F.when((F.col("x") == 0) | (F.col("x") == F.col("n")), F.col("x")).otherwise(at).cast("bigint").alias("x"))
    diffs = region_pairs(by_region(p, ["b", "theme"], F.max("x").alias("x"), F.max("n").alias("n")), ["b", "theme"], {"x": "bigint", "n": "bigint"}).where("n_a > 0 and n_b > 0")
    diffs = diffs.withColumn("diff", F.col("x_a").cast("double") / F.col("n_a") - F.col("x_b").cast("double") / F.col("n_b"))
    q = F.percentile("diff", F.array(F.lit(0.025), F.lit(0.975)))
    return diffs.groupBy("theme", "region_a", "region_b").agg(q.alias("q")).select("theme", "region_a", "region_b", rnd(F.col("q")[0], "ci_low"), rnd(F.col("q")[1], "ci_high"))


def _boot_mean_sql() -> str:
    u = U_DUCK.format(seed=SEED, b="b", key="concat_ws('/', use, region, i)")
    return sql(
        """SELECT use, region_a, region_b, round(quantile_cont(diff, 0.025), 9) AS ci_low, round(quantile_cont(diff, 0.975), 9) AS ci_high FROM md GROUP BY ALL""",
        SQL_BASE.rstrip() + f""",
mg AS (SELECT use, region, list(round(mean, 9) ORDER BY round(mean, 9)) AS m, count(*) AS n FROM inst_sent GROUP BY ALL HAVING count(*) > 1),
mu AS (SELECT use, region, m, n, b, i, {u} AS u FROM (SELECT use, region, m, n, b, unnest(range(n)) AS i FROM mg CROSS JOIN (SELECT unnest(range({DRAWS})) AS b))),
mb AS (SELECT use, region, b, sum(m[CAST(floor(u * n) AS INTEGER) + 1]) / any_value(n) AS mean FROM mu GROUP BY use, region, b),
md AS (SELECT x.use, x.region AS region_a, y.region AS region_b, x.mean - y.mean AS diff FROM mb x JOIN regions rx ON rx.region = x.region JOIN mb y ON x.b = y.b AND x.use = y.use JOIN regions ry ON ry.region = y.region AND rx.ord < ry.ord)""",
    )


@query(_boot_mean_sql())
def bootstrap_diff_mean(spark, d):
    """Bootstrap limits of differences of mean sentiment between regions of at least two institutions.

    A draw takes as many institutions as the region has, with repeats, by a hash;
    a region's means fit one row, the sampling frame being what it is.
    """
    from ..domain import inst_sentiment

    rows = inst_sentiment(spark, d).groupBy("use", "region").agg(F.array_sort(F.collect_list(F.round("mean", 9))).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    u = U_SPARK.format(seed=SEED, b="b", key="concat_ws('/', use, region, i)")
    drawn = over_cores(rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))))
    drawn = drawn.withColumn("mean", F.expr(f"aggregate(sequence(0, cast(n as int) - 1), 0D, (acc, i) -> acc + m[cast(floor({u} * n) as int)]) / n"))
    diffs = region_pairs(by_region(drawn, ["b", "use"], F.max("mean").alias("mean"), F.max("n").alias("n")), ["b", "use"], {"mean": "double", "n": "bigint"}).where("n_a > 0 and n_b > 0")
    q = F.percentile(F.col("mean_a") - F.col("mean_b"), F.array(F.lit(0.025), F.lit(0.975)))
    return diffs.groupBy("use", "region_a", "region_b").agg(q.alias("q")).select("use", "region_a", "region_b", rnd(F.col("q")[0], "ci_low"), rnd(F.col("q")[1], "ci_high"))
