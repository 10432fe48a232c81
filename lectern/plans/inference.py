"""Prevalence by region and the tests on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..domain import ALPHA, EPS_SENTIMENT, EPS_THEME, FDR_Q, PAIRS, PRIMARY, REGIONS, THEMES, USES, by_region, codings, grid, inst_sentiment, inst_theme, institutions, long, region_pairs, sql
from ..functions.special import Duck, chi2_upper, f_upper, normal_two_sided, normal_upper
from ..operators import stats
from .catalog import query

R = 9
rnd = lambda c, a: F.round(c, R).alias(a)
rnd7 = lambda c: F.round(c, 7).alias(c)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """A row a theme: the map m of region -> (x, n)."""
    return by_region(inst_theme(spark, d), ["theme"], F.sum("v").alias("x"), F.count(F.lit(1)).alias("n"))


def region_theme(spark: SparkSession, d: str) -> DataFrame:
    """theme, region, x, n for every theme and region, 0 where there is none."""
    counts = inst_theme(spark, d).groupBy("theme", "region").agg(F.sum("v").alias("x"), F.count(F.lit(1)).alias("n"))
    full = grid(spark, theme=THEMES, region=REGIONS).join(counts, ["theme", "region"], "left")
    return full.select("theme", "region", F.coalesce("x", F.lit(0)).cast("bigint").alias("x"), F.coalesce("n", F.lit(0)).alias("n"))


def theme_pairs(spark: SparkSession, d: str) -> DataFrame:
    return region_pairs(_counts(spark, d), ["theme"], {"x": "bigint", "n": "bigint"})


@query(sql("SELECT theme, region, x, n, round(x / nullif(n, 0), 9) AS prevalence FROM rt"))
def region_theme_prevalence(spark, d):
    return region_theme(spark, d).select("theme", "region", "x", "n", rnd(stats.ratio("x", "n"), "prevalence"))


def _w(x: str, n: str, z: float) -> tuple[str, str]:
    p, k = f"({x}::DOUBLE / nullif({n}, 0))", z * z
    scale = f"(1 + {k!r} / nullif({n}, 0))"
    centre, half = f"(({p} + {k!r} / (2 * nullif({n}, 0)::DOUBLE)) / {scale})", f"({z!r} * sqrt({p} * (1 - {p}) / nullif({n}, 0) + {k!r} / (4 * nullif({n}::DOUBLE * {n}, 0))) / {scale})"
    return f"coalesce(greatest(0.0::DOUBLE, {centre} - {half}), 0.0)", f"coalesce(least(1.0::DOUBLE, {centre} + {half}), 1.0)"


_lo, _hi = _w("x", "n", stats.Z95)


@query(sql(f"SELECT theme, region, x, n, round(x / nullif(n, 0), 9) AS prevalence, round({_lo}, 9) AS ci_low, round({_hi}, 9) AS ci_high FROM rt"))
def wilson_ci(spark, d):
    low, high = stats.wilson("x", "n")
    return region_theme(spark, d).select("theme", "region", "x", "n", rnd(stats.ratio("x", "n"), "prevalence"), rnd(low, "ci_low"), rnd(high, "ci_high"))


@query(sql("SELECT use, region, count(*) AS n, round(avg(mean), 9) AS mean, round(stddev_samp(mean), 9) AS sd FROM inst_sent GROUP BY ALL"))
def region_sentiment(spark, d):
    return inst_sentiment(spark, d).groupBy("use", "region").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("mean"), "mean"), rnd(F.stddev_samp("mean"), "sd"))


@query(
    sql(
        f"SELECT region, theme, count(*) AS n_chunks, sum(v)::BIGINT AS n_coded, round(sum(v)::DOUBLE / count(*), 9) AS prevalence FROM (UNPIVOT (SELECT region, {', '.join(THEMES)} FROM coded) ON {', '.join(THEMES)} INTO NAME theme VALUE v) GROUP BY ALL"
    )
)
def chunk_level_prevalence(spark, d):
    own = codings(spark, d).where(F.col("model_name") == PRIMARY).join(institutions(spark, d).select("institution_id", "region"), "institution_id")
    wide = own.groupBy("region").agg(F.count(F.lit(1)).alias("n_chunks"), *[F.sum(t).alias(t) for t in THEMES])
    return long(wide, ["region", "n_chunks"], THEMES, "theme", "n_coded").select("region", "theme", "n_chunks", "n_coded", rnd(stats.ratio("n_coded", "n_chunks"), "prevalence"))


_pa, _pb = "(x_a::DOUBLE / nullif(n_a, 0))", "(x_b::DOUBLE / nullif(n_b, 0))"
(_la, _ua), (_lb, _ub) = _w("x_a", "n_a", stats.Z90), _w("x_b", "n_b", stats.Z90)
_nlow = f"coalesce({_pa} - {_pb} - sqrt(({_pa} - {_la}) * ({_pa} - {_la}) + ({_ub} - {_pb}) * ({_ub} - {_pb})), -1.0)"
_nhigh = f"coalesce({_pa} - {_pb} + sqrt(({_ua} - {_pa}) * ({_ua} - {_pa}) + ({_pb} - {_lb}) * ({_pb} - {_lb})), 1.0)"


@query(sql(f"SELECT theme, region_a, region_b, round({_pa} - {_pb}, 9) AS diff, round({_nlow}, 9) AS ci_low, round({_nhigh}, 9) AS ci_high FROM pairs"))
def newcombe_ci(spark, d):
    low, high = stats.newcombe("x_a", "n_a", "x_b", "n_b")
    return theme_pairs(spark, d).select("theme", "region_a", "region_b", rnd(stats.ratio("x_a", "n_a") - stats.ratio("x_b", "n_b"), "diff"), rnd(low, "ci_low"), rnd(high, "ci_high"))


def _tost_theme(spark, d) -> DataFrame:
    pa, pb = stats.ratio("x_a", "n_a"), stats.ratio("x_b", "n_b")
    low, high = stats.newcombe("x_a", "n_a", "x_b", "n_b")
    se = F.sqrt(pa * (1 - pa) / F.nullif(F.col("n_a").cast("double"), F.lit(0.0)) + pb * (1 - pb) / F.nullif(F.col("n_b").cast("double"), F.lit(0.0)))
    df = theme_pairs(spark, d).withColumns({"diff": pa - pb, "ci_low": low, "ci_high": high, "se": F.when(se == 0, 1e-9).otherwise(se)})
    df = df.withColumns({"z_low": (F.col("diff") + EPS_THEME) / F.col("se"), "z_high": -(F.col("diff") - EPS_THEME) / F.col("se")})
    df = df.withColumns({"p_low": stats.p_upper("z_low"), "p_high": stats.p_upper("z_high")})
    return df.withColumns({"equivalent": ((F.col("ci_low") > -EPS_THEME) & (F.col("ci_high") < EPS_THEME)).cast("int"), "p": F.greatest("p_low", "p_high")})


_TOST = f"""tost0 AS (SELECT theme, region_a, region_b, {_pa} - {_pb} AS diff, {_nlow} AS ci_low, {_nhigh} AS ci_high, sqrt({_pa} * (1 - {_pa}) / nullif(n_a, 0) + {_pb} * (1 - {_pb}) / nullif(n_b, 0)) AS se0 FROM pairs),
tost1 AS (SELECT *, CASE WHEN se0 = 0 THEN 1e-9 ELSE se0 END AS se FROM tost0),
tost2 AS (SELECT *, (diff + {EPS_THEME}::DOUBLE) / se AS z_low, -(diff - {EPS_THEME}::DOUBLE) / se AS z_high FROM tost1),
tost3 AS (SELECT *, CASE WHEN z_low IS NULL THEN NULL ELSE {normal_upper(Duck, 'z_low')} END AS p_low, CASE WHEN z_high IS NULL THEN NULL ELSE {normal_upper(Duck, 'z_high')} END AS p_high FROM tost2),
tost AS (SELECT *, CAST(ci_low > -{EPS_THEME} AND ci_high < {EPS_THEME} AS INTEGER) AS equivalent, greatest(p_low, p_high) AS p FROM tost3)"""


def _more(extra: str, q: str) -> str:
    from ..domain import SQL_BASE

    return sql(q, SQL_BASE.rstrip() + ",\n" + extra)


@query(_more(_TOST, "SELECT theme, region_a, region_b, round(diff, 9) AS diff, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, round(p_low, 9) AS p_low, round(p_high, 9) AS p_high, equivalent FROM tost"))
def tost_theme(spark, d):
    return _tost_theme(spark, d).select("theme", "region_a", "region_b", *[rnd(F.col(c), c) for c in ("diff", "ci_low", "ci_high", "p_low", "p_high")], "equivalent")


def _tost_sentiment(spark, d) -> DataFrame:
    moments = by_region(inst_sentiment(spark, d), ["use"], F.count(F.lit(1)).alias("n"), F.avg("mean").alias("m"), F.coalesce(F.var_samp("mean"), F.lit(0.0)).alias("v"))
    df = region_pairs(moments, ["use"], {"n": "bigint", "m": "double", "v": "double"})
    part = lambda s: F.col(f"v_{s}") / F.nullif(F.col(f"n_{s}").cast("double"), F.lit(0.0))
    se = F.sqrt(part("a") + part("b"))
    df = df.where("n_a > 1 and n_b > 1").withColumns({"diff": F.col("m_a") - F.col("m_b"), "se": F.when(se == 0, 1e-9).otherwise(se)})
    df = df.withColumns({"ci_low": F.col("diff") - stats.Z90 * F.col("se"), "ci_high": F.col("diff") + stats.Z90 * F.col("se"), "z_low": (F.col("diff") + EPS_SENTIMENT) / F.col("se"), "z_high": -(F.col("diff") - EPS_SENTIMENT) / F.col("se")})
    df = df.withColumn("p", F.greatest(stats.p_upper("z_low"), stats.p_upper("z_high")))
    return df.withColumn("equivalent", ((F.col("ci_low") > -EPS_SENTIMENT) & (F.col("ci_high") < EPS_SENTIMENT)).cast("int"))


_SENT = f"""sm AS (SELECT use, region, count(*) AS n, avg(mean) AS m, coalesce(var_samp(mean), 0) AS v FROM inst_sent GROUP BY ALL),
sp AS (SELECT a.use, a.region AS region_a, b.region AS region_b, a.m - b.m AS diff, sqrt(a.v / a.n + b.v / b.n) AS se0 FROM sm a JOIN regions ra ON ra.region = a.region JOIN sm b ON a.use = b.use JOIN regions rb ON rb.region = b.region AND ra.ord < rb.ord WHERE a.n > 1 AND b.n > 1),
sq AS (SELECT *, CASE WHEN se0 = 0 THEN 1e-9 ELSE se0 END AS se FROM sp),
sz AS (SELECT *, diff - {stats.Z90!r} * se AS ci_low, diff + {stats.Z90!r} * se AS ci_high, (diff + {EPS_SENTIMENT}::DOUBLE) / se AS z_low, -(diff - {EPS_SENTIMENT}::DOUBLE) / se AS z_high FROM sq),
stost AS (SELECT *, greatest({normal_upper(Duck, 'z_low')}, {normal_upper(Duck, 'z_high')}) AS p, CAST(ci_low > -{EPS_SENTIMENT} AND ci_high < {EPS_SENTIMENT} AS INTEGER) AS equivalent FROM sz)"""


@query(_more(_SENT, "SELECT use, region_a, region_b, round(diff, 9) AS diff, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, round(p, 9) AS p, equivalent FROM stost"))
def tost_sentiment(spark, d):
    return _tost_sentiment(spark, d).select("use", "region_a", "region_b", *[rnd(F.col(c), c) for c in ("diff", "ci_low", "ci_high", "p")], "equivalent")


@query(
    _more(
        _TOST + ",\n" + _SENT + f""",
family AS (SELECT theme AS name, region_a, region_b, coalesce(p, 1.0) AS p FROM tost UNION ALL SELECT use, region_a, region_b, p FROM stost),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(p, 12), name, region_a, region_b) AS rk, count(*) OVER () AS m FROM family),
cut AS (SELECT coalesce(max(CASE WHEN round(p, 12) <= {FDR_Q}::DOUBLE * rk / m THEN rk END), 0) AS k FROM ranked)""",
        "SELECT name, region_a, region_b, round(p, 9) AS p, CAST(rk AS INTEGER) AS rk, CAST(rk <= k AS INTEGER) AS reject FROM ranked, cut",
    )
)
def bh_fdr(spark, d):
    """Step-up control over the tests of themes and sentiments; the family has a fixed few members."""
    a = _tost_theme(spark, d).select(F.col("theme").alias("name"), "region_a", "region_b", F.coalesce("p", F.lit(1.0)).alias("p"))
    family = a.unionByName(_tost_sentiment(spark, d).select(F.col("use").alias("name"), "region_a", "region_b", "p"))
    everything = Window.partitionBy(F.lit(1))
    ranked = family.withColumn("rk", F.row_number().over(everything.orderBy(F.round("p", 12), "name", "region_a", "region_b"))).withColumn("m", F.count(F.lit(1)).over(everything))
    cut = F.coalesce(F.max(F.when(F.round("p", 12) <= FDR_Q * F.col("rk") / F.col("m"), F.col("rk"))).over(everything), F.lit(0))
    return ranked.select("name", "region_a", "region_b", rnd(F.col("p"), "p"), "rk", (F.col("rk") <= cut).cast("int").alias("reject"))


def _pooled(spark, d) -> DataFrame:
    pool = (F.col("x_a") + F.col("x_b")).cast("double") / F.nullif((F.col("n_a") + F.col("n_b")).cast("double"), F.lit(0.0))
    inv = lambda n: 1 / F.nullif(F.col(n).cast("double"), F.lit(0.0))
    se = F.sqrt(pool * (1 - pool) * (inv("n_a") + inv("n_b")))
    df = theme_pairs(spark, d).withColumns({"diff": stats.ratio("x_a", "n_a") - stats.ratio("x_b", "n_b"), "se": se})
    df = df.withColumn("z", F.col("diff") / F.nullif("se", F.lit(0.0)))
    return df.withColumn("p", F.when(F.col("z").isNotNull(), stats.p_two_sided("z")))


_POOLED = f"""pool0 AS (SELECT *, (x_a + x_b)::DOUBLE / nullif(n_a + n_b, 0) AS pool FROM pairs),
pool1 AS (SELECT *, {_pa} - {_pb} AS diff, sqrt(pool * (1 - pool) * (1::DOUBLE / nullif(n_a, 0) + 1::DOUBLE / nullif(n_b, 0))) AS se FROM pool0),
pool2 AS (SELECT *, diff / nullif(se, 0) AS z FROM pool1),
pooled AS (SELECT *, CASE WHEN z IS NULL THEN NULL ELSE {normal_two_sided(Duck, 'z')} END AS p FROM pool2)"""


@query(_more(_POOLED, f"SELECT theme, region_a, region_b, round(z, 9) AS z, round(p, 9) AS p, coalesce(CAST(p < 0.05 AS INTEGER), 0) AS sig, coalesce(CAST(p < {ALPHA}::DOUBLE / 6 AS INTEGER), 0) AS sig_bonferroni FROM pooled"))
def bonferroni_pairwise(spark, d):
    flag = lambda at, name: F.coalesce((F.col("p") < at).cast("int"), F.lit(0)).alias(name)
    return _pooled(spark, d).select("theme", "region_a", "region_b", rnd(F.col("z"), "z"), rnd(F.col("p"), "p"), flag(0.05, "sig"), flag(ALPHA / len(PAIRS), "sig_bonferroni"))


@query(
    _more(
        _POOLED + f""",
hr AS (SELECT *, row_number() OVER (ORDER BY round(coalesce(p, 1.0), 12), theme, region_a, region_b) AS rk, count(*) OVER () AS m FROM pooled),
hf AS (SELECT *, min(CASE WHEN coalesce(p, 1.0) > {ALPHA}::DOUBLE / (m - rk + 1) THEN rk END) OVER () AS fail FROM hr)""",
        "SELECT theme, region_a, region_b, round(p, 9) AS p, CAST(rk AS INTEGER) AS rk, CAST(rk < coalesce(fail, m + 1) AS INTEGER) AS reject FROM hf",
    )
)
def holm_pairwise(spark, d):
    """Step-down control over all pairs and themes."""
    everything = Window.partitionBy(F.lit(1))
    p = F.coalesce("p", F.lit(1.0))
    ranked = _pooled(spark, d).withColumn("rk", F.row_number().over(everything.orderBy(F.round(p, 12), "theme", "region_a", "region_b"))).withColumn("m", F.count(F.lit(1)).over(everything))
    fail = F.min(F.when(p > ALPHA / (F.col("m") - F.col("rk") + 1), F.col("rk"))).over(everything)
    return ranked.select("theme", "region_a", "region_b", rnd(F.col("p"), "p"), "rk", (F.col("rk") < F.coalesce(fail, F.col("m") + 1)).cast("int").alias("reject"))


_chi = f"""cells AS (SELECT *, sum(x) OVER (PARTITION BY theme) AS sx, sum(n) OVER (PARTITION BY theme) AS sn FROM rt),
terms AS (SELECT theme, n, x, sx::DOUBLE * n / nullif(sn, 0) AS ey, (sn - sx)::DOUBLE * n / nullif(sn, 0) AS en FROM cells),
chi AS (SELECT theme, sum(CASE WHEN ey > 0 THEN (x - ey) * (x - ey) / ey ELSE 0 END + CASE WHEN en > 0 THEN (n - x - en) * (n - x - en) / en ELSE 0 END) AS chi2, sum(n)::DOUBLE AS n FROM terms GROUP BY theme),
both_ AS (SELECT theme, chi2, n FROM chi),
total AS (SELECT 'ALL' AS theme, sum(chi2) AS chi2, max(n) AS n FROM chi)"""


@query(
    _more(
        _chi,
        f"""SELECT theme, 3 AS df, round(chi2, 7) AS chi2, round({chi2_upper(Duck, 3, 'chi2')}, 9) AS p, round(sqrt(chi2 / nullif(n, 0)), 9) AS cramers_v FROM both_
        UNION ALL SELECT theme, 24, round(chi2, 7), round({chi2_upper(Duck, 24, 'chi2')}, 9), round(sqrt(chi2 / nullif(8 * n, 0)), 9) FROM total""",
    )
)
def chi2_region_theme(spark, d):
    """Homogeneity over regions: per theme (3 degrees of freedom) and summed over the eight (24)."""
    theme = Window.partitionBy("theme")
    share = lambda c: F.sum(c).over(theme).cast("double") * F.col("n") / F.nullif(F.sum("n").over(theme), F.lit(0))
    rows = region_theme(spark, d).withColumn("rest", F.col("n") - F.col("x")).withColumns({"ey": share("x"), "en": share("rest")})
    term = lambda o, e: F.when(F.col(e) > 0, (F.col(o) - F.col(e)) * (F.col(o) - F.col(e)) / F.col(e)).otherwise(0.0)
    chi = rows.groupBy("theme").agg(F.sum(term("x", "ey") + term("rest", "en")).alias("chi2"), F.sum("n").cast("double").alias("n"))
    per = chi.select("theme", F.lit(3).alias("df"), rnd7("chi2"), rnd(stats.p_chi2("chi2", 3), "p"), rnd(F.sqrt(F.col("chi2") / F.nullif("n", F.lit(0.0))), "cramers_v"))
    total = chi.agg(F.sum("chi2").alias("chi2"), F.max("n").alias("n"))
    return per.unionByName(total.select(F.lit("ALL").alias("theme"), F.lit(24).alias("df"), rnd7("chi2"), rnd(stats.p_chi2("chi2", 24), "p"), rnd(F.sqrt(F.col("chi2") / F.nullif(8 * F.col("n"), F.lit(0.0))), "cramers_v")))




@query(
    _more(
        f"""ca AS (SELECT theme, sum(n * (5 - ord))::DOUBLE AS ns, sum(n * (5 - ord) * (5 - ord))::DOUBLE AS nss, sum(x * (5 - ord))::DOUBLE AS xs, sum(x)::DOUBLE AS x, sum(n)::DOUBLE AS n FROM rt GROUP BY theme),
cb AS (SELECT theme, xs - x * ns / nullif(n, 0) AS num, (x / nullif(n, 0)) * (1 - x / nullif(n, 0)) * (nss - ns * ns / nullif(n, 0)) AS var FROM ca),
cz AS (SELECT *, num / sqrt(nullif(var, 0)) AS z FROM cb)""",
        f"SELECT theme, round(num, 7) AS num, round(var, 7) AS var, round(z, 9) AS z, CASE WHEN z IS NULL THEN NULL ELSE round({normal_two_sided(Duck, 'z')}, 9) END AS p FROM cz",
    )
)
def cochran_armitage(spark, d):
    """Trend over regions scored 4, 3, 2, 1 in their fixed order."""
    score = F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(REGIONS) for x in (r, 4 - k)]), F.col("region"))
    s = inst_theme(spark, d).withColumn("s", score).groupBy("theme").agg(*[F.sum(e).cast("double").alias(a) for e, a in ((F.col("s"), "ns"), (F.col("s") * F.col("s"), "nss"), (F.col("v") * F.col("s"), "xs"), (F.col("v"), "x"))], F.count(F.lit(1)).cast("double").alias("n"))
    p = F.col("x") / F.col("n")
    s = s.withColumns({"num": F.col("xs") - F.col("x") * F.col("ns") / F.col("n"), "var": p * (1 - p) * (F.col("nss") - F.col("ns") * F.col("ns") / F.col("n"))})
    s = s.withColumn("z", F.col("num") / F.sqrt(F.nullif("var", F.lit(0.0))))
    full = grid(spark, theme=THEMES).join(s, "theme", "left")
    return full.select("theme", rnd7("num"), rnd7("var"), rnd(F.col("z"), "z"), F.when(F.col("z").isNotNull(), F.round(stats.p_two_sided("z"), R)).alias("p"))


@query(
    _more(
        """am AS (SELECT use, region, count(*) AS n, avg(mean) AS m, var_samp(mean) AS v FROM inst_sent GROUP BY ALL HAVING count(*) > 1),
ag AS (SELECT use, count(*) AS k, sum(n)::DOUBLE AS n, sum(n * m) / sum(n) AS gm, sum(v * (n - 1)) AS ssw FROM am GROUP BY use HAVING count(*) > 1),
ab AS (SELECT ag.use, k - 1 AS df_between, CAST(ag.n - k AS BIGINT) AS df_within, sum(am.n * (m - gm) * (m - gm)) / (k - 1) AS msb, ssw / (ag.n - k) AS msw FROM am JOIN ag ON am.use = ag.use GROUP BY ag.use, k, ag.n, gm, ssw),
af AS (SELECT *, msb / nullif(msw, 0) AS f FROM ab)""",
        f"SELECT use, df_between, df_within, round(f, 7) AS f, CASE WHEN f IS NULL THEN NULL ELSE round({f_upper(Duck, 'f', 'df_between', 'df_within')}, 9) END AS p FROM af",
    )
)
def anova_sentiment(spark, d):
    """One-way analysis of institution means over regions with more than one institution."""
    g = inst_sentiment(spark, d).groupBy("use", "region").agg(F.count(F.lit(1)).alias("n"), F.avg("mean").alias("m"), F.var_samp("mean").alias("v")).where("n > 1")
    t = g.groupBy("use").agg(F.count(F.lit(1)).alias("k"), F.sum("n").cast("double").alias("nn"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum(F.col("v") * (F.col("n") - 1)).alias("ssw")).where("k > 1")
    b = g.join(t, "use").groupBy("use", "k", "nn", "ssw").agg(F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("ssb"))
    b = b.select("use", (F.col("k") - 1).alias("df_between"), (F.col("nn") - F.col("k")).cast("bigint").alias("df_within"), (F.col("ssb") / (F.col("k") - 1)).alias("msb"), (F.col("ssw") / (F.col("nn") - F.col("k"))).alias("msw"))
    b = b.withColumn("f", F.col("msb") / F.nullif("msw", F.lit(0.0)))
    return b.select("use", "df_between", "df_within", rnd7("f"), F.when(F.col("f").isNotNull(), F.round(stats.p_f("f", "df_between", "df_within"), R)).alias("p"))


_KW = """kr AS (SELECT use, region, round(mean, 12) AS v, rank() OVER (PARTITION BY use ORDER BY round(mean, 12)) + (count(*) OVER (PARTITION BY use, round(mean, 12)) - 1) / 2.0::DOUBLE AS rk FROM inst_sent),
kn AS (SELECT use, count(*)::DOUBLE AS n FROM kr GROUP BY use),
kg AS (SELECT use, region, sum(rk) AS s, count(*) AS n FROM kr GROUP BY ALL),
kt AS (SELECT use, sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT use, v, count(*)::DOUBLE AS t FROM kr GROUP BY ALL) GROUP BY use),
kh AS (SELECT kg.use, count(*) - 1 AS df, 12 / (kn.n * (kn.n + 1)) * sum(kg.s * kg.s / kg.n) - 3 * (kn.n + 1) AS h, 1 - ties / (kn.n * kn.n * kn.n - kn.n) AS c FROM kg JOIN kn ON kn.use = kg.use JOIN kt ON kt.use = kg.use GROUP BY kg.use, kn.n, ties),
kk AS (SELECT use, df, h / nullif(c, 0) AS h, c FROM kh)"""


@query(_more(_KW, f"SELECT use, df, round(h, 7) AS h, round(c, 9) AS tie_correction, round(CASE df WHEN 1 THEN {chi2_upper(Duck, 1, 'h')} WHEN 2 THEN {chi2_upper(Duck, 2, 'h')} WHEN 3 THEN {chi2_upper(Duck, 3, 'h')} END, 9) AS p FROM kk"))
def kruskal_wallis(spark, d):
    """Rank test of institution means over regions, with average ranks and tie correction.

    Ranks come from counts by distinct value, so that no window holds all institutions of a use in memory.
    """
    rows = inst_sentiment(spark, d).withColumn("v", F.round("mean", 12))
    by_value = rows.groupBy("use", "v").agg(F.count(F.lit(1)).alias("t"))
    below = Window.partitionBy("use").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_value.withColumn("rk", F.coalesce(F.sum("t").over(below), F.lit(0)) + 1 + (F.col("t") - 1) / 2.0)
    n = by_value.groupBy("use").agg(F.sum("t").cast("double").alias("n"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    g = rows.groupBy("use", "v", "region").agg(F.count(F.lit(1)).alias("k")).join(ranks.select("use", "v", "rk"), ["use", "v"]).groupBy("use", "region").agg(F.sum(F.col("rk") * F.col("k")).alias("s"), F.sum("k").alias("m"))
    h = g.join(n, "use").groupBy("use", "n", "ties").agg((F.count(F.lit(1)) - 1).alias("df"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"))
    h = h.withColumns({"h0": 12 / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1), "c": 1 - F.col("ties") / (F.col("n") * F.col("n") * F.col("n") - F.col("n"))})
    h = h.withColumn("h", F.col("h0") / F.nullif("c", F.lit(0.0)))
    p = F.when(F.col("df") == 1, stats.p_chi2("h", 1)).when(F.col("df") == 2, stats.p_chi2("h", 2)).when(F.col("df") == 3, stats.p_chi2("h", 3))
    return h.select("use", "df", rnd7("h"), rnd(F.col("c"), "tie_correction"), rnd(p, "p"))


@query(
    sql(
        """SELECT a.region AS region_a, b.region AS region_b, a.n AS n_a, b.n AS n_b, round((1.96::DOUBLE + 0.8416::DOUBLE) * sqrt(0.25 * (1::DOUBLE / a.n + 1::DOUBLE / b.n)) * 100, 7) AS mde_pp
        FROM (SELECT region, count(*) AS n FROM wide GROUP BY region) a JOIN (SELECT region, count(*) AS n FROM wide GROUP BY region) b ON a.region < b.region"""
    )
)
def mde_power(spark, d):
    """Least difference found with 80 % power, for pairs in the order of names."""
    pairs = tuple((a, b) for i, a in enumerate(sorted(REGIONS)) for b in sorted(REGIONS)[i + 1 :])
    n = inst_theme(spark, d).where(F.col("theme") == THEMES[0]).withColumn("k", F.lit(1))
    df = region_pairs(by_region(n, ["k"], F.count(F.lit(1)).alias("n")), ["k"], {"n": "bigint"}, pairs).where("n_a > 0 and n_b > 0")
    return df.select("region_a", "region_b", "n_a", "n_b", F.round((1.96 + 0.8416) * F.sqrt(0.25 * (1 / F.col("n_a").cast("double") + 1 / F.col("n_b").cast("double"))) * 100, 7).alias("mde_pp"))
