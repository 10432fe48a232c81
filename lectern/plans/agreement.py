"""Agreement between coders and with experts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import PRIMARY, REGIONS, SECOND, SQL_BASE, THEMES, USES, codings, grid, institutions, sql
from ..session import table
from .catalog import query

DIMS = THEMES + USES
rnd = lambda c, a: F.round(c, 9).alias(a)
_gold = {t: f"t{k + 1}" for k, t in enumerate(THEMES)} | {u: f"sent_{u}" for u in USES}


def by_chunk(spark, d) -> DataFrame:
    """One coding a passage and coder: of several seeds the last."""
    return codings(spark, d, by_seed=False).select("chunk_id", "model_name", "institution_id", *DIMS)


def paired(spark, d, other: Column, dims=THEMES) -> DataFrame:
    """Both codings of a passage, long: ``other``, ``dimension``, ``a``, ``b``; b is the coder held against the first."""
    rows = by_chunk(spark, d)
    a = rows.where(F.col("model_name") == PRIMARY).select("chunk_id", F.col("institution_id"), F.array(*dims).alias("a"))
    b = rows.where(other).select("chunk_id", F.col("model_name").alias("other"), F.array(*dims).alias("b"))
    both = a.join(b, "chunk_id")
    return both.select("chunk_id", "institution_id", "other", F.posexplode(F.arrays_zip("a", "b")).alias("k", "x")).select("chunk_id", "institution_id", "other", F.element_at(F.array(*map(F.lit, dims)), F.col("k") + 1).alias("dimension"), "x.a", "x.b")


def _cells(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: ``c``, the counts by label pair. Labels are a fixed few, so that a key's cells fit an array."""
    cells = pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "n")).alias("c"))


def _sum(cells: Column, value) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda acc, x: acc + value(x))


def _margin(side: str, label: Column) -> Column:
    return _sum(F.filter("c", lambda x: x[side] == label), lambda x: x["n"].cast("double"))


def _labels() -> Column:
    return F.array_sort(F.array_distinct(F.concat(F.transform("c", lambda x: x["a"]), F.transform("c", lambda x: x["b"]))))


def kappa(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Cohen's kappa of the columns a and b by keys: ``n``, ``p_obs``, ``p_exp``, ``kappa``.

    Counted by label pair before anything moves; the rest is arithmetic within
    the row. Certain chance agreement gives 1.
    """
    n = _sum(F.col("c"), lambda x: x["n"].cast("double"))
    same = _sum(F.filter("c", lambda x: x["a"] == x["b"]), lambda x: x["n"].cast("double"))
    chance = _sum(F.col("labels"), lambda l: _margin("a", l) * _margin("b", l))
    rows = _cells(pairs, keys).withColumns({"labels": _labels(), "n_": n}).withColumns({"p_obs": same / F.col("n_"), "p_exp": chance / (F.col("n_") * F.col("n_"))})
    return rows.select(*keys, F.col("n_").cast("bigint").alias("n"), "p_obs", "p_exp", F.when(F.col("p_exp") >= 1, 1.0).otherwise((F.col("p_obs") - F.col("p_exp")) / F.nullif(1 - F.col("p_exp"), F.lit(0.0))).alias("kappa"))


def weighted_kappa(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Quadratic-weighted kappa; weights use the dense place of the labels that occur."""
    rows = _cells(pairs, keys).withColumns({"labels": _labels(), "n_": _sum(F.col("c"), lambda x: x["n"].cast("double"))})
    k = F.size("labels").cast("double")

    def w(a: Column, b: Column) -> Column:
        d = (F.array_position("labels", a) - F.array_position("labels", b)).cast("double")
        return d * d / F.greatest(F.lit(1.0), (k - 1) * (k - 1))

    num = _sum(F.col("c"), lambda x: w(x["a"], x["b"]) * x["n"])
    den = _sum(F.col("labels"), lambda la: _sum(F.col("labels"), lambda lb: w(la, lb) * _margin("a", la) * _margin("b", lb)))
    rows = rows.withColumns({"num": num, "den": den})
    return rows.select(*keys, F.col("n_").cast("bigint").alias("n"), (1 - F.col("num") / F.nullif(F.col("den") / F.col("n_"), F.lit(0.0))).alias("kappa"))


_long = lambda src, dims: f"(UNPIVOT (SELECT * FROM {src}) ON {', '.join(dims)} INTO NAME dimension VALUE v)"
_BY = f"""bychunk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, model_name ORDER BY timestamp_utc DESC, coalesce(seed, -1) DESC) AS rk FROM codings) WHERE rk = 1),
bl AS (SELECT chunk_id, model_name, institution_id, dimension, v FROM {_long('(SELECT chunk_id, model_name, institution_id, ' + ', '.join(DIMS) + ' FROM bychunk)', DIMS)}),
pr AS (SELECT a.chunk_id, a.institution_id, b.model_name AS other, a.dimension, a.v AS a, b.v AS b FROM bl a JOIN bl b ON a.chunk_id = b.chunk_id AND a.dimension = b.dimension WHERE a.model_name = '{PRIMARY}' AND b.model_name <> '{PRIMARY}')"""


def _kappa_sql(src: str, keys: str, where: str = "TRUE") -> str:
    on = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    return f"""kp AS (SELECT * FROM {src} WHERE {where}),
kc AS (SELECT {keys}, a, b, count(*) AS n FROM kp GROUP BY ALL),
kt AS (SELECT {keys}, sum(n)::BIGINT AS n, sum(CASE WHEN a = b THEN n ELSE 0 END)::DOUBLE / sum(n) AS p_obs FROM kc GROUP BY ALL),
ka AS (SELECT {keys}, a AS label, sum(n)::DOUBLE AS n FROM kc GROUP BY ALL),
kb AS (SELECT {keys}, b AS label, sum(n)::DOUBLE AS n FROM kc GROUP BY ALL),
ke AS (SELECT {', '.join('x.' + k for k in keys.split(', '))}, sum(x.n * y.n) AS chance FROM ka x JOIN kb y ON {on} AND x.label = y.label GROUP BY ALL),
kx AS (SELECT x.*, coalesce(chance, 0) / (n::DOUBLE * n) AS p_exp FROM kt x LEFT JOIN ke y ON {on}),
kappa AS (SELECT *, CASE WHEN p_exp >= 1 THEN 1.0 ELSE (p_obs - p_exp) / nullif(1 - p_exp, 0) END AS kappa FROM kx)"""


def _q(extra: str, q: str) -> str:
    return sql(q, SQL_BASE.rstrip() + ",\n" + extra)


_in_themes = "dimension IN (" + ", ".join(f"'{t}'" for t in THEMES) + ")"
_shown = "round(p_obs, 9) AS p_obs, round(p_exp, 9) AS p_exp, round(kappa, 9) AS kappa"


@query(_q(_BY + ",\n" + _kappa_sql("pr", "dimension", f"other = '{SECOND}' AND {_in_themes}"), f"SELECT dimension AS theme, n, {_shown} FROM kappa"))
def cohen_kappa(spark, d):
    k = kappa(paired(spark, d, F.col("model_name") == SECOND), ["dimension"])
    return k.select(F.col("dimension").alias("theme"), "n", *[rnd(F.col(c), c) for c in ("p_obs", "p_exp", "kappa")])


@query(
    _q(
        _BY + ",\n" + _kappa_sql(f"(SELECT pr.*, i.region FROM pr JOIN inst i USING (institution_id) WHERE {_in_themes} AND other = '{SECOND}')", "dimension, region"),
        "SELECT t.theme, r.region, coalesce(n, 0) AS n, round(kappa, 9) AS kappa FROM themes_ t CROSS JOIN regions r LEFT JOIN kappa k ON k.dimension = t.theme AND k.region = r.region",
    )
)
def kappa_by_region(spark, d):
    rows = paired(spark, d, F.col("model_name") == SECOND).join(institutions(spark, d).select("institution_id", "region"), "institution_id")
    k = kappa(rows, ["dimension", "region"]).withColumnRenamed("dimension", "theme")
    return grid(spark, theme=THEMES, region=REGIONS).join(k, ["theme", "region"], "left").select("theme", "region", F.coalesce("n", F.lit(0)).alias("n"), rnd(F.col("kappa"), "kappa"))


@query(
    _q(
        _BY + f""",
wp AS (SELECT * FROM pr WHERE other = '{SECOND}' AND NOT {_in_themes}),
wc AS (SELECT dimension, a, b, count(*)::DOUBLE AS n FROM wp GROUP BY ALL),
wl AS (SELECT dimension, label, dense_rank() OVER (PARTITION BY dimension ORDER BY label) - 1 AS i FROM (SELECT dimension, a AS label FROM wc UNION SELECT dimension, b FROM wc)),
wk AS (SELECT dimension, count(*) AS k FROM wl GROUP BY ALL),
wa AS (SELECT dimension, a AS label, sum(n) AS n FROM wc GROUP BY ALL),
wb AS (SELECT dimension, b AS label, sum(n) AS n FROM wc GROUP BY ALL),
wn AS (SELECT c.dimension, sum((x.i - y.i)::DOUBLE * (x.i - y.i) / greatest(1, (k - 1) * (k - 1)) * n) AS num, sum(n) AS total FROM wc c JOIN wl x ON x.dimension = c.dimension AND x.label = c.a JOIN wl y ON y.dimension = c.dimension AND y.label = c.b JOIN wk ON wk.dimension = c.dimension GROUP BY ALL),
wd AS (SELECT a.dimension, sum((x.i - y.i)::DOUBLE * (x.i - y.i) / greatest(1, (k - 1) * (k - 1)) * a.n * b.n) AS den FROM wa a JOIN wb b ON a.dimension = b.dimension JOIN wl x ON x.dimension = a.dimension AND x.label = a.label JOIN wl y ON y.dimension = b.dimension AND y.label = b.label JOIN wk ON wk.dimension = a.dimension GROUP BY ALL)""",
        "SELECT wn.dimension AS use, CAST(total AS BIGINT) AS n, round(1 - num / nullif(den / total, 0), 9) AS kappa FROM wn JOIN wd ON wn.dimension = wd.dimension",
    )
)
def weighted_kappa_sentiment(spark, d):
    return weighted_kappa(paired(spark, d, F.col("model_name") == SECOND, USES), ["dimension"]).select(F.col("dimension").alias("use"), "n", rnd(F.col("kappa"), "kappa"))


@query(
    _q(
        _BY + ",\n" + _kappa_sql("pr", "other, dimension", _in_themes),
        f"""SELECT other AS condition, dimension AS theme, n, round(kappa, 9) AS kappa FROM kappa
        UNION ALL SELECT other, 'MEAN', sum(n)::BIGINT, round(sum(kappa) / {len(THEMES)}, 9) FROM kappa GROUP BY other""",
    )
)
def ablation_kappa_rollup(spark, d):
    """Kappa of every other coder with the first by theme, and the mean over the eight themes."""
    k = kappa(paired(spark, d, F.col("model_name") != PRIMARY), ["other", "dimension"])
    rolled = k.rollup("other", "dimension").agg(F.sum("n").alias("n"), F.sum("kappa").alias("kappa"), F.grouping("dimension").alias("g"))
    rolled = rolled.where("other is not null")
    return rolled.select(F.col("other").alias("condition"), F.when(F.col("g") == 1, "MEAN").otherwise(F.col("dimension")).alias("theme"), "n", F.round(F.when(F.col("g") == 1, F.col("kappa") / len(THEMES)).otherwise(F.col("kappa")), 9).alias("kappa"))


def _condition_prevalence(spark, d) -> DataFrame:
    """By coder, region and theme the share of coded passages."""
    rows = by_chunk(spark, d).join(institutions(spark, d).select("institution_id", "region"), "institution_id")
    wide = rows.groupBy(F.col("model_name").alias("condition"), "region").agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in THEMES])
    return wide.unpivot(["condition", "region", "n"], list(THEMES), "theme", "x").withColumn("prevalence", F.col("x").cast("double") / F.col("n"))


_CP = f"""cp AS (SELECT model_name AS condition, region, theme, count(*) AS n, sum(v)::BIGINT AS x, sum(v)::DOUBLE / count(*) AS prevalence FROM (UNPIVOT (SELECT b.model_name, i.region, {', '.join('b.' + t for t in THEMES)} FROM bychunk b JOIN inst i USING (institution_id)) ON {', '.join(THEMES)} INTO NAME theme VALUE v) GROUP BY ALL)"""


@query(_q(_BY + ",\n" + _CP, "SELECT condition, region, theme, n, x, round(prevalence, 9) AS prevalence FROM cp"))
def ablation_prevalence(spark, d):
    return _condition_prevalence(spark, d).select("condition", "region", "theme", "n", "x", rnd(F.col("prevalence"), "prevalence"))


@query(
    _q(
        _BY + ",\n" + _CP + """,
tp AS (SELECT condition, coalesce(max(CASE WHEN region = 'NA' THEN prevalence END), 0) AS na, coalesce(max(CASE WHEN region = 'EU' THEN prevalence END), 0) AS eu, coalesce(max(CASE WHEN region = 'EA' THEN prevalence END), 0) AS ea, coalesce(max(CASE WHEN region = 'LA' THEN prevalence END), 0) AS la FROM cp WHERE theme = 'T7_vendor_governance' GROUP BY condition)""",
        "SELECT condition, round(na, 9) AS na, round(eu, 9) AS eu, round(ea, 9) AS ea, round(la, 9) AS la, round(na - la, 9) AS gradient, CAST(na >= eu AND eu >= ea AND ea >= la AS INTEGER) AS ordered FROM tp",
    )
)
def t7_gradient_pivot(spark, d):
    p = _condition_prevalence(spark, d).where(F.col("theme") == "T7_vendor_governance").groupBy("condition").pivot("region", list(REGIONS)).agg(F.max("prevalence")).na.fill(0.0, list(REGIONS))
    a = {r: F.col(f"`{r}`") for r in REGIONS}
    ordered = ((a["NA"] >= a["EU"]) & (a["EU"] >= a["EA"]) & (a["EA"] >= a["LA"])).cast("int")
    return p.select("condition", *[rnd(a[r], r.lower()) for r in REGIONS], rnd(a["NA"] - a["LA"], "gradient"), ordered.alias("ordered"))


def expert_pairs(spark, d, dims) -> DataFrame:
    """Expert and first coder on the passages both coded."""
    gold = table(spark, d, "expert_gold").groupBy("chunk_id").agg(F.max(F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in _gold.values()])).alias("g"))
    rows = by_chunk(spark, d).where(F.col("model_name") == PRIMARY)
    both = gold.join(rows, "chunk_id").select("chunk_id", F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(f"g.{_gold[k]}").alias("a"), F.col(k).alias("b")) for k in dims])).alias("x"))
    return both.select("chunk_id", "x.*")


_GOLD = _BY + f""",
g1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY {', '.join(f'coalesce({c}, 0) DESC' for c in _gold.values())}) AS rk FROM expert_gold) WHERE rk = 1),
gl AS (SELECT chunk_id, dimension, v FROM (UNPIVOT (SELECT chunk_id, {', '.join(f'coalesce({c}, 0) AS {k}' for k, c in _gold.items())} FROM g1) ON {', '.join(_gold)} INTO NAME dimension VALUE v)),
gp AS (SELECT g.chunk_id, g.dimension, g.v AS a, b.v AS b FROM gl g JOIN bl b ON g.chunk_id = b.chunk_id AND g.dimension = b.dimension WHERE b.model_name = '{PRIMARY}')"""


@query(_q(_GOLD + ",\n" + _kappa_sql("gp", "dimension", _in_themes), "SELECT dimension AS theme, n, round(p_obs, 9) AS agreement, round(kappa, 9) AS kappa FROM kappa"))
def expert_kappa(spark, d):
    return kappa(expert_pairs(spark, d, THEMES), ["dimension"]).select(F.col("dimension").alias("theme"), "n", rnd(F.col("p_obs"), "agreement"), rnd(F.col("kappa"), "kappa"))


@query(_q(_GOLD, "SELECT dimension, count(*) AS n, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 9) AS agreement, sum(CASE WHEN a = 1 THEN 1 ELSE 0 END)::BIGINT AS positives_expert, sum(CASE WHEN b = 1 THEN 1 ELSE 0 END)::BIGINT AS positives_coder, round(avg(a), 9) AS mean_expert, round(avg(b), 9) AS mean_coder FROM gp GROUP BY ALL"))
def expert_agreement(spark, d):
    return (
        expert_pairs(spark, d, DIMS)
        .groupBy("dimension")
        .agg(F.count(F.lit(1)).alias("n"), rnd(F.avg((F.col("a") == F.col("b")).cast("double")), "agreement"), F.sum((F.col("a") == 1).cast("bigint")).alias("positives_expert"), F.sum((F.col("b") == 1).cast("bigint")).alias("positives_coder"), rnd(F.avg("a"), "mean_expert"), rnd(F.avg("b"), "mean_coder"))
    )
