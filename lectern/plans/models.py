"""Iterative models, fitted on counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import PRIMARY, REGIONS, SECOND, SEED, THEMES, TIERS, inst_theme, institutions
from ..operators import mixed
from ..session import ship
from .agreement import by_chunk
from .catalog import query

DUMMIES = {"region": list(REGIONS[1:]), "tier": list(TIERS[1:])}
TERMS = "theme string, term string, beta double, se double, z double, p double"


def cells(spark, d) -> DataFrame:
    """By theme, country, region and tier: institutions and those with the theme."""
    return inst_theme(spark, d).groupBy("theme", "country", "region", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("y"))


@query()
def mixed_logit(spark, d):
    """Theme by region and tier with a random intercept by country."""
    ship(spark)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["country", "region", "tier"])
        out = mixed.table(rows, DUMMIES, "country")
        return out.assign(theme=rows.theme.iloc[0])[["theme", "term", "beta", "se", "z", "p"]]

    return cells(spark, d).groupBy("theme").applyInPandas(one, TERMS)


@query()
def icc_country(spark, d):
    """Share of variance between countries on the logit scale."""
    return mixed_logit(spark, d).where("term = 'sigma2'").select("theme", (F.col("beta") / (F.col("beta") + math.pi**2 / 3)).alias("icc"))


@query()
def logit_terms(spark, d):
    """The region terms of the models."""
    return mixed_logit(spark, d).where(F.col("term").startswith("region_")).select("theme", "term", "beta", "p", (F.col("p") < 0.05).cast("int").alias("sig"))


@query()
def kfold_cv(spark, d):
    """Five folds of institutions by a hash of their id: area under the curve and Brier score of the held-out fold."""
    ship(spark)
    fold = F.expr(f"cast(conv(substr(md5(concat_ws(':', {SEED}, institution_id)), 1, 8), 16, 10) as bigint) % 5")
    rows = inst_theme(spark, d).withColumn("own", fold).groupBy("theme", "country", "region", "tier", "own").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("y"))
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["country", "region", "tier", "own"])
        train, test = g[g.own != g.fold], g[g.own == g.fold]
        auc = brier = float("nan")
        if train.n.sum() >= 10 and len(test):
            both = pd.concat([train, test])
            x, _ = mixed.design(both, DUMMIES)
            code, groups = pd.factorize(both.country.fillna(""))
            k = len(train)
            seen = sorted(set(code[:k]))
            place = {c: i for i, c in enumerate(seen)}
            f = mixed.fit(x[:k], np.array([place[c] for c in code[:k]]), train.n.to_numpy(float), train.y.to_numpy(float))
            u = np.array([f["u"][place[c]] if c in place else 0.0 for c in code[k:]])
            p = 1 / (1 + np.exp(-np.clip(x[k:] @ f["beta"] + u, -30, 30)))
            n, y = test.n.to_numpy(float), test.y.to_numpy(float)
            auc = mixed.auroc(p, n, y)
            brier = float((y * (1 - p) ** 2 + (n - y) * p**2).sum() / n.sum())
        return pd.DataFrame([(g.theme.iloc[0], int(g.fold.iloc[0]), auc, brier)], columns=["theme", "fold", "auroc", "brier"])

    return rows.groupBy("theme", "fold").applyInPandas(one, "theme string, fold int, auroc double, brier double")


@query()
def kfold_summary(spark, d):
    """Mean and standard deviation over the folds, by theme; folds with one class only have no area and are left out of its mean."""
    rows = kfold_cv(spark, d)
    stats_ = [f(F.nanvl(c, F.lit(None).cast("double"))).alias(f"{c}_{name}") for c in ("auroc", "brier") for name, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return rows.groupBy("theme").agg(F.count(F.lit(1)).alias("n_folds"), *stats_)


@query()
def annotator_effect(spark, d):
    """Theme by region, tier and coder on the passages both coders have, with a random intercept by institution."""
    ship(spark)
    rows = by_chunk(spark, d).where(F.col("model_name").isin(PRIMARY, SECOND))
    both = rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("chunk_id")
    rows = rows.join(both, "chunk_id").join(institutions(spark, d).select("institution_id", "region", "tier"), "institution_id").withColumn("coder", F.when(F.col("model_name") == SECOND, "second").otherwise("first"))
    wide = rows.groupBy("institution_id", "region", "tier", "coder").agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in THEMES])
    counted = wide.unpivot(["institution_id", "region", "tier", "coder", "n"], list(THEMES), "theme", "y")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["institution_id", "coder"])
        out = mixed.table(g, DUMMIES | {"coder": ["second"]}, "institution_id")
        return out.assign(theme=g.theme.iloc[0])[["theme", "term", "beta", "se", "z", "p"]]

    return counted.groupBy("theme").applyInPandas(one, TERMS)


@query()
def bootstrap_kappa(spark, d):
    """Bootstrap limits of kappa between the two coders: multinomial draws of the 2 x 2 counts, finite draws only."""
    from .agreement import paired

    counts = paired(spark, d, F.col("model_name") == SECOND).groupBy(F.col("dimension").alias("theme"), "a", "b").agg(F.count(F.lit(1)).alias("n"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((2, 2))
        for a, b, n in zip(g.a, g.b, g.n):
            m[int(a > 0), int(b > 0)] += n
        total = int(m.sum())
        draws = np.random.default_rng(SEED).multinomial(total, m.ravel() / total, 2000).reshape(-1, 2, 2) / total
        obs = draws[:, 0, 0] + draws[:, 1, 1]
        exp = (draws.sum(2) * draws.sum(1)).sum(1)
        k = np.where(exp < 1, (obs - exp) / np.where(exp < 1, 1 - exp, 1), 1.0)
        low, high = np.percentile(k[np.isfinite(k)], [2.5, 97.5])
        return pd.DataFrame([(g.theme.iloc[0], total, float(low), float(high))], columns=["theme", "n", "ci_low", "ci_high"])

    return counts.groupBy("theme").applyInPandas(one, "theme string, n bigint, ci_low double, ci_high double")


def _weights(k: int) -> np.ndarray:
    i = np.arange(k)
    return (i[:, None] - i[None, :]) ** 2 / max(1, (k - 1) ** 2)


@query()
def bootstrap_expert_kappa(spark, d):
    """Expert against first coder with bootstrap limits: kappa for themes, quadratic-weighted kappa for sentiment.

    Draws are multinomial on the counts of label pairs; weights go by the place among the labels that occur.
    """
    from .agreement import DIMS, expert_pairs

    ship(spark)
    counts = expert_pairs(spark, d, DIMS).groupBy("dimension", "a", "b").agg(F.count(F.lit(1)).alias("n"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        name = g.dimension.iloc[0]
        labels = sorted({*g.a, *g.b})
        k = len(labels)
        m = np.zeros((k, k))
        for a, b, n in zip(g.a, g.b, g.n):
            m[labels.index(a), labels.index(b)] += n
        w = 1 - np.eye(k) if name in THEMES else _weights(k)

        def kappas(p: np.ndarray) -> np.ndarray:
            seen = (p * w).sum((1, 2))
            chance = (p.sum(2)[:, :, None] * p.sum(1)[:, None, :] * w).sum((1, 2))
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(chance > 0, 1 - seen / chance, 1.0 if name in THEMES else np.nan)

        total = int(m.sum())
        draws = np.random.default_rng(SEED).multinomial(total, m.ravel() / total, 2000).reshape(-1, k, k) / total
        x = kappas(draws)
        x = x[np.isfinite(x)]
        low, high = np.percentile(x, [2.5, 97.5]) if len(x) else (None, None)
        whole = kappas(m[None] / total)[0]
        return pd.DataFrame([(name, total, float(whole) if np.isfinite(whole) else None, low, high)], columns=["dimension", "n", "kappa", "ci_low", "ci_high"])

    return counts.groupBy("dimension").applyInPandas(one, "dimension string, n bigint, kappa double, ci_low double, ci_high double")
