"""Random-intercept logistic regression on counted cells.

Rows with the same group and covariates enter only by their number and their
successes, so that a fit sees cells, not rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

RIDGE, FLOOR, TOLERANCE, ROUNDS, CLIP = 1e-6, 1e-4, 1e-6, 200, 30.0


def fit(x: np.ndarray, group: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict:
    """Fixed effects with standard errors, the variance of the intercepts, log likelihood and the intercepts.

    x: cells by covariates; group: the place of each cell's group; n, y: rows and successes of each cell.
    """
    k, p = int(group.max()) + 1, x.shape[1]
    beta, u, var = np.zeros(p), np.zeros(k), 1.0
    for done in range(1, ROUNDS + 1):
        eta = np.clip(x @ beta + u[group], -CLIP, CLIP)
        mu = 1 / (1 + np.exp(-eta))
        w = n * (mu * (1 - mu) + 1e-9)
        z = eta + (y - n * mu) / w
        h = x.T @ (w[:, None] * x) + RIDGE * np.eye(p)
        new = np.linalg.solve(h, x.T @ (w * (z - u[group])))
        rest = w * (z - x @ new)
        u = np.bincount(group, rest, k) / (np.bincount(group, w, k) + 1 / var)
        new_var = max(FLOOR, float(np.mean(u * u)))
        moved, beta, shift, var = np.abs(new - beta).max(), new, abs(new_var - var), new_var
        if moved < TOLERANCE and shift < TOLERANCE:
            break
    eta = np.clip(x @ beta + u[group], -CLIP, CLIP)
    mu = 1 / (1 + np.exp(-eta))
    w = n * (mu * (1 - mu) + 1e-9)
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ (w[:, None] * x) + RIDGE * np.eye(p))))
    log_l = float((y * np.log(mu) + (n - y) * np.log1p(-mu)).sum() - 0.5 * (u * u).sum() / var - 0.5 * k * math.log(2 * math.pi * var))
    return {"beta": beta, "se": se, "var": var, "log_l": log_l, "u": u, "rounds": done}


def design(cells: pd.DataFrame, dummies: dict[str, list[str]]) -> tuple[np.ndarray, list[str]]:
    """Intercept and dummies of the given levels that occur; other levels are the reference."""
    cols, names = [np.ones(len(cells))], ["intercept"]
    for c, levels in dummies.items():
        for level in levels:
            hit = (cells[c] == level).to_numpy()
            if hit.any():
                cols.append(hit.astype(float))
                names.append(f"{c}_{level}")
    return np.column_stack(cols), names


def table(cells: pd.DataFrame, dummies: dict[str, list[str]], group: str, least: int = 10) -> pd.DataFrame:
    """Rows (term, beta, se, z, p) with sigma2, logL, n_obs and n_groups after them; empty below ``least`` rows."""
    if cells.n.sum() < least:
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("term", "str"), ("beta", "float"), ("se", "float"), ("z", "float"), ("p", "float"))})
    x, names = design(cells, dummies)
    code, groups = pd.factorize(cells[group].fillna(""))
    f = fit(x, code, cells.n.to_numpy(float), cells.y.to_numpy(float))
    z = f["beta"] / f["se"]
    rows = [(t, b, s, v, math.erfc(abs(v) / math.sqrt(2))) for t, b, s, v in zip(names, f["beta"], f["se"], z)]
    rows += [(t, v, None, None, None) for t, v in (("sigma2", f["var"]), ("logL", f["log_l"]), ("n_obs", float(cells.n.sum())), ("n_groups", float(len(groups))))]
    return pd.DataFrame(rows, columns=["term", "beta", "se", "z", "p"])


def auroc(score: np.ndarray, n: np.ndarray, y: np.ndarray) -> float:
    """Area under the curve of cells with scores, average ranks; nan with one class."""
    order = np.argsort(score, kind="stable")
    score, n, y = score[order], n[order], y[order]
    _, at = np.unique(score, return_inverse=True)
    m, pos = np.bincount(at, n), np.bincount(at, y)
    ranks = np.cumsum(m) - m + (m + 1) / 2
    n1, n0 = pos.sum(), m.sum() - pos.sum()
    return float("nan") if not n1 or not n0 else float(((ranks * pos).sum() - n1 * (n1 + 1) / 2) / (n1 * n0))
