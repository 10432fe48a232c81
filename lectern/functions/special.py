"""Tails of distributions as SQL expressions without UDFs.

Series and continued fractions run as folds of a fixed length, so that Spark and
DuckDB evaluate the same arithmetic. ``Spark`` and ``Duck`` differ only in how
they write a fold.
"""

from __future__ import annotations

import math

#: Lanczos coefficients for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


class Spark:
    """Folds in Spark SQL."""

    real = staticmethod(lambda x: f"{x!r}D")

    @staticmethod
    def fold(n: int, start: dict[str, str], step: dict[str, str], out: str) -> str:
        pack = lambda f: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in f.items()) + ")"
        return f"aggregate(sequence(1, {n}), {pack(start)}, (acc, i) -> {pack(step)}, acc -> acc.{out})"

    @staticmethod
    def let(name: str, value: str, body: str) -> str:
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"


class Duck:
    """Folds in DuckDB's SQL."""

    real = staticmethod(lambda x: f"{x!r}::DOUBLE")

    @staticmethod
    def fold(n: int, start: dict[str, str], step: dict[str, str], out: str) -> str:
        pack = lambda f: "{" + ", ".join(f"'{k}': {v}" for k, v in f.items()) + "}"
        return f"struct_extract(list_reduce(range(1, {n + 1}), lambda acc, i: {pack(step)}, {pack(start)}), '{out}')"

    @staticmethod
    def let(name: str, value: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]"


def log_gamma(e, z: str) -> str:
    """ln of the gamma function of a positive expression."""
    r = e.real
    terms = " + ".join(f"{r(c)} / (({z}) - {r(1.0)} + {r(float(k))})" for k, c in enumerate(LANCZOS) if k)
    t = f"(({z}) - {r(1.0)} + {r(7.5)})"
    return f"({r(0.5 * math.log(2 * math.pi))} + (({z}) - {r(0.5)}) * ln({t}) - {t} + ln({r(LANCZOS[0])} + {terms}))"


def gamma_q(e, a: float, x: str) -> str:
    """The upper regularised incomplete gamma function of a constant a and an expression x; 1 for x <= 0."""
    r, lg = e.real, math.lgamma(a)

    def body(v: str) -> str:
        front = f"exp(-{v} + {r(a)} * ln({v}) - {r(lg)})"
        series = e.fold(200, {"d": r(1 / a), "s": r(1 / a)}, {"d": f"acc.d * {v} / ({r(a)} + i)", "s": f"acc.s + acc.d * {v} / ({r(a)} + i)"}, "s")
        an = f"(-i * (i - {r(a)}))"
        b = f"({v} + {r(1 - a)} + 2 * i)"
        d = f"({r(1.0)} / ({an} * acc.d + {b}))"
        c = f"({b} + {an} / acc.c)"
        lentz = e.fold(200, {"c": r(1e300), "d": f"{r(1.0)} / ({v} + {r(1 - a)})", "h": f"{r(1.0)} / ({v} + {r(1 - a)})"}, {"c": c, "d": d, "h": f"acc.h * {d} * {c}"}, "h")
        return f"CASE WHEN {v} <= 0 THEN {r(1.0)} WHEN {v} < {r(a + 1)} THEN {r(1.0)} - {front} * {series} ELSE {front} * {lentz} END"

    return e.let("gx", f"({x})", body("gx"))


def normal_two_sided(e, z: str) -> str:
    """P(|Z| > |z|)."""
    return gamma_q(e, 0.5, f"({z}) * ({z}) / 2")


def normal_upper(e, z: str) -> str:
    """P(Z > z)."""
    two = normal_two_sided(e, z)
    return f"CASE WHEN ({z}) >= 0 THEN 0.5 * ({two}) ELSE 1 - 0.5 * ({two}) END"


def chi2_upper(e, df: int, x: str) -> str:
    return gamma_q(e, df / 2, f"({x}) / 2")


def f_upper(e, f: str, d1: str, d2: str) -> str:
    """P(F > f) for expressions of the degrees of freedom; 1 for f <= 0."""
    r = e.real

    def beta_inc(x: str, a: str, b: str) -> str:
        front = f"exp({log_gamma(e, f'{a} + {b}')} - {log_gamma(e, a)} - {log_gamma(e, b)} + {a} * ln({x}) + {b} * ln({r(1.0)} - {x})) / {a}"
        even = f"(i * ({b} - i) * {x} / (({a} + 2 * i - 1) * ({a} + 2 * i)))"
        odd = f"(-({a} + i) * ({a} + {b} + i) * {x} / (({a} + 2 * i) * ({a} + 2 * i + 1)))"
        d1_, c1_ = f"(1 / (1 + {even} * acc.d))", f"(1 + {even} / acc.c)"
        d2_, c2_ = f"(1 / (1 + {odd} * {d1_}))", f"(1 + {odd} / {c1_})"
        d0 = f"({r(1.0)} / (1 - ({a} + {b}) * {x} / ({a} + 1)))"
        return f"({front}) * {e.fold(100, {'c': r(1.0), 'd': d0, 'h': d0}, {'c': c2_, 'd': d2_, 'h': f'acc.h * {d1_} * {c1_} * {d2_} * {c2_}'}, 'h')}"

    a, b = f"(({d2}) / {r(2.0)})", f"(({d1}) / {r(2.0)})"
    x = "fx"
    body = f"CASE WHEN {x} >= 1 THEN {r(1.0)} WHEN {x} < ({a} + 1) / ({a} + {b} + 2) THEN {beta_inc(x, a, b)} ELSE 1 - {beta_inc(f'({r(1.0)} - {x})', b, a)} END"
    return e.let("fx", f"(({d2}) / (({d2}) + ({d1}) * ({f})))", body)


#: Coefficients of a rational approximation to the normal quantile.
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def normal_quantile(e, p: str) -> str:
    """z with P(Z < z) = p to nine digits; null outside (0, 1)."""
    r = e.real

    def horner(coefficients, x: str) -> str:
        out = r(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * {x} + {r(c)})"
        return out

    middle = e.let("q", f"(({p}) - 0.5)", e.let("s", "(q * q)", f"{horner(QUANTILE_A, 's')} * q / ({horner(QUANTILE_B, 's')} * s + {r(1.0)})"))
    tail = lambda x: e.let("t", f"sqrt(-2 * ln({x}))", f"{horner(QUANTILE_C, 't')} / ({horner(QUANTILE_D, 't')} * t + {r(1.0)})")
    return f"CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN ({p}) < {r(0.02425)} THEN {tail(p)} WHEN ({p}) > {r(1 - 0.02425)} THEN -{tail(f'1 - ({p})')} ELSE {middle} END"
