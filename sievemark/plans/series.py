"""Distribution functions as SQL text, for the other side of the comparison: Simpson's rule over the densities.

None of it is shared with functions.special, whose continued fractions it checks. Arguments are SQL
expressions without side effects, best plain columns, as they are repeated.
"""

from __future__ import annotations

#: Steps of Simpson's rule.
STEPS = 1000
# Acklam's rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def integral(density: str, end: str) -> str:
    """From 0 to end, of a density of @."""
    weight = f"case when i = 0 or i = {STEPS} then 1 when i % 2 = 1 then 4 else 2 end"
    return f"(({end}) / {3 * STEPS} * list_sum(list_transform(range({STEPS + 1}), lambda i: ({weight}) * {density.replace('@', f'(({end}) * i / {STEPS})')})))"


def normal_cdf(z: str) -> str:
    return f"(0.5 + sign({z}) * {integral('exp(-0.5 * @ * @)', f'abs({z})')} / 2.5066282746310002)"


def t_sf(t: str, df: str) -> str:
    """Upper tail of |t|."""
    constant = f"exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(pi() * ({df}))"
    return f"(0.5 - {constant} * {integral(f'pow(1 + @ * @ / ({df}), -(({df}) + 1) / 2)', f'abs({t})')})"


def chi2_cdf(x: str, df: str) -> str:
    """Over the root of the variable, in which the density is smooth."""
    return integral(f"case when @ = 0 then case when ({df}) = 1 then 2 / sqrt(2 * pi()) else 0 end else 2 * exp((({df}) - 1) * ln(@) - @ * @ / 2 - ({df}) / 2.0 * ln(2) - lgamma(({df}) / 2.0)) end", f"sqrt({x})")


def f_sf(x: str, d1: str, d2: str) -> str:
    """Over the root of the variable, in which the density is smooth."""
    constant = f"exp(lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0) + ({d1}) / 2.0 * ln(({d1}) / ({d2})))"
    return f"(1 - {constant} * {integral(f'2 * pow(@, ({d1}) - 1) * pow(1 + ({d1}) * @ * @ / ({d2}), -(({d1}) + ({d2})) / 2.0)', f'sqrt({x})')})"


def _horner(values: tuple[float, ...], x: str) -> str:
    out = repr(values[0])
    for v in values[1:]:
        out = f"({out} * {x} + {v!r})"
    return out


def normal_quantile(source: str, p: str, out: str, name: str) -> str:
    """Two common table expressions: source with the quantile of column p as column out, by Acklam's approximation and one step of Newton's method; the second has the given name."""
    tail = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    middle = f"({p} - 0.5)"
    first = f"case when least({p}, 1 - {p}) < 0.02425 then sign(0.5 - {p}) * {_horner(_C, tail)} / {_horner(_D, tail)} else {_horner(_A, f'({middle} * {middle})')} * {middle} / {_horner(_B, f'({middle} * {middle})')} end"
    step = f"{out}_0 - ({normal_cdf(f'{out}_0')} - {p}) * 2.5066282746310002 * exp(0.5 * {out}_0 * {out}_0)"
    return f"{name}_0 as (select *, {first} as {out}_0 from {source}), {name} as (select *, {step} as {out} from {name}_0)"
