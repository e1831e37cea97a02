"""SQL fragments for the oracle texts: distribution tails by Simpson's rule and shared sub-queries."""

from __future__ import annotations

STEPS = 2000


def sql_f_upper(f: str, d1: str, d2: str) -> str:
    """P(F > f): the beta integral in the angle atan(sqrt(d1 f / d2)), Simpson's rule."""
    f, d1, d2 = f"(({f})::DOUBLE)", f"(({d1})::DOUBLE)", f"(({d2})::DOUBLE)"
    psi = f"atan(sqrt({d1} * {f} / {d2}))"
    h = f"({psi} / {STEPS})"
    weight = f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END)"
    norm = f"lgamma(({d1} + {d2}) / 2) - lgamma({d1} / 2) - lgamma({d2} / 2)"
    body = (
        f"{weight} * exp({norm} + ({d1} - 1) * ln(greatest(sin(i * {h}), 1e-300)) "
        f"+ ({d2} - 1) * ln(greatest(cos(i * {h}), 1e-300)))"
    )
    integral = f"(list_sum(list_transform(range(0, {STEPS + 1}), lambda i: {body})) * {h} / 3)"
    return (
        f"(CASE WHEN {f} IS NULL THEN NULL WHEN {f} < 0 OR {d1} < 1 OR {d2} < 1 THEN 1.0::DOUBLE "
        f"ELSE greatest(0.0::DOUBLE, 1 - 2 * {integral}) END)"
    )


def sql_t_two(t: str, df: str) -> str:
    return (
        f"(CASE WHEN ({df}) < 1 - 1e-9 THEN 1.0::DOUBLE ELSE {sql_f_upper(f'({t}) * ({t})', '1', df)} END)"
    )


def sql_chi2_1(x: str) -> str:
    """P(chi-squared with one degree of freedom > x) from the normal integral."""
    x = f"(({x})::DOUBLE)"
    h = f"(least(sqrt({x}), 40.0::DOUBLE) / {STEPS})"
    weight = f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END)"
    body = f"{weight} * exp(-(i * {h}) * (i * {h}) / 2)"
    integral = f"(list_sum(list_transform(range(0, {STEPS + 1}), lambda i: {body})) * {h} / 3)"
    return (
        f"(CASE WHEN {x} <= 0 THEN 1.0::DOUBLE "
        f"ELSE greatest(0.0::DOUBLE, 1 - sqrt(2 / pi()) * {integral}) END)"
    )


def sql_stars(p: str) -> str:
    return f"(CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE 'ns' END)"


def sql_t_critical(df: str) -> str:
    return (
        f"(CASE WHEN {df} <= 0 THEN 1.96 WHEN {df} <= 1 THEN 12.706 WHEN {df} <= 2 THEN 4.303 WHEN {df} <= 5 THEN 2.571 "
        f"WHEN {df} <= 10 THEN 2.228 WHEN {df} <= 20 THEN 2.086 WHEN {df} <= 30 THEN 2.042 ELSE 1.96 END)::DOUBLE"
    )


def sql_welch(source: str, keys: str) -> str:
    """CTE body with t, df, p_value from columns n1, mean1, var1, n2, mean2, var2 of ``source``."""
    return f"""
  SELECT *, {sql_t_two('t', 'df')} AS p_value FROM (
    SELECT *, (mean1 - mean2) / sqrt(var1 / n1 + var2 / n2) AS t,
      pow(var1 / n1 + var2 / n2, 2) / (pow(var1 / n1, 2) / (n1 - 1) + pow(var2 / n2, 2) / (n2 - 1)) AS df
    FROM {source} WHERE n1 >= 2 AND n2 >= 2 AND var1 / n1 + var2 / n2 > 0)
  UNION ALL
  SELECT *, 0.0::DOUBLE AS t, (n1 + n2 - 2)::DOUBLE AS df, 1.0::DOUBLE AS p_value
  FROM {source} WHERE NOT (n1 >= 2 AND n2 >= 2 AND coalesce(var1 / n1 + var2 / n2 > 0, false))"""
