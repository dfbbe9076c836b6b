"""DuckDB text of the counter-based draws (evalspark.functions.draws)."""

from __future__ import annotations

from evalspark.functions.draws import ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D, MOST, SMALL_MEAN, TAIL

# P(X <= k) of the small means as lists
CDF = f"""cdf AS (SELECT m, list(cum ORDER BY k) AS cums FROM
  (SELECT m, k, sum(CASE WHEN m = 0 THEN CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END ELSE exp(-m + k * ln(greatest(m, 1)) - lgamma(k + 1)) END)
          OVER (PARTITION BY m ORDER BY k) AS cum FROM range(0, {SMALL_MEAN + 1}) a(m), range(0, {MOST + 1}) b(k)) GROUP BY m)"""


def uniform(*parts: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT) + 0.5) / {float(1 << 52)!r}::DOUBLE)"


def _poly(coefficients, x: str) -> str:
    total = f"({coefficients[0]!r})::DOUBLE"
    for c in coefficients[1:]:
        total = f"({total} * {x} + ({c!r})::DOUBLE)"
    return total


def quantile(u: str) -> str:
    def tail(p: str) -> str:
        q = f"sqrt(-2.0 * ln({p}))"
        return f"({_poly(ACKLAM_C, q)} / {_poly(ACKLAM_D, q)})"

    q = f"({u} - 0.5)"
    return f"CASE WHEN {u} < {TAIL} THEN {tail(u)} WHEN {u} > {1 - TAIL} THEN -{tail(f'(1.0 - {u})')} ELSE {_poly(ACKLAM_A, f'({q} * {q})')} * {q} / {_poly(ACKLAM_B, f'({q} * {q})')} END"


def drawn(source: str, keep: str, draws: dict[str, tuple[str, str]]) -> str:
    """A subselect of ``keep`` and, for every name -> (mean, uniform), the Poisson draw."""
    us = ", ".join(f"{u} AS u_{n}, {mean} AS m_{n}" for n, (mean, u) in draws.items())
    zs = ", ".join(f"{quantile(f'u_{n}')} AS z_{n}" for n in draws)
    joins = " ".join(f"LEFT JOIN cdf c_{n} ON c_{n}.m = d.m_{n}" for n in draws)
    out = ", ".join(f"""CASE WHEN m_{n} <= {SMALL_MEAN} THEN len(list_filter(c_{n}.cums, lambda c: c < u_{n}))::DOUBLE
      ELSE greatest(floor(m_{n} + sqrt(m_{n}) * z_{n} + (z_{n} * z_{n} - 1.0) / 6.0 + (z_{n} - z_{n} * z_{n} * z_{n}) / (72.0 * sqrt(m_{n})) + 0.5), 0.0) END AS {n}""" for n in draws)
    return f"(SELECT {keep}, {out} FROM (SELECT *, {zs} FROM (SELECT *, {us} FROM {source})) d {joins})"
