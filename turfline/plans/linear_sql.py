"""Linear algebra in plain SQL for the oracles: leading eigenvectors and linear systems.

Matrices are lists of rows, one matrix per group, and the steps are rows of a recursive
query. Texts that use a fragment start with ``WITH RECURSIVE``.
"""

from __future__ import annotations

SQUARINGS = 18  # the matrix to the power 2^18 leaves one direction


def eigen_sql(cells: str, count: int, out: str) -> str:
    """``out``: g, comps, lams, total - the ``count`` leading eigenpairs of ``cells`` (g, fa, fb, c).

    The matrix is squared until one direction is left, its pair is recorded and subtracted.
    The largest entry of a vector is positive.
    """
    trace = lambda m: f"list_sum(list_transform({m}, lambda r, i: r[i]))"
    deflated = "list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - lam * vec[i] * vec[j]))"
    return f"""{out}_r AS (SELECT g, fa, list(c ORDER BY fb) AS r FROM {cells} GROUP BY g, fa),
{out}_m AS (SELECT g, list(r ORDER BY fa) AS m FROM {out}_r GROUP BY g),
{out}_p AS (SELECT g, m, m AS p, 0 AS step, CAST([] AS DOUBLE[][]) AS comps, CAST([] AS DOUBLE[]) AS lams FROM {out}_m
 UNION ALL
 SELECT g, m2 AS m, CASE WHEN ready THEN m2 ELSE list_transform(sq, lambda r: list_transform(r, lambda x: x / size)) END AS p, step + 1 AS step,
  CASE WHEN ready THEN list_append(comps, vec) ELSE comps END AS comps, CASE WHEN ready THEN list_append(lams, lam) ELSE lams END AS lams
 FROM (SELECT *, {trace("sq")} AS size, CASE WHEN ready THEN {deflated} ELSE m END AS m2
  FROM (SELECT *, list_sum(list_transform(vec, lambda x, i: x * list_dot_product(m[i], vec))) AS lam
   FROM (SELECT *, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))
       * CASE WHEN list_max(raw) < -list_min(raw) THEN -1 ELSE 1 END) AS vec
    FROM (SELECT *, step % {SQUARINGS + 1} = {SQUARINGS} AS ready, list_transform(p, lambda a: list_transform(p, lambda b: list_dot_product(a, b))) AS sq,
        p[list_position(list_transform(p, lambda r, i: r[i]), list_max(list_transform(p, lambda r, i: r[i])))] AS raw
     FROM {out}_p WHERE step < {count * (SQUARINGS + 1)}) q1) q2) q3) q4),
{out} AS (SELECT p.g, p.comps, p.lams, {trace("s.m")} AS total FROM {out}_p p JOIN {out}_m s USING (g) WHERE step = {count * (SQUARINGS + 1)})"""


def solve_sql(cells: str, out: str) -> str:
    """``out``: g, sol - the solution of the positive definite systems ``cells`` (g, i, j, c).

    Column 1000 of ``cells`` is the right side; rows and columns count from 1. Gauss-Jordan
    elimination, one pivot a step.
    """
    return f"""{out}_r AS (SELECT g, i, list(c ORDER BY j) AS r FROM {cells} GROUP BY g, i),
{out}_s AS (SELECT g, list(r ORDER BY i) AS m, 1 AS k, len(list(r)) AS d FROM {out}_r GROUP BY g
 UNION ALL
 SELECT g, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / m[k][k])
   ELSE list_transform(r, lambda x, j: x - r[k] / m[k][k] * m[k][j]) END) AS m, k + 1 AS k, d FROM {out}_s WHERE k <= d),
{out} AS (SELECT g, list_transform(m, lambda r: r[d + 1]) AS sol FROM {out}_s WHERE k = d + 1)"""
