"""Seasonal-trend decomposition stated in SQL, for the comparison with the Spark side.

Local regression is a weighted sum over the neighbours of a cell: five sums per cell give the line
through them. Neighbours and their base weights are tables of their own; a pass joins them with the
current values and robustness weights.
"""

from __future__ import annotations

SPAN = 7
INNER, OUTER = 2, 15


def _hood(name: str, source: str, m: str, q: str, before: int) -> str:
    """(source's columns, pos, nb, w): the `q` nearest cells of every cell of a series of `m`."""
    ratio = "abs(nb - pos) / reach"
    return f"""
{name} AS MATERIALIZED (SELECT *, CASE WHEN {ratio} > 0.999 THEN 0 WHEN {ratio} <= 0.001 THEN 1 ELSE pow(1 - pow({ratio}, 3), 3) END AS w FROM (
  SELECT *, fst + j AS nb, greatest(pos - fst, fst + width - 1 - pos) + greatest(0, ({q} - {m}) // 2) AS reach FROM (
    SELECT *, greatest(0, least(pos - (width - 1) // 2, {m} - width)) AS fst FROM (
      SELECT *, least({q}, {m}) AS width FROM {source}, LATERAL (SELECT unnest(range(-{before}, {m} + {before})) AS pos))),
    LATERAL (SELECT unnest(range(width)) AS j)))"""


def _fit(hood: str, values: str, m: str, keys: str) -> str:
    """(keys, pos, v): the local lines. `values` is a table with v and r and its join with the hood;
    where every weight is gone the value itself stands."""
    return f"""(SELECT {keys}, pos, CASE WHEN s0 > 0 THEN (sy + CASE WHEN sqrt(greatest(s2 / s0 - (s1 / s0) * (s1 / s0), 0)) > 0.001 * (m - 1)
    THEN -(s1 / s0) / (s2 / s0 - (s1 / s0) * (s1 / s0)) ELSE 0 END * (sxy - s1 / s0 * sy)) / s0 ELSE own END AS v
  FROM (SELECT {keys}, pos, any_value({m}) AS m, sum(w * r) AS s0, sum(w * r * (nb - pos)) AS s1, sum(w * r * (nb - pos) * (nb - pos)) AS s2,
      sum(w * r * v) AS sy, sum(w * r * (nb - pos) * v) AS sxy, any_value(v) FILTER (nb = greatest(0, least(pos, {m} - 1))) AS own
    FROM {hood} JOIN {values} GROUP BY {keys}, pos))"""


def stl_ctes(series: str, cells: str, inner: int = INNER, outer: int = OUTER) -> tuple[str, str]:
    """CTEs for the decomposition, and the name of the last: (s, i, y, t, se).

    `series` is a table (s, n, p), `cells` one (s, i, y) with i from 0.
    """
    out = [f"""
st_s AS MATERIALIZED (SELECT s, n, p, CAST(ceil(p + 1) AS BIGINT) + (CAST(ceil(p + 1) AS BIGINT) + 1) % 2 AS lw,
  CAST(ceil(1.5 * p / (1 - 1.5 / {SPAN})) AS BIGINT) + (CAST(ceil(1.5 * p / (1 - 1.5 / {SPAN})) AS BIGINT) + 1) % 2 AS tw FROM {series}),
st_p AS (SELECT s, n, p, c, (n - c + p - 1) // p AS len FROM st_s, LATERAL (SELECT unnest(range(p)) AS c)),
{_hood('st_hc', 'st_p', 'len', str(SPAN), 1)}, {_hood('st_hl', 'st_s', 'n', 'lw', 0)}, {_hood('st_ht', 'st_s', 'n', 'tw', 0)},
st_y AS MATERIALIZED (SELECT s, i, y, p, n FROM {cells} JOIN st_s USING (s)),
st_t0 AS (SELECT s, i, 0.0::DOUBLE AS t FROM st_y), st_r0 AS (SELECT s, i, 1.0::DOUBLE AS r FROM st_y)"""]
    k = 0
    for o in range(outer + 1):
        for _ in range(inner):
            k += 1
            gone = f"(SELECT s, i % p AS c, i // p AS nb, y - t AS v, r FROM st_y JOIN st_t{k - 1} USING (s, i) JOIN st_r{o} USING (s, i))"
            mean = "avg(v) OVER (PARTITION BY s ORDER BY i ROWS BETWEEN CURRENT ROW AND {0} FOLLOWING) AS v"
            low = f"SELECT s, i, p, n, {mean.format('p - 1')} FROM st_c{k}"
            low = f"SELECT s, i, p, n, {mean.format('p - 1')} FROM ({low}) WHERE i < n + p + 1"
            low = f"SELECT s, i, {mean.format(2)}, n FROM ({low}) WHERE i < n + 2"
            out.append(f"""
st_c{k} AS MATERIALIZED (SELECT s, (pos + 1) * p + c AS i, p, n, v FROM {_fit('st_hc', f'{gone} USING (s, c, nb)', 'len', 's, c, p, n')}),
st_l{k} AS MATERIALIZED (SELECT s, i AS nb, v, 1.0::DOUBLE AS r FROM ({low}) WHERE i < n),
st_e{k} AS MATERIALIZED (SELECT st_y.s, st_y.i, c.v - l.v AS se FROM st_y JOIN st_c{k} c ON c.s = st_y.s AND c.i = st_y.i + st_y.p
  JOIN {_fit('st_hl', f'st_l{k} USING (s, nb)', 'n', 's')} l ON l.s = st_y.s AND l.pos = st_y.i),
st_d{k} AS (SELECT s, i AS nb, y - se AS v, r FROM st_y JOIN st_e{k} USING (s, i) JOIN st_r{o} USING (s, i)),
st_t{k} AS MATERIALIZED (SELECT s, pos AS i, v AS t FROM {_fit('st_ht', f'st_d{k} USING (s, nb)', 'n', 's')})""")
        if o < outer:
            out.append(f"""
st_z{o} AS (SELECT s, i, abs(y - t - se) AS z, 6.0 * median(abs(y - t - se)) OVER (PARTITION BY s) AS top FROM st_y JOIN st_t{k} USING (s, i) JOIN st_e{k} USING (s, i)),
st_r{o + 1} AS MATERIALIZED (SELECT s, i, CASE WHEN top <= 0 THEN 1.0 WHEN z / top >= 0.999 THEN 0.0 WHEN z / top <= 0.001 THEN 1.0
  ELSE pow(1 - least(z / top, 1.0) * least(z / top, 1.0), 2) END AS r FROM st_z{o})""")
    out.append(f"st_last AS MATERIALIZED (SELECT s, i, y, t, se, y - t - se AS resid, p FROM st_y JOIN st_t{k} USING (s, i) JOIN st_e{k} USING (s, i))")
    return ",\n".join(out), "st_last"
