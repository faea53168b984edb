"""DuckDB texts, written from the definitions: sliding frames where the engine uses differences of running sums."""

from __future__ import annotations

import math

from driftline.operators.calibration import EDGES, GRID
from driftline.operators.features import WINDOWS

W = "PARTITION BY id ORDER BY t"
CUM = f"({W} ROWS UNBOUNDED PRECEDING)"


def win(width: int) -> str:
    return f"({W} ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"


SERIES = """q AS (
  SELECT l_suppkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS time, CAST(l_quantity AS DOUBLE) AS x FROM lineitem
), s AS (SELECT id, time, x, CASE WHEN time > 360 THEN 2 ELSE 1 END AS period, CASE WHEN time > 360 THEN time - 361 END AS t FROM q
), hist AS (SELECT id, time - 1 AS t, x FROM s WHERE period = 1
), onl AS (SELECT id, t, x FROM s WHERE period = 2
), lab AS (SELECT *, CAST(coalesce(t >= tau_index, false) AS INTEGER) AS target FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 60 + (id * 37) % 120 END AS tau_index FROM onl))"""

CAL = (
    SERIES
    + """, c0 AS (SELECT id, count(*) AS n_hist, avg(x) AS mu, greatest(coalesce(stddev_samp(x), 0), 1e-9) AS sd, median(x) AS med, max_by(x, t) AS x_last FROM hist GROUP BY id
), cz AS (SELECT h.id, t, x, (x - mu) / sd AS z, x - mu AS d, n_hist, mu, sd, med FROM hist h JOIN c0 USING (id)
), c1 AS (SELECT id, avg(z ** 3) AS skew, avg(z ** 4) - 3 AS kurt FROM cz GROUP BY id
), c2 AS (SELECT id, sum(p1) / sum(d * d) AS acf1_h, sum(p2) / sum(d * d) AS acf2_h FROM (SELECT id, d, d * lag(d) OVER (PARTITION BY id ORDER BY t) AS p1, d * lag(d, 2) OVER (PARTITION BY id ORDER BY t) AS p2 FROM cz) GROUP BY id
), c3 AS (SELECT id, greatest(var_pop(d), 1e-9) AS dvar_h, greatest(avg(abs(d)), 1e-9) AS dabs_h FROM (SELECT id, x - lag(x) OVER (PARTITION BY id ORDER BY t) AS d FROM hist) GROUP BY id
), c4 AS (SELECT id, list_transform(quantile_cont(x, """
    + str(EDGES)
    + """), lambda e, i: e + (i - 1) * 1e-12) AS edges FROM hist GROUP BY id
), cal AS (SELECT c0.*, skew, kurt, acf1_h, acf2_h, least(0.95, greatest(-0.95, acf1_h)) AS phi, dvar_h, dabs_h, edges FROM c0 JOIN c1 USING (id) JOIN c2 USING (id) JOIN c3 USING (id) JOIN c4 USING (id)
), z AS (SELECT o.id, t, t + 1 AS n, x, (x - mu) / sd AS z, n_hist, mu, sd, med, x_last, skew, kurt, acf1_h, acf2_h, phi, dvar_h, dabs_h, edges FROM onl o JOIN cal USING (id))"""
)

SCORES = """sc AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, CAST(round(value * 100) AS DOUBLE) AS score, CAST(event_type = 'error' AS INTEGER) AS y FROM events)"""


def rounded(select: str, keys: str, cols: list[str], ctes: str, digits: int = 6) -> str:
    body = ", ".join(f"round({c}, {digits}) + 0.0::DOUBLE AS {c}" for c in cols)
    return f"WITH {ctes} SELECT {keys}, {body} FROM ({select})"


def auc(source: str, by: str = "") -> str:
    """(by,) ts_auc and pairs of a relation (by, t, score, y)."""
    k = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    return f"""SELECT {k}round(coalesce(sum(w * auc) / sum(w), 0.5), 9) AS ts_auc, CAST(coalesce(sum(w), 0) AS BIGINT) AS pairs FROM (
  SELECT {k}t, p * m AS w, (r - p * (p + 1) / CAST(2 AS DOUBLE)) / (p * m) AS auc FROM (
    SELECT {k}t, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS m, sum(rk) FILTER (y = 1) AS r FROM (
      SELECT {k}t, y, rank() OVER (PARTITION BY {k}t ORDER BY score) + (count(*) OVER (PARTITION BY {k}t, score) - 1) / CAST(2 AS DOUBLE) AS rk FROM {source})
    GROUP BY {k}t) WHERE p > 0 AND m > 0) {g}"""


def moment_columns(s: list[str], n: str, over: str) -> dict[str, str]:
    """mean, variance, skew and kurtosis expressions over a frame of z."""
    a1, a2, a3, a4 = (f"avg({e}) OVER {over}" for e in s)
    v = f"greatest({a2} - ({a1}) * ({a1}), 0)"
    live = f"{n} > 2 AND {v} > 1e-12"
    return {
        "m": a1,
        "v": v,
        "skew": f"CASE WHEN {live} THEN ({a3} - 3 * ({a1}) * ({a2}) + 2 * ({a1}) ** 3) / greatest({v}, 1e-12) ** 1.5 ELSE 0 END",
        "kurt": f"CASE WHEN {live} THEN ({a4} - 4 * ({a1}) * ({a3}) + 6 * ({a1}) * ({a1}) * ({a2}) - 3 * ({a1}) ** 4) / greatest({v}, 1e-12) ** 2 - 3 ELSE 0 END",
    }


Z = ["z", "z * z", "z ** 3", "z ** 4"]


def window_moments(width: int) -> str:
    m = moment_columns(Z, f"least(n, {width})", win(width))
    cols = {f"w{width}_mean_z": f"{m['m']} * sqrt(least(n, {width}))", f"w{width}_logvar": f"ln(greatest({m['v']}, 1e-12))", f"w{width}_skew": m["skew"], f"w{width}_kurt": m["kurt"]}
    return rounded("SELECT id, t, " + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + " FROM z", "id, t", list(cols), CAL)


def cusum_ctes(c: str, k: float, name: str, source: str) -> str:
    """A relation ``name`` with m, the running maximum of the recursion's reflected walks, by nested selects."""
    return f"""{name} AS (SELECT id, t, n, max(g) OVER {CUM} AS m FROM (
  SELECT id, t, n, greatest(u - least(0, min(u) OVER {CUM}), d - least(0, min(d) OVER {CUM})) AS g FROM (
    SELECT id, t, n, sum({c} - {k}) OVER {CUM} AS u, sum(-({c}) - {k}) OVER {CUM} AS d FROM {source})))"""


def acf_expr(c: str, width: int | None, lag: int = 1, fill: str | None = None) -> str:
    """Lagged autocorrelation of column c over a window (or all rows so far); needs column l{lag} = c * lag(c)."""
    over = win(width) if width else CUM
    pairs_over = win(width - lag) if width else CUM
    n = f"least(n, {width})" if width else "n"
    m = f"avg({c}) OVER {over}"
    return f"CASE WHEN {n} - {lag} > 1 THEN least(1, greatest(-1, (coalesce(sum(l{lag}) OVER {pairs_over}, 0) / ({n} - {lag}) - ({m}) ** 2) / greatest(avg({c} * {c}) OVER {over} - ({m}) ** 2, 1e-12))) ELSE 0 END"


LAGGED = "(SELECT *, " + ", ".join(f"z * lag(z, {k}) OVER ({W}) AS l{k}" for k in range(1, 6)) + " FROM z)"

BINS = "b AS (SELECT *, len(list_filter(edges, lambda e: e <= x)) AS bin FROM z)"


def shape_columns(over: str, n: str) -> tuple[str, str, str]:
    gaps = [f"abs(avg(CASE WHEN bin <= {j} THEN 1.0::DOUBLE ELSE 0 END) OVER {over} - {q})" for j, q in enumerate(EDGES)]
    chi = " + ".join(f"(sum(CASE WHEN bin = {j} THEN 1.0::DOUBLE ELSE 0 END) OVER {over} - {n} / 20.0::DOUBLE) ** 2 / ({n} / 20.0::DOUBLE)" for j in range(20))
    return f"greatest({', '.join(gaps)})", " + ".join(gaps), f"({chi}) / {n}"


def window_shape(width: int) -> str:
    ks, l1, chi = shape_columns(win(width), f"least(n, {width})")
    cols = {f"w{width}_ks": ks, f"w{width}_l1": f"({l1}) / 19", f"w{width}_chi2": chi}
    return rounded("SELECT id, t, " + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + " FROM b", "id, t", list(cols), f"{CAL}, {BINS}", 10)


def interp(col: str, width: int) -> str:
    at = f"least({len(GRID) - 1}.0::DOUBLE, greatest(0, log2(least(n, {width})) - 3))"
    low = f"CAST(least(floor({at}), {len(GRID) - 2}) AS BIGINT)"
    f = f"({at} - {low})"
    return f"({col}[{low} + 1] * (1 - {f}) + {col}[{low} + 2] * {f})"


def _keep(g: int, parts: int) -> str:
    return f"t >= {g - 1} AND (t - {g - 1}) % {max(1, g // parts)} = 0"


def nulls(source: str, stats: dict, n: str = "n_hist") -> str:
    """CTE bodies: per id arrays over the scale grid.

    stats: name -> (row expression of g, stride parts, loc aggregate, scale aggregate, floor, loc default, scale default);
    aggregates take the filtered expression.  A scale longer than half the history repeats the one before.
    """
    inner, aggs, cols = [], [], []
    for s, (expr, parts, loc, scale, floor, d_loc, d_scale) in stats.items():
        for g in GRID:
            inner.append(f"CASE WHEN {_keep(g, parts)} THEN {expr(g)} END AS {s}{g}")
            aggs.append(f"{loc(f'{s}{g}')} AS {s}{g}_a, greatest({scale(f'{s}{g}')}, {floor}) AS {s}{g}_s")
        for tag, name, default in (("a", "loc", d_loc), ("s", "scale", d_scale)):
            vals, last = [], None
            for g in GRID:
                v = f"CASE WHEN n >= 64 AND n >= {2 * g} THEN {s}{g}_{tag} END"
                last = f"coalesce({v}, {last})" if last else v
                vals.append(f"CASE WHEN n >= 64 THEN {last} ELSE {default(g)!r}::DOUBLE END")
            cols.append(f"[{', '.join(vals)}] AS null_{s}_{name}")
    return f"SELECT id, {', '.join(cols)} FROM (SELECT id, max({n}) AS n, {', '.join(aggs)} FROM (SELECT id, {n}, {', '.join(inner)} FROM {source}) GROUP BY id)"


def _avg(c):
    return f"avg({c})"


def _std(c):
    return f"stddev_pop({c})"


def _hist_acf(c: str, lagged: str, centre: str):
    def expr(g):
        m = f"avg({c}) OVER {win(g)}"
        return f"least(1, greatest(-1, (coalesce(sum({lagged}) OVER {win(g - 1)}, 0) / {g - 1} - ({m}) ** 2) / greatest(avg({c} * {c}) OVER {win(g)} - ({m}) ** 2, 1e-12))) - {centre}"
    return expr


HZ = "hz AS (SELECT cz.*, z * lag(z) OVER (PARTITION BY cz.id ORDER BY t) AS lz, acf1_h FROM cz JOIN c2 USING (id))"
NULL_MOMENTS = nulls("hz", {
    "mz": (lambda g: f"avg(z) OVER {win(g)} * sqrt({g})", 8, _avg, _std, 0.05, lambda g: 0.0, lambda g: 1.0),
    "lv": (lambda g: f"ln(greatest(avg(z * z) OVER {win(g)} - (avg(z) OVER {win(g)}) ** 2, 1e-12))", 8, _avg, _std, 0.01, lambda g: -1.0 / g, lambda g: (2.0 / g) ** 0.5),
    "acf": (_hist_acf("z", "lz", "acf1_h"), 8, _avg, _std, 0.01, lambda g: 0.0, lambda g: g**-0.5),
})
HB = "hb AS (SELECT h.id, t, n_hist, len(list_filter(edges, lambda e: e <= x)) AS bin FROM hist h JOIN cal USING (id))"


def _med(c):
    return f"quantile_cont({c}, 0.5)"


def _spread(c):
    return f"quantile_cont({c}, 0.9) - quantile_cont({c}, 0.5)"


NULL_SHAPE = nulls("hb", {
    "ks": (lambda g: shape_columns(win(g), str(g))[0], 4, _med, _spread, 0.005, lambda g: 0.86 / g**0.5, lambda g: 0.35 / g**0.5),
    "l1": (lambda g: f"({shape_columns(win(g), str(g))[1]}) / 19", 4, _med, _spread, 0.003, lambda g: 0.4 / g**0.5, lambda g: 0.2 / g**0.5),
})


def unrolled(relation: str, arrays: list[str], digits: int = 6) -> str:
    """Arrays over the grid as one row a scale."""
    return f"SELECT id, CAST(k AS INTEGER) AS k, {', '.join(f'round({a}[k], {digits}) + 0.0::DOUBLE AS {a}' for a in arrays)} FROM {relation}, (SELECT unnest(range(1, {len(GRID) + 1})) AS k)"


def calibrated(widths=WINDOWS) -> tuple[str, list[str]]:
    """CTEs ending in ``cw`` with the calibrated window statistics."""
    cols, names = [], []
    for w in widths:
        m = moment_columns(Z, "n", win(w))
        ks, l1, _ = shape_columns(win(w), f"least(n, {w})")
        parts = {
            "nmz": (f"{m['m']} * sqrt(least(n, {w}))", "mz", False), "nlv": (f"ln(greatest({m['v']}, 1e-12))", "lv", True),
            "nacf": (f"({acf_expr('z', w)}) - acf1_h", "acf", True), "nks": (ks, "ks", True), "nl1": (f"({l1}) / 19", "l1", True),
        }
        for k, (e, s, centre) in parts.items():
            c = f" - {interp(f'null_{s}_loc', w)}" if centre else ""
            cols.append(f"CASE WHEN least(n, {w}) >= 5 THEN (({e}){c}) / {interp(f'null_{s}_scale', w)} ELSE 0 END AS w{w}_{k}")
            names.append(f"w{w}_{k}")
    rows = f"(SELECT *, len(list_filter(edges, lambda e: e <= x)) AS bin, z * lag(z) OVER ({W}) AS l1 FROM z JOIN nm USING (id) JOIN ns USING (id))"
    return f"{CAL}, {HZ}, {HB}, nm AS ({NULL_MOMENTS}), ns AS ({NULL_SHAPE}), cw AS (SELECT id, t, n, {', '.join(cols)} FROM {rows})", names


LOG6 = math.log(6)
