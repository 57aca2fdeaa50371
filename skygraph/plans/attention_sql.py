"""SQL with the rows of the feature and attention queries: Box-Cox by zoomed grids, and graph attention layer by layer."""

from __future__ import annotations

from skygraph.operators.gat import HEADS, HIDDEN
from skygraph.plans.fixtures import WITH_PAIRS, WITH_POINTS

FEATURES = [f"f{i}" for i in range(1, 11)]


def boxcox_fit(zooms: int, grid: int = 41) -> str:
    """(id, f1..f10): each feature by its own best power, standardised."""
    last = grid - 1
    ctes = [
        WITH_POINTS,
        f"long AS (SELECT id, unnest(range({len(FEATURES)})) AS c, unnest([{', '.join(FEATURES)}]) + 1E-6 AS x FROM points)",
        "base AS (SELECT c, count(*) AS n, sum(ln(x)) AS logs FROM long GROUP BY c)",
        "z0 AS (SELECT c, -5E0 AS lo, 5E0 AS hi FROM base)",
    ]
    for k in range(zooms + 1):
        ctes += [
            f"g{k} AS (SELECT c, i, CASE WHEN abs(lo + i * ((hi - lo) / {last}E0)) < 1E-12 THEN 0E0 WHEN i = {last} THEN hi ELSE lo + i * ((hi - lo) / {last}E0) END AS p FROM z{k}, range({grid}) t(i))",
            f"t{k} AS (SELECT c, i, p, avg(y) AS m, var_pop(y) AS v FROM (SELECT c, i, p, CASE WHEN p = 0 THEN ln(x) ELSE (pow(x, p) - 1E0) / p END AS y FROM g{k} JOIN long USING (c)) GROUP BY c, i, p)",
            f"b{k} AS (SELECT c, arg_max(i, (p - 1) * logs - n / 2E0 * ln(v)) AS i FROM t{k} JOIN base USING (c) GROUP BY c)",
            f"z{k + 1} AS (SELECT b{k}.c, l.p AS lo, h.p AS hi FROM b{k} JOIN g{k} l ON l.c = b{k}.c AND l.i = greatest(b{k}.i - 1, 0) JOIN g{k} h ON h.c = b{k}.c AND h.i = least(b{k}.i + 1, {last}))",
        ]
    value = "round((CASE WHEN p = 0 THEN ln(x) ELSE (pow(x, p) - 1E0) / p END - m) / sqrt(v), 4) + 0E0"
    columns = ", ".join(f"max({value}) FILTER (WHERE c = {i}) AS {name}" for i, name in enumerate(FEATURES))
    return ", ".join(ctes) + f" SELECT id, {columns} FROM long JOIN b{zooms} USING (c) JOIN t{zooms} USING (c, i) GROUP BY id"


def w(layer: int, i: str, j: str = "0") -> str:
    """The closed formula of the fixed weights."""
    return f"(({layer}*31 + ({i})*17 + ({j})*7) % 23 - 11) / 40E0"


def layers(depth: int) -> str:
    """CTEs of attention layers 1 to ``depth`` over the ball pairs: out<k>(id, i, v), before normalisation."""
    ctes = [
        f"{WITH_PAIRS}, ways AS (SELECT src, dst, sqrt(d2) AS length FROM pairs UNION ALL SELECT dst, src, sqrt(d2) FROM pairs)",
        "looped AS (SELECT * FROM ways UNION ALL SELECT id, id, coalesce(avg(length), 0E0) FROM points LEFT JOIN ways ON dst = id GROUP BY id)",
        f"x0 AS (SELECT id, unnest(range({len(FEATURES)})) AS j, unnest([{', '.join(FEATURES)}]) AS v FROM points)",
    ]
    for k in range(1, depth + 1):
        heads, width = (HEADS, HIDDEN) if k < 4 else (1, 4)
        n = heads * width
        side = lambda name, o: f"{name}{k} AS (SELECT id, i, sum(v * ({w(8 * k + o, 'i', 'j')})) + {w(8 * k + o + 1, 'i')} AS v FROM x{k - 1}, range({n}) t(i) GROUP BY id, i)"  # noqa: B023, E731
        ctes += [
            side("l", 0),
            side("r", 2),
            f"s{k} AS (SELECT src, dst, h, sum(CASE WHEN u > 0 THEN u ELSE 0.2E0 * u END * ({w(8 * k + 5, 'h', f'i % {width}')})) AS s FROM (SELECT e.src, e.dst, l.i, l.i // {width} AS h, l.v + r.v + e.length * ({w(8 * k + 4, 'l.i')}) AS u FROM looped e JOIN l{k} l ON l.id = e.src JOIN r{k} r ON r.id = e.dst AND r.i = l.i) GROUP BY src, dst, h)",
            f"a{k} AS (SELECT src, dst, h, e / sum(e) OVER (PARTITION BY dst, h) AS a FROM (SELECT src, dst, h, exp(s - max(s) OVER (PARTITION BY dst, h)) AS e FROM s{k}))",
            f"out{k} AS (SELECT a.dst AS id, l.i, sum(a.a * l.v) + {w(8 * k + 6, 'l.i')} AS v FROM a{k} a JOIN l{k} l ON l.id = a.src AND l.i // {width} = a.h GROUP BY a.dst, l.i)",
        ]
        if k < 4:
            residual = " + x.v" if k > 1 else ""
            joined = f" JOIN x{k - 1} x ON x.id = o.id AND x.j = o.i" if k > 1 else ""
            ctes.append(f"x{k} AS (SELECT o.id, o.i AS j, greatest((o.v - m.m) / sqrt(m.s + 1E-5) * (1 + {w(8 * k + 7, 'o.i')}) + {w(8 * k + 8, 'o.i')}{residual}, 0E0) AS v FROM out{k} o JOIN (SELECT id, avg(v) AS m, var_pop(v) AS s FROM out{k} GROUP BY id) m ON m.id = o.id{joined})")
    return ", ".join(ctes)


LAYER = f"{layers(1)} SELECT id, CAST(i AS INT) AS i, round(v, 6) + 0E0 AS v FROM out1"
LOGITS = f"{layers(4)} SELECT id, " + ", ".join(f"round(max(v) FILTER (WHERE i = {i}), 5) + 0E0 AS logit_{i}" for i in range(4)) + " FROM out4 GROUP BY id"
PREDICTED = f"{layers(4)}, wide AS (SELECT id, " + ", ".join(f"max(v) FILTER (WHERE i = {i}) AS g{i}" for i in range(4)) + " FROM out4 GROUP BY id), top AS (SELECT *, greatest(g0, g1, g2, g3) AS g FROM wide), part AS (SELECT *, exp(g0 - g) + exp(g1 - g) + exp(g2 - g) + exp(g3 - g) AS total FROM top)"
PREDICT = f"{PREDICTED} SELECT points.*, CAST(CASE WHEN g0 = g THEN 0 WHEN g1 = g THEN 1 WHEN g2 = g THEN 2 ELSE 3 END AS BIGINT) AS gat_env, " + ", ".join(f"round(CAST(CAST(exp(g{i} - g) / total AS FLOAT) AS DOUBLE), 5) AS gat_{c}_prob" for i, c in enumerate(("void", "wall", "filament", "cluster"))) + " FROM points JOIN part USING (id)"
