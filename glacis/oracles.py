"""DuckDB SQL for the queries that SQL can express, over the same fixtures."""

from __future__ import annotations

from .queries import COLUMNS, HOLE, OUTER

DEM = f"""m AS (SELECT count(*) // {COLUMNS} AS m FROM part),
dem AS (SELECT p_partkey // {COLUMNS} AS r, p_partkey % {COLUMNS} AS c, p_retailprice + p_size AS z FROM part)"""
PICKS = """picks AS (SELECT s_suppkey AS pid, 2.5::DOUBLE + (s_suppkey * 37) % 245 AS x, 2.5::DOUBLE + (s_suppkey * 53) % (5 * m - 5) AS y,
  5.0::DOUBLE + abs(s_acctbal) / 100 AS val FROM supplier, m)"""


def _grad(source: str, value: str = "z", x: str = "sx", y: str = "sy", name: str = "g") -> str:
    part = lambda along, other, n: f"""CASE WHEN {along} = 0 THEN (lead({value}) OVER (PARTITION BY {other} ORDER BY {along}) - {value}) / 5
      WHEN {along} = {n} - 1 THEN ({value} - lag({value}) OVER (PARTITION BY {other} ORDER BY {along})) / 5
      ELSE (lead({value}) OVER (PARTITION BY {other} ORDER BY {along}) - lag({value}) OVER (PARTITION BY {other} ORDER BY {along})) / 10 END"""  # noqa: E731
    return f"{name} AS (SELECT *, {part('c', 'r', COLUMNS)} AS {x}, {part('r', 'c', '(SELECT m FROM m)')} AS {y} FROM {source})"


def _sample(points: str, cells: str, values: list[str], name: str = "s", x: str = "x", y: str = "y") -> str:
    """Bilinear values at points by their four cells; points outside of the centres have no row."""
    return f"""{name}_at AS (SELECT pid, {x} / 5.0 - 0.5 AS fx, {y} / 5.0 - 0.5 AS fy FROM {points}),
{name}_in AS (SELECT *, least(floor(fx), {COLUMNS - 2}) AS c0, least(floor(fy), (SELECT m FROM m) - 2) AS r0 FROM {name}_at WHERE fx BETWEEN 0 AND {COLUMNS - 1} AND fy BETWEEN 0 AND (SELECT m FROM m) - 1),
{name}_four AS (SELECT pid, r0 + i AS r, c0 + j AS c, (CASE i WHEN 0 THEN 1 - (fy - r0) ELSE fy - r0 END) * (CASE j WHEN 0 THEN 1 - (fx - c0) ELSE fx - c0 END) AS w
  FROM {name}_in, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(i, j)),
{name} AS (SELECT pid, {', '.join(f'sum(w * {v}) AS {v}' for v in values)} FROM {name}_four JOIN {cells} USING (r, c) GROUP BY pid)"""


def _mask() -> str:
    rings = []
    for k, ring in enumerate((OUTER, HOLE)):
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            rings.append(f"({k}, {x0}::DOUBLE, {y0}::DOUBLE, {x1}::DOUBLE, {y1}::DOUBLE)")
    return f"""e AS (SELECT k, x0 * 250 AS x0, y0 * 5 * m AS y0, x1 * 250 AS x1, y1 * 5 * m AS y1 FROM (VALUES {', '.join(rings)}) AS v(k, x0, y0, x1, y1), m),
hits AS (SELECT r, c, k, count(*) % 2 AS odd FROM (SELECT r, c, (c + 0.5) * 5 AS x, (r + 0.5) * 5 AS y FROM dem) p JOIN e ON (y0 > y) <> (y1 > y) AND x0 + (y - y0) / (y1 - y0) * (x1 - x0) > x GROUP BY r, c, k),
mask AS (SELECT dem.*, coalesce(o.odd, 0) = 1 AND coalesce(h.odd, 0) = 0 AS inside FROM dem LEFT JOIN (SELECT * FROM hits WHERE k = 0) o USING (r, c) LEFT JOIN (SELECT * FROM hits WHERE k = 1) h USING (r, c))"""


def _eroded() -> str:
    near = lambda f, along, other: f"coalesce({f}(inside) OVER (PARTITION BY {other} ORDER BY {along}), false)"
    return f"er AS (SELECT *, inside AND {near('lag', 'c', 'r')} AND {near('lead', 'c', 'r')} AND {near('lag', 'r', 'c')} AND {near('lead', 'r', 'c')} AS eroded FROM mask)"


def _filtered(source: str, kcs: str, scale: str, name: str) -> str:
    """(kc, r, c, z) for each of ``kcs`` (a list of numbers, above zero): separable kernels (1/n) sum over f of exp(-(2 pi s f)^2 / 2 kc^2) cos(2 pi f d), wrapped around."""
    def kernel(axis, n):
        return f"""{name}_{axis} AS MATERIALIZED (SELECT kc, d, sum(CASE WHEN kc > 0 THEN exp(-power(2 * pi() * {scale} * f, 2) / (2 * kc * kc)) ELSE 1 END * cos(2 * pi() * f * d)) / {n} AS w
  FROM (SELECT unnest({kcs})::DOUBLE AS kc), (SELECT k.range AS d, (((j.range + {n} // 2) % {n}) - {n} // 2)::DOUBLE / {n} AS f FROM range(0, {n}) k, range(0, {n}) j) GROUP BY kc, d)"""
    rows = "(SELECT m FROM m)"
    return f"""{kernel('kx', COLUMNS)}, {kernel('ky', rows)},
{name}_a AS MATERIALIZED (SELECT kc, r, o.range AS c, sum(z * w) AS z FROM {source}, range(0, {COLUMNS}) o JOIN {name}_kx kx ON true WHERE kx.d = (o.range - c + {COLUMNS}) % {COLUMNS} GROUP BY kc, r, o.range),
{name} AS MATERIALIZED (SELECT a.kc, o.range AS r, c, sum(z * w) AS z FROM {name}_a a, range(0, {rows}) o JOIN {name}_ky ky ON true WHERE ky.kc = a.kc AND ky.d = (o.range - r + {rows}) % {rows} GROUP BY a.kc, o.range, c)"""


def _lowpass(kc: float, scale: str) -> str:
    return f"WITH {DEM}, {_filtered('dem', f'[{kc}]', scale, 'b')} SELECT r, c, round(z, 6) + 0.0 AS z FROM b"


def _kriged(points: str, cells: str, drift: tuple[str, ...] = ("1",), name: str = "k") -> str:
    """(r, c, z_hat, var): kriging of ``points`` (x, y, v, u) at ``cells`` (r, c, x, y, u). ``drift``: columns of X and Y, places over
    the largest distance, and u. The system is that of covariances (sill less semivariance), which has the same weights; its
    inverse is found in place, step by step, by Gauss and Jordan: first the samples, then the drift."""
    def columns(x, y, key, source):
        return " UNION ALL ".join(f"SELECT {key} AS key, {d} AS d, {f.replace('X', f'({x} / e)').replace('Y', f'({y} / e)')} AS f FROM {source}, {name}_s" for d, f in enumerate(drift, 1))

    rise = "s * (1.5 * h / a - 0.5 * power(h / a, 3))"
    n = f"(SELECT n + {len(drift)} FROM {name}_s)"
    return f"""{name}_p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY x, y, v) AS i, x, y, v, u FROM {points}),
{name}_h AS MATERIALIZED (SELECT a.i, b.i AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS h FROM {name}_p a, {name}_p b),
{name}_s AS MATERIALIZED (SELECT greatest(0.6::DOUBLE * max(h), 1) AS a, (SELECT var_pop(v) FROM {name}_p) AS s, greatest(max(h), 1) AS e, max(i) AS n FROM {name}_h),
{name}_f AS MATERIALIZED (SELECT key AS i, n + d AS j, f FROM ({columns('x', 'y', 'i', name + '_p')}), {name}_s),
{name}_m AS MATERIALIZED (SELECT i, j, CASE WHEN i = j THEN s - 1e-8 WHEN h > a THEN 0 ELSE s - {rise} END AS v FROM {name}_h, {name}_s
  UNION ALL SELECT i, j, f FROM {name}_f UNION ALL SELECT j, i, f FROM {name}_f UNION ALL SELECT n + a.range, n + b.range, 0 FROM range(1, {len(drift) + 1}) a, range(1, {len(drift) + 1}) b, {name}_s),
{name}_g(k, i, j, v) AS (SELECT 0, i, j, v::DOUBLE FROM {name}_m UNION ALL
  SELECT g.k + 1, g.i, g.j, CASE WHEN g.i = g.k + 1 AND g.j = g.k + 1 THEN 1 / p.v WHEN g.i = g.k + 1 THEN g.v / p.v WHEN g.j = g.k + 1 THEN -g.v / p.v ELSE g.v - c.v * r.v / p.v END
  FROM {name}_g g, (SELECT v FROM {name}_g WHERE i = k + 1 AND j = k + 1) p, (SELECT j, v FROM {name}_g WHERE i = k + 1) r, (SELECT i, v FROM {name}_g WHERE j = k + 1) c
  WHERE r.j = g.j AND c.i = g.i AND g.k < {n}),
{name}_i AS MATERIALIZED (SELECT i, j, v FROM {name}_g WHERE k = {n}),
{name}_w AS MATERIALIZED (SELECT q.i, sum(q.v * p.v) AS w FROM {name}_i q JOIN {name}_p p ON p.i = q.j GROUP BY q.i),
{name}_c AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM {cells}),
{name}_r AS MATERIALIZED (SELECT id, i, g, s - g AS v FROM (SELECT id, i, s, CASE WHEN h > a THEN s WHEN h = 0 THEN 0 ELSE {rise} END AS g
    FROM (SELECT c.id, p.i, sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) AS h FROM {name}_c c, {name}_p p), {name}_s)
  UNION ALL SELECT key, n + d, -f, f FROM ({columns('x', 'y', 'id', name + '_c')}), {name}_s),
{name}_z AS (SELECT id, sum(v * w) AS z_hat FROM {name}_r JOIN {name}_w USING (i) GROUP BY id),
{name}_v AS (SELECT b.id, sum(a.g * q.v * b.v) AS var FROM {name}_r b JOIN {name}_i q ON q.j = b.i JOIN {name}_r a ON a.id = b.id AND a.i = q.i GROUP BY b.id),
{name} AS MATERIALIZED (SELECT r, c, z_hat, greatest(var, 0) AS var FROM {name}_c JOIN {name}_z USING (id) JOIN {name}_v USING (id))"""


def _places(source: str) -> str:
    return f"(SELECT r, c, c * (250.0::DOUBLE / {COLUMNS - 1}) AS x, r * (5.0::DOUBLE * m / (m - 1)) AS y, u FROM {source}, m)"


RIM = f"""rim AS (SELECT r, c, row_number() OVER (ORDER BY r, c) - 1 AS i, count(*) OVER () AS n FROM er WHERE inside AND NOT eroded),
zeros AS (SELECT c * (250.0::DOUBLE / {COLUMNS - 1}) AS x, r * (5.0::DOUBLE * m / (m - 1)) AS y, 0.0::DOUBLE AS val FROM rim, m WHERE i % greatest(1, n // 100) = 0)"""


def _fitted(bins: str, name: str = "fit") -> str:
    """(kc, a, c, c0) of the least squares of ``bins`` (kc, h, g): 400 ranges first, then 20 at a time between the best one's neighbours."""
    def errors(source):
        return f"""(SELECT kc, k, a, arg_min(struct_pack(c := c, c0 := c0), e) AS p, min(e) AS e, any_value(lo) AS lo, any_value(step) AS step FROM (
    SELECT kc, k, a, lo, step, c, c0, gg - 2 * c * fg - 2 * c0 * sg + c * c * ff + 2 * c * c0 * sf + n * c0 * c0 AS e FROM (
      SELECT *, unnest([struct_pack(c := (fg - sf * sg / n) / (ff - sf * sf / n), c0 := (sg - (fg - sf * sg / n) / (ff - sf * sf / n) * sf) / n),
        struct_pack(c := 1e-6, c0 := least(greatest((sg - 1e-6 * sf) / n, 0), high)), struct_pack(c := 5 * high, c0 := least(greatest((sg - 5 * high * sf) / n, 0), high)),
        struct_pack(c := least(greatest(fg / ff, 1e-6), 5 * high), c0 := 0.0::DOUBLE), struct_pack(c := least(greatest((fg - high * sf) / ff, 1e-6), 5 * high), c0 := high)], recursive := true)
      FROM (SELECT kc, k, a, any_value(lo) AS lo, any_value(step) AS step, count(*)::DOUBLE AS n, max(g) AS high, sum(f) AS sf, sum(f * f) AS ff, sum(g) AS sg, sum(f * g) AS fg, sum(g * g) AS gg
        FROM (SELECT t.kc, k, a, lo, step, g, 1.5 * least(h / a, 1) - 0.5 * power(least(h / a, 1), 3) AS f FROM {source} t JOIN {bins} b USING (kc)) GROUP BY kc, k, a))
    WHERE c BETWEEN 1e-6 AND 5 * high AND c0 BETWEEN 0 AND high) GROUP BY kc, k, a)"""

    out = [f"{name}_t0 AS (SELECT kc, k.range AS k, 1e-3 + k.range * step AS a, 1e-3 AS lo, step FROM (SELECT kc, (2 * max(h) - 1e-3) / 399 AS step FROM {bins} GROUP BY kc), range(0, 400) k)"]
    for level in range(10):
        out.append(f"{name}_e{level} AS MATERIALIZED (SELECT kc, arg_min(k, (e, k)) AS k, arg_min(a, (e, k)) AS a, arg_min(p, (e, k)) AS p, max(k) AS top, any_value(lo) AS lo, any_value(step) AS step FROM {errors(f'{name}_t{level}')} GROUP BY kc)")
        out.append(f"{name}_t{level + 1} AS (SELECT kc, j.range AS k, low + j.range * (high - low) / 20 AS a, low AS lo, (high - low) / 20 AS step FROM (SELECT kc, lo + greatest(k - 1, 0) * step AS low, lo + least(k + 1, top) * step AS high FROM {name}_e{level}), range(0, 21) j)")
    return ",\n".join(out) + f",\n{name} AS (SELECT kc, a, p.c AS c, p.c0 AS c0 FROM {name}_e9)"


def _swept(angles: str, points: str, kcs: str, frozen: bool = False) -> str:
    """(kc, mean_variance): products of ``points`` (pid, x, y, val) with the filtered ``angles`` (r, c, z), judged by their variograms."""
    first = "(SELECT arg_max(a, kc) FROM fit)"
    return f"""{_filtered(angles, kcs, '5', 'fl')},
at_ AS (SELECT pid, val, x, y, x / 5.0 - 0.5 AS fx, y / 5.0 - 0.5 AS fy FROM {points} WHERE val > 0),
at_in AS (SELECT *, least(floor(fx), {COLUMNS - 2}) AS c0, least(floor(fy), (SELECT m FROM m) - 2) AS r0 FROM at_ WHERE fx BETWEEN 0 AND {COLUMNS - 1} AND fy BETWEEN 0 AND (SELECT m FROM m) - 1),
prod AS MATERIALIZED (SELECT kc, pid, any_value(x) AS x, any_value(y) AS y, sum(w * z) * any_value(val) AS v FROM (SELECT pid, val, x, y, r0 + i AS r, c0 + j AS c, (CASE i WHEN 0 THEN 1 - (fy - r0) ELSE fy - r0 END) * (CASE j WHEN 0 THEN 1 - (fx - c0) ELSE fx - c0 END) AS w
  FROM at_in, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(i, j)) JOIN fl USING (r, c) GROUP BY kc, pid),
pr AS MATERIALIZED (SELECT a.kc, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS h, (a.v - b.v) * (a.v - b.v) / 2 AS d FROM prod a JOIN prod b ON a.kc = b.kc AND a.pid < b.pid),
bins AS MATERIALIZED (SELECT kc, avg(h) AS h, avg(d) AS g FROM pr, (SELECT max(h) / 2 AS reach FROM pr) WHERE h < reach GROUP BY kc, least(floor(h / (reach / 15)), 14)),
{_fitted('bins')},
mean_ AS (SELECT kc, avg(v) AS mean FROM prod GROUP BY kc),
scores AS (SELECT kc, coalesce(avg(g / (mean * mean)) FILTER (WHERE h <= {first if frozen else 'a'}), avg(g / (mean * mean))) AS mean_variance FROM bins JOIN mean_ USING (kc) JOIN fit USING (kc) GROUP BY kc)"""


def _gauss(source: str, value: str, sigma: float, name: str) -> str:
    reach = int(4 * sigma + 0.5)
    fold = lambda i, n: f"CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END"
    rows = "(SELECT m FROM m)"
    return f"""{name}_w AS (SELECT d, exp(-0.5 * power(d / {sigma}::DOUBLE, 2)) / sum(exp(-0.5 * power(d / {sigma}::DOUBLE, 2))) OVER () AS w FROM (SELECT range - {reach} AS d FROM range(0, {2 * reach + 1}))),
{name}_x AS (SELECT t.r, t.c, sum(s.v * w) AS v FROM (SELECT r, c, d, w, {fold('c + d', COLUMNS)} AS cc FROM {source}, {name}_w) t JOIN (SELECT r, c, {value} AS v FROM {source}) s ON s.r = t.r AND s.c = t.cc GROUP BY t.r, t.c),
{name} AS (SELECT t.r, t.c, sum(s.v * w) AS {value} FROM (SELECT r, c, d, w, {fold('r + d', rows)} AS rr FROM {name}_x, {name}_w) t JOIN {name}_x s ON s.r = t.rr AND s.c = t.c GROUP BY t.r, t.c)"""


def _distance() -> str:
    """Squared distances along columns, then the smallest sum along rows."""
    return f"""col AS (SELECT a.r, a.c, min((a.r - b.r) * (a.r - b.r)) AS g FROM mask a JOIN mask b ON a.c = b.c AND NOT b.inside GROUP BY a.r, a.c),
dist AS (SELECT a.r, a.c, sqrt(min((a.c - b.c) * (a.c - b.c) + b.g)) * 5.0 AS distance FROM mask a JOIN col b ON a.r = b.r GROUP BY a.r, a.c)"""


SINE = "sin(atan(sqrt(sx * sx + sy * sy)))"
LEAST = "sin(radians(2.0::DOUBLE))"
VARIOGRAM = """p AS (SELECT sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS h, power(a.val - b.val, 2) AS d FROM picks a JOIN picks b ON a.pid < b.pid)"""
FIELD = "field AS (SELECT r, c, z / 20 AS z, 200.0::DOUBLE + 40 * sin((c + 0.5) * 5 / 60) + 30 * cos((r + 0.5) * 5 / 75) AS t FROM dem)"


def _rays(v: str, name: str) -> str:
    return f"""{name} AS (SELECT r, c, z, -t * {v} * {v} * (cx * (cy * cy + sy * sy) / area * tx - sx * cx * sy / area * ty - sx * cy / sqrt(area) * down) AS dx,
  -t * {v} * {v} * (cy * (cx * cx + sx * sx) / area * ty - sy * sx * cy / area * tx - cx * sy / sqrt(area) * down) AS dy,
  -t * {v} * {v} * (cy * cy * sx / area * tx + cx * cx * sy / area * ty + cx * cy / sqrt(area) * down) AS dz
  FROM (SELECT *, sqrt(greatest(power(1 / {v}, 2) - (tx * tx + ty * ty + 2 * tx * ty * sx * sy), 0)) AS down, greatest(cy * cy * cx * cx + sy * sy * cx * cx + sx * sx * cy * cy, 1e-6) AS area
    FROM (SELECT *, sin(atan(zx)) AS sx, cos(atan(zx)) AS cx, sin(atan(zy)) AS sy, cos(atan(zy)) AS cy FROM gz)))"""


def _migrated(v: str, name: str) -> str:
    return f"""{_rays(v, name + '_f')}, {_sample('picks', name + '_f', ['dx', 'dy', 'dz'], name + '_s')},
{name}_m AS (SELECT pid, x + coalesce(dx, 0) AS x_mig, y + coalesce(dy, 0) AS y_mig, CASE WHEN -coalesce(dz, 0) > 0 THEN -dz ELSE val * {v} END AS d_mig FROM picks LEFT JOIN {name}_s USING (pid))"""


TIMED = f"WITH {DEM}, {PICKS}, {FIELD}, {_grad('field', 't', 'tx', 'ty', 'gt')}, {_grad('gt', 'z', 'zx', 'zy', 'gz')}"
RECONSTRUCTED = f"""WITH {DEM}, {_mask()}, {_grad('mask')},
q AS (SELECT *, {SINE} AS sine, 20.0::DOUBLE + 8 * sin(r / 5.0::DOUBLE) * cos(c / 6.0::DOUBLE) AS product, 2.0::DOUBLE + cos(c / 8.0::DOUBLE) AS variance FROM g),
rec AS (SELECT r, c, z, inside, CASE WHEN inside THEN least(greatest(product / greatest(sine, {LEAST}), 0), 500) ELSE 0 END AS thickness,
  CASE WHEN inside THEN sqrt(greatest(variance / power(greatest(sine, {LEAST}), 2), 0)) ELSE 0 END AS uncertainty FROM q)"""

DEM20 = DEM.replace("p_retailprice + p_size AS z", "(p_retailprice + p_size) / 20 AS z")
ANGLES = f"ang AS (SELECT r, c, atan(sqrt(sx * sx + sy * sy)) AS z FROM g)"
#: The facade's fixture: a gentler raster, its outline, and the sine of the slope filtered at a cutoff of 2.
FACADE = f"WITH RECURSIVE {DEM20}, {PICKS}, {_mask()}, {_eroded()}, {_grad('mask')}, {ANGLES}, {_filtered('ang', '[2.0]', '5', 'fa')}, sine AS MATERIALIZED (SELECT r, c, sin(z) AS sine FROM fa), {_sample('picks', 'sine', ['sine'], 'ps')}"
PRODUCTS = "kp AS (SELECT x, y, val * greatest(coalesce(sine, 0.1::DOUBLE), 1e-4) AS v, 0 AS u FROM picks LEFT JOIN ps USING (pid)"
INTERPOLATED = f"""{FACADE}, {RIM}, {PRODUCTS} UNION ALL SELECT x, y, val, 0 FROM zeros), kc AS {_places('(SELECT r, c, 0 AS u FROM dem)')}, {_kriged('kp', 'kc')},
got AS MATERIALIZED (SELECT mask.r, mask.c, z, inside, CASE WHEN inside THEN least(greatest(z_hat / greatest(sine, {LEAST}), 0), greatest(1.5 * top, 500)) ELSE 0 END AS thickness, CASE WHEN inside THEN var / power(greatest(sine, {LEAST}), 2) ELSE 0 END AS var
  FROM mask JOIN k USING (r, c) JOIN sine USING (r, c), (SELECT max(val) AS top FROM picks))"""


def _blended(source: str, width: str) -> str:
    """(r, c, z, inside, th) of ``source`` (r, c, z, inside, thickness), thinned towards the margin."""
    return f"""{_distance()}, th AS (SELECT r, c, z, inside, CASE WHEN inside THEN thickness ELSE 0 END AS thickness, 0.5 * (1 - cos(pi() * least(distance / {width}, 1))) AS weight FROM {source} JOIN dist USING (r, c)),
ta AS MATERIALIZED (SELECT *, thickness * weight AS t FROM th), {_gauss('ta', 't', 1.0, 'so')},
bl AS (SELECT r, c, z, inside, CASE WHEN NOT inside THEN 0 WHEN weight > 0.8 THEN thickness ELSE so.t END AS th FROM ta JOIN so USING (r, c))"""


SPLINE = f"""WITH RECURSIVE {DEM}, {PICKS}, {_mask()}, p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY x, y, val) AS i, x, y, val FROM picks),
ex AS (SELECT avg(x) AS mx, avg(y) AS my, greatest(max(x) - min(x), max(y) - min(y)) / 2 AS s, max(i) AS n FROM p),
f AS (SELECT i, n + d AS j, CASE d WHEN 1 THEN 1 WHEN 2 THEN (x - mx) / s ELSE (y - my) / s END AS v FROM p, ex, (VALUES (1), (2), (3)) AS t(d)),
sy AS MATERIALIZED (SELECT i, j, CASE WHEN i = j THEN 0.1 ELSE 0.5 * q * ln(q) END::DOUBLE AS v FROM (SELECT a.i, b.i AS j, power(a.x - b.x, 2) + power(a.y - b.y, 2) AS q FROM p a, p b)
  UNION ALL SELECT i, j, v FROM f UNION ALL SELECT j, i, v FROM f UNION ALL SELECT n + a.range, n + b.range, 0 FROM range(1, 4) a, range(1, 4) b, ex
  UNION ALL SELECT i, n + 4, val FROM p, ex UNION ALL SELECT n + a.range, n + 4, 0 FROM range(1, 4) a, ex),
ge(k, i, j, v, used) AS (SELECT 0, i, j, v, 0 FROM sy UNION ALL
  SELECT g.k + 1, g.i, g.j, CASE WHEN g.i = b.i THEN g.v / b.v ELSE g.v - c.v * r.v / b.v END, CASE WHEN g.i = b.i THEN g.k + 1 ELSE g.used END
  FROM ge g, (SELECT arg_max(i, abs(v)) AS i, arg_max(v, abs(v)) AS v FROM ge WHERE j = k + 1 AND used = 0) b, (SELECT i, j, v FROM ge) r, (SELECT i, v FROM ge WHERE j = k + 1) c
  WHERE r.i = b.i AND r.j = g.j AND c.i = g.i AND g.k < (SELECT n + 3 FROM ex)),
w AS MATERIALIZED (SELECT used AS i, v FROM ge, ex WHERE k = n + 3 AND j = n + 4),
sp AS (SELECT r, c, sum(CASE WHEN q > 0 THEN 0.5 * q * ln(q) ELSE 0 END * v) AS t FROM (SELECT r, c, w.v, power((c + 0.5) * 5 - x, 2) + power((r + 0.5) * 5 - y, 2) AS q FROM dem, p JOIN w USING (i)) GROUP BY r, c),
pl AS (SELECT (SELECT v FROM w WHERE i = n + 1) AS a, (SELECT v FROM w WHERE i = n + 2) AS b, (SELECT v FROM w WHERE i = n + 3) AS d, mx, my, s FROM ex),
got AS MATERIALIZED (SELECT r, c, z, inside, greatest(t + a + b * ((c + 0.5) * 5 - mx) / s + d * ((r + 0.5) * 5 - my) / s, 0) AS thickness FROM mask JOIN sp USING (r, c), pl)"""

QUADRATIC = ("1", "X", "Y", "X * X", "Y * Y", "X * Y")
KRIGED = "SELECT r, c, round(z_hat, 4) + 0.0 AS z_hat, round(var, 4) + 0.0 AS var FROM k"
ALL_PICKS = "kp AS (SELECT x, y, val AS v, 0 AS u FROM picks"
CELLS = f"kc AS {_places('(SELECT r, c, 0 AS u FROM dem)')}"
SHAPED = f"SELECT r, c, round(z, 4) + 0.0 AS z, m AS nrows, {COLUMNS} AS ncols, 5.0::DOUBLE AS dx, 5.0::DOUBLE * m AS maxy FROM dem, m"
INSIDE = f"WITH {DEM}, {_mask()} SELECT r, c, inside FROM mask"


def _values(rows: list[tuple], names: str) -> str:
    show = lambda v: "NULL" if v is None else repr(v) if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"


# The plain settings of the configuration format, as JSON, by section
SETTINGS = {
    ("inputs", "dem_path"): "null", ("inputs", "outline_path"): "null", ("inputs", "survey_data_path"): "null", ("inputs", "survey_data_type"): '"one_way_travel_time"',
    ("spatial_parameters", "dx"): "null", ("spatial_parameters", "dy"): "null", ("spatial_parameters", "bounds"): "null",
    ("migration_parameters", "perform_migration"): "true", ("migration_parameters", "velocity"): "0.16", ("migration_parameters", "interactive_migration"): "false",
    ("optimization_parameters", "kc_max"): "10.0", ("optimization_parameters", "kc_min"): "0.01", ("optimization_parameters", "d_kc"): "0.1", ("optimization_parameters", "num_steps"): "10",
    ("optimization_parameters", "interactive_optimization"): "false",
    ("finalization_parameters", "random_forest_gap_filling"): "false", ("finalization_parameters", "apply_margin_blend"): "false", ("finalization_parameters", "min_gap_dist"): "50.0",
    ("finalization_parameters", "smooth_bedrock"): "false", ("finalization_parameters", "smoothing_method"): '"gaussian"', ("finalization_parameters", "smoothing_sigma"): "1.5",
    ("finalization_parameters", "smoothing_kernel_size"): "3", ("finalization_parameters", "smoothing_kc_cutoff"): "null",
    ("outputs", "output_path"): '"final_bedrock.tif"', ("outputs", "output_format"): '"tif"', ("outputs", "plots_dir"): "null"}
OWN = {("inputs", "dem_path"): '"dem.tif"', ("inputs", "travel_times_path"): '"picks.csv"', ("inputs", "survey_data_path"): '"picks.csv"', ("optimization_parameters", "kc_max"): "5.0", ("finalization_parameters", "smooth_bedrock"): "true"}
LIST = "[10.0 - i * 0.1::DOUBLE FOR i IN range(0, 100)]"

ORACLE = {
    "terrain_slope": f"""WITH {DEM}, {_grad('dem')} SELECT r, c, round(sx, 6) + 0.0 AS slope_x, round(sy, 6) + 0.0 AS slope_y, round(sqrt(sx * sx + sy * sy), 6) + 0.0 AS slope,
  round(atan(sqrt(sx * sx + sy * sy)), 6) + 0.0 AS slope_rad FROM g""",
    "terrain_trig": f"""WITH {DEM}, {_grad('dem')} SELECT r, c, round(degrees(atan(sqrt(sx * sx + sy * sy))), 6) + 0.0 AS slope_grad, round(sin(atan(sx)), 6) + 0.0 AS sin_x, round(cos(atan(sx)), 6) + 0.0 AS cos_x,
  round(sin(atan(sy)), 6) + 0.0 AS sin_y, round(cos(atan(sy)), 6) + 0.0 AS cos_y, round({SINE}, 6) + 0.0 AS sin_slope FROM g""",
    "fft_lowpass": _lowpass(10.0, "5"),
    "post_fft_lowpass": _lowpass(0.3, "0.2::DOUBLE"),
    "gaussian_smooth": f"WITH {DEM}, {_gauss('dem', 'z', 1.5, 'sm')} SELECT r, c, round(z, 6) + 0.0 AS z FROM sm",
    "median_smooth": f"""WITH {DEM}, w AS (SELECT d.r, d.c, CASE WHEN d.r + i < 0 THEN 0 WHEN d.r + i >= m THEN m - 1 ELSE d.r + i END AS rr, CASE WHEN d.c + j < 0 THEN 0 WHEN d.c + j >= {COLUMNS} THEN {COLUMNS - 1} ELSE d.c + j END AS cc
  FROM dem d, m, (VALUES (-1), (0), (1)) AS a(i), (VALUES (-1), (0), (1)) AS b(j))
SELECT w.r, w.c, round(median(z), 6) + 0.0 AS z FROM w JOIN dem ON dem.r = w.rr AND dem.c = w.cc GROUP BY w.r, w.c""",
    "variogram_bins": f"""WITH {DEM}, {PICKS}, {VARIOGRAM} SELECT floor(h / 6.0::DOUBLE)::INT AS bin, round(avg(h), 4) + 0.0 AS distance, round(avg(d) / 2, 4) + 0.0 AS val, count(*) AS np FROM p WHERE h < 90 GROUP BY 1""",
    "variogram_default_reach": f"""WITH {DEM}, {PICKS}, {VARIOGRAM}, t AS (SELECT max(h) / 2 AS reach FROM p)
SELECT floor(h / (reach / 15))::INT AS bin, round(avg(h), 4) + 0.0 AS distance, round(avg(d) / 2, 4) + 0.0 AS val, count(*) AS np FROM p, t WHERE h < reach GROUP BY 1""",
    "variogram_models": """SELECT round(h, 6) + 0.0 AS h, round(CASE WHEN h > 80 THEN 4 ELSE 4 * (1.5 * h / 80 - 0.5 * power(h / 80, 3)) END, 6) + 0.0 AS spherical, round(4 * (1 - exp(-3 * h / 80)), 6) + 0.0 AS exponential,
  round(4 * (1 - exp(-3 * power(h / 80, 2))), 6) + 0.0 AS gaussian, round(4 * least(h / 80, 1), 6) + 0.0 AS linear FROM (SELECT range * 2.5::DOUBLE AS h FROM range(0, 60))""",
    "bilinear_sample": f"WITH {DEM}, {PICKS}, {_sample('picks', 'dem', ['z'])} SELECT pid, round(z, 6) + 0.0 AS z FROM s",
    "mask_polygon_with_hole": f"WITH {DEM}, {_mask()} SELECT r, c, inside FROM mask",
    "mask_boundary": f"WITH {DEM}, {_mask()}, {_eroded()} SELECT r, c, eroded, inside AND NOT eroded AS boundary FROM er",
    "zero_boundary_points": f"""WITH {DEM}, {_mask()}, {_eroded()}, b AS (SELECT r, c, row_number() OVER (ORDER BY r, c) - 1 AS i, count(*) OVER () AS n FROM er WHERE inside AND NOT eroded)
SELECT round(c * (250.0::DOUBLE / {COLUMNS - 1}), 6) + 0.0 AS x, round(r * (5.0::DOUBLE * m / (m - 1)), 6) + 0.0 AS y, 0.0::DOUBLE AS val FROM b, m WHERE i % greatest(1, n // 100) = 0""",
    "distance_to_margin": f"WITH {DEM}, {_mask()}, {_distance()} SELECT r, c, round(distance, 6) + 0.0 AS distance FROM dist",
    "nearest_fill": f"""WITH {DEM}, k AS (SELECT r, c, CASE WHEN (r * 7 + c * 3) % 5 > 1 THEN z END AS z FROM dem), n AS (SELECT a.r, a.c, b.z, row_number() OVER (PARTITION BY a.r, a.c ORDER BY (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c), b.r, b.c) AS i
  FROM k a JOIN k b ON a.z IS NULL AND b.z IS NOT NULL AND abs(a.r - b.r) < 9 AND abs(a.c - b.c) < 9)
SELECT r, c, round(z, 6) + 0.0 AS z FROM k WHERE z IS NOT NULL UNION ALL SELECT r, c, round(z, 6) + 0.0 AS z FROM n WHERE i = 1""",
    "resample_dem": f"""WITH {DEM}, ij AS (SELECT i.range AS r, j.range AS c FROM range(0, (SELECT m // 2 FROM m)) i, range(0, {COLUMNS // 2}) j)
SELECT ij.r, ij.c, round(sum(z) / 4, 6) + 0.0 AS z FROM ij JOIN dem ON dem.r // 2 = ij.r AND dem.c // 2 = ij.c GROUP BY ij.r, ij.c""",
    "margin_blend": f"""WITH {DEM}, {_mask()}, {_distance()},
th AS (SELECT r, c, z, inside, CASE WHEN inside THEN 40 + 10 * sin(r / 7.0::DOUBLE) * cos(c / 9.0::DOUBLE) ELSE 0 END AS thickness, 0.5 * (1 - cos(pi() * least(distance / 30, 1))) AS weight FROM mask JOIN dist USING (r, c)),
ta AS (SELECT *, thickness * weight AS t FROM th), {_gauss('ta', 't', 1.0, 'so')},
f AS (SELECT r, c, z, CASE WHEN NOT inside THEN 0 WHEN weight > 0.8 THEN thickness ELSE so.t END AS th FROM ta JOIN so USING (r, c))
SELECT r, c, round(th, 6) + 0.0 AS thickness, round(z - th, 6) + 0.0 AS bed FROM f""",
    "eikonal_migration": f"""{TIMED}, {_sample('picks', 'field', ['z'], 'zs')}, {_migrated('0.16::DOUBLE', 'a')}, {_sample('a_m', 'field', ['z'], 'zm', 'x_mig', 'y_mig')}
SELECT pid, round(x_mig, 6) + 0.0 AS x_mig, round(y_mig, 6) + 0.0 AS y_mig, round(coalesce(zm.z, zs.z), 6) + 0.0 AS z_surf_mig, round(d_mig, 6) + 0.0 AS d_mig FROM a_m LEFT JOIN zm USING (pid) LEFT JOIN zs USING (pid)""",
    "velocity_sweep": f"""{TIMED}, {_migrated('0.12::DOUBLE', 'a')}, {_migrated('0.16::DOUBLE', 'b')}
SELECT pid, 0.12::DOUBLE AS velocity, round(x_mig, 6) + 0.0 AS x_mig, round(y_mig, 6) + 0.0 AS y_mig, round(d_mig, 6) + 0.0 AS d_mig FROM a_m
UNION ALL SELECT pid, 0.16::DOUBLE, round(x_mig, 6) + 0.0, round(y_mig, 6) + 0.0, round(d_mig, 6) + 0.0 FROM b_m""",
    "survey_units": f"WITH {DEM}, {PICKS} SELECT pid, round(val, 6) + 0.0 AS one_way_travel_time, round(val / 2, 6) + 0.0 AS two_way_travel_time, round(val, 6) + 0.0 AS thickness FROM picks",
    "survey_extent": f"WITH {DEM}, {PICKS} SELECT round(min(x), 6) + 0.0 AS minx, round(max(x), 6) + 0.0 AS maxx, round(min(y), 6) + 0.0 AS miny, round(max(y), 6) + 0.0 AS maxy FROM picks",
    "unmigrated_depth": f"""WITH {DEM}, {PICKS}, {_sample('picks', 'dem', ['z'])}, t AS (SELECT max(val) AS top FROM picks)
SELECT pid, round(x, 6) + 0.0 AS x_mig, round(y, 6) + 0.0 AS y_mig, round(z, 6) + 0.0 AS z_surf_mig, round(CASE WHEN top > 15 THEN val * 0.16::DOUBLE ELSE val END, 6) + 0.0 AS d_mig FROM picks LEFT JOIN s USING (pid), t""",
    "stress_products": f"""WITH {DEM}, {PICKS}, {_grad('dem')}, sn AS (SELECT r, c, {SINE} AS sine FROM g), {_sample('picks', 'sn', ['sine'])}
SELECT pid, round(val * greatest(coalesce(sine, 0.1::DOUBLE), 1e-4), 6) + 0.0 AS product FROM picks LEFT JOIN s USING (pid)""",
    "sia_drift_standardized": f"""WITH {DEM}, {_grad('dem')}, u AS (SELECT r, c, 1 / greatest({SINE}, {LEAST}) AS u FROM g)
SELECT r, c, round((u - avg(u) OVER ()) / greatest(stddev_pop(u) OVER (), 1e-6), 6) + 0.0 AS u FROM u""",
    "kriging_system": f"""WITH {DEM}, {PICKS}, {VARIOGRAM} SELECT round(greatest(0.6::DOUBLE * (SELECT max(h) FROM p), 1), 6) + 0.0 AS "range", round(var_pop(val), 6) + 0.0 AS sill, count(*) AS samples FROM picks""",
    "thickness_reconstruct": f"{RECONSTRUCTED} SELECT r, c, round(thickness, 5) + 0.0 AS thickness, round(z - thickness, 5) + 0.0 AS bed, round(uncertainty, 5) + 0.0 AS uncertainty FROM rec",
    "thickness_stats": f"""{RECONSTRUCTED} SELECT round(avg(thickness) FILTER (WHERE inside), 5) + 0.0 AS mean_thickness, round(max(thickness) FILTER (WHERE inside), 5) + 0.0 AS max_thickness,
  round(avg(uncertainty) FILTER (WHERE inside), 5) + 0.0 AS mean_uncertainty, count(*) AS cells FROM rec""",
    "kriging_ordinary": f"WITH RECURSIVE {DEM}, {PICKS}, {ALL_PICKS}), {CELLS}, {_kriged('kp', 'kc')} {KRIGED}",
    "kriging_universal": f"WITH RECURSIVE {DEM}, {PICKS}, {_mask()}, {_eroded()}, {RIM}, {ALL_PICKS} UNION ALL SELECT x, y, val, 0 FROM zeros), {CELLS}, {_kriged('kp', 'kc', QUADRATIC)} {KRIGED}",
    "kriging_linear": f"WITH RECURSIVE {DEM}, {PICKS}, {ALL_PICKS}), {CELLS}, {_kriged('kp', 'kc', QUADRATIC[:3])} {KRIGED}",
    "kriging_sia": f"""WITH RECURSIVE {DEM}, {PICKS}, {_grad('dem')}, un AS (SELECT r, c, 1 / greatest({SINE}, {LEAST}) AS u FROM g), us AS MATERIALIZED (SELECT r, c, (u - avg(u) OVER ()) / greatest(stddev_pop(u) OVER (), 1e-6) AS u FROM un),
{_sample('picks', 'us', ['u'])}, kp AS (SELECT x, y, val AS v, coalesce(u, 0) AS u FROM picks LEFT JOIN s USING (pid)), kc AS {_places('us')}, {_kriged('kp', 'kc', ('1', 'u'))} {KRIGED}""",
    "kriging_plausible": _values([("estimates", True), ("far", False), ("gap", False)], "name, plausible"),
    "variogram_gaps": f"""WITH {DEM}, {PICKS}, q AS (SELECT * FROM picks WHERE pid % 7 <> 3 AND pid % 11 <> 5 AND pid % 13 <> 6), {VARIOGRAM.replace('picks', 'q')}
SELECT floor(h / 6.0::DOUBLE)::INT AS bin, round(avg(h), 4) + 0.0 AS distance, round(avg(d) / 2, 4) + 0.0 AS val, count(*) AS np FROM p WHERE h < 90 GROUP BY 1""",
    "variogram_fit": f"""WITH {DEM}, {PICKS}, wave AS (SELECT pid, x, y, 30 * sin(x / 40) * cos(y / 50) + val / 10 AS val FROM picks), {VARIOGRAM.replace('picks', 'wave')}, bins AS MATERIALIZED (SELECT 0 AS kc, avg(h) AS h, avg(d) / 2 AS g FROM p WHERE h < 90 GROUP BY floor(h / 6.0::DOUBLE)), {_fitted('bins')},
hs AS (SELECT i.range * (1.2 * (SELECT max(h) FROM bins) / 99) AS h FROM range(0, 100) i) SELECT round(h, 4) + 0.0 AS h, round(c0 + c * (1.5 * least(h / a, 1) - 0.5 * power(least(h / a, 1), 3)), 4) + 0.0 AS gamma FROM hs, fit""",
    "bss_sweep": f"WITH {DEM}, {PICKS}, {_grad('dem')}, {ANGLES}, {_swept('ang', 'picks', LIST)} SELECT kc, round(mean_variance, 5) + 0.0 AS mean_variance FROM (SELECT round(kc, 5) + 0.0 AS kc, mean_variance FROM scores)",
    "bss_sweep_frozen": f"WITH {DEM}, {PICKS}, {_grad('dem')}, {ANGLES}, {_swept('ang', 'picks', '[8.0, 4.0, 1.0, 0.0]', True)} SELECT kc, round(mean_variance, 5) + 0.0 AS mean_variance FROM scores",
    "sweep_points": f"WITH {DEM}, {PICKS} SELECT pid, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(val, 6) + 0.0 AS v FROM picks WHERE pid % 7 <> 3 AND pid % 11 <> 5 AND pid % 5 <> 1",
    "cutoff_list": "SELECT 'step' AS kind, 2.0::DOUBLE - range * 0.25 AS kc FROM range(0, 9) UNION ALL SELECT 'number', 2.0::DOUBLE - range * 0.25 FROM range(0, 7)",
    "forest_masks": f"""WITH {DEM}, {_mask()}, b AS (SELECT *, CASE WHEN r % 7 = 3 THEN z - 0.1::DOUBLE * (c % 3) WHEN r % 5 > 0 THEN z - 40 - 10 * sin(r / 7.0::DOUBLE) * cos(c / 9.0::DOUBLE) END AS bed FROM mask)
SELECT r, c, coalesce(inside AND bed IS NOT NULL AND z - bed > 0.1::DOUBLE, false) AS known, coalesce(inside AND z - bed <= 0.1::DOUBLE, false) AS hole FROM b""",
    "final_thickness": f"""WITH {DEM}, {_mask()} SELECT r, c, round(CASE WHEN inside THEN greatest(40 + 10 * sin(r / 7.0::DOUBLE) * cos(c / 9.0::DOUBLE) - CASE WHEN c % 3 = 1 THEN 45 ELSE 0 END, 0) ELSE 0 END, 6) + 0.0 AS thickness FROM mask""",
    "survey_routing": f"""WITH {DEM}, {PICKS}, k AS (SELECT * FROM (VALUES ('thickness', 1.0, 1.0), ('ice_thickness', 1.0, 1.0), ('depth', 1.0, 1.0), ('one_way_travel_time', 1.0, 0.16), ('twt', 0.5, 0.16)) AS t(kind, f, v)), w AS (SELECT pid, kind, val * f::DOUBLE AS val, v::DOUBLE AS v FROM picks, k)
SELECT pid, kind, round(CASE WHEN max(val) OVER (PARTITION BY kind) > 15 THEN val * v ELSE val END, 6) + 0.0 AS d_mig FROM w""",
    "survey_outside": _values([("at home", True), ("over the edge", True), ("in the margin", True), ("beyond", False), ("far west", False)], "name, holds"),
    "config_required": _values([("dem", False), ("both", True), ("survey", False), ("none", False)], "name, holds"),
    "config_template": _values([(*k, v) for k, v in SETTINGS.items()], "section, key, value"),
    "config_merged": _values([(*k, v) for k, v in (SETTINGS | OWN).items()], "section, key, value"),
    "crs_equality": _values([*[(n, True) for n in ("code", "urn", "versioned", "address", "text", "identifier", "crs84", "unknown")], *[(n, False) for n in ("other", "other text", "axes")]], "name, holds"),
    "polygon_repair": _values([("fine", 2, 100.0), ("flat hole", 1, 100.0), ("crossed hole", 1, 100.0), ("short hole", 1, 100.0), ("empty", 0, 0.0)], "name, rings, area"),
    "scan_geotiff": f"WITH {DEM} {SHAPED}", "scan_ascii": f"WITH {DEM} {SHAPED}", "scan_csv": f"WITH {DEM} {SHAPED}", "scan_npy": f"WITH {DEM} {SHAPED}",
    "scan_array": f"WITH {DEM} SELECT r, c, round(z, 6) + 0.0 AS z FROM dem",
    "save_all": _values([(f"bed.{k}", True) for k in ("tif", "asc", "csv", "npy")], "name, filled"),
    "outline_geojson": INSIDE, "outline_shapefile": INSIDE, "outline_geopackage": INSIDE, "outline_rings": INSIDE,
    "outline_array": f"WITH {DEM} SELECT r, c, (r * 3 + c * 5) % 7 - 3 > 0 AS inside FROM dem",
    "outline_none": f"WITH {DEM} SELECT r, c, (r + c) % 4 > 0 AS inside FROM dem",
    "scan_survey": f"WITH {DEM}, {PICKS} SELECT pid, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, NULL::DOUBLE AS z_surf, round(val, 6) + 0.0 AS val FROM picks",
    "plot_extent": f"WITH {DEM} SELECT 0.0::DOUBLE AS minx, 250.0::DOUBLE AS maxx, 0.0::DOUBLE AS miny, 5.0::DOUBLE * m AS maxy FROM m",
    "plot_arrows": f"""{TIMED}, {_migrated('0.16::DOUBLE', 'a')} SELECT pid, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(x_mig - x, 6) + 0.0 AS dx, round(y_mig - y, 6) + 0.0 AS dy
FROM picks JOIN a_m USING (pid) WHERE pid % greatest((SELECT count(*) FROM picks) // 80, 1) = 0""",
    "pseudo_picks": f"WITH {DEM} SELECT r * {COLUMNS} + c AS pid, (c + 0.5) * 5.0::DOUBLE AS x, (r + 0.5) * 5.0::DOUBLE AS y, 10.0::DOUBLE AS val FROM dem WHERE r % 5 = 0 AND c % 5 = 0",
    "smooth_methods": f"""WITH {DEM}, w AS (SELECT d.r, d.c, CASE WHEN d.r + i < 0 THEN -1 - d.r - i WHEN d.r + i >= m THEN 2 * m - 1 - d.r - i ELSE d.r + i END AS rr, CASE WHEN d.c + j < 0 THEN -1 - d.c - j WHEN d.c + j >= {COLUMNS} THEN 2 * {COLUMNS} - 1 - d.c - j ELSE d.c + j END AS cc
  FROM dem d, m, range(-2, 2) AS a(i), range(-2, 2) AS b(j)),
md AS (SELECT w.r, w.c, list_sort(list(z))[9] AS median FROM w JOIN dem ON dem.r = w.rr AND dem.c = w.cc GROUP BY w.r, w.c),
gp AS (SELECT r, c, (r * 7 + c * 3) % 11 > 0 AS known, CASE WHEN (r * 7 + c * 3) % 11 > 0 THEN z ELSE (SELECT avg(z) FROM dem WHERE (r * 7 + c * 3) % 11 > 0) END AS z FROM dem), {_gauss('gp', 'z', 1.0, 'sm')}
SELECT md.r, md.c, round(median, 6) + 0.0 AS median, CASE WHEN known THEN round(sm.z, 6) + 0.0 END AS gaussian FROM md JOIN gp USING (r, c) JOIN sm USING (r, c)""",
    "spline_blend": f"{SPLINE}, {_blended('got', '30')} SELECT r, c, round(th, 4) + 0.0 AS thickness, round(z - th, 4) + 0.0 AS bed FROM bl",
    "facade_slope": f"{FACADE} SELECT r, c, round(sine, 6) + 0.0 AS sine FROM sine",
    "facade_interpolate": f"{INTERPOLATED} SELECT r, c, inside, round(thickness, 4) + 0.0 AS thickness, round(z - thickness, 4) + 0.0 AS bed, round(var, 4) + 0.0 AS var FROM got",
    "facade_blend": f"{INTERPOLATED}, {_blended('got', '25')} SELECT r, c, round(th, 4) + 0.0 AS thickness, round(z - th, 4) + 0.0 AS bed FROM bl",
    "facade_finalize": f"""{INTERPOLATED}, {_gauss('got', 'thickness', 1.5, 'sg')}, soft AS MATERIALIZED (SELECT got.r, got.c, z, inside, CASE WHEN inside THEN greatest(sg.thickness, 0) ELSE 0 END AS thickness FROM got JOIN sg USING (r, c)), {_blended('soft', '20')}
SELECT r, c, inside, round(z - th, 4) + 0.0 AS bed, round(CASE WHEN inside THEN greatest(th, 0) ELSE 0 END, 4) + 0.0 AS thickness, round(CASE WHEN got.inside THEN sqrt(greatest(var, 0)) ELSE 0 END, 4) + 0.0 AS uncertainty FROM bl JOIN (SELECT r, c, var, inside FROM got) got USING (r, c, inside)""",
    "facade_migrate": f"""{FACADE}, {PRODUCTS}), {CELLS}, {_kriged('kp', 'kc')}, field AS MATERIALIZED (SELECT r, c, z, greatest(z_hat / greatest(sine, {LEAST}), 0) AS t FROM mask JOIN k USING (r, c) JOIN sine USING (r, c)),
{_grad('field', 't', 'tx', 'ty', 'gt')}, {_grad('gt', 'z', 'zx', 'zy', 'gz')}, {_sample('picks', 'field', ['z'], 'zs')}, {_migrated('0.16::DOUBLE', 'a')}, {_sample('a_m', 'field', ['z'], 'zm', 'x_mig', 'y_mig')}
SELECT pid, round(x_mig, 4) + 0.0 AS x_mig, round(y_mig, 4) + 0.0 AS y_mig, round(coalesce(zm.z, zs.z), 4) + 0.0 AS z_surf_mig, round(d_mig, 4) + 0.0 AS d_mig FROM a_m LEFT JOIN zm USING (pid) LEFT JOIN zs USING (pid)""",
    "facade_optimize": f"""WITH {DEM20}, {_grad('dem')}, {ANGLES}, pseudo AS (SELECT r * {COLUMNS} + c AS pid, (c + 0.5) * 5.0::DOUBLE AS x, (r + 0.5) * 5.0::DOUBLE AS y, 10.0::DOUBLE AS val FROM dem WHERE r % 5 = 0 AND c % 5 = 0),
{_swept('ang', 'pseudo', '[4.0, 3.5, 3.0, 2.5, 2.0, 1.5, 1.0, 0.5]')} SELECT kc, round(mean_variance, 5) + 0.0 AS mean_variance, kc = (SELECT arg_min(kc, (mean_variance, -kc)) FROM scores) AS best FROM scores""",
    "facade_from_config": f"WITH {DEM}, {_mask()} SELECT r, c, z, inside, 100::BIGINT AS cutoffs FROM mask",
}
