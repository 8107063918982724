"""The registered raster queries and their DuckDB equivalents.

Values that come from transcendental functions or averages are compared in single precision, which is how rasters keep
them: two engines agree to the last bit of a double only where arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebra import compile_expression
from ..operators import contour, fill, focal, grade, hydro, kernels, render, sampling, stats, visibility, zones
from ..operators.grid import Grid, crop, dense, overview
from ..streaming import windows
from . import rasters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLE[query.__name__] = sql
        return query

    return add


def single(value: Column | str) -> Column:
    """In single precision, zeros without a sign."""
    return (F.col(value) if isinstance(value, str) else value).cast("float") + F.lit(0.0).cast("float")


def sql_single(value: str) -> str:
    return f"(CAST({value} AS FLOAT) + CAST(0 AS FLOAT))"


def algebra(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    cells, _ = rasters.days(spark, sf_dir)
    return cells.select("row", "col", compile_expression(text, {"b1": F.col("b1"), "b2": F.col("b2")}).alias("v"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map algebra over the events raster, summarised by groups of ten rows."""
    cells = algebra(spark, sf_dir, "iif(b1 > 100, b1 / b2, -1)").withColumn("rows", F.floor(F.col("row") / 10).cast("int"))
    return stats.statistics(cells, "v", "rows")


ALGEBRA = f'WITH {rasters.DAYS} SELECT "row", col, {{}} AS v FROM days'


@registered(ALGEBRA.format("CAST((CAST(b1 AS DOUBLE) - b2) / nullif(CAST(b1 AS DOUBLE) + b2, 0) AS FLOAT)"))
def algebra_ndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra(spark, sf_dir, "(b1 - b2) / (b1 + b2)")


@registered(ALGEBRA.format("CAST(CASE WHEN b1 > 100 THEN CAST(b1 AS DOUBLE) / b2 ELSE -1 END AS FLOAT)"))
def algebra_iif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra(spark, sf_dir, "iif(B1 > 100, b1 / b2, -1)")


@registered(ALGEBRA.format(sql_single("CAST(sqrt(abs(CAST(b1 AS DOUBLE) - 50)) + ln(CAST(b2 AS DOUBLE) + 1) + least(CAST(b1 AS DOUBLE), 10 * CAST(b2 AS DOUBLE)) AS FLOAT)")))
def algebra_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra(spark, sf_dir, "sqrt(abs(b1 - 50)) + log(b2 + 1) + min(b1, 10 * b2)").withColumn("v", single("v"))


@registered(ALGEBRA.format("CAST(CAST(CAST(b1 AS DOUBLE) >= 10 * CAST(b2 AS DOUBLE) AS INT) AS FLOAT)"))
def algebra_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra(spark, sf_dir, "b1 >= 10 * b2")


STATS = f"count(v) AS n, {sql_single('min(CAST(v AS DOUBLE))')} AS min, {sql_single('max(CAST(v AS DOUBLE))')} AS max, {sql_single('avg(CAST(v AS DOUBLE))')} AS mean, {sql_single('stddev_pop(CAST(v AS DOUBLE))')} AS std"


@registered(f"WITH {rasters.VECTORS} SELECT {STATS} FROM emb")
def band_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.statistics(rasters.vectors(spark, sf_dir), "v").select("n", *(single(c).alias(c) for c in ("min", "max", "mean", "std")))


@registered(f"WITH {rasters.VECTORS} SELECT label, {STATS} FROM emb GROUP BY label")
def band_stats_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.statistics(rasters.vectors(spark, sf_dir), "v", "label").select("label", "n", *(single(c).alias(c) for c in ("min", "max", "mean", "std")))


@registered(f"""WITH {rasters.VECTORS}, s AS (SELECT min(CAST(v AS DOUBLE)) lo, max(CAST(v AS DOUBLE)) hi, avg(CAST(v AS DOUBLE)) m, stddev_pop(CAST(v AS DOUBLE)) d FROM emb)
SELECT {sql_single('greatest(lo, m - 2 * d)')} AS low, {sql_single('least(hi, m + 2 * d)')} AS high FROM s""")
def sigma_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.sigma_range(stats.statistics(rasters.vectors(spark, sf_dir), "v"), 2.0)
    return found.select(single("low").alias("low"), single("high").alias("high"))


BINNED = f"""WITH {rasters.VECTORS}, s AS (SELECT min(CAST(v AS DOUBLE)) AS low, max(CAST(v AS DOUBLE)) AS high FROM emb),
h AS (SELECT CAST(least(1023, greatest(0, trunc((CAST(v AS DOUBLE) - low) * (1024 / (high - low))))) AS INT) AS bin, count(*) AS n, any_value(low) AS low, any_value(high) AS high FROM emb, s GROUP BY 1)"""


@registered(f"{BINNED} SELECT bin, n FROM h")
def histogram_1024(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(rasters.vectors(spark, sf_dir), "v").select("bin", "n")


@registered(f"""{BINNED}, r AS (SELECT *, sum(n) OVER (ORDER BY bin) AS running, sum(n) OVER () AS total FROM h),
p AS (SELECT unnest([2.0, 98.0]) AS percent)
SELECT CAST(percent AS DOUBLE) AS percent, {sql_single('min(low) + (min(bin) + 0.5) / (1024 / (min(high) - min(low)))')} AS value FROM r, p
WHERE running >= round_even(percent / 100 * total, 0) GROUP BY percent""")
def percentile_2_98(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.percentiles(stats.histogram(rasters.vectors(spark, sf_dir), "v"), [2.0, 98.0])
    return found.select("percent", single("value").alias("value"))


@registered(f'WITH {rasters.DAYS} SELECT (SELECT (max("row") + 1) * (max(col) + 1) FROM days) - count(b1) AS n_missing, (SELECT CAST((max("row") + 1) * (max(col) + 1) AS BIGINT) FROM days) AS n_cells FROM days')
def nodata_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.days(spark, sf_dir)
    found = stats.no_data(dense(cells, grid, "b1"), "b1")
    return found.select(F.col("n_missing").cast("long").alias("n_missing"), F.col("n_cells").cast("long").alias("n_cells"))


PAIRED = """pair AS (SELECT CAST(l_suppkey % 25 AS INT) AS "row", CAST(l_partkey % 40 AS INT) AS col,
  CAST(sum(l_quantity) FILTER (l_returnflag = 'A') AS FLOAT) AS a, CAST(sum(l_quantity) FILTER (l_returnflag = 'R') AS FLOAT) AS r FROM lineitem GROUP BY 1, 2)"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).cast("float")
    lines = rasters.table(spark, sf_dir, "lineitem")
    return lines.groupBy((F.col("l_suppkey") % 25).cast("int").alias("row"), (F.col("l_partkey") % 40).cast("int").alias("col")).agg(flag("A").alias("a"), flag("R").alias("r"))


@registered(f"""WITH {PAIRED}, d AS (SELECT CAST(r AS DOUBLE) - CAST(a AS DOUBLE) AS d FROM pair)
SELECT count(d) AS n, count(*) FILTER (d IS NULL) AS n_missing, min(d) AS min, max(d) AS max, {sql_single('avg(d)')} AS mean, {sql_single('stddev_pop(d)')} AS std,
count(*) FILTER (abs(d) > 20) AS n_beyond, coalesce(sum(-d * 6) FILTER (d < 0), 0) AS cut, coalesce(sum(d * 6) FILTER (d >= 0), 0) AS fill,
coalesce(sum(d * 6) FILTER (d >= 0), 0) - coalesce(sum(-d * 6) FILTER (d < 0), 0) AS net, CAST(count(*) FILTER (abs(d) > 20) * 6 AS DOUBLE) AS area_beyond FROM d""")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.change(paired(spark, sf_dir), "a", "r", 6.0, 20.0).withColumn("mean", single("mean")).withColumn("std", single("std"))


@registered(f'WITH {PAIRED} SELECT "row", col, CAST(CAST(r AS DOUBLE) - CAST(a AS DOUBLE) AS FLOAT) AS v FROM pair')
def change_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.change_raster(paired(spark, sf_dir), "a", "r")


@registered(f"""WITH {rasters.DAYS} SELECT CAST(y.i AS INT) AS "row", CAST(x.i AS INT) AS col, b1 FROM range(8) y(i), range(10) x(i)
LEFT JOIN days ON days."row" = y.i + 5 AND days.col = x.i + 25""")
def crop_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.days(spark, sf_dir)
    return crop(cells, grid, 25, 5, 10, 8, "b1")[0]


@registered(f"""WITH {rasters.VECTORS}, s AS (SELECT greatest(1, ceil(64 / 16), ceil((max("row") + 1) / 100.0)) AS k FROM emb)
SELECT CAST("row" // k AS INT) AS "row", CAST(col // k AS INT) AS col, v FROM emb, s WHERE "row" % k = 0 AND col % k = 0""")
def overview_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = rasters.vectors(spark, sf_dir)
    return overview(cells, rasters.sized(cells), 16, 100).select("row", "col", "v")


def halves(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, Grid]]:
    """The events raster twice, north up, the second ten columns to the east."""
    cells, grid = rasters.days(spark, sf_dir)
    first = Grid(grid.width, grid.height, 0.0, 1.0, 0.0, float(grid.height), 0.0, -1.0)
    second = Grid(grid.width, grid.height, 10.0, 1.0, 0.0, float(grid.height), 0.0, -1.0)
    return [(cells.select("row", "col", F.col("b1").alias("v")), first), (cells.select("row", "col", F.col("b2").alias("v")), second)]


MOSAIC = f"""WITH {rasters.DAYS}, s AS (SELECT max("row") + 1 AS h, max(col) + 1 AS w FROM days),
g AS (SELECT CAST(y.i AS INT) AS "row", CAST(x.i AS INT) AS col FROM s, range(100000) y(i), range(40) x(i) WHERE y.i < h AND x.i < w + 10)
SELECT g."row", g.col, CAST({{}} AS FLOAT) AS v FROM g LEFT JOIN days p ON p."row" = g."row" AND p.col = g.col LEFT JOIN days q ON q."row" = g."row" AND q.col = g.col - 10"""


@registered(MOSAIC.format("coalesce(p.b1, q.b2)"))
def mosaic_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.mosaic(halves(spark, sf_dir), "first")[0]


@registered(MOSAIC.format("coalesce(q.b2, p.b1)"))
def mosaic_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.mosaic(halves(spark, sf_dir), "last")[0]


@registered(MOSAIC.format("coalesce((CAST(p.b1 AS DOUBLE) + CAST(q.b2 AS DOUBLE)) / 2, p.b1, q.b2)"))
def mosaic_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.mosaic(halves(spark, sf_dir), "average")[0]


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.relief(spark, sf_dir)
    return focal.neighbours(cells, grid.width, grid.height)


#: The nine cells of each window in SQL: the edge test is of the place.
NEAR = f"""WITH {rasters.RELIEF},
h3 AS (SELECT "row", col, v, w, h, CASE WHEN col = 0 THEN v ELSE lag(v) OVER (PARTITION BY "row" ORDER BY col) END AS a,
  CASE WHEN col = w - 1 THEN v ELSE lead(v) OVER (PARTITION BY "row" ORDER BY col) END AS e FROM cells, size),
n AS (SELECT "row", col, {', '.join(f'''CASE WHEN "row" = 0 THEN {c} ELSE lag({c}) OVER (PARTITION BY col ORDER BY "row") END AS z{i}''' for i, c in enumerate(('a', 'v', 'e')))},
  a AS z3, v AS z4, e AS z5, {', '.join(f'''CASE WHEN "row" = h - 1 THEN {c} ELSE lead({c}) OVER (PARTITION BY col ORDER BY "row") END AS z{i + 6}''' for i, c in enumerate(('a', 'v', 'e')))} FROM h3),
g AS (SELECT *, z0 + z1 + z2 + z3 + z4 + z5 + z6 + z7 + z8 IS NOT NULL AS full_, ((z2 + 2*z5 + z8) - (z0 + 2*z3 + z6)) / 8 AS gx, ((z6 + 2*z7 + z8) - (z0 + 2*z1 + z2)) / 8 AS gy,
  (z3 + z5) / 2 - z4 AS d, (z1 + z7) / 2 - z4 AS e, (-z0 + z2 + z6 - z8) / 4 AS f, (z5 - z3) / 2 AS p, (z1 - z7) / 2 AS q FROM n)
SELECT "row", col, {{}} AS v FROM g"""


def near_sql(value: str) -> str:
    return NEAR.format(sql_single(f"CASE WHEN full_ THEN {value} END"))


def rounded(cells: DataFrame) -> DataFrame:
    return cells.withColumn("v", single("v"))


@registered(near_sql("atan(sqrt(gx*gx + gy*gy)) * (180 / pi())"))
def slope_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.slope(near(spark, sf_dir)))


@registered(near_sql("sqrt(gx*gx + gy*gy) * 100"))
def slope_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.slope(near(spark, sf_dir), percent=True))


TURN = "90.0 - atan2(gy, -gx) * (180 / pi())"


@registered(near_sql(f"CASE WHEN gx = 0 AND gy = 0 THEN -1 WHEN {TURN} < 0 THEN {TURN} + 360 WHEN {TURN} >= 360 THEN {TURN} - 360 ELSE {TURN} END"))
def aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.aspect(near(spark, sf_dir)))


def shade_sql(azimuth: float) -> str:
    facing = "CASE WHEN gx = 0 AND gy = 0 THEN 0 ELSE atan2(-gx, gy) END"
    return f"greatest(cos(radians(45)) * cos(atan(sqrt(gx*gx + gy*gy))) + sin(radians(45)) * sin(atan(sqrt(gx*gx + gy*gy))) * cos(radians({azimuth}) - ({facing})), 0) * 255"


@registered(near_sql(shade_sql(315)))
def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.hillshade(near(spark, sf_dir)))


@registered(near_sql("(" + " + ".join(f"CAST(CAST({shade_sql(a)} AS FLOAT) AS DOUBLE)" for a in (225, 270, 315, 360)) + ") / 4"))
def multi_hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.multi_hillshade(near(spark, sf_dir)))


@registered(near_sql("-2 * (d + e)"))
def curvature_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.curvature(near(spark, sf_dir), "general"))


@registered(near_sql("CASE WHEN p*p + q*q < 1e-12 THEN -(d + e) ELSE -2 * (d*p*p + e*q*q + f*p*q) / (p*p + q*q) END"))
def curvature_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.curvature(near(spark, sf_dir), "profile"))


@registered(near_sql("CASE WHEN p*p + q*q < 1e-12 THEN -(d + e) ELSE -2 * (d*q*q + e*p*p - f*p*q) / (p*p + q*q) END"))
def curvature_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.curvature(near(spark, sf_dir), "plan"))


def kernel_sql(kernel: focal.Kernel, divisor: float) -> str:
    weights = [w for row in kernel for w in row]
    total = " + ".join(f"coalesce(z{k}, z4) * {float(w)}" for k, w in enumerate(weights) if w)
    return f"CAST(CASE WHEN z4 IS NOT NULL THEN ({total}) / {float(divisor)} END AS FLOAT)"


@registered(NEAR.format(sql_single(kernel_sql(focal.MEAN3, 9))))
def convolve_mean3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.convolve3(near(spark, sf_dir), focal.MEAN3, 9.0))


@registered(NEAR.format(sql_single(kernel_sql(focal.sharpen_kernel(1.0), 1))))
def convolve_sharpen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.convolve3(near(spark, sf_dir), focal.sharpen_kernel(1.0)))


@registered(NEAR.format(sql_single(kernel_sql(focal.LAPLACE8, 1))))
def convolve_laplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.convolve3(near(spark, sf_dir), focal.LAPLACE8))


EMBOSS, EMBOSS_DIVISOR = focal.emboss_kernel(315.0)


@registered(NEAR.format(sql_single(kernel_sql(EMBOSS, EMBOSS_DIVISOR))))
def convolve_emboss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.convolve3(near(spark, sf_dir), EMBOSS, EMBOSS_DIVISOR))


@registered(NEAR.format(sql_single(f"CAST(sqrt(CAST({kernel_sql(focal.SOBEL_X, 8)} AS DOUBLE) ** 2 + CAST({kernel_sql(focal.SOBEL_Y, 8)} AS DOUBLE) ** 2) AS FLOAT)")))
def sobel_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(focal.sobel(near(spark, sf_dir)))


def around_sql(weights: list[float]) -> str:
    r = len(weights) // 2
    w = f"[{', '.join(map(repr, weights))}]"
    mean = f"sum(b.v * {w}[b.col - a.col + {r + 1}] * {w}[b.\"row\" - a.\"row\" + {r + 1}]) / sum({w}[b.col - a.col + {r + 1}] * {w}[b.\"row\" - a.\"row\" + {r + 1}]) FILTER (b.v IS NOT NULL)"
    return f"""WITH {rasters.RELIEF} SELECT a."row", a.col, {sql_single(f'CASE WHEN any_value(a.v) IS NOT NULL THEN {mean} END')} AS v
FROM (SELECT "row", col, v, dy, dx FROM cells, range({-r}, {r + 1}) p(dy), range({-r}, {r + 1}) q(dx)) a JOIN cells b ON b."row" = a."row" + dy AND b.col = a.col + dx GROUP BY a."row", a.col"""


@registered(around_sql([1.0] * 5))
def box_mean_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.relief(spark, sf_dir)
    return rounded(focal.box_mean(cells, 2, grid))


@registered(around_sql([2.718281828459045 ** (-0.5 * i * i) for i in range(-3, 4)]))
def gaussian_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.relief(spark, sf_dir)
    return rounded(focal.gaussian(cells, 1.0, grid))


#: Direction of each cell: the steepest of eight strictly lower neighbours, earlier codes first.
FALLS = ", ".join(
    f"{{'steep': (v - {z}) / sqrt({dx * dx + dy * dy}), 'place': {-k}, 'code': {1 << k}, 'dx': {dx}, 'dy': {dy}}}"
    for k, (z, dx, dy) in enumerate((("z5", 1, 0), ("z8", 1, 1), ("z7", 0, 1), ("z6", -1, 1), ("z3", -1, 0), ("z0", -1, -1), ("z1", 0, -1), ("z2", 1, -1)))
)
DIRECTION = f"""{rasters.RELIEF},
side AS (SELECT "row", col, v, lag(v) OVER (PARTITION BY "row" ORDER BY col) AS a, lead(v) OVER (PARTITION BY "row" ORDER BY col) AS e FROM cells),
nine AS (SELECT "row", col, v, a AS z3, e AS z5, lag(a) OVER c AS z0, lag(v) OVER c AS z1, lag(e) OVER c AS z2, lead(a) OVER c AS z6, lead(v) OVER c AS z7, lead(e) OVER c AS z8 FROM side WINDOW c AS (PARTITION BY col ORDER BY "row")),
best AS (SELECT "row", col, v, list_sort(list_filter([{FALLS}], lambda x: x.steep > 0), 'DESC')[1] AS b FROM nine),
dir AS MATERIALIZED (SELECT "row", col, CASE WHEN v IS NOT NULL THEN CAST(coalesce(b.code, 0) AS INT) END AS v, b.dx AS dx, b.dy AS dy FROM best)"""


@registered(f'WITH {DIRECTION} SELECT "row", col, v FROM dir')
def d8_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.relief(spark, sf_dir)
    return hydro.flow_direction(cells, grid.width, grid.height)


ACCUMULATION = f"""WITH RECURSIVE {DIRECTION},
walk AS (SELECT "row", col, "row" AS r, col AS c FROM dir WHERE v IS NOT NULL
  UNION ALL SELECT w."row", w.col, d."row" + d.dy, d.col + d.dx FROM walk w JOIN dir d ON d."row" = w.r AND d.col = w.c WHERE d.v > 0),
acc AS (SELECT r AS "row", c AS col, count(*) - 1 AS n FROM walk GROUP BY 1, 2)
SELECT dir."row", dir.col, CAST(n AS FLOAT) AS v FROM dir LEFT JOIN acc ON acc."row" = dir."row" AND acc.col = dir.col"""


@registered(ACCUMULATION)
def d8_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.relief(spark, sf_dir)
    return hydro.flow_accumulation(hydro.flow_direction(cells, grid.width, grid.height))


@registered(f'SELECT "row", col, v FROM ({ACCUMULATION}) WHERE v >= 4')
def stream_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydro.stream_cells(d8_accumulation(spark, sf_dir), 4)


#: A concave and a self-crossing ring over the quantity raster, in pixels.
ZONES: list[tuple[str, list[tuple[float, float]]]] = [
    ("notch", [(2.2, 0.7), (30.4, 1.3), (31.0, 8.8), (16.1, 3.9), (4.6, 9.1)]),
    ("bow", [(20.3, 0.4), (38.7, 9.2), (20.3, 9.2), (38.7, 0.4)]),
]
RINGS = ", ".join(f"('{z}', {i}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for z, ring in ZONES for i, (a, b) in enumerate(zip(ring, [ring[-1], *ring[:-1]], strict=True)))
INSIDE = f"""{rasters.QUANTITY}, ring AS (SELECT * FROM (VALUES {RINGS}) t(zone, i, ax, ay, cx, cy)),
held AS (SELECT zone, c."row", c.col, any_value(c.v) AS v FROM cells c, ring
  WHERE (ay > c."row" + 0.5) <> (cy > c."row" + 0.5) AND c.col + 0.5 < CAST(ax AS DOUBLE) + (c."row" + 0.5 - ay) / (CAST(cy AS DOUBLE) - ay) * (CAST(cx AS DOUBLE) - ax)
  GROUP BY zone, c."row", c.col HAVING count(*) % 2 = 1)"""


@registered(f"""WITH {INSIDE} SELECT zone, count(v) AS n, count(*) - count(v) AS n_missing, min(v) AS min, max(v) AS max, {sql_single('avg(v)')} AS mean, {sql_single('stddev_pop(v)')} AS std,
coalesce(sum(v), 0) AS sum, CAST(count(*) AS DOUBLE) AS area FROM held GROUP BY zone""")
def zonal_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.quantity(spark, sf_dir)
    found = zones.zonal(cells, zones.polygons(cells, ZONES), grid)
    return found.withColumn("mean", single("mean")).withColumn("std", single("std"))


@registered(f'WITH {INSIDE} SELECT "row", col, CAST(v AS FLOAT) AS v FROM cells WHERE ("row", col) IN (SELECT ("row", col) FROM held)')
def mask_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.quantity(spark, sf_dir)
    return zones.inside(cells, zones.row_spans(zones.polygons(cells, ZONES), grid), "left_semi")


@registered(f'WITH {INSIDE} SELECT "row", col, CAST(v AS FLOAT) AS v FROM cells WHERE ("row", col) NOT IN (SELECT ("row", col) FROM held)')
def mask_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.quantity(spark, sf_dir)
    return zones.inside(cells, zones.row_spans(zones.polygons(cells, ZONES), grid), "left_anti")


@registered(f"""WITH ring AS (SELECT * FROM (VALUES {RINGS}) t(zone, i, ax, ay, cx, cy))
SELECT zone, {sql_single('sum(sqrt(CAST((ax - cx) AS DOUBLE) ** 2 + CAST((ay - cy) AS DOUBLE) ** 2))')} AS perimeter, {sql_single('abs(sum(CAST(cx AS DOUBLE) * ay - CAST(ax AS DOUBLE) * cy)) / 2')} AS area FROM ring GROUP BY zone""")
def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = zones.polygons(spark.range(0), ZONES)
    return rings.select("zone", single(zones.perimeter(F.col("points"))).alias("perimeter"), single(zones.area(F.col("points"))).alias("area"))


TAPPED = """SELECT id, CASE WHEN sum(w) FILTER (v IS NOT NULL) > 0 THEN sum(w * v) / sum(w) FILTER (v IS NOT NULL) END AS value FROM (
  SELECT id, c.v, (CASE WHEN dx = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN dy = 1 THEN fy ELSE 1 - fy END) AS w FROM (SELECT id, floor(x - 0.5) AS c0, floor(y - 0.5) AS r0, x - 0.5 - floor(x - 0.5) AS fx, y - 0.5 - floor(y - 0.5) AS fy FROM pts), range(2) a(dx), range(2) b(dy)
  LEFT JOIN cells c ON c."row" = r0 + dy AND c.col = c0 + dx) WHERE w > 0 GROUP BY id"""


@registered(f"""WITH {rasters.QUANTITY}, pts AS (SELECT i AS id, i / 60.0 * sqrt(36.5::DOUBLE ** 2 + 8::DOUBLE ** 2) AS distance, CAST(1.25 + i / 60.0 * 36.5 AS DOUBLE) AS x, CAST(0.75 + i / 60.0 * 8 AS DOUBLE) AS y FROM range(61) t(i))
SELECT pts.id, {sql_single('distance')} AS distance, {sql_single('value')} AS value FROM pts LEFT JOIN ({TAPPED}) USING (id)""")
def bilinear_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.quantity(spark, sf_dir)
    line = sampling.line_points(cells, (1.25, 0.75), (37.75, 8.75), 61)
    found = sampling.bilinear(line.select("id", "x", "y"), cells, grid)
    return line.join(found, "id").select("id", single("distance").alias("distance"), single("value").alias("value"))


@registered(f"""WITH {rasters.QUANTITY}, pts AS (SELECT i AS id, i / 60.0 * sqrt(36.5::DOUBLE ** 2 + 8::DOUBLE ** 2) AS distance, CAST(1.25 + i / 60.0 * 36.5 AS DOUBLE) AS x, CAST(0.75 + i / 60.0 * 8 AS DOUBLE) AS y FROM range(61) t(i)),
got AS (SELECT pts.id, distance, value FROM pts LEFT JOIN ({TAPPED}) USING (id)),
stepped AS (SELECT distance - lag(distance) OVER (ORDER BY id) AS d, value - lag(value) OVER (ORDER BY id) AS dz FROM got)
SELECT {sql_single('sum(coalesce(sqrt(d * d + dz * dz), d))')} AS length FROM stepped""")
def surface_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.quantity(spark, sf_dir)
    line = sampling.line_points(cells, (1.25, 0.75), (37.75, 8.75), 61)
    profile = line.join(sampling.bilinear(line.select("id", "x", "y"), cells, grid), "id")
    return sampling.surface_length(profile).select(single("length").alias("length"))


@registered(f"""WITH {rasters.QUANTITY}, out AS (SELECT y.i * 13 + x.i AS id, CAST(y.i AS INT) AS "row", CAST(x.i AS INT) AS col FROM range(4) y(i), range(13) x(i)),
pts AS (SELECT id, CAST((col + 0.5) * 3 AS DOUBLE) AS x, CAST(("row" + 0.5) * 2.5 AS DOUBLE) AS y FROM out)
SELECT "row", col, {sql_single('CAST(value AS FLOAT)')} AS v FROM out LEFT JOIN ({TAPPED}) USING (id)""")
def resample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.quantity(spark, sf_dir)
    return rounded(sampling.resample(cells, grid, Grid(13, 4, 0.0, 3.0, 0.0, 0.0, 0.0, 2.5)))


def spline_sql(t: str) -> str:
    return f"[(1 - 3*{t} + 3*{t}*{t} - {t}*{t}*{t}) / 6, (4 - 6*{t}*{t} + 3*{t}*{t}*{t}) / 6, (1 + 3*{t} + 3*{t}*{t} - 3*{t}*{t}*{t}) / 6, {t}*{t}*{t} / 6]"


@registered(f"""WITH {rasters.QUANTITY}, pts AS (SELECT i AS id, CAST(2.3 + i * 0.7 AS DOUBLE) AS x, CAST(2.1 + i * 0.11 AS DOUBLE) AS y FROM range(50) t(i)),
b AS (SELECT id, floor(x - 0.5) AS c0, floor(y - 0.5) AS r0, x - 0.5 - floor(x - 0.5) AS fx, y - 0.5 - floor(y - 0.5) AS fy FROM pts),
s AS (SELECT id, sum(c.v * ({spline_sql('fx')})[dx + 1] * ({spline_sql('fy')})[dy + 1]) AS value, count(c.v) AS n FROM b, range(4) p(dx), range(4) q(dy) LEFT JOIN cells c ON c."row" = r0 - 1 + dy AND c.col = c0 - 1 + dx GROUP BY id)
SELECT id, {sql_single('CASE WHEN n = 16 THEN value END')} AS value FROM s""")
def bspline_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.quantity(spark, sf_dir)
    points = spark.range(50).select("id", (2.3 + F.col("id") * 0.7).alias("x"), (2.1 + F.col("id") * 0.11).alias("y"))
    return sampling.bspline(points, cells, grid).select("id", single("value").alias("value"))


@registered(f"""WITH {rasters.QUANTITY}, q AS (SELECT a."row", a.col, a.v AS tl, b.v AS tr, d.v AS br, c.v AS bl FROM cells a JOIN cells b ON b."row" = a."row" AND b.col = a.col + 1
  JOIN cells c ON c."row" = a."row" + 1 AND c.col = a.col JOIN cells d ON d."row" = a."row" + 1 AND d.col = a.col + 1 WHERE a.v + b.v + c.v + d.v IS NOT NULL),
l AS (SELECT *, unnest(range(CAST(ceil(least(tl, tr, br, bl) / 50 - 1e-9) AS BIGINT), CAST(floor(greatest(tl, tr, br, bl) / 50 + 1e-9) AS BIGINT) + 1)) * 50.0::DOUBLE AS level FROM q),
m AS (SELECT *, 8 * (tl >= level)::INT + 4 * (tr >= level)::INT + 2 * (br >= level)::INT + (bl >= level)::INT AS mask FROM l)
SELECT level, count(DISTINCT ("row", col)) AS squares, sum(CASE WHEN mask IN (5, 10) THEN 2 ELSE 1 END)::BIGINT AS segments FROM m WHERE mask BETWEEN 1 AND 14 GROUP BY level""")
def contour_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contour.segments(rasters.quantity(spark, sf_dir)[0], 50.0)
    return found.groupBy("level").agg(F.countDistinct("row", "col").alias("squares"), F.count("*").alias("segments"))


PALETTE = render.ramp([(0, 0, 80), (40, 160, 60), (250, 240, 200)])


@registered(f"""WITH {rasters.QUANTITY}, p AS (SELECT [{', '.join(str((255 << 24 | r << 16 | g << 8 | b) - (1 << 32)) for r, g, b in PALETTE)}] AS colours)
SELECT "row", col, CASE WHEN v IS NOT NULL THEN CAST(colours[CAST(floor(least(greatest((v - 10) / 1500, 0), 1) * 255 + 0.5) AS INT) + 1] AS INT) END AS argb FROM cells, p""")
def colorize_argb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.argb(rasters.quantity(spark, sf_dir)[0], "v", PALETTE, 10.0, 1510.0)


@registered(f"""WITH {rasters.DAYS} SELECT "row", col, CAST(round_even(least(greatest(CAST(b1 AS DOUBLE) / 200, 0), 1) * 255, 0) AS INT) AS r, CAST(round_even(least(greatest((CAST(b2 AS DOUBLE) - 1) / 8, 0), 1) * 255, 0) AS INT) AS g,
CAST(round_even(least(greatest(CAST(b1 AS DOUBLE) / 50, 0), 1) * 255, 0) AS INT) AS b, 255 AS alpha FROM days""")
def rgb_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.composite(rasters.days(spark, sf_dir)[0], "b1", "b2", "b1", [(0.0, 200.0), (1.0, 9.0), (0.0, 50.0)])


@registered("""WITH g AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey * 1.7 AS DOUBLE) AS x, CAST(n_regionkey * 2.9 AS DOUBLE) AS y FROM nation)
SELECT id, CAST(100 + x * 0.8 + y * 0.6 AS FLOAT) AS world_x, CAST(200 + x * 0.6 - y * 0.8 AS FLOAT) AS world_y, CAST(round(x, 6) AS FLOAT) AS px, CAST(round(y, 6) AS FLOAT) AS py FROM g""")
def pixel_world_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = Grid(50, 50, 100.0, 0.8, 0.6, 200.0, 0.6, -0.8)
    places = rasters.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") * 1.7).alias("x"), (F.col("n_regionkey") * 2.9).alias("y"))
    wx, wy = grid.world(F.col("x"), F.col("y"))
    placed = places.select("id", wx.alias("wx"), wy.alias("wy"))
    px, py = grid.pixel(F.col("wx"), F.col("wy"))
    return placed.select("id", single("wx").alias("world_x"), single("wy").alias("world_y"), single(F.round(px, 6)).alias("px"), single(F.round(py, 6)).alias("py"))


@registered(f"""WITH f AS (SELECT CAST(n_nationkey AS BIGINT) AS seq, n_name AS attribute, CAST(n_nationkey % 7 AS DOUBLE) AS x, CAST(n_nationkey // 7 AS DOUBLE) AS y FROM nation),
p AS (SELECT CAST(i AS BIGINT) AS id, CAST(i * 0.55 AS DOUBLE) AS x, CAST(i * 0.3 AS DOUBLE) AS y FROM range(12) t(i))
SELECT id, seq, attribute, {sql_single('d2')} AS d2 FROM (SELECT p.id, seq, attribute, (f.x - p.x) ** 2 + (f.y - p.y) ** 2 AS d2, row_number() OVER (PARTITION BY p.id ORDER BY (f.x - p.x) * (f.x - p.x) + (f.y - p.y) * (f.y - p.y), seq) AS rn FROM f, p) WHERE rn = 1""")
def identify_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    point = F.struct((key % 7).cast("double").alias("x"), F.floor(key / 7).cast("double").alias("y"))
    features = rasters.table(spark, sf_dir, "nation").select(key.alias("seq"), F.col("n_name").alias("attribute"), F.array(point).alias("points"))
    asked = spark.range(12).select("id", (F.col("id") * 0.55).alias("x"), (F.col("id") * 0.3).alias("y"))
    return zones.nearest(asked, features).withColumn("d2", single("d2"))


@registered()
def contour_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = contour.lines(contour.segments(rasters.quantity(spark, sf_dir)[0], 50.0), 50.0, smoothing=1)
    return drawn.select("level", "line", F.size("points").alias("n_points"), "is_index", "is_closed", single("length").alias("length"))


@registered()
def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.quantity(spark, sf_dir)
    direction = hydro.flow_direction(cells, grid.width, grid.height)
    found = hydro.stream_segments(direction, hydro.flow_accumulation(direction), 4)
    return found.select("segment", "strahler", "accumulation", F.size("points").alias("n_points"))


def gappy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    cells, grid = rasters.days(spark, sf_dir)
    return dense(cells.select("row", "col", F.col("b1").alias("v")), grid, "v"), grid


@registered()
def fill_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.fill_nearest(*gappy(spark, sf_dir))


@registered()
def fill_idw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.fill_idw(*gappy(spark, sf_dir), smoothing=1)


@registered()
def hull_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.hull_rows(gappy(spark, sf_dir)[0])


@registered()
def laplace_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.laplace(*rasters.quantity(spark, sf_dir))


@registered()
def bezier_x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.bezier_subdivide(*rasters.quantity(spark, sf_dir), 2)[0]


def sight_sql(row: int, col: int) -> str:
    """Terrain along each line of sight: tolerant bilinear values at every step between observer and target."""
    return f"""WITH {rasters.QUANTITY}, eye AS (SELECT v + 1.8 AS z FROM cells WHERE "row" = {row} AND col = {col}),
aim AS (SELECT "row" AS tr, col AS tc, v AS tz, greatest(abs("row" - {row}), abs(col - {col})) AS steps FROM cells WHERE v IS NOT NULL),
way AS (SELECT tr, tc, tz, CAST(i AS DOUBLE) / steps AS t FROM aim, range(1, 100) r(i) WHERE i < steps),
spot AS (SELECT *, {col} + (tc - {col}) * t AS x, {row} + (tr - {row}) * t AS y FROM way),
ground AS (SELECT tr, tc, tz, t, sum(w * v) FILTER (v IS NOT NULL) / nullif(sum(w) FILTER (v IS NOT NULL), 0) AS g FROM (
  SELECT s.*, c.v, (CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w
  FROM spot s, range(2) a(dx), range(2) b(dy) LEFT JOIN cells c ON c."row" = floor(y) + dy AND c.col = floor(x) + dx) WHERE w > 0 GROUP BY tr, tc, tz, t),
hid AS (SELECT DISTINCT tr, tc FROM ground, eye WHERE g > z + t * (tz - z) + 1e-6)
SELECT c."row", c.col, CAST(CASE WHEN c.v IS NULL THEN NULL WHEN hid.tr IS NULL THEN 1 ELSE 0 END AS FLOAT) AS v FROM cells c LEFT JOIN hid ON hid.tr = c."row" AND hid.tc = c.col"""


@registered(sight_sql(4, 12))
def viewshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.quantity(spark, sf_dir)
    return visibility.viewshed(cells, grid, 12, 4)


@registered(sight_sql(0, 0))
def viewshed_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a corner, by tiles of eight cells: every other one has lines that cross several."""
    cells, grid = rasters.quantity(spark, sf_dir)
    return visibility.viewshed(cells, grid, 0, 0, side=8)


VIRIDIS = render.BUILT_IN["Viridis"]

#: Entries of a palette from its stops, and the colour at a share t of the range, in SQL.
ENTRIES = """stop AS (SELECT * FROM (VALUES (0.0::DOUBLE, 68, 1, 84), (0.25, 59, 82, 139), (0.5, 33, 144, 140), (0.75, 93, 200, 99), (1.0, 253, 231, 37)) s(p, r, g, b)),
entry AS (SELECT i, CAST(floor((1 - u) * r0 + u * r1 + 0.5) AS INT) AS r, CAST(floor((1 - u) * g0 + u * g1 + 0.5) AS INT) AS g, CAST(floor((1 - u) * b0 + u * b1 + 0.5) AS INT) AS b FROM (
  SELECT i, (i / 255.0::DOUBLE - a.p) / 0.25 AS u, a.r AS r0, a.g AS g0, a.b AS b0, z.r AS r1, z.g AS g1, z.b AS b1 FROM range(256) t(i) JOIN stop a ON i / 255.0::DOUBLE > a.p AND i / 255.0::DOUBLE <= a.p + 0.25 OR i = 0 AND a.p = 0 JOIN stop z ON z.p = a.p + 0.25))"""
#: The colour of shares in ``asked(t)``; alpha 200.
SHADED = """shaded AS (SELECT q.t, (CAST(200 AS BIGINT) << 24) + (CAST(floor((1 - f) * a.r + f * z.r + 0.5) AS BIGINT) << 16) + (CAST(floor((1 - f) * a.g + f * z.g + 0.5) AS BIGINT) << 8) + CAST(floor((1 - f) * a.b + f * z.b + 0.5) AS BIGINT) - (CAST(1 AS BIGINT) << 32) AS argb
  FROM (SELECT t, t * 255 - floor(t * 255) AS f, CAST(floor(t * 255) AS INT) AS k FROM asked) q JOIN entry a ON a.i = k JOIN entry z ON z.i = least(255, k + 1))"""


@registered(f"""WITH {rasters.RELIEF}, {ENTRIES}, lit AS (SELECT "row", col, CASE WHEN v IS NOT NULL THEN 1 - sqrt(least(greatest((v - 100) / 700, 0), 1)) END AS t FROM cells), asked AS (SELECT DISTINCT t FROM lit WHERE t IS NOT NULL), {SHADED}
SELECT "row", col, CAST(coalesce(argb, 0) AS INT) AS argb FROM lit LEFT JOIN shaded USING (t)""")
def colour_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = render.Colouring(VIRIDIS, 100.0, 800.0, gamma=0.5, invert=True, opacity=200)
    return render.coloured(rasters.relief(spark, sf_dir)[0], "v", how)


@registered(f"""WITH {rasters.RELIEF}, {ENTRIES}, asked AS (SELECT DISTINCT least(4, floor(i / 4095.0::DOUBLE * 5)) / 4.0::DOUBLE AS t FROM range(4096) r(i)), {SHADED},
lit AS (SELECT "row", col, CASE WHEN v IS NOT NULL THEN least(4, floor(least(4095, greatest(0, floor((v - 100) * (4095 / 700.0::DOUBLE) + 0.5))) / 4095.0::DOUBLE * 5)) / 4.0::DOUBLE END AS t FROM cells)
SELECT "row", col, CAST(coalesce(argb, 0) AS INT) AS argb FROM lit LEFT JOIN shaded USING (t)""")
def render_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five classes through the table of 4,096 values."""
    how = render.Colouring(VIRIDIS, 100.0, 800.0, mode="discrete", classes=5, opacity=200)
    return render.rendered(rasters.relief(spark, sf_dir)[0], "v", how)


SUNS = "(" + " + ".join(f"CAST(CAST({shade_sql(a)} AS FLOAT) AS DOUBLE)" for a in (225, 270, 315, 360)) + ") / 4"


@registered(NEAR[: NEAR.index('SELECT "row", col, {} AS v FROM g')] .rstrip() + f""",
s AS (SELECT min(v) AS lo, max(v) AS hi FROM cells),
lit AS (SELECT "row", col, CASE WHEN full_ THEN CAST(CAST({SUNS} AS FLOAT) AS DOUBLE) END AS y, least(greatest((z4 - lo) / (hi - lo), 0), 1) * 0.35 AS f FROM g, s)
SELECT "row", col, {', '.join(f'CAST(CASE WHEN y IS NULL THEN 0 ELSE floor(least(greatest(y + ({h} - y) * f, 0), 255)) END AS INT) AS {c}' for c, h in zip('rgb', (225, 235, 240)))}, CASE WHEN y IS NULL THEN 0 ELSE 255 END AS alpha FROM lit""")
def swiss_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.swiss_relief(*rasters.relief(spark, sf_dir))


@registered(f"""WITH {rasters.RELIEF}, lit AS (SELECT "row", col, CASE WHEN v IS NOT NULL THEN CAST(floor(least(greatest(v / 1000.0::DOUBLE, 0), 1) * 255 + 0.5) AS INT) END AS k FROM cells)
SELECT "row", col, CAST(k AS FLOAT) AS r, CAST(k AS FLOAT) AS g, CAST(k AS FLOAT) AS b FROM lit""")
def image_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = render.Colouring(render.BUILT_IN["Grayscale"], 0.0, 1000.0, mode="nearest")
    return render.bands(render.coloured(rasters.relief(spark, sf_dir)[0], "v", how))


PERCENTILED = """bins AS (SELECT CAST(least(1023, greatest(0, trunc((CAST({0} AS DOUBLE) - lo) * (1024 / (hi - lo))))) AS INT) AS bin, count(*) AS n FROM {1}, (SELECT min(CAST({0} AS DOUBLE)) AS lo, max(CAST({0} AS DOUBLE)) AS hi FROM {1}) WHERE {0} IS NOT NULL GROUP BY 1),
ends AS (SELECT min(bin) FILTER (run >= round_even(0.02 * total, 0)) AS b2, min(bin) FILTER (run >= round_even(0.98 * total, 0)) AS b98 FROM (SELECT bin, sum(n) OVER (ORDER BY bin) AS run, sum(n) OVER () AS total FROM bins)),
reach AS (SELECT lo + (b2 + 0.5) / (1024 / (hi - lo)) AS low, lo + (b98 + 0.5) / (1024 / (hi - lo)) AS high FROM ends, (SELECT min(CAST({0} AS DOUBLE)) AS lo, max(CAST({0} AS DOUBLE)) AS hi FROM {1}))"""


@registered(f"""WITH {rasters.RELIEF}, {PERCENTILED.format('v', 'cells')}
SELECT "row", col, {', '.join(f'CAST(coalesce(round_even(least(greatest((v - low) / (high - low), 0), 1) * 255, 0), 0) AS INT) AS {c}' for c in 'rgb')}, CASE WHEN v IS NULL THEN 0 ELSE 255 END AS alpha FROM cells, reach""")
def rgb_stretched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each band stretched from its 2nd to its 98th percentile."""
    return render.composite(rasters.relief(spark, sf_dir)[0], "v", "v", "v")


@registered(f"WITH {rasters.RELIEF}, {PERCENTILED.format('v', 'cells')} SELECT {sql_single('low')} AS low, {sql_single('high')} AS high FROM reach")
def percentile_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.percentile_range(rasters.relief(spark, sf_dir)[0], "v")
    return found.select(single("low").alias("low"), single("high").alias("high"))


@registered(f"""WITH {rasters.RELIEF} SELECT CAST(trunc((v - lo) / (hi - lo) * 63) AS INT) AS bin, count(*) AS n FROM cells, (SELECT min(v) AS lo, max(v) AS hi FROM cells) WHERE v IS NOT NULL GROUP BY 1""")
def display_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.display_histogram(rasters.relief(spark, sf_dir)[0], "v")


BOXES = [("inner", 3.0, 4.0, 20.0, 9.0), ("edge", -5.0, -5.0, 6.2, 7.9)]


@registered(f"""WITH {rasters.RELIEF}, box AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, a, b, c, d in BOXES)}) t(zone, x0, y0, x1, y1))
SELECT zone, count(v) AS n, count(*) - count(v) AS n_missing, min(v) AS min, max(v) AS max, {sql_single('avg(v)')} AS mean, {sql_single('stddev_pop(v)')} AS std, {sql_single('sum(v)')} AS sum, CAST(count(*) AS DOUBLE) AS area
FROM box JOIN cells ON col + 0.5 >= x0 AND col + 0.5 < x1 AND "row" + 0.5 >= y0 AND "row" + 0.5 < y1 GROUP BY zone""")
def zonal_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.relief(spark, sf_dir)
    given = spark.createDataFrame(BOXES, "zone string, min_x double, min_y double, max_x double, max_y double")
    found = zones.zonal(cells, zones.boxes(given), grid)
    return found.withColumns({c: single(c) for c in ("mean", "std", "sum")})


@registered(f"""WITH {rasters.RELIEF}, spot AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey * 3.7::DOUBLE + 1 AS x, n_regionkey * 5.3::DOUBLE + 2 AS y FROM nation),
four AS (SELECT id, x - 0.5 - floor(x - 0.5) AS u, y - 0.5 - floor(y - 0.5) AS v, max(c.v) FILTER (dx = 0 AND dy = 0) AS a, max(c.v) FILTER (dx = 1 AND dy = 0) AS b, max(c.v) FILTER (dx = 0 AND dy = 1) AS c, max(c.v) FILTER (dx = 1 AND dy = 1) AS d
  FROM spot, range(2) p(dx), range(2) q(dy) LEFT JOIN cells c ON c.col = floor(x - 0.5) + dx AND c."row" = floor(y - 0.5) + dy GROUP BY id, x, y)
SELECT id, {sql_single('100 * sqrt(((b - a) * (1 - v) + (d - c) * v) ** 2 + ((c - a) * (1 - u) + (d - b) * u) ** 2)')} AS slope FROM four""")
def slope_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, grid = rasters.relief(spark, sf_dir)
    key = F.col("n_nationkey")
    points = rasters.table(spark, sf_dir, "nation").select(key.cast("long").alias("id"), (key * 3.7 + 1).alias("x"), (F.col("n_regionkey") * 5.3 + 2).alias("y"))
    return grade.slope_percent(points, cells, grid).withColumn("slope", single("slope"))


def plane(spark: SparkSession) -> tuple[DataFrame, Grid]:
    """Heights of an eighth of the world X, 100 x 100 cells north up."""
    cells = spark.range(10_000).select(F.floor(F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"))
    return cells.withColumn("v", ((F.col("col") + 0.5) / 8).cast("float")), Grid(100, 100, 0.0, 1.0, 0.0, 100.0, 0.0, -1.0)


@registered("""WITH s AS (SELECT CAST(n_nationkey AS BIGINT) AS id, 30.0::DOUBLE + n_nationkey AS x, 40.0::DOUBLE + n_regionkey AS y FROM nation)
SELECT id, CAST(k AS INT) AS branch, 'MaximumLength' AS stop, CAST(round(x + 4, 6) AS FLOAT) AS x, CAST(round(y + CASE WHEN k = 0 THEN 1 ELSE -1 END * 10 * sqrt(1 - 0.4 * 0.4), 6) AS FLOAT) AS y, CAST(round((x + 4) / 8, 6) AS FLOAT) AS z FROM s, range(2) r(k)""")
def grade_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 5 % and length 10 on a plane of 12.5 %: a start point for each nation."""
    cells, grid = plane(spark)
    starts = rasters.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.lit(30.0) + F.col("n_nationkey")).alias("x"), (F.lit(40.0) + F.col("n_regionkey")).alias("y"))
    found = grade.trace(starts, cells, grid, grade.Limits(5.0, 10.0), side=16).withColumn("end", F.element_at("samples", -1))
    return found.select("id", "branch", "stop", *(single(F.round(F.col("end")[c], 6)).alias(c) for c in ("x", "y", "z")))


@registered("""SELECT CAST(n_nationkey AS BIGINT) AS id, 'Success' AS status, CAST(10 AS FLOAT) AS length, CAST(10 AS FLOAT) AS required FROM nation""")
def grade_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of 5 % on the same plane between points 4 apart and half a unit of height: 10 long, whatever their shape."""
    cells, grid = plane(spark)
    key = F.col("n_nationkey").cast("double")
    pairs = rasters.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (key + 30).alias("x"), F.lit(50.0).alias("y"), (key + 34).alias("end_x"), F.lit(50.0).alias("end_y"))
    found = grade.route(pairs, cells, grid, grade.Limits(5.0, 100.0), side=32)
    return found.select("id", "status", single(F.round("length", 4)).alias("length"), single(F.round("required", 4)).alias("required"))


@registered("""WITH s AS (SELECT CAST(n_nationkey AS BIGINT) AS id, 30.0::DOUBLE + n_nationkey AS x, 50.0::DOUBLE AS y FROM nation)
SELECT id, false AS level, false AS missing, CAST(2 AS INT) AS n, CAST(round(x + 4, 4) AS FLOAT) AS x FROM s""")
def grade_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of a step of 10 that are half a unit higher, on the same plane: two, at one X."""
    cells, grid = plane(spark)
    x = F.col("n_nationkey").cast("double") + 30
    asked = rasters.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), x.alias("x"), F.lit(50.0).alias("y"), F.lit(10.0).alias("step"), (x / 8 + 0.5).alias("z"))
    found = grade.candidates(asked, cells, grid, side=32)
    return found.select("id", "level", "missing", F.size("points").alias("n"), single(F.round(F.array_max(F.transform("points", lambda p: p["x"])), 4)).alias("x"))


RELIEF_WEIGHTS = "[" + ", ".join(repr(2.718281828459045 ** (-0.5 * (k / 2.0) ** 2)) for k in range(-6, 7)) + "]"


def fitted_sql(source: str, value: str, axis: str) -> str:
    """The weighted line through each cell's known neighbours along an axis, at the cell itself."""
    other = '"row"' if axis == "col" else "col"
    gap = f'b.{axis} - a.{axis}'
    w = f"{RELIEF_WEIGHTS}[CAST({gap} + 7 AS INT)]"
    return f"""(SELECT "row", col, y, y + CASE WHEN s * q - m * m > 1e-12 * s * q THEN (r * q - t * m) / (s * q - m * m) ELSE r / s END AS fit FROM (
  SELECT a."row", a.col, any_value(a.{value}) AS y, sum({w}) AS s, sum({w} * ({gap})) AS m, sum({w} * ({gap}) * ({gap})) AS q, sum({w} * (b.{value} - a.{value})) AS r, sum({w} * (b.{value} - a.{value}) * ({gap})) AS t
  FROM {source} a JOIN {source} b ON a.{other} = b.{other} AND abs({gap}) <= 6 WHERE a.{value} IS NOT NULL AND b.{value} IS NOT NULL GROUP BY a."row", a.col))"""


@registered(f"""WITH {rasters.QUANTITY}, across AS (SELECT "row", col, fit AS v FROM {fitted_sql('cells', 'v', 'col')}), down AS (SELECT "row", col, fit FROM {fitted_sql('across', 'v', '"row"')})
SELECT c."row", c.col, CAST(c.v - fit AS FLOAT) + CAST(0 AS FLOAT) AS v FROM cells c LEFT JOIN down ON down."row" = c."row" AND down.col = c.col""")
def local_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.local_relief(*rasters.quantity(spark, sf_dir), 6.0).withColumn("v", single("v"))



@registered("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(value) AS n, min(value) AS min, max(value) AS max, CAST(avg(value) AS FLOAT) AS mean, CAST(stddev_pop(value) AS FLOAT) AS std FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily statistics of the events as they arrive: the table is read as a stream until nothing is left."""
    schema = rasters.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern: a stream reads folders, or files that match
    # a time without a zone as one of UTC, and back: whatever the session's zone, days are those of the table
    timed = stream.withColumn("at", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")))
    found = windows.drained(windows.windowed(timed, "at", "value", "1 day", "1 hour", "event_type"))
    start = F.expr("timestampadd(MICROSECOND, unix_micros(start), timestamp_ntz'1970-01-01 00:00:00')")
    return found.withColumns({"start": start, **{c: single(c) for c in ("mean", "std")}})
