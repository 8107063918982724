"""Rasters made from the driver's tables, each with its SQL twin."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Grid, dense


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(cells: DataFrame) -> Grid:
    """The grid that the cells span; one row goes to the driver."""
    r = cells.agg(F.max("col").alias("w"), F.max("row").alias("h")).first()
    return Grid(r["w"] + 1, r["h"] + 1)


def quantity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """Sums of quantities by supplier and part, folded to 25 x 40 cells at most: a stand-in for a terrain model."""
    lines = table(spark, sf_dir, "lineitem")
    cells = lines.groupBy((F.col("l_suppkey") % 25).cast("int").alias("row"), (F.col("l_partkey") % 40).cast("int").alias("col")).agg(F.sum("l_quantity").cast("float").alias("v"))
    grid = sized(cells)
    return dense(cells, grid, "v"), grid


QUANTITY = """raw AS (SELECT CAST(l_suppkey % 25 AS INT) AS "row", CAST(l_partkey % 40 AS INT) AS col, CAST(sum(l_quantity) AS FLOAT) AS v FROM lineitem GROUP BY 1, 2),
size AS (SELECT max(col) + 1 AS w, max("row") + 1 AS h FROM raw),
cells AS (SELECT CAST(r.i AS INT) AS "row", CAST(c.i AS INT) AS col, CAST(raw.v AS DOUBLE) AS v FROM size, range(25) r(i), range(40) c(i)
  LEFT JOIN raw ON raw."row" = r.i AND raw.col = c.i WHERE r.i < size.h AND c.i < size.w)"""


def relief(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """A raster that grows with the data: eight cells an order, from its price; one in 97 is missing, as is the end of the
    last row."""
    orders = table(spark, sf_dir, "orders")
    found = orders.agg(((F.max("o_orderkey") + 1) * 8).alias("cells")).first()  # one row
    width = math.ceil(math.sqrt(found["cells"])) if found["cells"] else 1
    grid = Grid(width, max(1, -(-(found["cells"] or 1) // width)))
    each = orders.select(F.rint(F.col("o_totalprice") * 100).cast("long").alias("price"), F.col("o_orderkey").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    at = F.col("key") * 8 + F.col("k")
    value = (F.col("price") * (F.col("k") * 37 + 11) % 100003).cast("double") / 100
    cells = each.select(at.alias("at"), value.cast("float").alias("v")).where("at % 97 <> 5").groupBy("at").agg(F.max("v").alias("v"))
    placed = cells.select(F.floor(F.col("at") / width).cast("int").alias("row"), (F.col("at") % width).cast("int").alias("col"), "v")
    return dense(placed, grid, "v"), grid


RELIEF = """given AS (SELECT o_orderkey * 8 + k AS at, CAST(max((CAST(round_even(o_totalprice * 100, 0) AS BIGINT) * (k * 37 + 11) % 100003) / 100.0::DOUBLE) AS FLOAT) AS v FROM orders, range(8) r(k) WHERE (o_orderkey * 8 + k) % 97 <> 5 GROUP BY 1),
span AS (SELECT CAST(ceil(sqrt((max(o_orderkey) + 1) * 8)) AS BIGINT) AS w, (max(o_orderkey) + 1) * 8 AS n FROM orders),
size AS (SELECT w, CAST(ceil(n / w) AS BIGINT) AS h FROM span),
cells AS MATERIALIZED (SELECT CAST(i // w AS INT) AS "row", CAST(i % w AS INT) AS col, CAST(given.v AS DOUBLE) AS v FROM (SELECT w, unnest(range(w * h)) AS i FROM size) LEFT JOIN given ON given.at = i)"""


def days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """Users by days from the first one of the table: b1 the greatest value, b2 the number of events; days without events are missing."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min(F.col("ts").cast("date")).alias("d"))  # one row
    day = F.datediff(F.col("ts").cast("date"), F.col("d")).cast("int")
    cells = events.crossJoin(F.broadcast(first)).groupBy(F.col("user_id").cast("int").alias("row"), day.alias("col"))
    cells = cells.agg(F.max("value").cast("float").alias("b1"), F.count("*").cast("float").alias("b2"))
    grid = sized(cells)
    return cells, grid


DAYS = """days AS (SELECT CAST(user_id AS INT) AS "row", CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS INT) AS col,
  CAST(max(value) AS FLOAT) AS b1, CAST(count(*) AS FLOAT) AS b2 FROM events GROUP BY 1, 2)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a dense raster: a row for each vector, a column for each component."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("row"), "label", F.posexplode("embedding").alias("col", "v"))


VECTORS = """emb AS (SELECT CAST(vec_id AS INT) AS "row", label, CAST(i - 1 AS INT) AS col, embedding[i] AS v
  FROM embeddings, range(1, 65) r(i))"""
