"""Frames that queries on the test tables share: the tables' rows in the shapes operators take, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerloom.runtime import table

LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

#: Boxes made of order lines: about twenty to a page of five orders. Equal lines are equal boxes, so their order doesn't matter.
BOXES_SQL = f"""boxes AS (
  SELECT l_orderkey // 5 AS page, CAST(row_number() OVER (PARTITION BY l_orderkey // 5 ORDER BY {LINE_ORDER}) - 1 AS INTEGER) AS idx, l_returnflag AS label,
         CAST(l_partkey % 37 AS DOUBLE) * 20 AS x1, CAST(l_suppkey % 41 AS DOUBLE) * 25 AS y1,
         CAST(l_partkey % 37 AS DOUBLE) * 20 + 30 + l_quantity * 4 AS x2, CAST(l_suppkey % 41 AS DOUBLE) * 25 + 20 + l_linenumber * 10 AS y2,
         CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS score FROM lineitem)"""


def boxes(spark, root: str) -> DataFrame:
    li = table(spark, root, "lineitem")
    page = F.floor(F.col("l_orderkey") / 5)
    w = W.partitionBy("page").orderBy(*LINE_ORDER.split(", "))
    x, y = (F.col("l_partkey") % 37).cast("double") * 20, (F.col("l_suppkey") % 41).cast("double") * 25
    b = li.withColumn("page", page).withColumn("idx", (F.row_number().over(w) - 1).cast("int"))
    return b.select("page", "idx", F.col("l_returnflag").alias("label"), x.alias("x1"), y.alias("y1"), (x + 30 + F.col("l_quantity") * 4).alias("x2"), (y + 20 + F.col("l_linenumber") * 10).alias("y2"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).alias("score"))


#: Cells with the description of their column, each cell once as delivered last.
CELLS_SQL = """grid AS (
  SELECT c.project, c.row_id, g.variable, c.cell_id, c.value, c.original_value, c.updated_at, g.position
  FROM cells c JOIN (SELECT DISTINCT project, col_id, variable, position FROM grid_columns) g USING (project, col_id)),
 latest AS (SELECT * FROM grid QUALIFY row_number() OVER (PARTITION BY project, row_id, variable ORDER BY updated_at DESC, cell_id DESC) = 1)"""


def grid(spark, root: str) -> DataFrame:
    cols = table(spark, root, "grid_columns").select("project", "col_id", "variable", "position").distinct()
    return table(spark, root, "cells").join(cols, ["project", "col_id"]).select("project", "row_id", "variable", "cell_id", "value", "original_value", "updated_at", "position")


def latest(spark, root: str) -> DataFrame:
    """The latest delivery of each cell; a map-side aggregation, so that a cell delivered very often stays small."""
    g = grid(spark, root)
    pick = F.max_by(F.struct("cell_id", "value", "original_value", "updated_at", "position"), F.struct("updated_at", "cell_id"))
    return g.groupBy("project", "row_id", "variable").agg(pick.alias("c")).select("project", "row_id", "variable", "c.*")


#: Printed numbers in DuckDB, as ledgerloom.functions.numbers.printed_number reads them.
PRINTED = """CASE WHEN {c} IS NULL OR trim({c}) = '' THEN NULL
  WHEN regexp_matches({c}, '^[\\s\\-–—−_.·•*:;x×=~]*[\\-–—−_·•*:;x×=~][\\s\\-–—−_.·•*:;x×=~]*$') THEN 0.0
  WHEN regexp_matches(regexp_replace({c}, '[.,\\s\\x{{00A0}}\\x{{2009}}\\x{{202F}}]', '', 'g'), '^[+-]?\\d+$') THEN TRY_CAST(regexp_replace({c}, '[.,\\s\\x{{00A0}}\\x{{2009}}\\x{{202F}}]', '', 'g') AS DOUBLE)
  ELSE TRY_CAST(trim({c}) AS DOUBLE) END"""


def printed(c: str) -> str:
    return PRINTED.format(c=c)


# Accented letters of the test tables and what they fold to.
ACCENTED = "áàâäãåéèêëíìîïóòôöőõúùûüűçñýÿšžčćÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖŐÕÚÙÛÜŰÇÑÝŠŽČĆ"
PLAIN = "aaaaaaeeeeiiiioooooouuuuucnyyszccAAAAAAEEEEIIIIOOOOOOUUUUUCNYSZCC"


def folded(c: str) -> str:
    """Folding in DuckDB."""
    return f"trim(regexp_replace(lower(replace(translate({c}, '{ACCENTED}', '{PLAIN}'), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"
