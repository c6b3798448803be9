"""Ordered scans over pages and rows as windows: record chains, fills, hierarchies, orders of pages.

A scan runs in one ordered partition per key (a volume). Order columns must be unique within it; ties are the
caller's to break. Nulls in the filled column are what is filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerloom.runtime import ranked


def filled_forward(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """`df` with the value last seen up to each row; null before the first."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def ditto_filled(df: DataFrame, by: list[str], order: list[str], text: str, is_ditto: Column, name: str, breaks: list[str] | None = None) -> DataFrame:
    """`df` with the text that a blank, ditto mark or wordless print stands for: the last real one above.

    Where a column of `breaks` (a page, a table) changes, nothing is inherited.
    """
    real = F.when(F.coalesce(F.trim(text), F.lit("")).rlike(r"[\p{L}\p{N}]") & ~is_ditto, F.col(text))
    return filled_forward(df, [*by, *(breaks or [])], order, real, name)


def record_sweep(df: DataFrame, by: list[str], order: list[str], continuation: str, locked_id: str, start: int = 1, carry: int | None = None) -> DataFrame:
    """`df` with record_id and orphan: boxes in reading order chained to records.

    A box starts a record unless it continues the one before; a locked box keeps its id; a new id is one more than any seen.
    In closed form: with N the running count of new records and L the locked ids, the greatest id seen is N + max(start - 1,
    max(L - N)), and a continuation has the last id given to a box that is none.
    """
    w = W.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    locked = F.col(locked_id).isNotNull()
    cont = F.coalesce(F.col(continuation), F.lit(False)) & ~locked
    first = F.row_number().over(w) == 1
    opens = F.lit(carry is not None) | ~first
    new = ~locked & ~(cont & opens)
    d = df.withColumn("__new", new.cast("bigint")).withColumn("__n", F.sum("__new").over(upto))
    ahead = F.when(locked, F.col(locked_id) - F.col("__n"))
    if carry is not None:
        lead = F.sum((~(cont)).cast("int")).over(upto) == 0
        ahead = F.coalesce(ahead, F.when(cont & lead, F.lit(carry) - F.col("__n")))
    d = d.withColumn("__m", F.greatest(F.lit(start - 1).cast("bigint"), F.coalesce(F.max(ahead).over(upto), F.lit(start - 1).cast("bigint"))))
    given = F.when(locked, F.col(locked_id)).when(F.col("__new") == 1, F.col("__n") + F.col("__m"))
    d = d.withColumn("__g", given).withColumn("record_id", F.coalesce(F.last("__g", ignorenulls=True).over(upto), F.lit(carry).cast("bigint")))
    is_first = F.row_number().over(W.partitionBy(*by, "record_id").orderBy(*order)) == 1
    d = d.withColumn("orphan", F.coalesce(F.col(continuation), F.lit(False)) & is_first & (F.col("record_id") != F.lit(-1 if carry is None else carry)))
    return d.drop("__new", "__n", "__m", "__g")


def resweep_seed(df: DataFrame, by: list[str], order: list[str], record_id: str) -> DataFrame:
    """(by..., max_id, last_id): what a sweep that goes on from here starts with."""
    return df.where(F.col(record_id).isNotNull()).groupBy(*by).agg(F.max(record_id).alias("max_id"), F.max_by(F.col(record_id), F.struct(*order)).alias("last_id"))


def open_role(df: DataFrame, by: list[str], order: list[str], role: str) -> DataFrame:
    """`df` with open_at_end: whether the last start or stop up to each row was a start; open before any."""
    d = filled_forward(df, by, order, F.when(F.col(role).isin("start", "stop"), F.col(role)), "__r")
    return d.withColumn("open_at_end", F.coalesce("__r", F.lit("start")) == "start").drop("__r")


def fragments(df: DataFrame, volume: list[str], page: list[str], by: list[str], role: str, bottom: str, carry_open: bool = True) -> DataFrame:
    """(volume..., page..., by..., y1, y2, continuation): pieces from each start mark to the next mark or the end of the column, and the piece a column begins with if a record is open there.

    `df` has the marks (role start or stop) with y1, and a row without a role for a column that has no mark; `bottom` is the end of the column. A volume
    is read page by page and column by column in the order of `page` and `by`; a record is open before its first mark if `carry_open`.
    """
    keys = [*volume, *page, *by]
    flow = W.partitionBy(*volume).orderBy(*page, *by, "y1")
    col = W.partitionBy(*keys).orderBy("y1")
    d = df.withColumn("__m", F.when(F.col(role).isin("start", "stop"), F.col(role)))
    d = d.withColumn("__before", F.last("__m", ignorenulls=True).over(flow.rowsBetween(W.unboundedPreceding, -1))).withColumn("__k", F.row_number().over(col))
    d = d.withColumn("__first", F.min(F.when(F.col("__m").isNotNull(), F.col("y1"))).over(W.partitionBy(*keys)))
    marks = d.where("__m is not null").withColumn("__next", F.lead("y1").over(col))
    own = marks.where("__m = 'start'").select(*keys, "y1", F.coalesce("__next", bottom).alias("y2"), F.lit(False).alias("continuation"))
    opened = F.coalesce("__before", F.lit("start" if carry_open else "stop")) == "start"
    lead = d.where((F.col("__k") == 1) & opened).select(*keys, F.lit(0.0).alias("y1"), F.coalesce("__first", bottom).alias("y2"), F.lit(True).alias("continuation"))
    return own.unionByName(lead).where("y2 > y1")


def records(df: DataFrame, by: list[str], record_id: str, order: list[str], page: str, text: str) -> DataFrame:
    """(by..., record_id, n_fragments, first_page, last_page, n_pages, name): what the fragments of each record amount to."""
    o = F.struct(*order)
    return df.groupBy(*by, record_id).agg(F.count("*").alias("n_fragments"), F.min_by(page, o).alias("first_page"), F.max_by(page, o).alias("last_page"), F.countDistinct(page).alias("n_pages"), F.min_by(text, o).alias("name"))


def page_order(pages: DataFrame, by: list[str], stem: str = "stem") -> DataFrame:
    """(by..., finding, value): stems without a number, numbers twice, numbers missing between the least and the greatest.

    Gaps come from the number before, so a missing million is one range and not a million rows.
    """
    n = F.regexp_extract(stem, r"(\d+)\D*$", 1)
    p = pages.withColumn("__n", n.try_cast("bigint"))
    bad = p.where(F.col("__n").isNull()).select(*by, F.lit("not numbered").alias("finding"), F.col(stem).alias("value"))
    num = p.where(F.col("__n").isNotNull())
    twice = num.groupBy(*by, "__n").agg(F.count("*").alias("c")).where("c > 1").select(*by, F.lit("twice").alias("finding"), F.col("__n").cast("string").alias("value"))
    before = F.lag("__n").over(W.partitionBy(*by).orderBy("__n"))
    gap = num.select(*by, "__n").distinct().withColumn("__p", before).where("__n - __p > 1")
    gaps = gap.select(*by, F.lit("missing").alias("finding"), F.when(F.col("__n") - F.col("__p") == 2, (F.col("__p") + 1).cast("string")).otherwise(F.concat_ws("-", (F.col("__p") + 1).cast("string"), (F.col("__n") - 1).cast("string"))).alias("value"))
    return bad.unionByName(twice).unionByName(gaps)


def hierarchy_sums(rows: DataFrame, by: list[str], order: list[str], level: str, value: str, top: int = 4, tol: float = 0.5) -> DataFrame:
    """(by..., order..., level, stated, computed, ok): each row of a level with the sum of the rows back to the row of the same or a higher one.

    The children of a row of level N are the rows since the previous row with level N or more that have the level below (0 for unlevelled rows).
    """
    out = None
    w = W.partitionBy(*by).orderBy(*[F.col(c) for c in order])
    lv = F.coalesce(F.col(level), F.lit(0))
    for n in range(1, top + 1):
        seg = F.sum((lv >= n).cast("int")).over(w) - (lv >= n).cast("int")
        d = rows.withColumn("__lv", lv).withColumn("__seg", seg)
        child = F.sum(F.when(F.col("__lv") == n - 1, F.col(value).cast("double"))).over(W.partitionBy(*by, "__seg"))
        d = d.withColumn("__sum", child).where(F.col("__lv") == n).where(F.col("__sum").isNotNull() & F.col(value).isNotNull())
        d = d.select(*by, *order, F.lit(n).alias("level"), F.col(value).cast("double").alias("stated"), F.col("__sum").alias("computed"))
        out = d if out is None else out.unionByName(d)
    return out.withColumn("ok", F.abs(F.col("stated") - F.col("computed")) <= tol)


def line_mode(cells: DataFrame, row: list[str], n: str) -> DataFrame:
    """`cells` with the most usual line count of their row (the least on ties) and whether they deviate."""
    counted = cells.groupBy(*row, n).agg(F.count("*").alias("__c"))
    mode = counted.groupBy(*row).agg(F.max_by(F.col(n), F.struct("__c", (-F.col(n)).alias("x"))).alias("usual"))
    return cells.join(mode, row).withColumn("deviates", F.col(n) != F.col("usual"))


def nested_subset(df: DataFrame, stem: str, fraction: float) -> DataFrame:
    """A share of the pages, at least one, that holds every smaller share: the first by the SHA-1 of their stem."""
    n = df.select(stem).distinct().agg(F.count("*").alias("__n"))
    numbered = ranked(df.select(stem).distinct().withColumn("__h", F.sha1(F.col(stem))), ["__h", stem], "__r")
    keep = numbered.join(F.broadcast(n)).where(F.col("__r") <= F.greatest(F.lit(1), F.bround(F.col("__n") * fraction)))
    return df.join(keep.select(stem), stem, "left_semi")


def evenly_spaced(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """k rows at equal steps of the order; the step's positions are rounded half to even."""
    n = df.agg(F.count("*").alias("__n"))
    numbered = ranked(df, order, "__i").withColumn("__i", F.col("__i") - 1).join(F.broadcast(n))
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / max(1, k - 1)).cast("int"))
    return numbered.where(F.array_contains(at, F.col("__i"))).drop("__i", "__n")
