"""Boxes on pages: geometry, reading order, containment and overlap joins.

A box is four doubles x1, y1, x2, y2 on a page given by key columns. Boxes without two points are left out by
`from_points`. Joins meet boxes of one page only, where there are about a hundred; boxes of very full pages are met
through a grid of cells instead, so that no page becomes a square of its boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")
# What share of a page makes a box wide, where a gutter is looked for, and how wide it must be.
WIDE, SEARCH, GUTTER = 0.7, (0.25, 0.75), 0.03


def from_points(df: DataFrame, points: str = "points") -> DataFrame:
    """`df` with the bounding box of its points; rows with fewer than two are left out."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    box = {"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)}
    return df.where(F.size(points) >= 2).select("*", *[c.cast("double").alias(k) for k, c in box.items()])


def area(p: str = "") -> Column:
    return (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))


def center_x(p: str = "") -> Column:
    return (F.col(f"{p}x1") + F.col(f"{p}x2")) / 2


def center_y(p: str = "") -> Column:
    return (F.col(f"{p}y1") + F.col(f"{p}y2")) / 2


def intersection(p: str = "a_", q: str = "b_") -> Column:
    w = F.least(f"{p}x2", f"{q}x2") - F.greatest(f"{p}x1", f"{q}x1")
    h = F.least(f"{p}y2", f"{q}y2") - F.greatest(f"{p}y1", f"{q}y1")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(p: str = "a_", q: str = "b_") -> Column:
    i = intersection(p, q)
    return F.coalesce(F.try_divide(i, area(p) + area(q) - i), F.lit(0.0))


def overlap_of_smaller(p: str = "a_", q: str = "b_") -> Column:
    return F.coalesce(F.try_divide(intersection(p, q), F.least(area(p), area(q))), F.lit(0.0))


def scale(df: DataFrame, fx: Column, fy: Column) -> DataFrame:
    return df.withColumns({"x1": F.col("x1") * fx, "y1": F.col("y1") * fy, "x2": F.col("x2") * fx, "y2": F.col("y2") * fy})


def shift_and_clip(df: DataFrame, dx: Column, dy: Column, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """Boxes moved and, where a frame is given, cut to it; what has no extent left is dropped."""
    new = {"x1": F.col("x1") + dx, "y1": F.col("y1") + dy, "x2": F.col("x2") + dx, "y2": F.col("y2") + dy}
    if width is not None and height is not None:
        new = {k: F.least(F.greatest(c, F.lit(0.0)), width if k[0] == "x" else height) for k, c in new.items()}
    return df.withColumns(new).where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def crop_rect(width: Column, height: Column, margin: float) -> Column:
    """(left, top, right, bottom) in whole pixels: grown by a margin, lower edges cut off, upper edges rounded half to even, kept on the page."""
    return F.struct(
        F.greatest(F.lit(0), (F.col("x1") - margin).cast("int")).alias("left"), F.greatest(F.lit(0), (F.col("y1") - margin).cast("int")).alias("top"),
        F.least(width.cast("int"), F.bround(F.col("x2") + margin).cast("int")).alias("right"), F.least(height.cast("int"), F.bround(F.col("y2") + margin).cast("int")).alias("bottom"),
    )


def page_width(df: DataFrame, page: list[str], stored: str) -> DataFrame:
    """`df` with page_width: as stored, else the rightmost edge on the page, else 1."""
    far = F.max("x2").over(W.partitionBy(*page))
    return df.withColumn("page_width", F.coalesce(F.when(F.col(stored) > 0, F.col(stored).cast("double")), F.when(far > 0, far), F.lit(1.0)))


def gutters(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., split_x): the middle of the widest empty run of x in the middle half of the page, where boxes stand on both sides of it and it is wide enough.

    The right edge so far is a running maximum over boxes in order of their left edge; where the next box begins beyond it, there is a gap.
    """
    w = W.partitionBy(*by).orderBy("x1", "x2")
    far = F.max("x2").over(w.rowsBetween(W.unboundedPreceding, -1))
    g = df.withColumn("__far", far).where("__far < x1")
    lo, hi = F.greatest("__far", F.col("page_width") * SEARCH[0]), F.least("x1", F.col("page_width") * SEARCH[1])
    g = g.withColumn("__w", hi - lo).withColumn("__mid", (lo + hi) / 2).where("__w > 0")
    best = g.groupBy(*by).agg(F.max(F.struct("__w", (-F.col("x1")).alias("left"), F.col("__mid").alias("mid"), F.col("page_width").alias("pw"))).alias("g"))
    best = best.where(F.col("g.__w") >= GUTTER * F.col("g.pw")).select(*by, F.col("g.mid").alias("split_x"))
    sides = df.join(best, by).groupBy(*by, "split_x").agg(F.min(center_x()).alias("l"), F.max(center_x()).alias("r"))
    return sides.where((F.col("l") < F.col("split_x")) & (F.col("r") >= F.col("split_x"))).select(*by, "split_x")


def reading_order(df: DataFrame, page: list[str], idx: str = "idx", mode: str = "auto") -> DataFrame:
    """`df` (with page_width) and reading_pos, from 1 on each page: bands between wide boxes, in a band the left column and then the right."""
    wide = (F.col("x2") - F.col("x1")) > WIDE * F.col("page_width")
    down = W.partitionBy(*page).orderBy("y1", "x1", idx)
    d = df.withColumn("__wide", wide).withColumn("__cut", F.sum(F.col("__wide").cast("int")).over(down))
    # A wide box is a band of its own, between the band before it and the one after.
    d = d.withColumn("__band", F.when(F.col("__wide"), F.col("__cut") * 2 - 1).otherwise(F.col("__cut") * 2))
    if mode == "1":
        d = d.withColumn("split_x", F.lit(None).cast("double"))
    else:
        g = gutters(d.where(~F.col("__wide")), [*page, "__band"])
        d = d.join(g, [*page, "__band"], "left")
        if mode == "2":
            d = d.withColumn("split_x", F.when(~F.col("__wide"), F.coalesce("split_x", F.col("page_width") / 2)))
    side = F.when(F.col("split_x").isNull(), 0).otherwise((center_x() >= F.col("split_x")).cast("int"))
    d = d.withColumn("column", side)
    pos = F.row_number().over(W.partitionBy(*page).orderBy("__band", "column", "y1", "x1", idx))
    return d.withColumn("reading_pos", pos).withColumnRenamed("__band", "band").drop("__wide", "__cut", "split_x")


def _sides(a: DataFrame, b: DataFrame, page: list[str]) -> tuple[DataFrame, DataFrame]:
    keep = lambda df, p: df.select(*page, *[F.col(c).alias(f"{p}{c}") for c in df.columns if c not in page])
    return keep(a, "a_"), keep(b, "b_")


def _gridded(a: DataFrame, b: DataFrame, page: list[str], cell: float) -> DataFrame:
    """Pairs of boxes of a page that share a grid cell, each once: in the cell where their common part begins."""

    def spread(df: DataFrame, p: str) -> DataFrame:
        steps = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
        return df.withColumn("__gx", F.explode(steps(f"{p}x1", f"{p}x2"))).withColumn("__gy", F.explode(steps(f"{p}y1", f"{p}y2")))

    met = spread(a, "a_").join(spread(b, "b_"), [*page, "__gx", "__gy"])
    first = (F.col("__gx") == F.floor(F.greatest("a_x1", "b_x1") / cell)) & (F.col("__gy") == F.floor(F.greatest("a_y1", "b_y1") / cell))
    return met.where(first).drop("__gx", "__gy")


def box_pairs(a: DataFrame, b: DataFrame, page: list[str], cell: float | None = None) -> DataFrame:
    """Pairs (a_..., b_...) of boxes on one page whose closed rectangles touch."""
    x, y = _sides(a, b, page)
    touch = (F.col("a_x1") <= F.col("b_x2")) & (F.col("b_x1") <= F.col("a_x2")) & (F.col("a_y1") <= F.col("b_y2")) & (F.col("b_y1") <= F.col("a_y2"))
    met = x.join(y, page) if cell is None else _gridded(x, y, page, cell)
    return met.where(touch)


def contained(children: DataFrame, parents: DataFrame, page: list[str], cell: float | None = None) -> DataFrame:
    """Pairs (a_ child, b_ parent) where the child's centre lies in the parent, edges included; a child may have several parents."""
    inside = center_x("a_").between(F.col("b_x1"), F.col("b_x2")) & center_y("a_").between(F.col("b_y1"), F.col("b_y2"))
    return box_pairs(children, parents, page, cell).where(inside)


def smallest_parent(children: DataFrame, parents: DataFrame, page: list[str], idx: str = "idx", cell: float | None = None) -> DataFrame:
    """`contained` with the smallest parent of each child, the first on ties; children outside all parents are dropped."""
    w = W.partitionBy(*page, f"a_{idx}").orderBy(area("b_"), f"b_{idx}")
    return contained(children, parents, page, cell).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def anchored(refs: DataFrame, boxes: DataFrame, page: list[str], tol: float = 0.5) -> DataFrame:
    """Each of `refs` (ref_id, hint, label, box) with the idx of the box it means: the one at its hint if that fits, else the first that fits; null if none."""
    close = F.lit(True)
    for c in BOX:
        close = close & (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tol)
    x, y = _sides(refs, boxes, page)
    met = x.join(y, page).where((F.col("a_label") == F.col("b_label")) & close)
    best = met.groupBy(*page, "a_ref_id").agg(F.min(F.struct((F.col("b_idx") != F.coalesce("a_hint", F.lit(-1))).alias("no_hint"), F.col("b_idx").alias("idx"))).alias("b"))
    return refs.join(best.select(*page, F.col("a_ref_id").alias("ref_id"), F.col("b.idx").alias("idx")), [*page, "ref_id"], "left")


def suppressed(new: DataFrame, protected: DataFrame, page: list[str], share: float = 0.5) -> DataFrame:
    """The boxes of `new` that no protected box covers by `share` of the smaller one."""
    hit = box_pairs(new, protected, page).where(overlap_of_smaller() >= share).select(*page, F.col("a_idx").alias("idx")).distinct()
    return new.join(hit, [*page, "idx"], "left_anti")


def covered_duplicates(df: DataFrame, page: list[str], share: float) -> DataFrame:
    """(page..., idx) of the larger of two boxes where the smaller is covered by `share`."""
    pairs = box_pairs(df, df, page).where((F.col("a_idx") < F.col("b_idx")) & (overlap_of_smaller() >= share))
    return pairs.select(*page, F.when(area("a_") >= area("b_"), F.col("a_idx")).otherwise(F.col("b_idx")).alias("idx")).distinct()


def table_regions(cells: DataFrame, page: list[str], table: str, margin: float, width: Column, height: Column) -> DataFrame:
    """(page..., table, box): what each table of a page covers, with a margin, on the page."""
    g = cells.where(F.col(table).isNotNull()).groupBy(*page, table).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    grow = {"x1": F.greatest(F.col("x1") - margin, F.lit(0.0)), "y1": F.greatest(F.col("y1") - margin, F.lit(0.0)), "x2": F.least(F.col("x2") + margin, width), "y2": F.least(F.col("y2") + margin, height)}
    return g.withColumns(grow)


def snapped(cells: DataFrame, page: list[str], table: str = "table", row: str = "super_row", column: str = "super_column") -> DataFrame:
    """Cells of a lattice on the rounded medians of their rows and columns; a column ends where the next begins, a row likewise."""

    def bands(key: str, lo: str, hi: str, p: str) -> DataFrame:
        whole = lambda c: F.floor(F.median(c) + 0.5)
        g = cells.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(*page, table, key).agg(whole(lo).alias(f"{p}lo"), whole(hi).alias(f"{p}hi"))
        nxt = F.lead(f"{p}lo").over(W.partitionBy(*page, table).orderBy(f"{p}lo", key))
        return g.withColumn(f"{p}hi", F.coalesce(nxt, f"{p}hi"))

    c = cells.join(bands(column, "x1", "x2", "__c"), [*page, table, column]).join(bands(row, "y1", "y2", "__r"), [*page, table, row])
    return c.withColumns({"x1": F.col("__clo").cast("double"), "x2": F.col("__chi").cast("double"), "y1": F.col("__rlo").cast("double"), "y2": F.col("__rhi").cast("double")}).drop("__clo", "__chi", "__rlo", "__rhi")


def merged_intervals(df: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(by..., lo, hi): the union of intervals as islands; touching ones are one."""
    w = W.partitionBy(*by).orderBy(lo, hi)
    far = F.max(hi).over(w.rowsBetween(W.unboundedPreceding, -1))
    i = df.withColumn("__new", F.coalesce((F.col(lo) > far).cast("int"), F.lit(1))).withColumn("__i", F.sum("__new").over(w))
    return i.groupBy(*by, "__i").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__i")


def free_intervals(whole: DataFrame, taken: DataFrame, by: list[str]) -> DataFrame:
    """(by..., lo, hi): what of one interval per key the taken ones leave."""
    m = merged_intervals(taken, by).join(whole.select(*by, F.col("lo").alias("a"), F.col("hi").alias("b")), by, "right")
    m = m.withColumn("lo", F.greatest("lo", "a")).withColumn("hi", F.least("hi", "b"))
    w = W.partitionBy(*by).orderBy("lo")
    good = F.col("lo") < F.col("hi")
    t = m.where(good)
    before = t.select(*by, F.coalesce(F.lag("hi").over(w), "a").alias("lo"), F.col("lo").alias("hi"))
    after = t.groupBy(*by).agg(F.max("hi").alias("lo"), F.first("b").alias("hi"))
    none = m.select(*by, "a", "b").distinct().join(t.select(*by).distinct(), by, "left_anti").select(*by, F.col("a").alias("lo"), F.col("b").alias("hi"))
    return before.unionByName(after).unionByName(none).where("lo < hi")


def filled_gaps(cells: DataFrame, line: list[str], least: float = 8.0) -> DataFrame:
    """(line..., x1, x2, after): the gaps of at least `least` between neighbours on a line of cells."""
    w = W.partitionBy(*line).orderBy("x1", "idx")
    nxt = F.lead("x1").over(w)
    return cells.select(*line, F.col("x2").alias("x1"), nxt.alias("x2"), F.col("idx").alias("after")).where((F.col("x2") - F.col("x1")) >= least)


def stacked_segments(cells: DataFrame, page: list[str], least: float = 60.0) -> DataFrame:
    """`cells` with segment: tables stacked on a page, cut where no cell reaches over a gap of three median heights or `least`."""
    w = W.partitionBy(*page).orderBy("y1", "idx")
    med = F.median(F.col("y2") - F.col("y1")).over(W.partitionBy(*page))
    far = F.max("y2").over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = F.coalesce((F.col("y1") - far >= F.greatest(3 * med, F.lit(least))).cast("int"), F.lit(0))
    return cells.withColumn("__c", cut).withColumn("segment", F.sum("__c").over(w)).drop("__c")
