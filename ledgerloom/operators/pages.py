"""Pages and crops: boxes between frames, smoothing, templates, write-back, predictions, exports.

Frames are joined on page keys; boxes out of their frame are dropped, never moved into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import fold, page_status
from ledgerloom.operators import geometry


def onto_page(boxes: DataFrame, crops: DataFrame, key: str = "crop") -> DataFrame:
    """Boxes found in crops, in the frame of their page, cut to the crop. `crops` is (crop, stem, left, top, right, bottom)."""
    j = boxes.join(crops, key)
    moved = {"x1": F.greatest(F.col("x1") + F.col("left"), F.col("left").cast("double")), "y1": F.greatest(F.col("y1") + F.col("top"), F.col("top").cast("double")), "x2": F.least(F.col("x2") + F.col("left"), F.col("right").cast("double")), "y2": F.least(F.col("y2") + F.col("top"), F.col("bottom").cast("double"))}
    return j.withColumns(moved).where("x2 > x1 and y2 > y1").drop("left", "top", "right", "bottom")


def into_crops(boxes: DataFrame, parents: DataFrame, page: list[str]) -> DataFrame:
    """The boxes whose centre lies in a parent, in its frame and cut to it, once for every parent."""
    c = geometry.contained(boxes, parents, page)
    x = {"x1": F.greatest(F.col("a_x1") - F.col("b_x1"), F.lit(0.0)), "y1": F.greatest(F.col("a_y1") - F.col("b_y1"), F.lit(0.0)), "x2": F.least(F.col("a_x2"), F.col("b_x2")) - F.col("b_x1"), "y2": F.least(F.col("a_y2"), F.col("b_y2")) - F.col("b_y1")}
    return c.select(*page, F.col("b_idx").alias("parent"), F.col("a_idx").alias("idx"), F.col("a_label").alias("label"), *[e.alias(k) for k, e in x.items()]).where("x2 > x1 and y2 > y1")


def written_back(pages: DataFrame, crops: DataFrame, page: list[str], origin: str = "crop_origin") -> tuple[DataFrame, DataFrame]:
    """(boxes, stale): page boxes in which those that came from a crop give way to the crop's present ones. Crops whose parent box is gone are stale and change nothing.

    `crops` has the page's keys, the crop's name as `origin` and parent_alive.
    """
    stale = crops.where(~F.coalesce("parent_alive", F.lit(False))).select(*page, origin).distinct()
    live = crops.where(F.coalesce("parent_alive", F.lit(False)))
    kept = pages.join(live.select(*page, origin).distinct(), [*page, origin], "left_anti")
    return kept.unionByName(live.drop("parent_alive"), allowMissingColumns=True), stale


def smoothed(cells: DataFrame, page: list[str]) -> DataFrame:
    """Cells of a region on the rounded medians of their row and then of their column, where those have two cells or more."""

    def on(df: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
        w = W.partitionBy(*page, key)
        many = (F.count("*").over(w) >= 2) & F.col(key).isNotNull()
        whole = lambda c: F.floor(F.median(c).over(w) + 0.5).cast("double")
        return df.withColumns({"__lo": F.when(many, whole(lo)).otherwise(F.col(lo)), "__hi": F.when(many, whole(hi)).otherwise(F.col(hi))}).withColumns({lo: F.col("__lo"), hi: F.col("__hi")}).drop("__lo", "__hi")

    return on(on(cells, "super_row", "y1", "y2"), "super_column", "x1", "x2")


def autofilled(pages: DataFrame, boxes: DataFrame, n: int, page_no: str = "page_no") -> DataFrame:
    """Boxes for the pages after the first n, as a cyclic copy of those."""
    t = boxes.where(F.col(page_no) < n).withColumnRenamed(page_no, "__t")
    rest = pages.where(F.col(page_no) >= n).select(page_no)
    return rest.join(t, F.col(page_no) % n == F.col("__t")).drop("__t")


def homography(src: list[tuple[float, float]], dst: list[tuple[float, float]]) -> list[float]:
    """The eight coefficients that take four points to four others."""
    import numpy as np

    rows, rhs = [], []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    return np.linalg.solve(np.array(rows, float), np.array(rhs, float)).tolist()


def warped(boxes: DataFrame, h: list[float]) -> DataFrame:
    """Boxes under a homography: the rectangle around their four moved corners."""

    def at(x: Column, y: Column) -> tuple[Column, Column]:
        d = h[6] * x + h[7] * y + 1
        return (h[0] * x + h[1] * y + h[2]) / d, (h[3] * x + h[4] * y + h[5]) / d

    corners = [at(F.col(a), F.col(b)) for a, b in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))]
    return boxes.withColumns({"x1": F.least(*[c[0] for c in corners]), "y1": F.least(*[c[1] for c in corners]), "x2": F.greatest(*[c[0] for c in corners]), "y2": F.greatest(*[c[1] for c in corners])})


def propagated(boxes: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    """`boxes` with heading: the text of the last box of a label up to each box, in flow order."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return boxes.withColumn("heading", F.last(F.when(F.col("label") == label, F.col("text")), ignorenulls=True).over(w))


def exported_records(boxes: DataFrame, by: list[str], order: list[str], modes: dict[str, str]) -> DataFrame:
    """(by..., json): boxes as JSON records. A label is exported, ignored, or propagated to the records after it; labels without a mode are exported."""
    out = boxes
    carried = [k for k, m in modes.items() if m == "propagate"]
    for k in carried:
        out = propagated(out, by, order, k).withColumnRenamed("heading", f"__{k}")
    hidden = [k for k, m in modes.items() if m in ("ignore", "propagate")]
    keep = out.where(~F.coalesce(F.col("label").isin(hidden), F.lit(False))) if hidden else out
    return keep.select(*by, *order, F.to_json(F.struct("label", "text", *[F.col(f"__{k}").alias(k) for k in carried])).alias("json"))


def sheet(cells: DataFrame, page: list[str]) -> DataFrame:
    """(page..., row, column, value): a page's lattice as a sheet, free boxes in rows of their own where they stand, texts of several lines over several rows.

    A row of the lattice is as high as its longest cell; the rows above it push it down by a running sum.
    """
    text = F.split(F.coalesce("text", F.lit("")), "\n")
    c = cells.withColumn("__lines", text)
    free = F.col("super_row").isNull()
    top = F.min("y1").over(W.partitionBy(*page, F.coalesce("super_row", -F.col("idx") - 1)))
    c = c.withColumn("__top", top).withColumn("__key", F.coalesce("super_row", -F.col("idx") - 1))
    high = c.groupBy(*page, "__key").agg(F.min("__top").alias("__t"), F.max(F.size("__lines")).alias("__h"))
    before = F.coalesce(F.sum("__h").over(W.partitionBy(*page).orderBy("__t", "__key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    c = c.join(high.withColumn("__start", before).select(*page, "__key", "__start"), [*page, "__key"])
    return c.select(*page, "__start", F.when(free, 0).otherwise(F.col("super_column")).alias("column"), F.posexplode("__lines").alias("__i", "value")).select(*page, (F.col("__start") + F.col("__i")).alias("row"), "column", "value").where("value <> ''")


def applicable(predictions: DataFrame, pages: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """Predictions for the pages that have no boxes yet and are not skipped."""
    free = pages.where(page_status(F.col("status")) != "skip").select(*page).join(boxes.select(*page).distinct(), page, "left_anti")
    return predictions.join(free, page, "left_semi")


def prompts(cells: DataFrame, declared: DataFrame) -> DataFrame:
    """Cells with the prompt their declaration gives their column; a column without one has its declaration's."""
    own = declared.where("column is not null").select("declaration", F.col("column").alias("super_column"), F.col("prompt").alias("__own"))
    general = declared.where("column is null").groupBy("declaration").agg(F.first("prompt").alias("__general"))
    return cells.join(own, ["declaration", "super_column"], "left").join(general, "declaration", "left").withColumn("prompt", F.coalesce("__own", "__general")).drop("__own", "__general")


def record_inputs(fragments: DataFrame, record: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` fragments of each record, as the images one request takes, with truncated: whether the record has more."""
    w = W.partitionBy(*record)
    f = fragments.withColumn("pos", F.row_number().over(w.orderBy(*order))).withColumn("truncated", F.count("*").over(w) > most)
    return f.where(F.col("pos") <= most)


def kept_structured(parsed: Column, previous: Column, edited: Column) -> Column:
    """What a new extraction leaves: data a person edited stays."""
    return F.when(F.coalesce(edited, F.lit(False)), previous).otherwise(parsed)


def without_repeats(strips: DataFrame, by: list[str], strip: str, order: str, key: str, back: int = 8) -> DataFrame:
    """Rows of overlapping strips without those that repeat one of the last `back` keys of the strip before."""
    w = W.partitionBy(*by, strip).orderBy(F.col(order).desc())
    tail = strips.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= back).select(*by, (F.col(strip) + 1).alias(strip), fold(F.col(key)).alias("__k")).distinct()
    return strips.withColumn("__k", fold(F.col(key))).join(tail, [*by, strip, "__k"], "left_anti").drop("__k")


def blank_marked(cells: DataFrame, ink: DataFrame, key: list[str], least: float) -> DataFrame:
    """Cells marked blank where their band holds less ink than `least` and no layer has text."""
    j = cells.join(ink.select(*key, "ink"), key, "left")
    empty = F.coalesce("human", "llm", "ocr", "pdf", F.lit("")) == ""
    return j.withColumn("blank", F.coalesce(F.col("blank"), F.lit(False)) | (empty & F.coalesce(F.col("ink") < least, F.lit(False)))).drop("ink")


def row_bands(cells: DataFrame, rows: int | None = None) -> DataFrame:
    """Cells with bands (y0, y1): as many equal bands as a cell's longest layer has lines, or `rows`."""
    n = F.lit(rows) if rows else F.greatest(*[F.size(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\n+$", ""), "\n")) for c in ("human", "llm", "ocr")])
    h = (F.col("y2") - F.col("y1")) / F.col("__n")
    return cells.withColumn("__n", n).withColumn("bands", F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.struct((F.col("y1") + i * h).alias("y0"), (F.col("y1") + (i + 1) * h).alias("y1")))).drop("__n")


def schema_issues(text: Column, schema: dict) -> Column:
    """What a JSON text lacks of a schema's required fields and types, as paths; unions of types aren't checked."""
    paths: list[tuple[str, str, bool]] = []

    def walk(node: dict, path: str) -> None:
        for name, sub in (node.get("properties") or {}).items():
            kind = sub.get("type")
            at = f"{path}.{name}"
            paths.append((at, kind if isinstance(kind, str) else "", name in (node.get("required") or [])))
            if kind == "object":
                walk(sub, at)

    walk(schema, "$")
    numeric, checks = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$", []
    for at, kind, needed in paths:
        v = F.get_json_object(text, at)
        fits = {"integer": v.rlike(r"^-?\d+$"), "number": v.rlike(numeric), "boolean": v.isin("true", "false"), "array": v.startswith("["), "object": v.startswith("{")}.get(kind, F.lit(True))
        checks.append(F.when(v.isNull(), F.lit(f"{at}: missing") if needed else None).when(~fits, F.lit(f"{at}: not {kind}")))
    valid = F.try_parse_json(text).isNotNull()
    found = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")
    return F.when(valid, found).otherwise(F.array(F.lit("$: not JSON")))


def finite(c: Column, kind=None) -> Column:
    """A number, or null where it is not finite; with `kind`, its Spark type, the same for all numbers within arrays, maps and structs."""
    from pyspark.sql import types as T

    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: finite(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[finite(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if kind is not None and not isinstance(kind, (T.DoubleType, T.FloatType)):
        return c
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
