"""Training sets and derived pages: what goes in, what changed, what is stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import page_status
from ledgerloom.runtime import ranked


def training_pages(pages: DataFrame, boxes: DataFrame, statuses: list[str], page: list[str]) -> DataFrame:
    """(page..., use): positive, negative (verified and empty), or why a page is left out. Skipped pages never go in."""
    n = boxes.groupBy(*page).agg(F.count("*").alias("__n"))
    s = page_status(F.col("status"))
    have = F.coalesce("__n", F.lit(0))
    use = F.when(s == "skip", "skipped").when(~s.isin(statuses) if statuses else F.lit(False), "status").when(have > 0, "positive").when(s == "verified", "negative").otherwise("empty")
    return pages.join(n, page, "left").select(*page, use.alias("use"))


def counts_by_source(pages: DataFrame) -> DataFrame:
    """Pages per status and source, per source, and in all, in one pass of grouping sets."""
    s = page_status(F.col("status")).alias("status")
    return pages.select("source", s).cube("source", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def coco(pages: DataFrame, boxes: DataFrame, labels: list[str], page: str = "stem") -> dict[str, DataFrame]:
    """The images, annotations and categories of a detection set, with ids from 1 in page order; boxes without area are dropped.

    Ids come from a distributed ranking, not from one ordered partition.
    """
    images = ranked(pages.select(page, "width", "height").distinct(), [page], "id").select("id", F.col(page).alias("file_name"), "width", "height")
    cats = pages.sparkSession.createDataFrame([(k, v) for k, v in enumerate(labels, 1)], "category_id int, label string")
    b = boxes.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).join(F.broadcast(cats), "label").join(images.select(F.col("id").alias("image_id"), F.col("file_name").alias(page)), page)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ann = ranked(b, ["image_id", "idx"], "id").select("id", "image_id", "category_id", F.array("x1", "y1", w, h).alias("bbox"), (w * h).alias("area"), F.lit(0).alias("iscrowd"))
    return {"images": images, "annotations": ann, "categories": cats.select(F.col("category_id").alias("id"), F.col("label").alias("name"))}


def derived_state(sources: DataFrame, derived: DataFrame, key: list[str], tol: float = 0.5) -> DataFrame:
    """(key..., state) of derived pages against their sources: created, unchanged, refreshed (framed anew), stale (its source is gone), protected (stale or moved but worked on by a person).

    `sources` has the box each key should have, `derived` the box it was made of, and has_human_work.
    """
    d = derived.select(*key, *[F.col(c).alias(f"__{c}") for c in ("x1", "y1", "x2", "y2")], "has_human_work")
    j = sources.join(d, key, "full_outer")
    same = F.lit(True)
    for c in ("x1", "y1", "x2", "y2"):
        same = same & (F.abs(F.col(c) - F.col(f"__{c}")) <= tol)
    gone, new, human = F.col("x1").isNull(), F.col("__x1").isNull(), F.coalesce("has_human_work", F.lit(False))
    state = F.when(new, "created").when(gone & human, "protected").when(gone, "stale").when(same, "unchanged").when(human, "protected").otherwise("refreshed")
    return j.select(*key, state.alias("state"))


def render_plan(pages: DataFrame, wanted: Column) -> DataFrame:
    """`pages` with plan: no_source, missing_pdf, no_image, altered, up_to_date or to_render, the first that holds."""
    plan = (
        F.when(F.col("pdf_source").isNull(), "no_source").when(~F.col("pdf_exists"), "missing_pdf").when(F.col("image_width").isNull(), "no_image")
        .when(F.abs(F.col("image_width") - F.col("width")) > 1, "altered").when(F.abs(F.coalesce("pdf_scale", F.lit(0.0)) - wanted) < 1e-4, "up_to_date").otherwise("to_render")
    )
    return pages.withColumn("plan", plan)


def render_scale(mode: str, value: float, page_px: Column) -> Column:
    """The scale a page is rendered at: given, by its longest edge in pixels, or native; kept within 0.5 and 12, four decimals."""
    raw = {"scale": F.lit(float(value)), "longest": F.try_divide(F.lit(float(value)), page_px), "native": F.col("native_scale")}[mode]
    return F.round(F.least(F.greatest(raw, F.lit(0.5)), F.lit(12.0)), 4)


def sync_state(local: DataFrame, remote: DataFrame, key: str = "path") -> DataFrame:
    """(path, state) of two manifests (path, hash): new, remote_only, identical or differing."""
    j = local.select(key, F.col("hash").alias("l")).join(remote.select(key, F.col("hash").alias("r")), key, "full_outer")
    return j.select(key, F.when(F.col("r").isNull(), "new").when(F.col("l").isNull(), "remote_only").when(F.col("l") == F.col("r"), "identical").otherwise("differing").alias("state"))


def not_imported(incoming: DataFrame, existing: DataFrame, key: str = "stem") -> DataFrame:
    """What of an inbox is not yet there."""
    return incoming.join(existing.select(key).distinct(), key, "left_anti")


def folders(files: DataFrame) -> DataFrame:
    """(folder, files, bytes) of the top folders of (path, length)."""
    return files.groupBy(F.element_at(F.split("path", "/"), 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def trash_entries(files: DataFrame) -> DataFrame:
    """(entry, files, bytes, changed): what lies in the trash, one row per top entry of (path, length, mtime), with its last change."""
    return files.groupBy(F.element_at(F.split("path", "/"), 1).alias("entry")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("mtime").alias("changed"))


def renumbered_tables(boxes: DataFrame, page: list[str], taken: DataFrame) -> DataFrame:
    """`boxes` whose table ids that `taken` (page..., table) already has get the next free numbers, in their order."""
    clash = boxes.select(*page, "table").distinct().where(F.col("table").isNotNull()).join(taken.select(*page, "table").distinct(), [*page, "table"], "left_semi")
    most = boxes.select(*page, "table").unionByName(taken.select(*page, "table")).groupBy(*page).agg(F.max("table").alias("__m"))
    new = clash.join(most, page).withColumn("__new", F.col("__m") + F.row_number().over(W.partitionBy(*page).orderBy("table"))).drop("__m")
    return boxes.join(new, [*page, "table"], "left").withColumn("table", F.coalesce("__new", "table").cast("int")).drop("__new")


def restorable(trash: DataFrame, live: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(restored, refused): what of the trash can come back, and what has a live namesake."""
    return trash.join(live.select(key), key, "left_anti"), trash.join(live.select(key), key, "left_semi")
