"""Reading and writing page documents and the tables made of them.

Unreadable pages are skipped and can be listed; empty folders give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import natural_key, page_status

TEXT = "struct<human_corrected_text:string>"
ROW = "struct<y0:double,y1:double,human:string,llm:string,ocr:string,pdf:string,blank:boolean>"
SHAPE = f"struct<label:string,points:array<array<double>>,group_id:bigint,continuation:boolean,group_locked:boolean,score:double,super_row:int,super_column:int,`table`:int,blank:boolean,human_output:{TEXT},ocr_output:struct<tesseract:string,easyocr:string>,llm_output:struct<text:string>,pdf_text:string,row_struct:struct<rows:array<{ROW}>>>"
PAGE = f"version string, flags struct<status:string>, shapes array<{SHAPE}>, imagePath string, imageWidth int, imageHeight int, _corrupt_record string"


def read_pages(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Page documents of a folder, one per file, with path, stem and sort_key. Hidden files are not read; broken ones have no shapes and keep their text in _corrupt_record."""
    r = spark.read.schema(PAGE).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", recursive).option("pathGlobFilter", "[!.]*.json")
    d = r.json(folder).withColumn("path", F.col("_metadata.file_path"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "")
    return d.withColumn("stem", stem).withColumn("sort_key", natural_key(stem))


def page_list(pages: DataFrame) -> DataFrame:
    """(stem, sort_key, status, boxes): every readable page with its status and how many boxes it has."""
    return pages.where("_corrupt_record is null").select("stem", "sort_key", page_status(F.col("flags.status")).alias("status"), F.coalesce(F.size("shapes"), F.lit(0)).alias("boxes"))


def read_boxes(pages: DataFrame) -> DataFrame:
    """(stem, idx, label, box, lattice, layers): the boxes of pages; those with fewer than two points are left out."""
    b = pages.where("_corrupt_record is null").select("stem", F.posexplode("shapes").alias("idx", "s")).where("size(s.points) >= 2")
    xs, ys = F.transform("s.points", lambda p: p[0]), F.transform("s.points", lambda p: p[1])
    return b.select(
        "stem", "idx", "s.label", F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"), "s.super_row", "s.super_column", "s.table", "s.score", "s.group_id", "s.continuation", "s.group_locked", "s.blank",
        F.col("s.human_output.human_corrected_text").alias("human"), F.col("s.llm_output.text").alias("llm"), F.coalesce("s.ocr_output.tesseract", "s.ocr_output.easyocr").alias("ocr"), F.col("s.pdf_text").alias("pdf"),
    )


def write_pages(pages: DataFrame, folder: str, partition: str | None = None) -> None:
    """Pages as JSON lines. Spark's commit makes the write atomic; unchanged pages should be filtered out before."""
    w = pages.drop("_corrupt_record").write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).json(folder)


def slim_parents(pages: DataFrame, label: str) -> DataFrame:
    """Pages with the boxes of one label only; skipped pages are left out."""
    keep = pages.where(page_status(F.col("flags.status")) != "skip")
    return keep.withColumn("shapes", F.filter("shapes", lambda s: s["label"] == label))


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)


def markdown_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """(value): a table as Markdown rows, each partition with its heading."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([|])", r"\\$1") for c in columns]), F.lit(" |"))
    heading = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]

    def with_heading(batches):
        import pandas as pd

        began = False
        for b in batches:
            if len(b):
                yield b if began else pd.concat([pd.DataFrame({"value": heading}), b])
                began = True

    return df.select(row.alias("value")).mapInPandas(with_heading, "value string")


def write_markdown(df: DataFrame, folder: str, columns: list[str]) -> None:
    """A table as Markdown, one file per partition, each with its heading."""
    markdown_lines(df, columns).write.mode("overwrite").text(folder)


def flow_markdown(boxes: DataFrame, page: list[str]) -> DataFrame:
    """(page..., text): the boxes of each page in flow order as Markdown, titles as headings; boxes without text are left out."""
    line = F.when(F.col("label") == "title", F.concat(F.lit("## "), "text")).otherwise(F.col("text"))
    b = boxes.where(F.coalesce(F.trim("text"), F.lit("")) != "")
    return b.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("flow_order", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("text"))


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def detector_metrics(lines: DataFrame) -> DataFrame:
    """(metric, value) of the last line of a training log that holds an evaluation, finite values only. `lines` is (line_no, value)."""
    j = lines.select("line_no", F.from_json("value", "map<string,double>", {"mode": "PERMISSIVE"}).alias("m")).where("exists(map_keys(m), k -> k like 'bbox/%')")
    last = j.agg(F.max_by("m", "line_no").alias("m"))
    return last.select(F.explode("m").alias("metric", "value")).where("value is not null and not isnan(value) and abs(value) < double('infinity')")
