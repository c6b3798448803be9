"""A project's table and what surrounds it: payloads, edits of columns and rules, the audit's tail, snapshots, deletions that can be undone, fragments that may be replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerloom.runtime import cut

# The layers of a box that count as content, and how far an edge may be off for a box to be the same.
CONTENT = "human_output human_correction openai_output ocr_output tesseract_output easyocr_output pdf_text row_struct authority structured clip crop_origin".split()
SAME_BOX = 0.5
OPERATORS = ("=", ">=", "<=")


def payload(cells: DataFrame, rows: DataFrame, include_deleted: bool = False) -> DataFrame:
    """(row_id, cells): each row's cells by column; what a cell was before and where it is from go along only where it was edited.

    A row's cells are as many as the table has columns.
    """
    c = cells if include_deleted else cells.join(rows.where("is_deleted = 0").select("row_id"), "row_id", "left_semi")
    edited = (F.coalesce("original_value", F.lit("")) != "") & ~F.col("original_value").eqNullSafe(F.col("value"))
    one = F.struct(F.col("value"), F.when(edited, F.col("original_value")).alias("original_value"), F.when(edited, F.col("source")).alias("source"))
    return c.groupBy("row_id", "col_id").agg(F.max_by(one, F.struct("updated_at", "cell_id")).alias("cell")).groupBy("row_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("col_id", "cell")))).alias("cells"))


def ordered(rows: DataFrame, columns: DataFrame, include_deleted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, columns) in the order of their positions, those without one last; deleted rows only if asked for."""
    r = rows if include_deleted else rows.where("is_deleted = 0")
    return r.orderBy(F.col("position").asc_nulls_last(), "row_id"), columns.orderBy(F.col("position").asc_nulls_last(), "col_id")


def edited_columns(columns: DataFrame, edits: DataFrame, table: list[str]) -> tuple[DataFrame, DataFrame]:
    """(columns, refused): columns with new names, variables and roles from `edits` (table..., col_id, name, variable, role), null leaving them.

    A variable that another column of the table has, or gets by an edit before in the order of col_id, is refused; the edit's other fields hold.
    """
    e = edits.select(*table, "col_id", F.col("name").alias("__n"), F.col("variable").alias("__v"), F.col("role").alias("__r"))
    j = columns.join(e, [*table, "col_id"], "left")
    taken = columns.select(*table, F.col("col_id").alias("__o"), F.col("variable").alias("__v")).where("__v is not null")
    asked = e.where("__v is not null").select(*table, "col_id", "__v")
    clash = asked.join(taken, [*table, "__v"]).where("__o <> col_id").select(*table, "col_id").distinct()
    later = asked.withColumn("__k", F.row_number().over(W.partitionBy(*table, "__v").orderBy("col_id"))).where("__k > 1").select(*table, "col_id")
    bad = clash.unionByName(later).distinct().withColumn("__bad", F.lit(True))
    j = j.join(bad, [*table, "col_id"], "left")
    free = F.when(F.col("__bad").isNull(), F.col("__v"))
    out = j.withColumns({"name": F.coalesce("__n", "name"), "variable": F.coalesce(free, F.col("variable")), "role": F.coalesce("__r", "role")}).select(*columns.columns)
    return out, j.where("__bad and __v is not null").select(*table, "col_id", F.col("__v").alias("variable"))


def with_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """`rules` (rule_id, label, lhs, operator, rhs, tolerance, severity) with new ones, numbered on from the greatest id; an operator not known is '='."""
    top = rules.agg(F.coalesce(F.max("rule_id"), F.lit(0)).alias("__m"))
    op = F.when(F.col("operator").isin(*OPERATORS), F.col("operator")).otherwise("=")
    # Rules are written by people, so there are few.
    n = new.withColumn("operator", op).withColumn("__k", F.row_number().over(W.orderBy("label", "lhs", "operator", "rhs"))).join(F.broadcast(top)).withColumn("rule_id", (F.col("__m") + F.col("__k")).cast(dict(rules.dtypes)["rule_id"]))
    return rules.unionByName(n.select(*rules.columns))


def without_rules(rules: DataFrame, gone: DataFrame) -> DataFrame:
    return rules.join(gone.select("rule_id").distinct(), "rule_id", "left_anti")


def audit_tail(audit: DataFrame, limit: int = 1000) -> DataFrame:
    """The last `limit` entries, the newest first; the limit is what the report asks for."""
    return audit.orderBy(F.col("log_id").desc()).limit(limit)


def snapshot(df: DataFrame, folder: str, name: str) -> DataFrame:
    """A table kept as it is before it is changed, and read from what was kept."""
    df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def deleted(pages: DataFrame, gone: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pages, undo): pages marked deleted, and what brings back exactly the status each had."""
    g = gone.select(*key).distinct().withColumn("__g", F.lit(True))
    j = pages.join(g, key, "left")
    hit = F.col("__g").isNotNull() & ~F.coalesce(F.col("status") == "deleted", F.lit(False))
    return j.withColumn("status", F.when(hit, "deleted").otherwise(F.col("status"))).select(*pages.columns), j.where(hit).select(*key, "status")


def undone(pages: DataFrame, undo: DataFrame, key: list[str]) -> DataFrame:
    u = undo.select(*key, F.col("status").alias("__s"), F.lit(True).alias("__u"))
    j = pages.join(u, key, "left")
    return j.withColumn("status", F.when(F.col("__u"), F.col("__s")).otherwise(F.col("status"))).select(*pages.columns)


def edited_row(rows: Column, k: int, field: str, value: Column) -> Column:
    """A box's rows with one field of the row at `k` set; a place it doesn't have changes nothing."""
    return F.transform(rows, lambda r, i: F.when(i == k, r.withField(field, value)).otherwise(r))


def flat_of_rows(rows: Column, field: str) -> Column:
    """The flat layer that belongs to a box's rows: their texts, one a line."""
    return F.array_join(F.transform(rows, lambda r: F.coalesce(r[field], F.lit(""))), "\n")


def topic_summaries(topics: DataFrame, notes: DataFrame) -> DataFrame:
    """(id, title, updated, n_notes): each topic with the time of its last change and the number of its notes."""
    n = notes.groupBy(F.col("topic").alias("id")).agg(F.count("*").alias("n_notes"), F.max("updated").alias("__u"))
    return topics.join(n, "id", "left").select("id", F.coalesce("title", F.lit("")).alias("title"), F.greatest("created", "__u").alias("updated"), F.coalesce("n_notes", F.lit(0).cast("bigint")).alias("n_notes"))


def in_pages(df: DataFrame, pattern: str | None, stem: str = "stem") -> DataFrame:
    """The rows of the pages whose stem a pattern finds; without one all."""
    return df.where(F.col(stem).rlike(pattern)) if pattern else df


# ---- derived fragments


def has_content(layers: list[str], kinds: dict[str, str]) -> Column:
    """Whether a person or a model put anything on a box: a layer that says something, or a flag."""
    said = F.coalesce(F.col("blank"), F.lit(False)) | F.coalesce(F.col("cross_page"), F.lit(False))
    for c in layers:
        k = kinds[c]
        full = F.length(c) > 0 if k == "string" else F.size(c) > 0 if k.startswith(("array", "map")) else F.col(c).isNotNull()
        said = said | F.coalesce(full, F.lit(False))
    return said


def is_replaceable(boxes: DataFrame) -> Column:
    """Whether a rerun may replace a box: derived, still where and as it was put, not locked, and without content.

    `boxes` has box and derived_box (arrays of four), continuation, derived_continuation, locked, blank, cross_page and any of the content layers.
    """
    same = (F.size("box") == 4) & (F.size("derived_box") == 4) & ~F.exists(F.zip_with("box", "derived_box", lambda a, b: F.coalesce(F.abs(a - b) > SAME_BOX, F.lit(True))), lambda x: x)
    cont = F.coalesce("continuation", F.lit(False)) == F.coalesce("derived_continuation", F.lit(False))
    layers = [c for c in CONTENT if c in boxes.columns]
    return F.col("derived_box").isNotNull() & F.coalesce(same, F.lit(False)) & cont & ~F.coalesce("locked", F.lit(False)) & ~has_content(layers, dict(boxes.dtypes))


def crop_diff(wanted: DataFrame, derived: DataFrame, key: list[str], policy: str = "replace") -> DataFrame:
    """(key..., action, reason, protected): what becomes of each derived crop.

    `wanted` has owner, box, framing (arrays of four) and fields of each crop there should be, `derived` the same as they were, with
    worked_on. Actions: created, unchanged, refreshed (fields alone moved), replaced or kept (stale: no_provenance, foreign, moved or reframed), vanished.
    What was worked on is kept unless the policy is 'force'; the policy 'keep' keeps all.
    """
    if policy not in ("replace", "keep", "force"):
        raise ValueError(f"no such policy: {policy!r}")
    w = wanted.select(*key, *[F.col(c).alias(f"w_{c}") for c in ("owner", "box", "framing", "fields")], F.lit(True).alias("w"))
    d = derived.select(*key, *[F.col(c).alias(f"d_{c}") for c in ("owner", "box", "framing", "fields")], F.coalesce("worked_on", F.lit(False)).alias("worked_on"), F.lit(True).alias("d"))
    near = lambda c: F.coalesce(~F.exists(F.zip_with(f"w_{c}", f"d_{c}", lambda a, b: F.coalesce(F.abs(a - b) > SAME_BOX, F.lit(True))), lambda x: x), F.lit(False))
    j = w.join(d, key, "full_outer")
    reason = F.when(F.col("w").isNull() | F.col("d").isNull(), None).when(F.col("d_owner").isNull(), "no_provenance").when(F.col("w_owner") != F.col("d_owner"), "foreign").when(~near("box"), "moved").when(~near("framing"), "reframed")
    keeps = F.lit(True) if policy == "keep" else F.lit(False) if policy == "force" else F.col("worked_on")
    action = F.when(F.col("d").isNull(), "created").when(F.col("w").isNull(), "vanished").when(F.col("reason").isNotNull() & keeps, "kept").when(F.col("reason").isNotNull(), "replaced").when(F.col("w_fields").eqNullSafe(F.col("d_fields")), "unchanged").otherwise("refreshed")
    return j.withColumn("reason", reason).select(*key, action.alias("action"), "reason", F.when(F.col("reason").isNotNull(), F.col("worked_on")).alias("protected"))
