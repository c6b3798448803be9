"""Edits as new versions: a table overlaid with changes, an audit of what changed, entities minted, slices and edges added.

An edit of a row that isn't there changes nothing; of several edits of one cell the last counts; repeated edges and
slices are kept once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerloom.operators.history import circles
from ledgerloom.runtime import cut, ranked


def overlaid(rows: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """`rows` with the values of `changes` (key..., ts, columns...); a null in a change leaves the value."""
    w = W.partitionBy(*key).orderBy(F.col("ts").desc())
    last = changes.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    j = rows.join(last, key, "left")
    return j.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*rows.columns)


def edited_cells(cells: DataFrame, edits: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cells, audit): cells with edited values; the original value is kept from the first edit on, and each change is a row of the audit."""
    w = W.partitionBy(*key).orderBy(F.col("ts").desc())
    last = edits.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*key, F.col("value").alias("__v"), F.col("ts").alias("__ts"))
    j = cells.join(last, key, "left").withColumn("__c", F.coalesce(F.col("__v") != F.coalesce("value", F.lit("")), F.lit(False)))
    audit = j.where("__c").select(*key, F.col("value").alias("old"), F.col("__v").alias("new"), F.col("__ts").alias("ts"))
    out = j.withColumn("original_value", F.when(F.col("__c"), F.coalesce("original_value", "value")).otherwise(F.col("original_value"))).withColumn("value", F.when(F.col("__c"), F.col("__v")).otherwise(F.col("value")))
    return out.select(*cells.columns), audit


def renamed_label(boxes: DataFrame, old: str, new: str) -> DataFrame:
    """Boxes with a label renamed; renaming onto a label that exists merges the two."""
    return boxes.withColumn("label", F.when(F.col("label") == old, new).otherwise(F.col("label")))


def cleared(boxes: DataFrame, layers: list[str], labels: list[str] | None = None, columns: list[int] | None = None) -> DataFrame:
    """Boxes without the text of some layers, of some labels and columns only where those are named; free boxes have no column and are always taken."""
    hit = F.lit(True)
    if labels:
        hit = hit & F.col("label").isin(labels)
    if columns:
        hit = hit & (F.col("super_column").isNull() | F.col("super_column").isin(columns))
    return boxes.withColumns({c: F.when(~hit, F.col(c)) for c in layers})


def accepted(boxes: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """Boxes with reviewed values in the human layer; an empty value marks the box blank. The state before is kept for an exact undo."""
    d = decisions.select(*key, F.col("value").alias("__v"))
    j = boxes.join(d, key, "left")
    seen = F.col("__v").isNotNull()
    before = F.when(seen, F.struct(F.col("human").alias("human"), F.col("blank").alias("blank")))
    return j.withColumn("previous", before).withColumn("blank", F.when(seen, F.col("__v") == "").otherwise(F.col("blank"))).withColumn("human", F.when(seen & (F.col("__v") != ""), F.col("__v")).when(seen, None).otherwise(F.col("human"))).drop("__v")


def with_status(pages: DataFrame, chosen: DataFrame, key: list[str], status: str, keep: list[str] = ()) -> DataFrame:
    """`pages` with one status for the chosen ones; those whose present status is in `keep` are left as they are."""
    c = chosen.select(*key).distinct().withColumn("__c", F.lit(True))
    now = F.coalesce("status", F.lit("predicted"))
    hit = F.col("__c").isNotNull() & ~now.isin(list(keep)) if keep else F.col("__c").isNotNull()
    return pages.join(c, key, "left").withColumn("status", F.when(hit, status).otherwise(F.col("status"))).select(*pages.columns)


def _padded(number, width: int):
    """A number with noughts before it; one that is longer keeps its digits."""
    return F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0"))


def minted(records: DataFrame, entities: DataFrame, prefix: str, width: int, order: list[str]) -> DataFrame:
    """`records` with a new entity id each, going on from the greatest there is, and namesakes: the entities of exactly that name."""
    top = entities.where(F.col("id").startswith(prefix)).agg(F.coalesce(F.max(F.substring("id", len(prefix) + 1, 30).try_cast("bigint")), F.lit(0)).alias("__m"))
    same = entities.groupBy("name").agg(F.array_sort(F.collect_set("id")).alias("namesakes"))
    n = ranked(records, order, "__k").join(F.broadcast(top)).withColumn("id", F.concat(F.lit(prefix), _padded((F.col("__m") + F.col("__k")).cast("string"), width)))
    return n.join(same, "name", "left").withColumn("namesakes", F.coalesce("namesakes", F.array().cast("array<string>"))).drop("__m", "__k")


def attached(slices: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Slices with new ones; one of the same key takes the place of the old."""
    both = slices.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(*key).orderBy(F.col("__n").desc(), F.col("recorded_at").desc())
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__n", "__r")


def with_edges(edges: DataFrame, new: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """(edges, refused): edges with new ones of known types between two entities, each once; of the new duplicate_of edges that close a circle, with old
    edges or with each other, the last one is refused."""
    n = new.where(F.col("type").isin(types) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & (F.col("from_id") != F.col("to_id"))).dropDuplicates(["from_id", "to_id", "type"])
    good = cut(n.join(edges.select("from_id", "to_id", "type").distinct(), ["from_id", "to_id", "type"], "left_anti").select(*edges.columns))
    refused = good.limit(0)
    # Each id has one edge that counts, so a circle is opened by taking out one; what then counts instead is looked at again.
    while True:
        on = circles(edges.unionByName(good))
        a, b = on.select(F.col("id").alias("from_id"), F.col("circle").alias("__f")), on.select(F.col("id").alias("to_id"), F.col("circle").alias("__t"))
        met = good.where("type = 'duplicate_of'").join(a, "from_id").join(b, "to_id").where("__f = __t")
        last = cut(met.withColumn("__r", F.row_number().over(W.partitionBy("__f").orderBy(F.col("ts").desc(), F.col("from_id").desc(), F.col("to_id").desc()))).where("__r = 1").select(*edges.columns))
        if last.limit(1).count() == 0:
            return edges.unionByName(good), refused
        good, refused = cut(good.join(last.select("from_id", "to_id", "type"), ["from_id", "to_id", "type"], "left_anti").select(*edges.columns)), refused.unionByName(last)


def unmerged(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """`edges` without the duplicate_of edges between the pairs (a, b), in either direction: what was folded stands alone again."""
    p = pairs.select(F.least("a", "b").alias("__a"), F.greatest("a", "b").alias("__b")).distinct()
    taken = edges.where("type = 'duplicate_of'").join(p, (F.least("from_id", "to_id") == F.col("__a")) & (F.greatest("from_id", "to_id") == F.col("__b")), "left_semi").select("from_id", "to_id", "type").distinct()
    return edges.join(taken, ["from_id", "to_id", "type"], "left_anti").select(*edges.columns)


def merged_entities(pairs: DataFrame) -> DataFrame:
    """(from_id, to_id, type): the edges that fold pairs of entities into one; the lesser id survives."""
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("from_id"), F.least("a", "b").alias("to_id"), F.lit("duplicate_of").alias("type")).distinct()


def reordered(rows: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Rows with the positions a list (key, position) gives; rows it doesn't name keep theirs."""
    return rows.join(order.select(key, F.col("position").alias("__p")), key, "left").withColumn("position", F.coalesce(F.col("__p").cast("double"), F.col("position"))).drop("__p")


def decisions(records: DataFrame, proposed: DataFrame) -> DataFrame:
    """Marks of records with proposals of a batch; what a person decided is never overwritten."""
    p = proposed.select("record", F.col("entity").alias("__e"), F.col("outcome").alias("__o"))
    j = records.join(p, "record", "left")
    free = (F.coalesce("source", F.lit("")) != "human") & F.col("__o").isNotNull()
    return j.withColumn("entity", F.when(free, F.col("__e")).otherwise(F.col("entity"))).withColumn("outcome", F.when(free, F.col("__o")).otherwise(F.col("outcome"))).withColumn("source", F.when(free, "auto").otherwise(F.col("source"))).drop("__e", "__o")


def applied_texts(cells: DataFrame, fixes: DataFrame, folded) -> DataFrame:
    """Cells with the entity a worklist gives to every occurrence of a folded text."""
    f = fixes.select(F.col("folded").alias("__f"), F.col("entity").alias("__e"))
    return cells.withColumn("__f", folded).join(f, "__f", "left").withColumn("entity", F.coalesce("__e", "entity")).drop("__f", "__e")
