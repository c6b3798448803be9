"""Predictions against what people drew or read: matching of boxes, corrections, accuracy of cells, alignment of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import geometry
from ledgerloom.runtime import by_group

MATCH, TIGHT = 0.5, 0.9


def matched_boxes(truth: DataFrame, predicted: DataFrame, page: list[str], least: float = MATCH) -> DataFrame:
    """(page..., label, truth_idx, predicted_idx, iou): boxes of one label matched greedily, the greatest overlap first, ties by index.

    Only overlapping pairs reach the greedy scan of their page and label.
    """
    pairs = geometry.box_pairs(truth, predicted, page).where(F.col("a_label").eqNullSafe(F.col("b_label"))).withColumn("iou", geometry.iou()).where(F.col("iou") >= least)
    pairs = pairs.select(*page, F.coalesce("a_label", F.lit("")).alias("label"), F.col("a_idx").alias("truth_idx"), F.col("b_idx").alias("predicted_idx"), "iou")

    def greedy(rows: list[dict]) -> list[dict]:
        g, p, keep = set(), set(), []
        for r in sorted(rows, key=lambda r: (-r["iou"], r["truth_idx"], r["predicted_idx"])):
            if r["truth_idx"] not in g and r["predicted_idx"] not in p:
                g.add(r["truth_idx"])
                p.add(r["predicted_idx"])
                keep.append(r)
        return keep

    return by_group(pairs, [*page, "label"], [], greedy, "truth_idx int, predicted_idx int, iou double")


def corrections(truth: DataFrame, predicted: DataFrame, page: list[str]) -> DataFrame:
    """(page..., label, ok, moved, added, deleted): what a person had to do to the predictions of each page and label."""
    m = matched_boxes(truth, predicted, page)
    hit = m.groupBy(*page, "label").agg(F.sum((F.col("iou") >= TIGHT).cast("bigint")).alias("ok"), F.sum((F.col("iou") < TIGHT).cast("bigint")).alias("moved"))
    count = lambda d, n: d.groupBy(*page, F.coalesce("label", F.lit("")).alias("label")).agg(F.count("*").alias(n))
    j = count(truth, "t").join(count(predicted, "p"), [*page, "label"], "full_outer").join(hit, [*page, "label"], "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return j.select(*page, "label", z("ok").alias("ok"), z("moved").alias("moved"), (z("t") - z("ok") - z("moved")).alias("added"), (z("p") - z("ok") - z("moved")).alias("deleted"))


def corrections_rollup(per_page: DataFrame, stem: str, label: str = "label") -> DataFrame:
    """Corrections per page and label, per page, and in all, in one pass."""
    return per_page.rollup(stem, label).agg(*[F.sum(c).alias(c) for c in ("ok", "moved", "added", "deleted")], F.grouping_id().alias("level"))


def moving_corrections(log: DataFrame, by: list[str], last: int = 20) -> DataFrame:
    """(by..., pages, mean): the mean of the `last` entries of a log in which the entry written last for a stem counts."""
    w = W.partitionBy(*by, "stem").orderBy(F.col("ts").desc(), F.col("n").desc())
    one = log.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    recent = one.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(F.col("ts").desc(), F.col("stem").desc())))
    return recent.groupBy(*by).agg(F.count("*").alias("pages"), F.avg(F.when(F.col("__k") <= last, F.col("n"))).alias("mean"))


def cell_accuracy(cells: DataFrame, by: list[str], truth: Column, got: Column) -> DataFrame:
    """(by..., exact, near, wrong, missing) of verified cells; near is one character away."""
    t, g = F.trim(truth), F.trim(got)
    kind = F.when(F.coalesce(g, F.lit("")) == "", "missing").when(t == g, "exact").when(F.levenshtein(t, g) <= 1, "near").otherwise("wrong")
    c = cells.where(F.coalesce(t, F.lit("")) != "").withColumn("__k", kind)
    return c.groupBy(*by).agg(*[F.sum((F.col("__k") == k).cast("bigint")).alias(k) for k in ("exact", "near", "wrong", "missing")])


def line_distance(a: Column, b: Column) -> Column:
    """The mean square distance of two texts line by line: of numbers their relative difference, of others the share of characters edited."""
    x, y = F.split(F.coalesce(a, F.lit("")), "\n"), F.split(F.coalesce(b, F.lit("")), "\n")

    def far(u: Column, v: Column) -> Column:
        u, v = F.coalesce(u, F.lit("")), F.coalesce(v, F.lit(""))
        n, m = u.try_cast("double"), v.try_cast("double")
        text = F.coalesce(F.try_divide(F.levenshtein(u, v), F.greatest(F.length(u), F.length(v))), F.lit(0.0))
        return F.when(n.isNotNull() & m.isNotNull(), F.coalesce(F.try_divide(F.abs(n - m), F.greatest(F.abs(n), F.abs(m))), F.lit(0.0))).otherwise(text)

    d = F.zip_with(x, y, far)
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v) / F.size(d)


def aligned_rows(gold: DataFrame, got: DataFrame, table: list[str], key: str, order: str) -> DataFrame:
    """(table..., gold_pos, got_pos): rows of two tables paired by their longest common runs of keys, the rest by position."""
    kinds = dict(gold.dtypes)

    def align(left, right):
        from difflib import SequenceMatcher

        import pandas as pd

        left, right = left.sort_values(order), right.sort_values(order)
        a, b = left[key].fillna("").tolist(), right[key].fillna("").tolist()
        pairs, used_a, used_b = [], set(), set()
        for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
            for k in range(m.size):
                pairs.append((m.a + k, m.b + k))
                used_a.add(m.a + k)
                used_b.add(m.b + k)
        rest_a, rest_b = [i for i in range(len(a)) if i not in used_a], [j for j in range(len(b)) if j not in used_b]
        pairs += list(zip(rest_a, rest_b))
        out = pd.DataFrame(sorted(pairs), columns=["gold_pos", "got_pos"])
        src = left if len(left) else right
        for k in reversed(table):
            out.insert(0, k, src[k].iloc[0])
        return out

    return gold.groupBy(*table).cogroup(got.groupBy(*table)).applyInPandas(align, ", ".join(f"{k} {kinds[k]}" for k in table) + ", gold_pos int, got_pos int")


def merged_children(old: DataFrame, new: DataFrame, page: list[str], allowed: Column | None = None) -> DataFrame:
    """Pages' boxes where predicted children (with a score) give way to new ones on the pages the new ones come for; drawn boxes stay."""
    pages = new.select(*page).distinct()
    stay = old.join(pages.withColumn("__p", F.lit(True)), page, "left").where(F.col("score").isNull() | F.col("__p").isNull()).drop("__p")
    fresh = new if allowed is None else new.where(allowed)
    return stay.unionByName(fresh, allowMissingColumns=True)


def merged_labels(old: DataFrame, new: DataFrame, page: list[str], labels: list[str]) -> DataFrame:
    """Boxes where those of `labels` give way to the new ones, which stand where the first that went stood."""
    going = old.where(F.col("label").isin(labels))
    at = going.groupBy(*page).agg(F.min("idx").alias("__at"))
    placed = new.where(F.col("label").isin(labels)).join(at, page, "left").withColumn("__o", F.coalesce("__at", F.lit(1 << 30))).withColumn("__n", F.lit(1)).drop("__at")
    kept = old.join(going.select(*page, "idx"), [*page, "idx"], "left_anti").withColumn("__o", F.col("idx")).withColumn("__n", F.lit(0))
    every = kept.unionByName(placed, allowMissingColumns=True)
    return every.withColumn("idx", (F.row_number().over(W.partitionBy(*page).orderBy("__o", "__n", "idx", "x1")) - 1).cast("int")).drop("__o", "__n")


def page_hash(boxes: DataFrame, page: list[str]) -> DataFrame:
    """(page..., hash): a hash of labels and corners to a tenth, whatever the order of the boxes."""
    one = F.concat_ws(",", F.coalesce("label", F.lit("")), *[F.bround(c, 1).cast("string") for c in geometry.BOX])
    return boxes.groupBy(*page).agg(F.sha1(F.array_join(F.array_sort(F.collect_list(one)), ";")).alias("hash"))


def drift(frozen: DataFrame, now: DataFrame, page: list[str]) -> DataFrame:
    """(page..., state): which pages of a frozen set are unchanged, changed or missing."""
    j = frozen.select(*page, F.col("hash").alias("__h")).join(page_hash(now, page), page, "left")
    return j.select(*page, F.when(F.col("hash").isNull(), "missing").when(F.col("hash") == F.col("__h"), "unchanged").otherwise("changed").alias("state"))


def changed_pages(before: DataFrame, after: DataFrame, page: list[str]) -> DataFrame:
    """(page...) whose multiset of boxes differs, by hashes and not by sorting boxes against each other."""
    a, b = page_hash(before, page), page_hash(after, page).withColumnRenamed("hash", "h2")
    return a.join(b, page, "full_outer").where(~F.col("hash").eqNullSafe(F.col("h2"))).select(*page)
