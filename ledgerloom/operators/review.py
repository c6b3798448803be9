"""Review of cells and pages: votes, queues, scoreboards, filters of batches, caches of answers.

Layers are columns human, llm, ocr, pdf of text; a null or blank layer says nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import numbers, text
from ledgerloom.operators import diagnostics


def majority(cells: DataFrame, key: list[str], layers: list[str]) -> DataFrame:
    """(key..., value, votes): what most layers read; one layer alone wins, else two must agree and no other value have as many."""
    votes = F.filter(F.array(*[F.trim(c) for c in layers]), lambda v: F.coalesce(v, F.lit("")) != "")
    v = cells.select(*key, votes.alias("__v"))
    each = v.select(*key, F.size("__v").alias("__n"), F.explode("__v").alias("value")).groupBy(*key, "__n", "value").agg(F.count("*").alias("votes"))
    top = F.rank().over(W.partitionBy(*key).orderBy(F.col("votes").desc()))
    tied = F.count("*").over(W.partitionBy(*key, "__r"))
    best = each.withColumn("__r", top).withColumn("__t", tied).where((F.col("__r") == 1) & (F.col("__t") == 1) & ((F.col("votes") >= 2) | (F.col("__n") == 1)))
    return best.select(*key, "value", "votes")


def majority_rowwise(layers: list[Column]) -> Column:
    """`majority` of the layers of one row as an expression, without a shuffle."""
    votes = F.filter(F.array(*[F.trim(c) for c in layers]), lambda v: F.coalesce(v, F.lit("")) != "")
    counted = F.transform(F.array_distinct(votes), lambda v: F.struct(F.size(F.filter(votes, lambda x: x == v)).alias("n"), v.alias("v")))
    best = F.array_max(F.transform(counted, lambda c: c["n"]))
    top = F.filter(counted, lambda c: c["n"] == best)
    return F.when((F.size(top) == 1) & ((best >= 2) | (F.size(votes) == 1)), F.element_at(top, 1)["v"])


def queue(cells: DataFrame, key: list[str], value: str = "value", by: str = "variable") -> DataFrame:
    """(key..., reason, severity): cells whose layers disagree (4), that are outliers of their variable (3) or that nobody has read (1); a human value or a blank mark clears a cell."""
    openc = cells.where(text.filled(F.col("human")).isNull() & ~F.coalesce(F.col("blank"), F.lit(False)))
    disagree = openc.where(text.layers_disagree(F.col("ocr"), F.col("llm"))).select(*key, F.lit("layers disagree").alias("reason"), F.lit(4).alias("severity"))
    odd = diagnostics.outliers(openc.where(F.col(value).isNotNull()), by).where("severity = 'extreme'").select(*key, F.lit("outlier").alias("reason"), F.lit(3).alias("severity"))
    unread = openc.where(text.filled(F.col("llm")).isNull()).select(*key, F.lit("unverified").alias("reason"), F.lit(1).alias("severity"))
    return disagree.unionByName(odd).unionByName(unread)


def scoreboard(pages: DataFrame, by: list[str]) -> DataFrame:
    """(by..., predicted, in_progress, verified, skip, total_work): pages per status; skipped ones are no work."""
    s = text.page_status(F.col("status"))
    kinds = ("predicted", "in_progress", "verified", "skip")
    return pages.groupBy(*by).agg(*[F.sum((s == k).cast("bigint")).alias(k) for k in kinds], F.sum((s != "skip").cast("bigint")).alias("total_work"))


def batch_filter(cells: DataFrame, condition: str, row: list[str] | None = None) -> DataFrame:
    """The cells a batch condition takes: skip_blank, pdf_has_digits, pdf_has_chars, pdf_has_any, rows_llm_empty, ocr_row_minority."""
    pdf = F.coalesce("pdf", F.lit(""))
    plain = {
        "skip_blank": ~F.coalesce(F.col("blank"), F.lit(False)), "pdf_has_digits": pdf.rlike(r"\d"), "pdf_has_chars": pdf.rlike(r"\p{L}"), "pdf_has_any": F.trim(pdf) != "",
        "rows_llm_empty": text.filled(F.col("llm")).isNull(),
    }
    if condition in plain:
        return cells.where(plain[condition])
    if condition != "ocr_row_minority":
        raise ValueError(f"no such condition: {condition!r}")
    from ledgerloom.operators.ordered import line_mode

    return line_mode(cells.withColumn("__l", text.line_count(F.col("ocr"))), row or [], "__l").where("deviates").drop("__l", "usual", "deviates")


def search(boxes: DataFrame, query: str, layers: list[str], labels: list[str] | None, order: list[str], limit: int) -> DataFrame:
    """The first `limit` boxes, in order, that hold the query in one of the layers, each with truncated: whether there are more.

    A limit is what a search page asks for; `limit + 1` rows are ranked by a distributed top-k.
    """
    hit = F.lit(False)
    for c in layers:
        hit = hit | text.full_text_match(F.col(c), query)
    found = boxes.where(hit if not labels else hit & F.col("label").isin(labels))
    top = found.orderBy(*order).limit(limit + 1)
    w = W.orderBy(*order)
    return top.withColumn("__k", F.row_number().over(w)).withColumn("truncated", F.count("*").over(W.partitionBy(F.lit(1))) > limit).where(F.col("__k") <= limit).drop("__k")


def answer_key(model: Column, messages: Column, max_tokens: Column, temperature: Column, answer_format: Column) -> Column:
    """The key of a cached answer: the bare model name and all that shapes the answer. Nulls are told from empty texts."""
    bare = F.element_at(F.split(model, "/"), -1)
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in (bare, messages, max_tokens, temperature, answer_format)]), 256)


def from_cache(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): requests (key, ...) with their cached answer, and those to be asked."""
    return requests.join(cache.select("key", "answer"), "key"), requests.join(cache.select("key"), "key", "left_anti")


def label_use(boxes: DataFrame) -> DataFrame:
    """(label, pages, boxes): how often each label is used, the guard before one is deleted."""
    return boxes.groupBy("label").agg(F.countDistinct("stem").alias("pages"), F.count("*").alias("boxes"))


def score_filtered(boxes: DataFrame, least: float) -> DataFrame:
    """Boxes scored at least `least`; drawn ones have no score and stay."""
    return boxes.where(F.col("score").isNull() | (F.col("score") >= least))


def smart_corrected(cells: DataFrame, row: list[str], value: str) -> DataFrame:
    """`cells` where a cell one line longer than the shortest of its row loses a blank or dash line at its edge, the last one first."""
    ls = text.positioned_lines(F.col(value))
    shortest = F.min(F.size("__l")).over(W.partitionBy(*row))
    edge = lambda c: F.coalesce(c, F.lit("")).rlike(numbers.NOUGHT) | (F.coalesce(F.trim(c), F.lit("")) == "")
    c = cells.withColumn("__l", ls).withColumn("__s", shortest)
    n = F.size("__l")
    longer = (n == F.col("__s") + 1) & (n > 1)
    cut = F.when(longer & edge(F.try_element_at("__l", F.lit(-1))), F.slice("__l", F.lit(1), n - 1)).when(longer & edge(F.try_element_at("__l", F.lit(1))), F.slice("__l", F.lit(2), n - 1)).otherwise(F.col("__l"))
    return c.withColumn("corrected", F.array_join(cut, "\n")).drop("__l", "__s")
