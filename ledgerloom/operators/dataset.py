"""Records of a dataset from the slots of its declaration: positional, keyed and ratio joins, scopes by header, findings.

A join never drops silently: what doesn't fit comes out as a finding. Nulls in a key are findings, not matches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import fold


def sequence_numbers(cells: DataFrame, slot: list[str], order: list[str], separator: Column | None = None) -> DataFrame:
    """`cells` with seq, their position in the slot's column; separators keep a position of their own out of the count."""
    c = cells if separator is None else cells.where(~separator)
    return c.withColumn("seq", F.row_number().over(W.partitionBy(*slot).orderBy(*order)))


def positional_join(slots: dict[str, DataFrame], by: list[str], order: list[str], value: str, excluded: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, findings): the slots' cells joined where they have the same position.

    Rows that are excluded (printed totals and heads) keep their position in the join and leave the records after it. A slot
    that has another number of cells than the first is a finding.
    """
    out, counts = None, None
    for name, df in slots.items():
        flag = F.lit(False) if excluded is None else F.coalesce(excluded, F.lit(False))
        n = sequence_numbers(df.withColumn("__x", flag), by, order).select(*by, "seq", F.col(value).alias(name), F.col("__x").alias(f"__x_{name}"))
        c = n.groupBy(*by).agg(F.count("*").alias("n")).withColumn("slot", F.lit(name))
        counts = c if counts is None else counts.unionByName(c)
        out = n if out is None else out.join(n, [*by, "seq"], "full_outer")
    any_x = F.greatest(*[F.coalesce(f"__x_{k}", F.lit(False)) for k in slots]) if len(slots) > 1 else F.coalesce(f"__x_{next(iter(slots))}", F.lit(False))
    rec = out.where(~any_x).drop(*[f"__x_{k}" for k in slots])
    first = next(iter(slots))
    base = counts.where(F.col("slot") == first).select(*by, F.col("n").alias("expected"))
    bad = counts.join(base, by, "full_outer").where(~F.col("n").eqNullSafe(F.col("expected"))).select(*by, "slot", "n", "expected")
    return rec, bad


def keyed_join(left: DataFrame, right: DataFrame, key: str, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, findings): rows joined on their folded key text; keys that stand twice on a side are left out and reported, like those without a partner."""
    by = by or []
    k = [*by, "__k"]

    def side(df: DataFrame, name: str) -> DataFrame:
        d = df.withColumn("__k", F.nullif(fold(F.col(key)), F.lit("")))
        return d.withColumn("__c", F.count("*").over(W.partitionBy(*k))).withColumn("__s", F.lit(name))

    le, ri = side(left, "left"), side(right, "right")
    report = lambda d, why: d.select(*by, F.col(key).alias("key"), F.col("__s").alias("side"), F.lit(why).alias("finding"))
    good_l, good_r = le.where("__k is not null and __c = 1"), ri.where("__k is not null and __c = 1")
    rec = good_l.drop("__c", "__s").join(good_r.select(*k, *[F.col(c).alias(c if c not in left.columns else f"right_{c}") for c in right.columns if c not in by]), k).drop("__k")
    findings = report(le.where("__k is null"), "no key").unionByName(report(ri.where("__k is null"), "no key"))
    findings = findings.unionByName(report(le.where("__k is not null and __c > 1"), "ambiguous")).unionByName(report(ri.where("__k is not null and __c > 1"), "ambiguous"))
    findings = findings.unionByName(report(good_l.join(ri.select(*k), k, "left_anti"), "orphan")).unionByName(report(good_r.join(le.select(*k), k, "left_anti"), "orphan"))
    return rec, findings


def header_scopes(tables: DataFrame, declarations: list[dict], table: list[str], header: str = "headers") -> DataFrame:
    """(table..., declaration, status): the declaration whose patterns all match a header of the table; tables none or several claim are reported.

    `tables` has an array of header texts. Declarations are few and given; each is one expression, so no join is needed.
    """
    claims = []
    for d in declarations:
        hit = F.lit(True)
        for p in d["patterns"]:
            hit = hit & _any_header(header, p)
        claims.append(F.when(hit, F.lit(d["name"])))
    names = F.filter(F.array(*claims), lambda x: x.isNotNull())
    n = F.size("__n")
    return tables.withColumn("__n", names).select(*table, F.when(n == 1, F.element_at("__n", 1)).alias("declaration"), F.when(n == 0, "uncovered").when(n > 1, "several").otherwise("covered").alias("status"))


def _any_header(header: str, pattern: str) -> Column:
    return F.exists(header, lambda h: F.coalesce(fold(h).rlike(pattern), F.lit(False)))


def inherited_scopes(scopes: DataFrame, volume: list[str], order: list[str]) -> DataFrame:
    """`scopes` where a table without a header of its own has the declaration of the one before it in the volume."""
    w = W.partitionBy(*volume).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return scopes.withColumn("effective", F.coalesce("declaration", F.last("declaration", ignorenulls=True).over(w)))


def page_pattern(page_no: Column, pattern: list[int]) -> Column:
    """(applies, slot): whether a cyclic pattern of 1 and 0 takes a page, and which of its ones."""
    p = F.array(*[F.lit(x) for x in pattern])
    at = F.pmod(page_no, F.lit(len(pattern))).cast("int")
    ones = F.aggregate(F.slice(p, F.lit(1), at + 1), F.lit(0), lambda s, x: s + x)
    hit = F.get(p, at) == 1
    return F.struct(hit.alias("applies"), F.when(hit, ones - 1).alias("slot"))


def page_ranges(text: str, page: Column) -> Column:
    """Whether a page is in '1-3,7,-5,9-'; an empty text takes all."""
    parts = [x.strip() for x in (text or "").split(",") if x.strip()]
    out = None
    for part in parts:
        m = re.fullmatch(r"(\d*)\s*(-?)\s*(\d*)", part)
        if not m or not (m[1] or m[3]):
            raise ValueError(f"not a range of pages: {part!r}")
        lo, hi = (int(m[1]) if m[1] else None), (int(m[3]) if m[3] else None)
        hit = page == lo if not m[2] else (page >= lo if hi is None else page <= hi if lo is None else page.between(lo, hi))
        out = hit if out is None else out | hit
    return F.lit(True) if out is None else out


def suggested_identities(rows: DataFrame, names: list[str], tol: float = 0.51, share: float = 0.8, top: int = 2) -> DataFrame:
    """(total, parts, tested, held, share): runs of neighbouring columns that sum to another column in most rows, the best that share no column per total.

    All candidate sums are conditional counts of one aggregation over the rows.
    """
    runs = [(t, names[i:j]) for t in names for i in range(len(names)) for j in range(i + 2, len(names) + 1) if t not in names[i:j]]
    if not runs:
        return rows.sparkSession.createDataFrame([], "total string, parts array<string>, tested bigint, held bigint, share double")
    aggs = []
    for k, (t, ps) in enumerate(runs):
        known = F.col(t).isNotNull()
        for p in ps:
            known = known & F.col(p).isNotNull()
        s = sum((F.col(p) for p in ps[1:]), F.col(ps[0]))
        aggs += [F.sum(known.cast("bigint")).alias(f"n{k}"), F.sum((known & (F.abs(s - F.col(t)) <= tol)).cast("bigint")).alias(f"h{k}")]
    one = rows.agg(*aggs)
    each = F.array(*[F.struct(F.lit(t).alias("total"), F.array(*map(F.lit, ps)).alias("parts"), F.col(f"n{k}").alias("tested"), F.col(f"h{k}").alias("held")) for k, (t, ps) in enumerate(runs)])
    r = one.select(F.explode(each).alias("e")).select("e.*").withColumn("share", F.try_divide("held", "tested")).where(F.col("share") >= share)
    best = W.partitionBy("total").orderBy(F.col("share").desc(), F.size("parts").desc(), F.array_join("parts", ","))
    r = r.withColumn("__r", F.row_number().over(best))
    first = r.where("__r = 1").select("total", F.col("parts").alias("__f"))
    r = r.join(first, "total").where((F.col("__r") == 1) | ~F.arrays_overlap("parts", "__f"))
    return r.withColumn("__q", F.row_number().over(best)).where(F.col("__q") <= top).drop("__r", "__q", "__f")


def tidy(values: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """A long table (keys..., variable, value) as one row per record, ready for a CSV or Parquet sink."""
    return values.where(F.col("variable").isin(names)).groupBy(*keys).pivot("variable", names).agg(F.first("value"))
