"""Checks of a dataset's numbers: identities, printed totals, ratios, distributions, trailing digits.

Values come as a long table (variable, value double, ... keys). A null value is untested; an empty table has no
findings; ties in order are broken by the keys the caller names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import numbers
from ledgerloom.runtime import cut, exact_quantiles

# The thresholds the checks are known by.
TOLERANCE, IQR_MILD, IQR_EXTREME, MAD_Z, MIN_N, ZERO_SHARE, DIGIT_EXCESS = 0.51, 1.5, 3.0, 3.5, 12, 0.5, 2
TRAILING = {"min_digits": 2, "min_n": 30, "alpha": 0.01, "min_ratio": 2.0, "expected": 1 / 9}
ESD = {"alpha": 0.05, "max_frac": 0.05}


def identities(rows: DataFrame, total: str, parts: list[str], tol: float = TOLERANCE) -> DataFrame:
    """`rows` with status (ok, mismatch, untestable), parts_sum, and the one cell whose single slip would explain a mismatch."""
    known = F.col(total).isNotNull()
    for p in parts:
        known = known & F.col(p).isNotNull()
    s = sum((F.col(p) for p in parts[1:]), F.col(parts[0])).cast("double")
    t = F.col(total).cast("double")
    status = F.when(~known, "untestable").when(F.abs(s - t) <= tol, "ok").otherwise("mismatch")
    txt = numbers.number_text
    options = [F.when(numbers.one_char_apart(txt(t), txt(s)), F.struct(F.lit(total).alias("variable"), s.alias("value")))]
    for p in parts:
        need = t - (s - F.col(p))
        options.append(F.when((need >= 0) & numbers.one_char_apart(txt(F.col(p).cast("double")), txt(need)), F.struct(F.lit(p).alias("variable"), need.alias("value"))))
    out = rows.withColumn("parts_sum", s).withColumn("status", status)
    fits = F.filter(F.array(*options), lambda x: x.isNotNull())
    return out.withColumn("culprit", F.when((F.col("status") == "mismatch") & (F.size(fits) == 1), F.element_at(fits, 1)))


def printed_totals(rows: DataFrame, group: list[str], order: list[str], is_total: str, variables: list[str], tol: float = TOLERANCE, min_match: float = 0.5) -> DataFrame:
    """For each total row the number of rows above it (since the last total) that it sums best, how many variables agree, and whether it is anchored.

    All suffix lengths are tried at once: the sum of the last K rows is a running sum from the total upwards, so one
    window gives every candidate and one aggregation picks the best, the shortest on ties.
    """
    by = W.partitionBy(*group).orderBy(*[F.col(c) for c in order])
    r = rows.withColumn("__seg", F.sum(F.col(is_total).cast("int")).over(by) - F.col(is_total).cast("int"))
    totals = r.where(is_total).select(*group, "__seg", *[F.col(c).alias(f"__o_{c}") for c in order], *[F.col(v).alias(f"__t_{v}") for v in variables])
    up = W.partitionBy(*group, "__seg").orderBy(*[F.col(c).desc() for c in order])
    data = r.where(~F.col(is_total)).withColumn("__k", F.row_number().over(up))
    for v in variables:
        data = data.withColumn(f"__s_{v}", F.sum(F.coalesce(F.col(v), F.lit(0)).cast("double")).over(up.rowsBetween(W.unboundedPreceding, 0)))
    joined = totals.join(data.select(*group, "__seg", "__k", *[f"__s_{v}" for v in variables]), [*group, "__seg"], "left")
    hits = sum((F.coalesce((F.abs(F.col(f"__s_{v}") - F.col(f"__t_{v}")) <= tol).cast("int"), F.lit(0)) for v in variables), F.lit(0))
    tested = sum((F.col(f"__t_{v}").isNotNull().cast("int") for v in variables), F.lit(0))
    keys = [*group, *[f"__o_{c}" for c in order]]
    best = joined.withColumn("m", hits).withColumn("tested", tested).groupBy(*keys).agg(F.max(F.struct("m", (-F.col("__k")).alias("nk"))).alias("b"), F.max("tested").alias("tested"))
    need = F.greatest(F.lit(3), F.ceil(F.col("tested") * min_match))
    return best.select(*group, *[F.col(f"__o_{c}").alias(c) for c in order], F.when(F.col("b.m") > 0, -F.col("b.nk")).alias("k"), F.coalesce(F.col("b.m"), F.lit(0)).alias("matches"), "tested", ((F.col("tested") > 0) & F.coalesce((F.col("b.m") > 0) & (F.col("b.m") >= need), F.lit(False))).alias("anchored"))


def ratio_bounds(rows: DataFrame, numerator: Column, denominator: Column, least: float | None, most: float | None) -> DataFrame:
    """`rows` with ratio and status (ok, low, high, untestable where the denominator is null or not positive)."""
    ratio = F.when(denominator > 0, F.try_divide(numerator, denominator))
    low = F.lit(False) if least is None else F.col("ratio") < least
    high = F.lit(False) if most is None else F.col("ratio") > most
    return rows.withColumn("ratio", ratio).withColumn("status", F.when(F.col("ratio").isNull(), "untestable").when(low, "low").when(high, "high").otherwise("ok"))


def population(values: DataFrame, by: str = "variable", declared: DataFrame | None = None) -> DataFrame:
    """The values that are tested: without zeros where more than half are zero; `t` is log1p unless a value is negative.

    `declared` (by, scale, stats), one row for each variable that declares something, may set the scale to 'log' or 'raw', and stats to false, which
    leaves the variable out.
    """
    if declared is not None:
        d = declared.select(by, F.when(F.col("scale").isin("log", "raw"), F.col("scale")).alias("__scale"), F.coalesce("stats", F.lit(True)).alias("__stats"))
        v = values.join(d, by, "left").where(F.coalesce("__stats", F.lit(True)))
        plain = population(v.drop("__scale", "__stats"), by)
        logs = plain.join(d.select(by, "__scale"), by, "left").withColumn("scale", F.coalesce("__scale", "scale")).drop("__scale")
        return logs.withColumn("t", F.when(F.col("scale") == "raw", F.col("value").cast("double")).otherwise(F.log1p("value")))
    stats = values.where("value is not null").groupBy(by).agg(F.min("value").alias("__least"), F.avg((F.col("value") == 0).cast("double")).alias("__zeros"))
    v = values.where("value is not null").join(stats, by)
    v = v.where(~((F.col("__zeros") > ZERO_SHARE) & (F.col("value") == 0)))
    return v.withColumn("scale", F.when(F.col("__least") < 0, "raw").otherwise("log")).withColumn("t", F.when(F.col("__least") < 0, F.col("value")).otherwise(F.log1p("value"))).drop("__least", "__zeros")


def fences(tested: DataFrame, by: str = "variable") -> DataFrame:
    """(by, n, q1, med, q3, mad, med_digits) with exact quantiles; the deviation is the median distance to the median."""
    q = cut(exact_quantiles(tested, by, "t", {"q1": 0.25, "med": 0.5, "q3": 0.75}))
    far = tested.join(q.select(by, "med"), by).withColumn("__d", F.abs(F.col("t") - F.col("med")))
    mad = exact_quantiles(far, by, "__d", {"mad": 0.5}).select(by, "mad")
    digits = tested.where("value <> 0").groupBy(by).agg(F.expr("percentile(length(cast(abs(cast(value as bigint)) as string)), 0.5)").alias("med_digits"))
    return q.join(mad, by).join(digits, by, "left")


def outliers(values: DataFrame, by: str = "variable", declared: DataFrame | None = None) -> DataFrame:
    """The tested values with z, severity (extreme, mild, null) by the quartile fences and the median deviation, and long_number."""
    tested = population(values, by, declared)
    f = fences(tested, by)
    iqr = F.col("q3") - F.col("q1")
    out_of = lambda k: (F.col("t") < F.col("q1") - k * iqr) | (F.col("t") > F.col("q3") + k * iqr)
    joined = tested.join(f.where(F.col("n") >= MIN_N), by)
    z = F.when(F.col("mad") > 0, 0.6745 * (F.col("t") - F.col("med")) / F.col("mad"))
    severity = F.when((iqr > 0) & out_of(IQR_EXTREME), "extreme").when((iqr > 0) & out_of(IQR_MILD), "mild").when(F.abs(z) > MAD_Z, "mild")
    long_number = (F.col("value") != 0) & (numbers.int_digits(F.col("value")) >= F.col("med_digits") + DIGIT_EXCESS)
    return joined.withColumn("z", z).withColumn("severity", severity).withColumn("long_number", long_number)


def extremes(values: DataFrame, order: list[str], n: int, by: str = "variable") -> DataFrame:
    """The n greatest and n least values of each variable with their rank; ties by `order`."""
    tie = [F.col(c) for c in order]
    top = F.row_number().over(W.partitionBy(by).orderBy(F.col("value").desc(), *tie))
    low = F.row_number().over(W.partitionBy(by).orderBy(F.col("value").asc(), *tie))
    v = values.where("value is not null")
    hi = v.withColumn("rank", top).where(F.col("rank") <= n).withColumn("side", F.lit("top"))
    lo = v.withColumn("rank", low).where(F.col("rank") <= n).withColumn("side", F.lit("bottom"))
    return hi.unionByName(lo)


def histogram(tested: DataFrame, bins: int = 24, by: str = "variable") -> DataFrame:
    """(by, bin, n) of equal bins over t; the greatest value falls in the last, equal values all in the first."""
    span = tested.groupBy(by).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("t") - F.col("lo")) / width))).otherwise(0)
    return tested.join(span, by).withColumn("bin", b.cast("int")).groupBy(by, "bin").agg(F.count("*").alias("n"))


def trailing_one(values: DataFrame, page: str, text: Column, by: str = "variable") -> DataFrame:
    """(by, page, k, n, share, p_adj, flagged): pages whose numbers end in 1 too often, by an exact binomial tail.

    Bonferroni runs over all pages with enough numbers. Only counts are shuffled.
    """
    d = numbers.last_digit(text)
    counted = values.where((numbers.int_digits(F.col("value")) >= TRAILING["min_digits"]) & (d > 0)).groupBy(by, page).agg(F.sum((d == 1).cast("bigint")).alias("k"), F.count("*").alias("n"))
    m = counted.where(F.col("n") >= TRAILING["min_n"]).agg(F.greatest(F.count("*"), F.lit(1)).alias("tests"))
    share = F.col("k") / F.col("n")
    enough = F.col("n") >= TRAILING["min_n"]
    p = F.when(enough, F.least(F.lit(1.0), numbers.binomial_tail(F.col("k"), F.col("n"), TRAILING["expected"]) * F.col("tests")))
    out = counted.join(F.broadcast(m)).withColumn("share", share).withColumn("p_adj", p)
    return out.withColumn("flagged", F.coalesce((F.col("p_adj") < TRAILING["alpha"]) & (F.col("share") >= TRAILING["min_ratio"] * TRAILING["expected"]), F.lit(False))).drop("tests")


def t_quantile(q: float, df: float) -> float:
    """Student's t by bisection over the regularised incomplete beta function (continued fraction)."""

    def beta(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
        f = c = 1.0
        d = 0.0
        for i in range(300):
            m = i // 2
            num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
            if abs(1 - c * d) < 1e-12:
                break
        return front * (f - 1)

    def cdf(t: float) -> float:
        tail = 0.5 * beta(df / 2, 0.5, df / (df + t * t))
        return 1 - tail if t > 0 else tail

    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < q else (lo, mid)
    return (lo + hi) / 2


def generalized_esd(values: list[float], most: int, alpha: float) -> list[int]:
    """Positions of the outliers by Rosner's test: take out the farthest value again and again, then compare backwards."""
    left = list(enumerate(values))
    taken, found = [], 0
    n = len(values)
    for i in range(1, min(most, n - 2) + 1):
        mean = sum(v for _, v in left) / len(left)
        dev = math.sqrt(sum((v - mean) ** 2 for _, v in left) / (len(left) - 1))
        if dev == 0:
            break
        k, (at, v) = max(enumerate(left), key=lambda x: (abs(x[1][1] - mean), -x[0]))
        r = abs(v - mean) / dev
        taken.append(at)
        left.pop(k)
        p = 1 - alpha / (2 * (n - i + 1))
        t = t_quantile(p, n - i - 1)
        if r > (n - i) * t / math.sqrt((n - i - 1 + t * t) * (n - i + 1)):
            found = i
    return taken[:found]


def esd_outliers(values: DataFrame, key: str, by: str = "variable") -> DataFrame:
    """(by, key, value) of the outliers of each variable by Rosner's test. Only a variable's tails are sent to Python.

    At most max_frac of the values can be taken out, and each time it is the least or the greatest, so the tails and the
    sums of the rest decide the test: count, sum and sum of squares are aggregated, the tails are ranked.
    """
    v = values.where("value is not null").select(by, F.col(key).alias("key"), F.col("value").cast("double").alias("value"))
    stats = v.groupBy(by).agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")).withColumn("most", F.greatest(F.lit(1), F.floor(F.col("n") * ESD["max_frac"])).cast("int"))
    w = lambda o: F.row_number().over(W.partitionBy(by).orderBy(o, "key"))
    tails = v.join(stats, by).withColumn("lo", w(F.col("value").asc())).withColumn("hi", w(F.col("value").desc())).where((F.col("lo") <= F.col("most")) | (F.col("hi") <= F.col("most")))
    kind = dict(values.dtypes)

    def test(pdf):
        import pandas as pd

        n, s, ss, most = int(pdf["n"].iloc[0]), float(pdf["s"].iloc[0]), float(pdf["ss"].iloc[0]), int(pdf["most"].iloc[0])
        rest = pdf.sort_values(["value", "key"]).drop_duplicates("key")
        vals, keys = rest["value"].tolist(), rest["key"].tolist()
        a, b, taken, found = 0, len(vals) - 1, [], 0
        for i in range(1, min(most, n - 2) + 1):
            m = n - i + 1
            mean = s / m
            var = max(0.0, (ss - s * s / m) / (m - 1))
            if var == 0 or a > b:
                break
            pick = a if abs(vals[a] - mean) >= abs(vals[b] - mean) else b
            r = abs(vals[pick] - mean) / math.sqrt(var)
            taken.append((keys[pick], vals[pick]))
            s, ss = s - vals[pick], ss - vals[pick] ** 2
            a, b = (a + 1, b) if pick == a else (a, b - 1)
            t = t_quantile(1 - ESD["alpha"] / (2 * (n - i + 1)), n - i - 1) if n - i - 1 > 0 else float("inf")
            if r > (n - i) * t / math.sqrt((n - i - 1 + t * t) * (n - i + 1)):
                found = i
        out = pd.DataFrame(taken[:found], columns=["key", "value"])
        out.insert(0, by, pdf[by].iloc[0])
        return out

    return tails.groupBy(by).applyInPandas(test, f"{by} {kind[by]}, key {kind[key]}, value double").withColumnRenamed("key", key)


def adjudicate(findings: DataFrame, confirmations: DataFrame, before: DataFrame) -> DataFrame:
    """(check, flagged, confirmed, open, corrected): findings against what was confirmed and what an earlier run found.

    A finding is confirmed if its flag_id and text are; one of the earlier run that is gone was corrected.
    """
    key = ["flag_id"]
    ok = confirmations.select(F.col("flag_id").alias("__id"), F.col("text").alias("__text")).distinct()
    now = findings.join(ok, (F.col("flag_id") == F.col("__id")) & F.col("text").eqNullSafe(F.col("__text")), "left").select("check", "flag_id", F.col("__id").isNotNull().alias("confirmed"))
    gone = before.join(findings.select(*key).distinct(), key, "left_anti").select("check", "flag_id")
    a = now.groupBy("check").agg(F.count("*").alias("flagged"), F.sum(F.col("confirmed").cast("bigint")).alias("confirmed"))
    b = gone.groupBy("check").agg(F.count("*").alias("corrected"))
    j = a.join(b, "check", "full_outer")
    flagged, confirmed = F.coalesce("flagged", F.lit(0)), F.coalesce("confirmed", F.lit(0))
    return j.select("check", flagged.alias("flagged"), confirmed.alias("confirmed"), (flagged - confirmed).alias("open"), F.coalesce("corrected", F.lit(0)).alias("corrected"))


def top_gap(values: DataFrame, by: str = "variable") -> DataFrame:
    """(by, top_gap): how many times the greatest value of a variable is the one below it; null where that isn't positive."""
    two = values.where("value is not null").groupBy(by).agg(F.max("value").alias("__a"))
    ties = values.join(two.select(by, "__a"), by).groupBy(by).agg(F.max(F.when(F.col("value") < F.col("__a"), F.col("value"))).alias("__b"), F.sum((F.col("value") == F.col("__a")).cast("bigint")).alias("__t"), F.max("__a").alias("__a"))
    below = F.when(F.col("__t") > 1, F.col("__a")).otherwise(F.col("__b"))
    return ties.select(by, F.when(below > 0, F.col("__a") / below).alias("top_gap"))


def run_history(runs: DataFrame, keep: int = 50) -> DataFrame:
    """The last `keep` runs of each check, newest first."""
    w = W.partitionBy("check").orderBy(F.col("ts").desc(), F.col("run_id").desc())
    return runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def esd_of(values: Iterator[float], most: int | None = None) -> list[int]:
    """`generalized_esd` with the defaults of the column operator, for small driver-side series."""
    vals = list(values)
    return generalized_esd(vals, most or max(1, int(len(vals) * ESD["max_frac"])), ESD["alpha"])
