import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numbers
from ledgerloom.operators import history, mutate, resolve, rules
from ledgerloom.runtime import exact_quantiles

EDGE = "from_id string, to_id string, type string, ts int"


def test_edges_of_one_batch_close_no_circle(spark, rows):
    old = spark.createDataFrame([("a", "b", "duplicate_of", 1), ("m", "n", "duplicate_of", 1), ("n", "m", "duplicate_of", 2)], EDGE)
    new = spark.createDataFrame([("x", "y", "duplicate_of", 5), ("y", "x", "duplicate_of", 6), ("b", "c", "duplicate_of", 5), ("c", "a", "duplicate_of", 7), ("p", "q", "rename", 1), ("q", "p", "rename", 1), ("d", "m", "duplicate_of", 3)], EDGE)
    good, bad = mutate.with_edges(old, new, ["duplicate_of", "rename"])
    assert rows(bad) == [("c", "a", "duplicate_of", 7), ("y", "x", "duplicate_of", 6)]
    assert good.count() == 3 + 5 and history.circles(good).count() == 2


def test_circles(spark, rows):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("e", "d"), ("f", "g"), ("p", "q"), ("q", "p")]
    d = spark.createDataFrame([(x, y, "duplicate_of", 1) for x, y in e], EDGE)
    assert rows(history.circles(d)) == [("a", "a"), ("b", "a"), ("c", "a"), ("p", "p"), ("q", "p")]
    assert history.circles(d.where("from_id in ('f', 'd')")).count() == 0 and history.circles(d.limit(0)).count() == 0


def test_unmerged(spark, rows):
    e = spark.createDataFrame([("a", "b", "duplicate_of", 1), ("c", "b", "duplicate_of", 1), ("a", "b", "rename", 1), ("a", "b", "duplicate_of", 2)], EDGE)
    pairs = spark.createDataFrame([("b", "a")], "a string, b string")
    assert rows(mutate.unmerged(e, pairs)) == [("a", "b", "rename", 1), ("c", "b", "duplicate_of", 1)]


def test_minted_ids_keep_all_digits(spark):
    e = spark.createDataFrame([("F98", "n")], "id string, name string")
    r = spark.createDataFrame([(k, "n") for k in range(4)], "k int, name string")
    assert [x.id for x in mutate.minted(r, e, "F", 2, ["k"]).orderBy("k").collect()] == ["F99", "F100", "F101", "F102"]


@pytest.mark.parametrize("n,k,p", [(10_000, 1200, 1 / 9), (10_000, 1000, 1 / 9), (1_000_000, 112_000, 1 / 9), (50, 0, 0.3), (50, 50, 0.3), (50, 51, 0.3), (0, 0, 0.3), (7000, 7000, 1 / 9), (30, 8, 1 / 9), (30, 1, 1 / 9)])
def test_binomial_tails_of_many_trials(spark, n, k, p):
    terms = [math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k, n + 1)]
    got = spark.createDataFrame([(k, n)], "k bigint, n bigint").select(numbers.binomial_tail(F.col("k"), F.col("n"), p)).first()[0]
    assert got == pytest.approx(math.fsum(terms), rel=1e-7, abs=1e-300)


def test_quantiles_of_one_hot_value(spark):
    import numpy as np

    vals = [0.0] * 5000 + [float(i) for i in range(1, 2001)]
    d = spark.createDataFrame([("a", v) for v in vals] + [("b", 3.0), ("b", None)], "k string, v double").repartition(8)
    got = {r.k: r for r in exact_quantiles(d, "k", "v", {"lo": 0.25, "m": 0.72, "hi": 0.99}).collect()}
    assert (got["a"].n, got["a"].lo) == (7000, 0.0) and got["a"].m == pytest.approx(np.quantile(vals, 0.72)) and got["a"].hi == pytest.approx(np.quantile(vals, 0.99))
    assert (got["b"].n, got["b"].lo, got["b"].hi) == (1, 3.0, 3.0)


def test_the_entry_above(spark, rows):
    rec = spark.createDataFrame([(1, 5, 1876, None, None, None, True), (2, 6, 1876, None, None, None, False), (3, 1, 1876, None, None, None, True), (4, 9, 1877, 7, None, None, False), (5, 9, 1877, 7, 2, None, False)], "record int, pos int, year int, issue int, volume_no int, cited_year int, previous boolean")
    iss = spark.createDataFrame([(1876, 7, "A", 1), (1876, 8, "B", 4), (1876, 9, "C", 5)], "year int, issue int, entity string, pos int")
    vol = spark.createDataFrame([(2, 1876)], "volume_no int, year int")
    assert rows(resolve.citations(rec, iss, vol)) == [(1, "B", "entry above"), (4, "A", "volume before"), (5, "A", "named volume")]


def test_cleaning_goes_on_to_the_end(spark):
    """Twelve variables, each with two rules of its own that are broken: every round repairs the best of a row, so it takes as many rounds as there are variables."""
    names = [f"v{k}" for k in range(12)]
    rule = [{"name": f"{n}{j}", "lhs": n, "operator": "=", "rhs": str(30 + k), "tol": 0.0} for k, n in enumerate(names) for j in range(2)]
    d = spark.createDataFrame([(1, *[40 + k for k in range(12)])], "k int, " + ", ".join(f"{n} bigint" for n in names))
    clean, audit = rules.batch_clean(d, rule, ["k"], names)
    assert audit.count() == 12 and list(clean.first())[1:] == [30 + k for k in range(12)]
