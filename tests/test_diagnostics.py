import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numbers
from ledgerloom.operators import dataset, diagnostics, rules


def test_identities(spark):
    d = spark.createDataFrame([(10, 4, 6), (10, 4, 5), (19, 4, 6), (None, 1, 1), (10, None, 1), (10, 40, 6)], "t int, a int, b int")
    got = [(r.status, r.culprit and (r.culprit.variable, r.culprit.value)) for r in diagnostics.identities(d, "t", ["a", "b"]).collect()]
    assert got == [("ok", None), ("mismatch", None), ("mismatch", ("t", 10.0)), ("untestable", None), ("untestable", None), ("mismatch", ("a", 4.0))]


def test_printed_totals_anchor_the_best_suffix(spark):
    data = [(1, False, 1, 1, 1), (2, False, 2, 2, 2), (3, False, 3, 3, 3), (4, True, 5, 5, 5), (5, False, 1, 1, 1), (6, True, 9, 9, 9), (7, True, 1, 1, 1)]
    d = spark.createDataFrame([("g", *r) for r in data], "g string, pos int, tot boolean, a int, b int, c int")
    got = {r.pos: (r.k, r.matches, r.anchored) for r in diagnostics.printed_totals(d, ["g"], ["pos"], "tot", ["a", "b", "c"]).collect()}
    assert got == {4: (2, 3, True), 6: (None, 0, False), 7: (None, 0, False)}


def test_outliers_find_the_odd_one(spark):
    rng = random.Random(1)
    rows = [("v", math.exp(rng.gauss(5, 0.3)), i) for i in range(200)] + [("v", 1e7, 999), ("w", 1.0, 0), ("z", None, 1)]
    d = spark.createDataFrame(rows, "variable string, value double, k int")
    got = diagnostics.outliers(d).where("severity = 'extreme'").select("k").collect()
    assert [r.k for r in got] == [999]
    assert diagnostics.outliers(d.where("false")).count() == 0


def test_histogram_keeps_the_greatest_in_the_last_bin(spark, rows):
    d = spark.createDataFrame([("v", float(x)) for x in (0, 1, 2, 3, 4)] + [("w", 7.0)] * 3, "variable string, t double")
    assert rows(diagnostics.histogram(d, 4)) == [("v", 0, 1), ("v", 1, 1), ("v", 2, 1), ("v", 3, 2), ("w", 0, 3)]


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.3), (3, 10, 0.3), (10, 10, 0.3), (20, 60, 1 / 9), (0, 0, 0.2)])
def test_binomial_tail(spark, k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    got = spark.createDataFrame([(k, n)], "k bigint, n bigint").select(numbers.binomial_tail(F.col("k"), F.col("n"), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


def test_student_quantiles():
    for q, df, want in ((0.975, 10, 2.228139), (0.95, 3, 2.353363), (0.5, 7, 0.0), (0.995, 40, 2.704459)):
        assert diagnostics.t_quantile(q, df) == pytest.approx(want, abs=1e-5)


def test_esd_by_tails_equals_the_direct_test(spark):
    rng = random.Random(3)
    vals = [rng.gauss(0, 1) for _ in range(120)] + [9.0, -8.0, 7.5]
    direct = diagnostics.generalized_esd(vals, max(1, int(len(vals) * 0.05)), 0.05)
    d = spark.createDataFrame([("v", i, x) for i, x in enumerate(vals)], "variable string, k int, value double")
    assert {r.k for r in diagnostics.esd_outliers(d, "k").collect()} == set(direct) == {120, 121, 122}


def test_trailing_one_flags_the_page(spark):
    rows = [("v", "p1", float(100 + i)) for i in range(90)] + [("v", "p2", float(1000 + 10 * i + 1)) for i in range(60)]
    d = spark.createDataFrame(rows, "variable string, page string, value double")
    got = {r.page: r.flagged for r in diagnostics.trailing_one(d, "page", F.col("value").cast("bigint").cast("string")).collect()}
    assert got == {"p1": False, "p2": True}


@pytest.mark.parametrize("text,want", [("12.5", 125.0), ("1.234,5", 12345.0), ("-", 0.0), ("—", 0.0), ("x", 0.0), ("", None), (None, None), ("abc", None), (" 1 234 ", 1234.0), ("+5", 5.0), ("1e3", 1000.0)])
def test_printed_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(numbers.printed_number(F.col("c"))).first()[0] == want


def test_declared_numbers(spark):
    d = spark.createDataFrame([("1.234,5",), ("–",), ("x1",), (None,)], "c string")
    got = [tuple(r[0]) for r in d.select(numbers.declared_number(F.col("c"), ["–"], ["."], ",")).collect()]
    assert got == [("ok", 1234.5), ("missing", None), ("error", None), ("missing", None)]


def test_digit_edits(spark):
    got = spark.createDataFrame([("10",)], "c string").select(numbers.digit_edits(F.col("c"))).first()[0]
    want = set()
    for i in range(3):
        for x in "0123456789":
            want |= {"10"[:i] + x + "10"[i:]} | ({"10"[:i] + x + "10"[i + 1 :]} if i < 2 else set())
        want |= {"10"[:i] + "10"[i + 1 :]} if i < 2 else set()
    assert set(got) == {w for w in want if w != "10" and (w == "0" or not w.startswith("0"))}


def test_rules_are_checked(spark):
    d = spark.createDataFrame([(1, 2.0, 3.0), (2, 2.0, 0.0), (3, None, 1.0)], "k int, a double, b double")
    good = [{"name": "r", "lhs": "a / b", "operator": "<=", "rhs": "0.5"}]
    assert [(r.rule, r.k) for r in rules.violations(d, good, ["k"]).collect()] == [("r", 1)]
    for bad in ("__import__('os')", "a.b", "a ** 2", "open(a)", "a if b else 0", "c + 1"):
        with pytest.raises(ValueError):
            rules.compile_rule(bad, {"a": F.col("a"), "b": F.col("b")})


def test_number_rules(spark):
    d = spark.createDataFrame([("1", "2", "3"), ("1", "2", "4"), ("x", "2", "3")], "a string, b string, c string")
    cols = {str(i): numbers.rule_number(F.col(c)) for i, c in ((1, "a"), (2, "b"), (4, "c"))}
    assert [r[0] for r in d.select(rules.number_rule("1+2=4", cols)).collect()] == [True, False, False]
    assert d.select(rules.number_rule("1+2", cols)).first()[0] is None


REPAIR = [{"name": "s", "lhs": "a + b", "operator": "=", "rhs": "c", "tol": 0.0}, {"name": "d", "lhs": "2 * a + 2 * b", "operator": "=", "rhs": "2 * c", "tol": 0.0}]


def test_batch_clean_repairs_single_slips(spark, rows):
    d = spark.createDataFrame([(1, 10, 20, 30), (2, 19, 20, 30), (3, 10, 20, 31)], "k int, a bigint, b bigint, c bigint")
    clean, audit = rules.batch_clean(d, REPAIR, ["k"], ["a", "b", "c"])
    assert all(r.a + r.b == r.c for r in clean.collect())
    assert {r.k for r in audit.collect()} == {2, 3}
    none, log = rules.batch_clean(d.where("k = 1"), REPAIR, ["k"], ["a", "b", "c"])
    assert log.count() == 0 and none.count() == 1


def test_fewest_edits_needs_two(spark):
    import json

    d = spark.createDataFrame([(1, 11, 21, 30), (2, 1, 1, 2), (3, 55, 66, 7)], "k int, a bigint, b bigint, c bigint")
    got = {r.k: r.edits for r in rules.fewest_edits(d, REPAIR, ["k"], ["a", "b", "c"], depth=2, states=4000).collect()}
    assert set(got) == {1, 3} and len(json.loads(got[1])) <= 2


def test_identity_discovery(spark):
    rng = random.Random(2)
    rows = [(a := rng.randint(0, 99), b := rng.randint(0, 99), a + b if i else 5) for i in range(40)]
    d = spark.createDataFrame(rows, "a int, b int, c int")
    got = dataset.suggested_identities(d, ["a", "b", "c"]).collect()
    assert [(r.total, r.parts) for r in got] == [("c", ["a", "b"])]
