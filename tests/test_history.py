import random

import pytest

from ledgerloom.operators import history

SLICE = "entity_id string, as_of int, parent string, name string, attrs map<string,string>, recorded_at timestamp, leaf string, delta int"
EDGE = "from_id string, to_id string, type string, as_of int, ts timestamp, canonical string"


def ts(n):
    import datetime

    return None if n is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)


def slices(spark, rows):
    return spark.createDataFrame([(e, y, p, n, a, ts(t), "x", 1) for e, y, p, n, a, t in rows], SLICE)


def edges(spark, rows):
    return spark.createDataFrame([(a, b, k, y, ts(0), "clash") for a, b, k, y in rows], EDGE)


def test_versions_by_example(spark, rows):
    s = slices(spark, [
        ("A", 1870, "P", "Firm", {"capital": "1000"}, 1), ("A", 1871, "p ", "FIRM", {"capital": "1,000"}, 2), ("A", 1872, None, " ", {"capital": "1000.00", "status": "active"}, 3),
        ("A", 1873, "P", "Firm", {"status": "closed"}, 4), ("A", 1873, "P", "Firm", {"status": "active"}, 5), ("A", 1874, "Q", None, None, 6), ("B", 1880, None, None, {}, None), ("B", 1880, None, None, {}, None),
        (None, 1880, None, "x", {}, 1), ("C", None, None, "x", {}, 1), ("D", 1875, "Q", "Firm", {}, 1),
    ])
    e = edges(spark, [("D", "A", "duplicate_of", None), ("A", "Z", "merger", 1880), ("A", "Z", "split", 1875), ("A", "Z", "merger", 1880), ("B", "Z", "split", 1890)])
    assert rows(history.versions(s, e)) == [("A", 1870, 1874), ("A", 1874, 1880), ("B", 1880, 9999)]


@pytest.mark.parametrize("values,same", [(("517,000", "517 000"), True), (("517.000", "517000.00"), True), (("517 000", "517000"), True), (("1.5", "15"), False), (("12.50", "12,5"), True), (("a b", "AB"), True), (("007", "7"), True), (("100", "1000"), False)])
def test_comparable(spark, values, same):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([values], "a string, b string").select(history.comparable(F.col("a")) == history.comparable(F.col("b"))).first()[0]
    assert r is same


def test_chains_and_circles(spark, rows):
    chain = [(f"n{i}", f"n{i + 1}", "duplicate_of", None) for i in range(9)] + [("a", "b", "duplicate_of", None), ("b", "c", "duplicate_of", None), ("c", "a", "duplicate_of", None), ("d", "b", "duplicate_of", None), ("x", "x", "duplicate_of", None), ("x", None, "duplicate_of", None)]
    got = dict(rows(history.canonical_ids(edges(spark, chain))))
    assert got == {f"n{i}": "n9" for i in range(9)} | {"a": "a", "b": "a", "c": "a", "d": "a"}


def test_empty(spark):
    assert history.versions(slices(spark, []), edges(spark, [])).count() == 0
    assert history.history(slices(spark, []), edges(spark, [])).count() == 0


@pytest.mark.parametrize("levels", [1, 3])
def test_only_leaves_that_differ_are_compared(spark, rows, levels):
    """Two of three leaves of the second snapshot say the same as in the snapshot they were last delivered in."""
    data = [(1, 5, 11), (1, 5, 12), (1, 9, 13), (1, 200, 14), (2, 5, 11), (2, 5, 12), (2, 9, 99), (3, 200, 14), (4, 200, 15), (4, 9, 99)]
    d = spark.createDataFrame(data, "as_of int, leaf bigint, h bigint")
    assert rows(history.merkle_changes(d, levels)) == [(1, 200), (1, 5), (1, 9), (2, 9), (4, 200)]


def test_the_rows_come_through_the_tree(spark, rows, monkeypatch):
    s = slices(spark, [(e, y, "P", "N" if y < 1875 else "M", {}, 1) for e in "ABCDEFGH" for y in (1870, 1872, 1875)])
    full = rows(history.versions(s, edges(spark, [])))
    assert len(full) == 16
    whole = history.merkle_changes
    monkeypatch.setattr(history, "merkle_changes", lambda r, levels: whole(r, levels).where("as_of < 1875"))
    assert rows(history.versions(s, edges(spark, []))) == [(e, 1870, 9999) for e in "ABCDEFGH"]


def test_equal_leaves_are_not_taken_apart(spark):
    s = slices(spark, [(f"E{i}", y, "P", "N", {}, 1) for i in range(50) for y in range(1870, 1880)])
    canon, states, levels = history._snapshots(s, edges(spark, []))
    assert history.changed_fields(states, levels).where("as_of > 1870").count() == 0


def test_content_of_versions(spark, rows):
    s = slices(spark, [("A", 1870, "P", "Firm", {"capital": "1000"}, 1), ("A", 1872, None, "FIRM", {"status": "active"}, 2), ("A", 1874, None, None, {"capital": "2000"}, 3), ("B", 1880, None, None, None, 1)])
    got = history.history(s, edges(spark, [("A", "B", "merger", 1880)])).collect()
    assert sorted((r.entity_id, r.valid_from, r.valid_to, r.name, r.parent, tuple(sorted(r.attrs.items()))) for r in got) == [
        ("A", 1870, 1874, "FIRM", "P", (("capital", "1000"), ("status", "active"))), ("A", 1874, 1880, "FIRM", "P", (("capital", "2000"), ("status", "active"))), ("B", 1880, 9999, None, None, ()),
    ]


def test_against_a_loop(spark, rows):
    rng = random.Random(5)
    data = [(f"E{rng.randint(0, 6)}", rng.randint(1860, 1880), rng.choice(["P", "Q", None]), rng.choice(["N", "n ", "M", ""]), {k: rng.choice(["1", "2", " ", None]) for k in rng.sample(["x", "y"], rng.randint(0, 2))}, i) for i in range(250)]
    last = {}
    for r in data:
        last[r[0], r[1]] = r
    want = []
    for e in sorted({r[0] for r in data}):
        cur, begins = {}, []
        for y in sorted(y for k, y in last if k == e):
            _, _, p, n, a, _ = last[e, y]
            f = {"p": p, "n": n, **{("a", k): v for k, v in a.items()}}
            f = {k: v.strip().lower() for k, v in f.items() if v and v.strip()}
            if not begins or any(k in cur and cur[k] != v for k, v in f.items()):
                begins.append(y)
            cur |= f
        want += [(e, a, b) for a, b in zip(begins, [*begins[1:], 9999])]
    for levels in (None, 1, 2):
        assert rows(history.versions(slices(spark, data), edges(spark, []), levels)) == sorted(want, key=str)
