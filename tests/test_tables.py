import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numbers
from ledgerloom.operators import heads, labels, resolve, rules, tables
from ledgerloom.operators.pages import finite
from ledgerloom.sources import pages as pages_io


def test_names_and_scopes(spark):
    d = spark.createDataFrame([("a.b",), ("a b",), ("_trash",), (".x",), ("",), (None,), ("x ",)], "c string")
    got = {r.c: (r.l, r.p) for r in d.select("c", labels.is_label(F.col("c")).alias("l"), labels.is_project(F.col("c")).alias("p")).collect()}
    assert got == {"a.b": (True, True), "a b": (False, True), "_trash": (True, False), ".x": (True, False), "": (False, False), None: (False, False), "x ": (False, False)}
    s = spark.createDataFrame([("within: cell ",), ("within:",), (" page",), (None,), ("other",)], "c string")
    assert [tuple(r) for r in s.select(labels.scope(F.col("c")), labels.parent_label(F.col("c")), labels.scope_slug(F.col("c"))).collect()] == [("within:cell", "cell", "within_cell"), (None, None, None), ("page", None, "page"), ("page", None, "page"), (None, None, None)]


def test_regions_start_from_the_defaults_in_use(spark):
    d = spark.createDataFrame([(["a", "b", "c"], None), (["a", "b", "c"], ["c"])], "ls array<string>, rs array<string>")
    r = lambda on: [x[0] for x in d.select(labels.with_region(F.col("rs"), F.col("ls"), F.lit("b"), F.lit(on), ["a", "b", "z"])).collect()]
    assert r(True) == [["a", "b"], ["c", "b"]] and r(False) == [["a"], ["c"]]


def test_queries_fall_back_to_the_own_text(spark, rows):
    schema = "id int, name string, name_hu string, name_de string, other_names array<struct<name:string,lang:string>>"
    d = spark.createDataFrame([(1, "own", "hu", " ", [("x", "ro"), (" ", "sr"), None]), (2, " own ", None, "", None), (3, None, None, None, [])], schema)
    assert rows(heads.queries_of(d, "id")) == [(1, 0, "hu", "hu"), (1, 1, "x", "ro"), (2, 0, "own", None)]
    assert [r[0] for r in d.orderBy("id").select(heads.display_name()).collect()] == ["hu", "own", ""]
    assert rows(heads.aliases_of(d, "id", "s")) == [(1, "hu", "hu", "s"), (1, "x", "ro", "s")]


def test_modes_of_the_entity_table(spark):
    d = spark.createDataFrame([("F1", "Gőzmalom", ["Dampfmühle"], ["F9"], [], ["p", "q"]), ("F2", None, [], [], ["rename"], ["p"]), ("F3", "x", [], [], ["duplicate_of"], [])], "id string, name string, aliases array<string>, merged array<string>, edges array<string>, cells array<string>")
    ids = lambda **k: sorted(r.id for r in heads.filtered(d, **k).collect())
    assert ids(query="GOZ") == ["F1"] and ids(query="dampfmuhle") == ["F1"] and ids(query="f9") == ["F1"] and ids(query="F2") == ["F2"]
    assert ids(mode="missing", columns=2) == ["F2", "F3"] and ids(mode="chain") == ["F2", "F3"] and ids(mode="dup") == ["F1", "F3"] and ids(mode="single") == ["F2"]
    with pytest.raises(ValueError):
        heads.filtered(d, mode="odd")


def test_verdicts(spark):
    d = spark.createDataFrame([("F1", 0.9, 0.6), ("F1", 0.9, 0.2), ("none", 0.86, 0.0), ("none", 0.5, 0.0), ("F1", 0.5, 0.9), (None, None, None)], "c string, p double, s double")
    assert [tuple(r[0])[:3] for r in d.select(heads.answered(F.col("c"), F.col("p"), F.col("s"))).collect()] == [("successor", "F1", 0.9), ("same", "F1", 0.9), ("new", None, 0.86), ("unsure", None, 0.5), ("unsure", "F1", 0.5), ("unsure", None, 0.0)]


def test_edits_of_columns_keep_variables_apart(spark, rows):
    c = spark.createDataFrame([("t", 1, "A", "a", "data"), ("t", 2, "B", None, "data"), ("t", 3, "C", None, "data"), ("u", 1, "A", "x", "data")], "project string, col_id int, name string, variable string, role string")
    e = spark.createDataFrame([("t", 2, "B2", "a", None), ("t", 3, None, "z", "key"), ("u", 1, None, "a", None)], "project string, col_id int, name string, variable string, role string")
    out, bad = tables.edited_columns(c, e, ["project"])
    assert rows(out) == [("t", 1, "A", "a", "data"), ("t", 2, "B2", None, "data"), ("t", 3, "C", "z", "key"), ("u", 1, "A", "a", "data")]
    assert rows(bad) == [("t", 2, "a")]


def test_rules_are_added_and_taken_away(spark, rows):
    schema = "rule_id int, label string, lhs string, operator string, rhs string, tolerance double, severity string"
    r = spark.createDataFrame([(4, "x", "a", "=", "b", 0.0, "e")], schema)
    out = tables.with_rules(r, spark.createDataFrame([(None, "y", "a", "!", "c", 0.0, "e"), (None, "z", "a", "<=", "c", 0.0, "e")], schema))
    assert [(x.rule_id, x.label, x.operator) for x in out.orderBy("rule_id").collect()] == [(4, "x", "="), (5, "y", "="), (6, "z", "<=")]
    assert rows(tables.without_rules(out, out.where("label <> 'z'")).select("rule_id")) == [(6,)]


def test_deletions_are_undone_exactly(spark, rows):
    p = spark.createDataFrame([(1, "verified"), (2, None), (3, "deleted"), (4, "skip")], "k int, status string")
    out, undo = tables.deleted(p, spark.createDataFrame([(1,), (2,), (3,), (9,)], "k int"), ["k"])
    assert rows(out) == [(1, "deleted"), (2, "deleted"), (3, "deleted"), (4, "skip")] and rows(tables.undone(out, undo, ["k"])) == rows(p)


def test_snapshots_are_kept_as_they_were(spark, rows, tmp_path):
    d = spark.createDataFrame([(1, "a")], "k int, v string")
    kept = tables.snapshot(d, str(tmp_path), "before")
    assert rows(kept) == [(1, "a")]
    with pytest.raises(Exception):
        tables.snapshot(d, str(tmp_path), "before")


def test_rows_and_their_flat_layer(spark):
    d = spark.createDataFrame([([("a", 1), ("b", 2)],)], "rows array<struct<t:string,n:int>>")
    e = d.select(tables.edited_row(F.col("rows"), 1, "t", F.lit("x")).alias("rows"))
    assert e.select(tables.flat_of_rows(F.col("rows"), "t")).first()[0] == "a\nx"
    assert d.select(tables.edited_row(F.col("rows"), 7, "t", F.lit("x"))).first()[0] == d.first()[0]


def test_policies_of_crops(spark):
    four = [0.0, 0.0, 9.0, 9.0]
    w = spark.createDataFrame([(k, "me", four, four, "f") for k in range(6)], "k int, owner string, box array<double>, framing array<double>, fields string")
    d = spark.createDataFrame([(1, "me", four, four, "f", None), (2, None, four, four, "f", True), (3, "me", [1.0, 0.0, 9.0, 9.0], four, "f", False), (4, "me", None, four, "f", False), (5, "me", four, four, None, False), (8, "me", four, four, "f", True)], "k int, owner string, box array<double>, framing array<double>, fields string, worked_on boolean")
    act = lambda p: {r.k: (r.action, r.reason) for r in tables.crop_diff(w, d, ["k"], p).collect()}
    assert act("replace") == {0: ("created", None), 1: ("unchanged", None), 2: ("kept", "no_provenance"), 3: ("replaced", "moved"), 4: ("replaced", "moved"), 5: ("refreshed", None), 8: ("vanished", None)}
    assert act("force")[2] == ("replaced", "no_provenance") and act("keep")[3] == ("kept", "moved")


def test_crawl_repairs_equal_trying_every_place(spark):
    rng = random.Random(11)
    data, lines, want = [], [], {}
    rule = [{"name": "s", "lhs": "a + b", "operator": "=", "rhs": "c", "tol": 0.0}, {"name": "l", "lhs": "b", "operator": "<=", "rhs": "a * 3", "tol": 0.0}]
    for g in range(30):
        n = rng.randint(1, 9)
        a, b = [rng.randint(1, 5) for _ in range(n)], [rng.choice([1, 2, 3, None]) for _ in range(n)]
        c = [x + (y or 0) if rng.random() < 0.8 else 9 for x, y in zip(a, b[1:] + [b[0]] if g % 2 else b)]
        diff = rng.choice([-2, -1, 0, 1])
        data += [(g, p, *v) for p, v in enumerate(zip(a, b, c))]
        lines += [(g, "a", n), (g, "b", n + diff), (g, "c", n)]

        def cost(col):
            return sum((v is not None and x + v != z) + (v is not None and v > 3 * x) for x, v, z in zip(a, col, c))

        tries = []
        for p in range(n):
            if diff < 0:
                tries.append((cost(b[:p] + [0] + b[p : n - 1]), p))
            elif diff > 0 and b[p] is not None:
                tries.append((cost(b[:p] + b[p + 1 :] + [None]), p))
        # Two lines of three columns agree, unless two lines are all there is.
        if tries and n > 1 and min(tries)[0] < cost(b):
            want[g] = (min(tries)[1] + 1, cost(b), min(tries)[0])
    d = spark.createDataFrame(data, "g int, p int, a int, b int, c int")
    got = {r.g: (r.position, r.before, r.after) for r in rules.crawl_repairs(d, rule, ["g"], ["p"], ["a", "b", "c"], spark.createDataFrame(lines, "g int, variable string, lines int")).collect()}
    assert got == want and len(want) > 3


def test_notes_on_slips(spark):
    d = spark.createDataFrame([(121.0, 12.0), (12.0, 12.0), (112.0, 12.0), (0.0, 5.0), (54.0, 45.0), (120.0, 12.0)], "a double, b double")
    assert [tuple(r) for r in d.select(numbers.slip_note(F.col("a"), F.col("b")), numbers.difference_hint(F.col("a"), F.col("b"))).collect()] == [("trailing 1", "one character"), (None, None), (None, "one character"), (None, None), (None, "transposed"), (None, "factor")]


def test_best_edits_prefer_what_stands_higher(spark):
    d = spark.createDataFrame([(1, 10, 20, 31)], "k int, a bigint, b bigint, c bigint")
    rule = [{"name": "s", "lhs": "a + b", "operator": "=", "rhs": "c", "tol": 0.0}]
    first = lambda h: rules.best_edits(d, rule, ["k"], ["a", "b", "c"], 1, h).first().variable
    assert first(None) == "a" and first({"c": 3, "a": 1}) == "c" and first({"b": 2}) == "b"


def test_trailing_words_go_from_the_end_only(spark):
    d = spark.createDataFrame([("Szombathely rtv",), ("rtv",), ("rtv Pest kgs. rtv",), ("pesti r. t. hengermalom",), ("pesti hengermalom részvénytársaság",), ("részvénytársaság",)], "c string")
    assert [r[0] for r in d.select(resolve.stripped(F.col("c"), [], ["reszvenytarsasag", "r t"], ["rtv", "kgs"])).collect()] == ["szombathely", "rtv", "rtv pest", "pesti hengermalom", "pesti hengermalom", "reszvenytarsasag"]


def test_markdown_has_a_heading(spark):
    d = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string").coalesce(1)
    assert [r.value for r in pages_io.markdown_lines(d, ["k", "v"]).collect()] == ["| k | v |", "|---|---|", "| 1 | a\\|b |", "| 2 |  |"]
    assert pages_io.markdown_lines(d.limit(0), ["k"]).count() == 0


def test_finite_at_any_level(spark):
    d = spark.createDataFrame([(1.0, [float("nan"), 2.0], {"a": float("inf")}, (float("-inf"), "x"), 3)], "a double, b array<double>, c map<string,double>, d struct<e:double,f:string>, g int")
    r = d.select(*[finite(F.col(f.name), f.dataType).alias(f.name) for f in d.schema.fields]).first()
    assert (r.a, r.b, r.c, tuple(r.d), r.g) == (1.0, [None, 2.0], {"a": None}, (None, "x"), 3)
