import datetime

from ledgerloom.llm import canon_list as cl


def frames(spark, values, counties=()):
    at = datetime.datetime(2024, 1, 1)
    cells = [("p", i, i, c, v, at, "clash") for i, (c, v) in enumerate(values)] + [("p", 1000 + i, r, 2, v, at + datetime.timedelta(days=d), "clash") for i, (r, v, d) in enumerate(counties)]
    cols = [("p", 1, "settlement", "entity"), ("p", 2, "county", "text"), ("p", 3, "industry", "entity"), ("p", 1, "settlement", "entity")]
    ents = [("M1", "Kis-Fárév", "settlement", {"county": "Zarog"}), ("M2", "Nagyhegy", "settlement", {"county": "Bogyor"}), ("M3", "Nagyhegy", "settlement", {"county": "Zarog"}), ("I1", "leather manufacture", "industry", {}), ("M4", "Felső-Szibrehalom", "settlement", None), ("F1", "Nagyhegy", "firm", {})]
    al = [("I1", "bőrgyártás"), ("M1", "Klein-Faurt"), ("M1", "Klein-Faurt"), ("nobody", "Sehol"), ("M1", None)]
    return (
        spark.createDataFrame(cells, "project string, cell_id bigint, row_id int, col_id int, value string, updated_at timestamp, dtype string"), spark.createDataFrame(cols, "project string, col_id int, variable string, dtype string"),
        spark.createDataFrame(ents, "id string, name string, type string, attrs map<string,string>"), spark.createDataFrame(al, "entity_id string, name string"),
    )


def test_ways_of_writing(spark):
    want = {"Kis-Fárév": "M1", "KIS FÁRÉV": "M1", "k.Fárév": "M1", "Fárév, Kis-": "M1", "Kis-Fárev": "M1", "Kis-Fráév": "M1", "klein-faurt.": "M1", "Kis-Fárév község": "M1", "Kis-Fárév (puszta)": "M1", "Kis-Fá.": "M1", "F.-Szibrehalom": "M4", "Felső-Szibreha1orn": "M4", "Sehol": "none", "???": "none", "1204": "none"}
    trades = {"bőrgy.": "I1", "Bőrgyártás, kisipar": "I1", "gyártás (bőr)": "I1", "bőrgyártás mint mellékfogl.": "I1", "borgyártas": "I1", "bőrgyárrtás;": "I1", "halászat": "none", "leather manufacture": "I1"}
    values = [(1, v) for v in want] + [(3, v) for v in trades] + [(1, v) for v in (None, "", "  ", "–", "- -", " ")] + [(9, "Kis-Fárév"), (2, "Zarog")] + [(1, "x" * 5000)]
    got = {r.cell_id: r.entity_id for r in cl.resolve(*frames(spark, values)).collect()}
    expect = {i: {**want, **trades}.get(v, "none") for i, (c, v) in enumerate(values) if c in (1, 3) and v and v.strip(" –- ")}
    assert got == expect
    rep = {r.value: r.cells for r in cl.unmatched(*frames(spark, values)).collect()}
    assert rep["halászat"] == 1 and "bőrgy." not in rep


def test_county_decides(spark):
    values = [(1, "Nagyhegy")] * 4 + [(1, "Nagyhegy (Zarog)")]
    got = {r.cell_id: r.entity_id for r in cl.resolve(*frames(spark, values, [(0, "Bogyor", 0), (0, "Zar. m.", 1), (1, "BOGYORER Comitat", 0), (2, "„", 0)])).collect()}
    assert got == {0: "M3", 1: "M2", 2: "M2", 3: "M2", 4: "M3"}


def test_empty(spark):
    c, g, e, a = frames(spark, [(1, "Nagyhegy")])
    assert cl.resolve(c.where("false"), g, e, a).count() == 0
    assert [tuple(r) for r in cl.resolve(c, g, e.where("false"), a).collect()] == [(0, "none")]


def test_pigeonhole_join_loses_nothing(spark):
    """Against all pairs by edit distance, on random keys."""
    import random

    from ledgerloom.llm.names import edit_distance

    rng = random.Random(2)
    key = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(3, 11)))
    refs, words = sorted({key() for _ in range(60)}), sorted({key() for _ in range(150)})
    r = spark.createDataFrame([("t", k, k, None) for k in refs], "type string, key string, entity_id string, county string")
    w = spark.createDataFrame([("t", k) for k in words], "type string, word string")
    k_of = lambda s: 0 if len(s) <= 3 else 1 if len(s) <= 4 else 2 if len(s) <= 8 else 3
    want = set()
    for a in words:
        near = [(edit_distance(a, b, 3), b) for b in refs]
        near = [(0, a)] if a in refs else [(d, b) for d, b in near if d <= k_of(b) and k_of(b)]
        want |= {(a, b, d) for d, b in near if d == min(near)[0]}
    assert {(x.word, x.key, x.distance) for x in cl.match_keys(w, r).collect()} == want
