import random

import duckdb

from ledgerloom.operators import resolve

ALL_PAIRS = """SELECT record, entity, max(score) AS score FROM (SELECT record, entity, 100.0 * (1 - levenshtein(q, e) / greatest(length(q), length(e))) AS score FROM q, e) WHERE score >= 70 GROUP BY 1, 2"""


def of_all_pairs(queries, names):
    """SQL without any blocking; the texts are given folded."""
    with duckdb.connect() as c:
        c.execute("CREATE TABLE q (record BIGINT, q VARCHAR); CREATE TABLE e (entity VARCHAR, e VARCHAR)")
        c.executemany("INSERT INTO q VALUES (?, ?)", queries)
        c.executemany("INSERT INTO e VALUES (?, ?)", names)
        return {(r, e): round(s, 6) for r, e, s in c.execute(ALL_PAIRS).fetchall()}


def candidates(spark, queries, names, **more):
    q, e = spark.createDataFrame(queries, "record bigint, query string"), spark.createDataFrame(names, "entity string, name string")
    return resolve.candidates(q, e, **more)


def misread(rng, text, k):
    for _ in range(k):
        if not text:
            break
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(("", rng.choice("abcdez 1"), text[i] + rng.choice("abcdez"))) + text[i + 1 :]
    return " ".join(text.split())


def test_candidates_need_no_common_token(spark):
    got = candidates(spark, [(1, "Csesoszigct"), (2, "Csezsofelek"), (3, "Pest")], [("A", "Csesosziget"), ("B", "Csezsotelek"), ("C", "Buda")])
    assert {(r.record, r.entity) for r in got.collect()} == {(1, "A"), (2, "B")}


def test_candidates_equal_all_pairs(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeszk") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    names = [(f"E{i}", " ".join(rng.sample(words, rng.randint(1, 4)))) for i in range(120)]
    queries = [(i, misread(rng, rng.choice(names)[1], rng.randint(0, 6)) or "a") for i in range(150)]
    queries += [(1000, "aaaaaaaaaa"), (1001, "aaaaaaabbb")]
    names += [("X", "aaaaaaabbb"), ("Y", "0123456789"), ("Z", "a")]
    got = candidates(spark, queries, names, top=10_000)
    assert {(r.record, r.entity): round(r.score, 6) for r in got.collect()} == of_all_pairs(queries, names)


def test_decisions_meet_names_by_a_frequent_word(spark, monkeypatch):
    from ledgerloom.plans import records

    # One word stands in every name, the other is misprinted.
    firms = [(f"F{i}", "firm", f"{w} gőzmalom") for i, w in enumerate(("Barakovics", "Csendesi", "Dombóvári", "Egerszegi", "Fehérvári"))]
    tables = {
        "court_entries": spark.createDataFrame([(1, "Barakovits gőzmalom", None, None, None, None, None), (2, "Dornbóvári gőzmalom", None, None, None, None, None)], "entry_id bigint, firm_text string, seat string, founded int, county string, legal_form string, court string"),
        "entities": spark.createDataFrame([(*f, None) for f in firms], "id string, type string, name string, attrs map<string,string>"),
        "slices": spark.createDataFrame([], "entity_id string, as_of int, parent string, recorded_at timestamp, attrs map<string,string>"),
    }
    monkeypatch.setattr(records, "table", lambda s, root, name: tables[name])
    assert sorted(tuple(r) for r in records.decisions(spark, "").collect()) == [(1, "F0", "same", "good name"), (2, "F2", "same", "good name")]
