import pytest

from ledgerloom.llm import lookalikes as la

CASES = [("gőzmаlom", "gőzmalom"), ("Ѕzin​áháza", "Szináháza"), ("ｆｒt", "frt"), ("rév", "rév"), ("a b", "a b"), ("Kis‑Hegy", "Kis-Hegy"), ("szeszɡyár", "szeszgyár"), ("kerüⅼeti", "kerületi"), ("egyesu͏̈let", "egyesület"), ("r­️ész", "rész"), ("Крофачeл", "Крофачел")]
SAME = ["Њевуђезан", "ρηδηζον", "„Firm”", "a – b", "x  y", "Rév", "à", "", "100 %", "ő"]


@pytest.mark.parametrize("text,want", CASES)
def test_table(text, want):
    assert la.by_table(text) == want


@pytest.mark.parametrize("text", SAME)
def test_plain_texts_stay(text):
    assert la.by_table(text) == text


def test_trie_reaches_what_looks_the_same():
    t = la.Trie()
    for w, n in (("gőzmalom", 5), ("gőzmalmok", 9), ("Сосо", 1), ("Coco", 2)):
        t.add(w, n)
    assert t.reach("gő​zmаlom") == [(0, 5, "gőzmalom")]
    assert {w for _, _, w in t.reach("Cосо")} == {"Сосо", "Coco"}
    assert {(c, w) for c, _, w in t.reach("gozmalom", 1)} == set()
    assert (1, 5, "gőzmalom") in t.reach("gőzmolom", 1)
    assert la.canonical("gő​zmаlom", t) == "gőzmalom" and la.canonical("új​", t) == "új"


def test_the_vocabulary_decides_before_the_table():
    """Half Cyrillic, half Latin: by the table the word becomes Latin, by a vocabulary that has only the Cyrillic word it becomes that one."""
    t = la.Trie()
    t.add("сорока", 3)
    assert la.by_table("copoка") != "сорока" or la.by_table("cорока") == "сорока"
    assert la.canonical("copока", t) == "сорока" and la.canonical("copoka", t) == "сорока"
    t.add("copoka", 9)
    assert la.canonical("copoka", t) == "copoka" and la.canonical("сорока", t) == "сорока" and la.canonical("copokа", t) == "copoka"


@pytest.mark.parametrize("text", [a for a, _ in CASES if a not in ("rév", "a b")])
def test_what_is_no_plain_word_is_in_no_vocabulary(text):
    assert not all(la.is_plain(w) for w in text.split(" "))


@pytest.mark.parametrize("text", SAME)
def test_plain_words(text):
    assert all(la.is_plain(w) for w in text.split(" "))


def test_the_automaton_needs_no_table(monkeypatch):
    t = la.Trie()
    t.add("gőzmalom", 2)
    monkeypatch.setattr(la, "by_table", lambda w: "by table")
    assert [la.canonical(w, t) for w in ("gőzmаlom", "gőz\u200bmalom", "gőzmalom", "szé\u200bk")] == ["gőzmalom", "gőzmalom", "gőzmalom", "by table"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "field string, row_key bigint, shape_idx int, value string, word string, bucket int")


def test_frames(spark, rows):
    long = "szó " * 20_000 + "vég​"
    d = frame(spark, [("f", i, -1, v, "clash", 1) for i, v in enumerate([None, "", " ", "gőzmаlom egy", "gőzmalom egy", "a  b", "x y", long, "Крофачел и синови", "gőzmаlom egy"])] + [("f", 3, -1, "gőzmаlom egy", "clash", 1)])
    assert rows(la.found(d)) == [("f", 3, -1), ("f", 6, -1), ("f", 7, -1), ("f", 9, -1)]
    plain = {r.row_key: r.plain for r in la.normalized(d).collect()}
    assert plain[0] is None and plain[1] == "" and plain[2] == " " and plain[3] == plain[4] == "gőzmalom egy" and plain[5] == "a  b" and plain[6] == "x y" and plain[7] == "szó " * 20_000 + "vég"
    assert la.found(d.where("false")).count() == 0 and la.normalized(d.where("false")).count() == 0
