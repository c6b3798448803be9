import pytest

from ledgerloom.llm import cutoff

ENDS = [("Ez egy mondat.", "end"), ("Ez egy mon", "open"), ("Ez egy mon...", "mark"), ("rea�", "broken"), ("a &am", "broken"), ("x \\u00", "broken"), ("Vége.\n— 12 —", "line"), ("Vége.\nDr. Kiss János", "line"), ("Vége.\nKiss János, közjegyző", "line"), ("Vége.\nPest, 1893. február 12", "line"),
        ("a | b | c\nd | 1 | 2", "row"), ("a | b | c\nd | 1", "short_row"), ("Laut Eintragung Nr.", "short"), ("igen (l. ott).", "end"), ("Igaz?”", "end"), ("nem (igaz)", "closed"), ("Vége.\n## Fejezet", "line"), ("Vége.\nAzonban Gapunyész", "open")]


@pytest.mark.parametrize("text,want", ENDS)
def test_endings(text, want):
    assert cutoff.ending(text) == want


def test_stack():
    assert cutoff.still_open("a (b [c] d") == 1
    assert cutoff.still_open("<b>x <i>y</i>") == 1
    assert cutoff.still_open('„a” "b" (c)') == 0
    assert cutoff.still_open(") a") == 0
    assert cutoff.still_open("(" * 50_000) == 50_000


def test_frames(spark, rows):
    body = "szó " * 30
    data = [(i, body[:100 - i % 2 * 0], "limited") for i in range(6)] + [(10, "x" * 94 + " (igy)", "limited"), (11, "Ez (igy)", "free"), (12, "Kész.", "free"), (13, None, "free"), (14, "", "free"), (15, "  ", None), (16, "félbe", None), (16, "félbe", None), (17, "y" * 300_000, "free")]
    d = spark.createDataFrame([(i, t, s, 1, "clash") for i, t, s in data], "doc_id bigint, text string, source string, chars int, ending string")
    assert [r[0] for r in rows(cutoff.truncated(d))] == sorted([0, 1, 2, 3, 4, 5, 10, 16, 17], key=lambda x: str((x,)))
    by = {r.source: (r.documents, r["cut"]) for r in cutoff.by_source(d).collect()}
    assert by == {"limited": (7, 7), "free": (3, 1), None: (2, 2)}
    assert cutoff.truncated(d.where("false")).count() == 0


def test_an_open_bracket_decides(spark, rows):
    sound = [(i, f"Megszűnt (1861. évi május {i}-én) a gép. Kész.", "feed") for i in range(10, 20)]
    inside = [(30, "Megszűnt a gép. A váltó (1861.", "feed"), (31, "Ez kész. A gép (1861. évi május.", "feed"), (32, "Siehe Blatt (vgl. Bd. 3.", None)]
    # Far from the end, or in a text that lost other marks, an opener says nothing; nor does a closed one.
    other = [(40, "Megszűnt (1861. évi május a gép. " + "Ez egy mondat. " * 5, "feed"), (41, "A gép 12-én) a váltó (1861. kész.", "feed"), (42, "A (gép és (a váltó. Kész (1861.", "feed"), (43, "A gép (1861).", "feed")]
    d = spark.createDataFrame(sound + inside + other, "doc_id bigint, text string, source string")
    assert rows(cutoff.truncated(d)) == [(30,), (31,), (32,)]


def test_marks_without_partner():
    assert cutoff.read_marks("a) (b [c) d (") == ([(")", 12)], 2, 6)
    assert cutoff.read_marks("<b>x</i></b>") == ([], 1, 12)


def test_the_whole_last_line_is_read():
    assert cutoff.ending("Vége.\nPest, 1893. február 12") == "line"
    row = " | ".join(["szó"] * 3000)
    assert cutoff.ending(f"{row}\n{row}") == "row" and cutoff.ending(f"{row}\n{row.rsplit(' | ', 1)[0]}") == "short_row"
    assert cutoff.ending("x.\n" + "SZÓ " * 50_000) == "line" and cutoff.ending("x.\n" + "SZÓ " * 50_000 + "szó") == "open"


def test_a_source_that_sets_no_marks(spark, rows):
    heads = [(i, f"Gőzmalom száma {i} és{'x' * (i % 40)}", "list") for i in range(60)] + [(70, "Tégla (kis", "list"), (71, "Tégla...", "list")]
    prose = [(100 + i, f"Ez a {i}. mondat kész.", "prose") for i in range(60)] + [(170, "Ez a mondat nem", "prose")]
    few = [(200 + i, f"Ez nem kész {i} és{'y' * i}", "few") for i in range(10)]
    d = spark.createDataFrame(heads + prose + few, "doc_id bigint, text string, source string")
    assert rows(cutoff.truncated(d)) == sorted([(70,), (71,), (170,), *[(200 + i,) for i in range(10)]], key=str)
