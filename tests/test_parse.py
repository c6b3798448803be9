import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import parse, text
from ledgerloom.operators import resolve


@pytest.fixture
def one(spark):
    return lambda fn, *texts: spark.createDataFrame([tuple(texts)], ", ".join(f"c{k} string" for k in range(len(texts)))).select(fn(*[F.col(f"c{k}") for k in range(len(texts))])).first()[0]


def every(spark, fn, cases):
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, c string").select("k", fn(F.col("c")).alias("v"))
    got = {r.k: r.v for r in d.collect()}
    return [(t, got[k], want) for k, (t, want) in enumerate(cases) if (tuple(got[k]) if isinstance(want, tuple) and got[k] else got[k]) != want]


def test_dates(spark):
    assert not every(spark, parse.partial_date, [
        ("1876. jan. 5.", "1876-01-05"), ("1876. évi január hó 5-én", "1876-01-05"), ("1876 jun. 26", "1876-06-26"), ("1877-01-30", "1877-01-30"), ("1877-13-30", "1877"), ("1876. márczius", "1876-03"),
        ("1876 május 45", "1876-05"), ("no year", None), ("", None), (None, None), ("1876. évi decz. 31.", "1876-12-31"), ("2 1876 xyz 3", "1876"), ("1883. máj. 4.\n547/1", "1883-05-04"), ("1876 martius", "1876-03"),
        ("kelt 1880", "1880"), ("1876 szerint", "1876"), ("1876 maradt", "1876"), ("1876 sept. 3", "1876-09-03"), ("1877-01-99", "1877-01"), ("1 8 7 6 évi j a n . 5", "1876-01-05"), ("kelt 1870, 1876 aug. 2", "1876-08-02"),
    ])


def test_folios(spark):
    assert not every(spark, parse.folio, [("32/2", (32, 2)), ("lap 7 / 4 alatt", (7, 4)), ("1/2/3", None), ("123456/1", None), ("", None), (None, None), ("1880. márc. 22.\n7/4", (7, 4)), ("1876. jan. 5.", None), ("1/2/3, 8/1", (8, 1)), ("/7/4", None), ("1/2345", None)])


def test_events(spark):
    assert not every(spark, parse.event_type, [
        ("a czég kitöröltetett és bejegyeztetett", "deleted"), ("csődöt nyitott", "bankruptcy"), ("b e j e g y e z t e t i k", "changed"), ("kitörl- ése", "deleted"), ("új czég", "registered"), ("", "registered"), (None, "registered"),
        ("átvezettetett", "transferred"), ("feloszlott", "dissolved"), ("felszámolás\nalá", "dissolved"), ("E z e n  czégnek  kitör- lése bejegyeztetet", "deleted"), ("Ezen czég a czégjegyzékből kitöröltetett.", "deleted"),
        ("átvezettetett a társas czégek jegyzékébe", "transferred"), ("Berger Fülöp kilépett", "changed"), ("Zinner Móritz kereskedő Pozsonyban", "registered"),
    ])


def test_roman(spark):
    assert not every(spark, parse.roman, [("xiv", 14), ("IV", 4), ("", None), ("abc", None), (None, None), ("cxlix", 149), ("ii", 2)])


def test_citations(spark):
    def said(c):
        r = parse.issue_reference(c)
        return F.concat_ws(" ", r["issue"].cast("string"), r["volume"], r["volume_no"].cast("string"), r["year"].cast("string"), F.when(r["previous"], "previous"), F.when(r["gazette"], "gazette"))

    assert not every(spark, said, [
        ("(Lásd az eredeti be- jegyzést, 14. szám.)", "14"), ("Lásd a II. évf. 34. számát", "34 II 2"), ("(Lásd 1924. évf. 8.)", "8 1924"), ("(Lásd az eredeti be- jegyzést »Közp. Ért.« 97. sz.)", "97 gazette"), ("(Lásd az előbbi be- jegyzést.)", "previous"),
        ("A kir. törvényszéknek 1876 évi november 17-én 14333 számú végzése alapján", ""), ("töröltetett 1876. évi 14333. számú végzés. (Lásd »Közp. Ért.« 5. sz.)", "5 gazette"), ("Ezen czég töröltetett.", ""),
        ("( L á s d  a z I.  évfolyam  e r e d e t i  bejegyzését 14. szám)", "14 I 1"), ("Lásd ott) 3. szám", ""), ("Lásd 14 ik szám", "14"), ("", ""), (None, ""), ("L á s d 2. szám", "2"), ("(L á s d az előbbi bejegyzést.)", "previous"),
    ])


def test_mastheads(spark):
    assert not every(spark, parse.issue_number, [("Központi Értesítő. 14. szám", 14), ("7, SZ Á M", 7), ("1876. szám", None), ("szám", None), (None, None), ("5. s z á m", 5)])


def test_letter_spacing(spark):
    assert not every(spark, text.unspaced, [
        ("Z i n n e r  M ó r i t z", "Zinner Móritz"), ("K u s n i t z k y  O s k á r\nO s k a r  K u s n i t z k y", "Kusnitzky Oskár Oskar Kusnitzky"), ("Wessely S a l a m o n", "Wessely Salamon"), ("R . P a t r i a r c h", "R.Patriarch"),
        ("A B", "A B"), ("1876. jun. 26.", "1876. jun. 26."), ("Buch Ágost E.", "Buch Ágost E."), ("  Glück   Sámuel ", "Glück Sámuel"), ("", ""), (None, ""), ("a b\nc d", "a b c d"),
    ])


def test_courts(one):
    for a, b, want in [("Budapesti k. és v. törv.", "Budapesti törvényszék", True), ("Sz.-fehérvári törvényszék", "Székesfehérvári törvényszék", True), ("Pesti törvényszék", "Szegedi törvényszék", False), ("", "Szegedi törvényszék", None), (None, "x", None), ("kir. törvényszék", "Szegedi", None)]:
        assert one(resolve.courts_agree, a, b) is want, (a, b)


def test_natural_keys_of_long_numbers(spark):
    nums = ["p9", "p10", "p123456789012", "p1234567890123", "p1234567890124", "p12345678901234567890", "p007"]
    d = spark.createDataFrame([(n,) for n in nums], "c string").withColumn("k", text.natural_key(F.col("c")))
    assert [r.c for r in d.orderBy("k").collect()] == ["p007", "p9", "p10", "p123456789012", "p1234567890123", "p1234567890124", "p12345678901234567890"]


def test_derive(spark):
    d = spark.createDataFrame([("Pest 1876. jan. 5.", "12/3", "")], "a string, b string, e string")
    assert d.select(parse.derive([F.col("a"), F.col("b")], "folio")).first()[0].folio == 12
    assert d.select(parse.derive([F.col("a")], "unknown")).first()[0] is None
    assert d.select(parse.derive([F.col("e")], "event")).first()[0] is None
