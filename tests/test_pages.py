import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import curation, dataset, images, mutate, pages, resolve, review
from ledgerloom.sources import pages as src

BOX = "stem string, idx int, label string, x1 double, y1 double, x2 double, y2 double"


def png(gray):
    raw = b"".join(b"\0" + r.tobytes() for r in gray)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_page_documents_are_read_and_written(spark, tmp_path, rows):
    docs = {"page_10": {"flags": {"status": "skip"}, "shapes": []}, "page_2": {"shapes": [{"label": "cell", "points": [[1, 2], [30, 4]], "human_output": {"human_corrected_text": "x"}}, {"label": "bad", "points": [[1, 1]]}, {"label": "head", "points": [[0, 0], [9, 9]]}]}}
    (tmp_path / "in").mkdir()
    for k, d in docs.items():
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(d))
    (tmp_path / "in" / "broken.json").write_text('{"shapes": [')
    (tmp_path / "in" / ".hidden.json").write_text("{}")
    p = src.read_pages(spark, str(tmp_path / "in"))
    assert [(r.stem, r.status, r.boxes) for r in src.page_list(p).orderBy("sort_key").collect()] == [("page_2", "predicted", 3), ("page_10", "skip", 0)]
    assert rows(src.read_boxes(p).select("stem", "idx", "label", "x2", "human")) == [("page_2", 0, "cell", 30.0, "x"), ("page_2", 2, "head", 9.0, None)]
    slim = src.slim_parents(p.where("_corrupt_record is null"), "head").cache()
    assert [(r.stem, len(r.shapes)) for r in slim.collect()] == [("page_2", 1)]
    src.write_pages(slim, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    src.write_csv(spark.range(2), str(tmp_path / "csv"))
    src.write_markdown(spark.createDataFrame([(1, "a|b")], "k int, v string"), str(tmp_path / "md"), ["k", "v"])
    assert [r.value for r in spark.read.text(str(tmp_path / "md")).collect()] == ["| k | v |", "|---|---|", "| 1 | a\\|b |"]


def test_detector_metrics(spark, rows):
    lines = ['{"iteration": 1, "bbox/AP": 10.0}', '{"iteration": 2, "loss": 3.0}', '{"iteration": 3, "bbox/AP": 20.5, "bbox/AP75": NaN}', "no json"]
    d = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    assert [r for r in rows(src.detector_metrics(d)) if r[0] == "bbox/AP"] == [("bbox/AP", 20.5)]


def test_frames_of_crops(spark, rows):
    b = spark.createDataFrame([("s", 0, "a", 10.0, 10.0, 60.0, 40.0), ("s", 1, "a", 200.0, 200.0, 210.0, 210.0)], BOX)
    parent = spark.createDataFrame([("s", 7, "p", 20.0, 0.0, 100.0, 100.0)], BOX)
    inside = pages.into_crops(b, parent, ["stem"])
    assert rows(inside) == [("s", 7, 0, "a", 0.0, 10.0, 40.0, 40.0)]
    crops = spark.createDataFrame([(7, 20, 0, 100, 100)], "parent int, left int, top int, right int, bottom int")
    back = pages.onto_page(inside, crops, "parent").select("x1", "y1", "x2", "y2")
    assert rows(back) == [(20.0, 10.0, 60.0, 40.0)]


def test_write_back(spark, rows):
    page = spark.createDataFrame([("s", "c1", 1), ("s", "c2", 2), ("s", None, 3)], "stem string, crop_origin string, v int")
    crop = spark.createDataFrame([("s", "c1", 10, True), ("s", "c2", 20, False)], "stem string, crop_origin string, v int, parent_alive boolean")
    new, stale = pages.written_back(page, crop, ["stem"])
    assert rows(new.select("v")) == [(10,), (2,), (3,)] and rows(stale) == [("s", "c2")]


def test_homography(spark):
    h = pages.homography([(0, 0), (10, 0), (10, 10), (0, 10)], [(5, 5), (25, 5), (25, 25), (5, 25)])
    b = spark.createDataFrame([("s", 0, "a", 1.0, 2.0, 3.0, 4.0)], BOX)
    assert list(pages.warped(b, h).select("x1", "y1", "x2", "y2").first()) == pytest.approx([7, 9, 11, 13])


def test_exports(spark, rows):
    d = spark.createDataFrame([("s", 0, "head", "County A"), ("s", 1, "note", "skip me"), ("s", 2, "cell", "x"), ("s", 3, "head", "County B"), ("s", 4, "cell", "y")], "stem string, pos int, label string, text string")
    out = [json.loads(r.json) for r in pages.exported_records(d, ["stem"], ["pos"], {"head": "propagate", "note": "ignore"}).orderBy("pos").collect()]
    assert out == [{"label": "cell", "text": "x", "head": "County A"}, {"label": "cell", "text": "y", "head": "County B"}]
    c = spark.createDataFrame([("s", 0, None, None, 0.0, "Title"), ("s", 1, 0, 1, 10.0, "a\nb"), ("s", 2, 0, 2, 10.0, "c"), ("s", 3, 1, 1, 20.0, "d"), ("s", 4, None, None, 30.0, "foot")], "stem string, idx int, super_row int, super_column int, y1 double, text string")
    assert rows(pages.sheet(c, ["stem"])) == sorted([("s", 0, 0, "Title"), ("s", 1, 1, "a"), ("s", 2, 1, "b"), ("s", 1, 2, "c"), ("s", 3, 1, "d"), ("s", 4, 0, "foot")], key=str)
    md = src.flow_markdown(d.withColumn("label", F.when(F.col("label") == "head", "title").otherwise("t")).withColumnRenamed("pos", "flow_order"), ["stem"])
    assert md.first().text.startswith("## County A\n\nskip me")


def test_ink(spark, tmp_path):
    a = np.full((40, 60), 250, np.uint8)
    a[5:10, 10:50] = 20
    a[20:26, 12:40] = 30
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.png").write_bytes(png(a))
    (tmp_path / "i" / "blank.png").write_bytes(png(np.full((8, 8), 200, np.uint8)))
    got = {r.path.rsplit("/", 1)[1]: r for r in images.page_bands(images.read_images(spark, str(tmp_path / "i"))).collect()}
    assert [(b.y0, b.y1) for b in got["a.png"].bands] == [(5, 10), (20, 26)] and (got["a.png"].left, got["a.png"].right) == (10, 50)
    assert got["blank.png"].bands == [] and got["blank.png"].left is None
    ink = images.ink_map(a)
    assert images.bands(images.masked(ink, [(0, 0, 60, 15)])) == [(20, 26)]
    ruled = ink.copy()
    ruled[0] = True
    assert images.extent(images.cleared_edges(ruled).sum(axis=1)) == (5, 26)
    assert images.carved((0, 0, 10, 10), [(5, 3, 20, 5), (0, 9, 1, 30), (50, 0, 60, 9)]) == [(0, 0, 10, 3), (0, 5, 10, 9)]


def test_schema_issues(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "object", "required": ["c"], "properties": {"c": {"type": "string"}}}}}
    d = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}}',), ('{"a": "x"}',), ("{}",), ("{",)], "t string")
    got = [r[0] for r in d.select(pages.schema_issues(F.col("t"), schema)).collect()]
    assert got == [[], ["$.a: not integer", "$.b.c: missing"], ["$.a: missing", "$.b.c: missing"], ["$: not JSON"]]


def test_text_functions(spark):
    one = lambda c, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(c).first()[0]
    c = F.col("c0")
    assert one(text.unspaced(c), "K ö z p o n t i  értesítő a b c") == "Központi értesítő abc"
    assert one(text.lines(c), " a \n\n b\n \n") == ["a", "", "b"] and one(text.lines(c), None) == [""]
    assert one(text.positioned_lines(c), "\na") == ["", "a"] and one(text.positioned_lines(c), "") == []
    assert one(text.fold(c), "  Őrült—Café ") == "orult cafe"
    assert one(text.is_ditto(c), "„") and one(text.is_ditto(c), "U.o.") and not one(text.is_ditto(c), "„szó”") and not one(text.is_ditto(c), None)
    assert one(text.natural_key(c), "Page_2") < one(text.natural_key(c), "page_10")
    assert one(text.parse_crop_stem(c), "p_1__c007").k == 7 and one(text.parse_crop_stem(c), "p_1") is None
    assert one(text.hallucinated(c, F.col("c1")), "a\nb\nc", "a") and one(text.hallucinated(c, F.col("c1")), "abcdef", "a") and not one(text.hallucinated(c, F.col("c1")), "ab", "a")
    assert one(text.safe_filename(c), " a b/c.jpg ") == "a_b_c.jpg"
    assert one(text.rejoin_rows(F.array(F.lit(""), F.lit(None)), c), "x\ny") == ["x", "y"]
    assert one(text.clean_tags(F.split(c, ",")), " a ,b,, a") == ["a", "b"]


def test_decision_tiers(spark):
    cols = "record string, entity string, rank int, score double, ranked double, seat_agree boolean, founded_agree boolean, court_agree boolean, keyed boolean"
    d = spark.createDataFrame([
        ("sure", "e", 1, 97.0, 97.0, None, None, None, False), ("both", "e", 1, 99.0, 99.0, False, False, None, False), ("good", "e", 1, 88.0, 88.0, True, None, None, False), ("fact", "e", 1, 88.0, 88.0, True, False, None, False), ("weak", "e", 1, 75.0, 97.0, True, True, None, False),
        ("weakno", "e", 1, 75.0, 87.0, True, None, None, False), ("far", "e", 1, 60.0, 90.0, True, True, None, False), ("court", "e", 1, 99.0, 99.0, True, True, False, True), ("key", "e", 1, 50.0, 90.0, None, None, None, True), ("close", "e", 1, 97.0, 97.0, None, None, None, False), ("close", "f", 2, 95.0, 95.0, None, None, None, False),
    ], cols)
    got = {r.record: (r.decision, r.reason) for r in resolve.decide(d).collect()}
    assert got == {"sure": ("same", "sure name"), "both": ("open", "seat and year contradict"), "good": ("same", "good name"), "fact": ("open", "a fact contradicts"), "weak": ("same", "corroborated"), "weakno": ("open", "weak name"), "far": ("open", "name too different"), "court": ("open", "court differs"), "key": ("same", "registry key"), "close": ("open", "ambiguous")}


def test_circles_of_duplicates_are_refused(spark, rows):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    cols = "from_id string, to_id string, type string, ts timestamp"
    old = spark.createDataFrame([("a", "b", "duplicate_of", at), ("b", "c", "duplicate_of", at)], cols)
    new = spark.createDataFrame([("c", "a", "duplicate_of", at), ("d", "a", "duplicate_of", at), ("d", "a", "duplicate_of", at), ("a", "b", "duplicate_of", at), ("x", "y", "nonsense", at), ("c", "a", "rename", at)], cols)
    good, bad = mutate.with_edges(old, new, ["duplicate_of", "rename"])
    assert rows(good.select("from_id", "to_id", "type")) == sorted([("a", "b", "duplicate_of"), ("b", "c", "duplicate_of"), ("d", "a", "duplicate_of"), ("c", "a", "rename")], key=str)
    assert rows(bad.select("from_id", "to_id")) == [("c", "a")]


def test_cache_keys(spark):
    d = spark.createDataFrame([("x/m", "hi", 5, 0.0, None), ("m", "hi", 5, 0.0, None), ("m", "hi", 6, 0.0, None), ("m", "hi", 5, 0.0, "")], "m string, q string, n int, t double, f string")
    k = [r[0] for r in d.select(review.answer_key(*[F.col(c) for c in "mqntf"])).collect()]
    assert k[0] == k[1] and len(set(k)) == 3


def test_page_ranges_refuse_nonsense(spark):
    with pytest.raises(ValueError):
        dataset.page_ranges("1-2-3", F.col("p"))


def test_inbox_folders(spark, rows):
    d = spark.createDataFrame([("a/x.jpg", 3), ("a/y/z.jpg", 4), ("b/q.jpg", 1)], "path string, length bigint")
    assert rows(curation.folders(d)) == [("a", 2, 7), ("b", 1, 1)]


def test_names_by_rare_words(spark):
    w = spark.createDataFrame([("bank", 1.0), ("zahobofus", 5.0), ("malom", 1.5)], "token string, weight double")
    d = spark.createDataFrame([("zahobofus bank", "zahobofus malom"), ("uj bank", "regi bank")], "q string, e string")
    got = {r.q: r.score for r in resolve.weighted_scores(d, w).collect()}
    assert got["zahobofus bank"] > 60 > got["uj bank"]
    s = spark.createDataFrame([("Első Pesti rt.",), ("rt.",)], "n string").select(resolve.stripped(F.col("n"), ["rt"], ["elso"]))
    assert [r[0] for r in s.collect()] == ["pesti", "rt"]


def test_exact_quantiles(spark):
    import random

    from ledgerloom.runtime import exact_quantiles

    rng = random.Random(1)
    data = [(k, rng.choice([1.0, 2.0, 2.0, rng.random() * 10])) for k in "abc" for _ in range(rng.randint(1, 500))] + [("d", 4.0), ("e", None)]
    d = spark.createDataFrame(data, "k string, v double")
    got = {r.k: (r.n, r.q, r.m) for r in exact_quantiles(d, "k", "v", {"q": 0.1, "m": 0.5}).collect()}
    want = {k: (len(x), float(np.quantile(x, 0.1)), float(np.quantile(x, 0.5))) for k in "abcd" if (x := [v for g, v in data if g == k])}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
