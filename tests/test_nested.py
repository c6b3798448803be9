import datetime
import json

from ledgerloom.operators import nested

SCHEMA = "save_id bigint, project string, stem string, page_no int, saved_at timestamp, doc string, label string"


def docs(spark, texts):
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, p, s, 1, at + datetime.timedelta(hours=h), t, "clash") for i, p, s, h, t in texts], SCHEMA)


def page(*shapes):
    return json.dumps({"shapes": list(shapes)})


def test_forms(spark, rows):
    full = page(
        {"label": "cell", "points": [[1, "2"], [3, 4]], "group_id": "12", "row_struct": {"rows": [{"ocr": "a", "authority": {"candidates": [{"id": "x"}, None, {"id": "y"}]}}, None, {}]}},
        None,
        {"points": [1, 2, 3, 4, 5, 6, 7, 8], "group_id": 5.0, "label": None, "structured": {"data": {"other_names": {"name": "n"}}, "llm": {"other_names": [{"name": "no"}]}}},
        {"points": [{"x": 1, "y": 2}, {"x": 3, "y": 4}], "group_id": None, "label": "", "row_struct": json.dumps([{"ocr": "b"}]), "structured": {"data": {"other_names": ["a", {"name": "b"}]}}},
        {"points": None, "group_id": 1.5, "row_struct": {}},
    )
    got = rows(nested.flat_parts(docs(spark, [(1, "p", "s", 0, full)])))
    want = [(1, 0, "shape", "", 12, "cell"), (1, 0, "point", "0", 12, "cell"), (1, 0, "point", "1", 12, "cell"), (1, 0, "row", "0", 12, "cell"), (1, 0, "row", "2", 12, "cell"), (1, 0, "candidate", "0.0", 12, "cell"), (1, 0, "candidate", "0.2", 12, "cell"),
            (1, 2, "shape", "", 5, ""), *[(1, 2, "point", str(k), 5, "") for k in range(4)], (1, 2, "other_name", "0", 5, ""),
            (1, 3, "shape", "", -1, ""), (1, 3, "point", "0", -1, ""), (1, 3, "point", "1", -1, ""), (1, 3, "row", "0", -1, ""), (1, 3, "other_name", "0", -1, ""), (1, 3, "other_name", "1", -1, ""), (1, 4, "shape", "", -1, "")]
    assert got == sorted(want, key=str)


def test_latest_valid_save_counts(spark, rows):
    box = {"label": "a", "points": []}
    d = docs(spark, [(1, "p", "s", 0, page(box)), (2, "p", "s", 2, page(box)[:-3]), (3, "p", "s", 1, page(box, box)), (4, "p", "t", 0, None), (5, "p", "u", 0, ""), (6, "p", "v", 1, json.dumps({"shapes": None})), (7, "p", "v", 0, page(box)), (8, None, None, 0, json.dumps([json.loads(page(box))])), (9, "p", "w", 0, json.dumps({"page": json.loads(page(box)), "meta": {"shapes": 1}})), (10, "p", "w", 0, "12"), (11, "p", "w", -1, "[]")])
    assert [(r[0], r[1]) for r in rows(nested.flat_parts(d))] == [(3, 0), (3, 1), (8, 0)]


def test_empty_and_long(spark):
    assert nested.flat_parts(docs(spark, [])).count() == 0
    long = page({"label": "x" * 100_000, "points": [[i, i] for i in range(5000)]})
    assert nested.flat_parts(docs(spark, [(1, "p", "s", 0, long), (1, "p", "s", 0, long)])).count() == 5001


def test_subtypes(spark, rows):
    d = docs(spark, [(1, "p", "s", 0, page(
        {"points": [[1, "2,5"], [3, 4]], "group_id": 4, "label": "L", "human_output": {"human_corrected_text": "h"}, "row_struct": {"rows": [{"y0": 1, "y1": "2", "human": " ", "llm": "m", "ocr": "o", "authority": {"id": "E1", "candidates": [{"id": "E1", "score": "0.5"}, {"id": "E2"}]}}, "bare"]}},
        {"points": [1, 2, 3, 4, 5], "row_struct": [{"ocr": "b"}], "structured": {"data": {"other_names": [{"name": "n", "lang": "de"}, {"name": "m"}, "w"]}}}, {"points": {"xs": [1, 2], "ys": [3, 4]}, "row_struct": {"ocr": "alone"}}))])
    t = {k: rows(v.drop("save_id", "project", "stem")) for k, v in nested.subtype_tables(d).items()}
    assert t == {
        ("shape", "points"): [(0, "", None, "points", 4, "L", "h")], ("shape", "flat_numbers"): [(1, "", None, "flat_numbers", -1, "", None)], ("shape", "columns"): [(2, "", None, "columns", -1, "", None)],
        ("point", "pair"): [(0, "0", "", "pair", 1.0, 2.5), (0, "1", "", "pair", 3.0, 4.0)], ("point", "flat"): [(1, "0", "", "flat", 1.0, 2.0), (1, "1", "", "flat", 3.0, 4.0)], ("point", "columns"): [(2, "0", "", "columns", 1.0, 3.0), (2, "1", "", "columns", 2.0, 4.0)],
        ("row", "in_object"): [(0, "0", "", "in_object", 1.0, 2.0, "m", "E1"), (0, "1", "", "in_object", None, None, "bare", None)], ("row", "bare_list"): [(1, "0", "", "bare_list", None, None, "b", None)], ("row", "alone"): [(2, "0", "", "alone", None, None, "alone", None)],
        ("candidate", "candidate_scored"): [(0, "0.0", "0", "candidate_scored", 0.5, "E1")], ("candidate", "candidate"): [(0, "0.1", "0", "candidate", None, "E2")],
        ("other_name", "name_with_language"): [(1, "0", "", "name_with_language", "n", "de")], ("other_name", "name"): [(1, "1", "", "name", "m", None)], ("other_name", "word"): [(1, "2", "", "word", "w", None)],
    }


def test_any_depth(spark, rows):
    deep = "[" * 100_000 + "]" * 100_000
    d = docs(spark, [(1, "p", "s", 0, page({"label": "old"})), (2, "p", "s", 1, f'{{"shapes": [{{"points": {deep}, "label": "new"}}, {{"label": "b", "extra": {{"n": {deep}}}}}]}}'), (3, "p", "s", 2, f'{{"shapes": [{deep}')])
    assert rows(nested.flat_parts(d)) == [(2, 0, "shape", "", -1, "new"), (2, 1, "shape", "", -1, "b")]
    assert nested.typed_boxes(f'{{"shapes": [{{"label": {deep}}}]}}')[0]["label"] == deep


def test_own_reader_reads_as_the_library(monkeypatch):
    texts = ['{"a": [1, {"b": null, "c": [true, "\\u00e9\\n", -1.5e3]}, []], "d": {}}', " [ ] ", '"x"', "12", "[1 2]", '{"a" 1}', "[1,]", "{", "nul", '{"a": 1} x', "[NaN, -Infinity]", "01", '["a\nb"]']

    def outcome(text):
        try:
            return json.dumps(nested.loads(text))
        except ValueError:
            return "invalid"

    want = [outcome(t) for t in texts]
    real = json.loads
    monkeypatch.setattr(nested.json, "loads", lambda s: (_ for _ in ()).throw(RecursionError()))
    got = [outcome(t) for t in texts]
    monkeypatch.setattr(nested.json, "loads", real)
    assert got == want and want.count("invalid") == 8
