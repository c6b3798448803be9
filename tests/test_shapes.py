import random

from pyspark.sql import functions as F

from ledgerloom.operators import curation, evaluate, geometry, lattice, ordered
from ledgerloom.runtime import ranked

BOX = "page int, idx int, label string, x1 double, y1 double, x2 double, y2 double, score double"


def boxes(spark, rows):
    return spark.createDataFrame([(p, i, lb, float(a), float(b), float(c), float(d), s) for p, i, lb, a, b, c, d, s in rows], BOX)


def test_two_columns_are_read_one_after_the_other(spark):
    b = boxes(spark, [(1, 0, "r", 0, 0, 100, 5, None), (1, 1, "r", 0, 10, 45, 20, None), (1, 2, "r", 55, 10, 100, 20, None), (1, 3, "r", 0, 30, 45, 40, None), (1, 4, "r", 55, 30, 100, 40, None), (1, 5, "r", 0, 50, 100, 60, None), (1, 6, "r", 0, 70, 40, 80, None)])
    got = {r.idx: r.reading_pos for r in geometry.reading_order(b.withColumn("page_width", F.lit(100.0)), ["page"]).collect()}
    assert sorted(got, key=got.get) == [0, 1, 3, 2, 4, 5, 6]
    one = geometry.reading_order(b.withColumn("page_width", F.lit(100.0)), ["page"], mode="1")
    assert [r.idx for r in one.orderBy("reading_pos").collect()] == [0, 1, 2, 3, 4, 5, 6]


def test_points(spark):
    d = spark.createDataFrame([(1, [[1.0, 5.0], [3.0, 2.0]]), (2, [[1.0, 1.0]]), (3, None)], "k int, points array<array<double>>")
    assert [tuple(r)[2:] for r in geometry.from_points(d).collect()] == [(1.0, 2.0, 3.0, 5.0)]


def sweep(rows, start=1, carry=None):
    most, last, out = start - 1, carry, []
    for cont, locked in rows:
        gid = locked if locked is not None else last if cont and last is not None else most + 1
        most, last = max(most, gid), gid
        out.append(gid)
    return out


def test_record_sweep_equals_the_loop(spark):
    rng = random.Random(4)
    for carry in (None, 7):
        data = []
        for v in range(60):
            for i in range(rng.randint(1, 9)):
                data.append((v, i, rng.random() < 0.4, rng.randint(1, 12) if rng.random() < 0.2 else None))
        d = spark.createDataFrame(data, "v int, i int, c boolean, l bigint")
        got = {(r.v, r.i): r.record_id for r in ordered.record_sweep(d, ["v"], ["i"], "c", "l", start=3, carry=carry).collect()}
        for v in range(60):
            own = [r for r in data if r[0] == v]
            assert [got[v, r[1]] for r in own] == sweep([(r[2], r[3]) for r in own], 3, carry)


def test_swept_stream_equals_the_loop(spark, tmp_path):
    from ledgerloom.streaming import events

    rng = random.Random(6)
    data = [(f"v{v}", i, rng.random() < 0.4, rng.randint(1, 12) if rng.random() < 0.2 else None) for v in range(3) for i in range(12)]
    schema = "volume string, pos bigint, continuation boolean, locked_id bigint"
    for k, part in enumerate((data[:18], data[18:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    s = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.swept(s).writeStream.format("memory").queryName("swept").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.volume, r.pos): r.record_id for r in spark.sql("select * from swept").collect()}
    for v in ("v0", "v1", "v2"):
        own = [r for r in data if r[0] == v]
        assert [got[v, r[1]] for r in own] == sweep([(r[2], r[3]) for r in own])


def test_windows_as_a_stream_equal_the_batch(spark, tmp_path):
    import datetime

    from ledgerloom.streaming import events

    at = datetime.datetime(2024, 1, 1)
    d = spark.createDataFrame([(at + datetime.timedelta(minutes=7 * i), "a" if i % 3 else "b", float(i), i % 4) for i in range(60)], "ts timestamp, event_type string, value double, user_id int")
    d.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "e"))
    q = events.tumbling(s, "1 hour", late="10 minutes").writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from hours").collect())) == sorted(map(tuple, events.tumbling(d, "1 hour").collect()))


def test_upserts_are_idempotent(spark, tmp_path):
    from ledgerloom.streaming import events

    rows = lambda *r: spark.createDataFrame(r, "k int, ts int, v string")
    target = str(tmp_path / "t")
    for batch in (rows((1, 1, "a"), (2, 1, "b")), rows((1, 2, "c")), rows((1, 2, "c"))):
        events.upserted(batch, target, ["k"], "ts")
    assert sorted(map(tuple, spark.read.parquet(f"{target}/v2").collect())) == [(1, 2, "c"), (2, 1, "b")]


def test_greedy_matching_equals_a_direct_version(spark):
    rng = random.Random(8)
    mk = lambda n: [(p, i, rng.choice("ab"), x := rng.randint(0, 60), y := rng.randint(0, 60), x + rng.randint(5, 40), y + rng.randint(5, 40), None) for p in range(6) for i in range(n)]
    gt, pr = mk(9), mk(10)

    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        if w <= 0 or h <= 0:
            return 0
        return w * h / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h)

    want = set()
    for p in range(6):
        for lb in "ab":
            pairs = sorted(((-iou(a, b), a[1], b[1]) for a in gt if a[0] == p and a[2] == lb for b in pr if b[0] == p and b[2] == lb and iou(a, b) >= 0.3))
            g, q = set(), set()
            for _, i, j in pairs:
                if i not in g and j not in q:
                    g.add(i), q.add(j), want.add((p, lb, i, j))
    got = evaluate.matched_boxes(boxes(spark, gt), boxes(spark, pr), ["page"], 0.3)
    assert {(r.page, r.label, r.truth_idx, r.predicted_idx) for r in got.collect()} == want


def test_grid_join_equals_the_plain_one(spark, rows):
    rng = random.Random(9)
    b = boxes(spark, [(p, i, "a", x := rng.randint(0, 500), y := rng.randint(0, 500), x + rng.randint(0, 200), y + rng.randint(0, 200), None) for p in range(3) for i in range(40)])
    plain, grid = geometry.box_pairs(b, b, ["page"]), geometry.box_pairs(b, b, ["page"], cell=64.0)
    key = ["page", "a_idx", "b_idx"]
    assert rows(plain.select(key)) == rows(grid.select(key))


def test_lattice_of_a_small_table(spark):
    cells = [(1, r * 3 + c, "t", 100 * c + r, 50 * r + c, 100 * c + 90 + r, 50 * r + 40 + c, None) for r in range(2) for c in range(3) if (r, c) != (1, 1)]
    got = {r.idx: (r.super_row, r.super_column) for r in lattice.coordinates(boxes(spark, cells), ["page"]).collect()}
    assert got == {0: (1, 1), 1: (1, 2), 2: (1, 3), 3: (2, 1), 5: (2, 3)}
    d = boxes(spark, cells).withColumns({"super_row": F.floor(F.col("idx") / 3).cast("int"), "super_column": (F.col("idx") % 3).cast("int")})
    new = [r for r in lattice.completed(d, ["page"]).collect() if r.added]
    assert [(r.super_row, r.super_column, r.label) for r in new] == [(1, 1, "t")]
    at = {r.idx: (r.row_idx, r.col_idx) for r in lattice.cells_of(boxes(spark, cells), ["page"]).collect()}
    assert at == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (1, 0), 5: (1, 2)}


def test_same_label_boxes_grow_together(spark):
    b = boxes(spark, [(1, 0, "a", 0, 0, 10, 10, 0.2), (1, 1, "a", 8, 8, 20, 20, 0.9), (1, 2, "a", 18, 0, 30, 9, None), (1, 3, "b", 0, 0, 30, 30, None)])
    got = [(r.idx, r.label, r.x1, r.y1, r.x2, r.y2, r.score) for r in lattice.merged_same_label(b, ["page"]).collect()]
    assert sorted(got) == [(1, "a", 0.0, 0.0, 30.0, 20.0, 0.9), (3, "b", 0.0, 0.0, 30.0, 30.0, None)]


def test_overlaps_are_trimmed_to_the_middle(spark):
    b = boxes(spark, [(1, 0, "a", 0, 0, 10, 100, None), (1, 1, "a", 6, 0, 20, 100, None)])
    assert sorted((r.idx, r.x1, r.x2) for r in lattice.trimmed(b, ["page"]).collect()) == [(0, 0.0, 8.0), (1, 8.0, 20.0)]


def test_regions_and_flow(spark):
    b = boxes(spark, [(1, 0, "title", 0, 0, 100, 10, None), (1, 1, "text", 0, 20, 40, 30, None), (1, 2, "title", 60, 20, 100, 30, None), (1, 3, "text", 0, 5000, 50, 5010, None)])
    reg = {r.idx: r.region for r in lattice.regions(b, ["page"]).collect()}
    assert reg[0] == reg[1] == reg[2]
    flow = {r.idx: (r.flow_order, r.article) for r in lattice.flow(b, ["page"]).collect()}
    assert flow == {0: (1, 1), 1: (2, 1), 3: (3, 1), 2: (4, 2)}


def test_empty_frames(spark):
    e = boxes(spark, [])
    for df in (lattice.coordinates(e, ["page"]), lattice.trimmed(e, ["page"]), evaluate.matched_boxes(e, e, ["page"]), geometry.reading_order(e.withColumn("page_width", F.lit(1.0)), ["page"]), geometry.merged_intervals(e.select("page", F.col("x1").alias("lo"), F.col("x2").alias("hi")), ["page"])):
        assert df.count() == 0


def test_ranks_run_over_all_partitions(spark):
    d = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = [r.n for r in ranked(d, ["k"], "n").orderBy("k").collect()]
    assert got == list(range(1, 1001))


def test_page_order_reports_ranges(spark, rows):
    d = spark.createDataFrame([("p", s) for s in ("a1", "a2", "a2", "a9", "cover")], "v string, stem string")
    assert rows(ordered.page_order(d, ["v"])) == [("p", "missing", "3-8"), ("p", "not numbered", "cover"), ("p", "twice", "2")]


def test_drift_of_a_frozen_set(spark, rows):
    b = boxes(spark, [(1, 0, "a", 0, 0, 9, 9, None), (2, 0, "a", 0, 0, 9, 9, None), (3, 0, "a", 0, 0, 9, 9, None)])
    frozen = evaluate.page_hash(b, ["page"])
    now = b.where("page < 3").withColumn("x1", F.when(F.col("page") == 2, 1.0).otherwise(F.col("x1")))
    assert rows(evaluate.drift(frozen, now, ["page"])) == [(1, "unchanged"), (2, "changed"), (3, "missing")]


def test_training_pages(spark, rows):
    p = spark.createDataFrame([(1, "verified"), (2, "verified"), (3, "skip"), (4, None), (5, "")], "page int, status string")
    assert rows(curation.training_pages(p, boxes(spark, [(1, 0, "a", 0, 0, 1, 1, None), (4, 0, "a", 0, 0, 1, 1, None)]), ["verified"], ["page"])) == [(1, "positive"), (2, "negative"), (3, "skipped"), (4, "status"), (5, "status")]


def test_fragments_go_on_over_pages(spark, rows):
    data = [("v", 1, 10.0, "start"), ("v", 1, 50.0, "start"), ("v", 2, 0.0, None), ("v", 3, 20.0, "stop"), ("v", 3, 60.0, "start"), ("v", 4, 5.0, "start"), ("w", 1, 30.0, "stop"), ("w", 2, 9.0, None)]
    d = spark.createDataFrame([(*r, 100.0) for r in data], "vol string, page int, y1 double, role string, bottom double")
    want = [("v", 1, 10.0, 50.0, False), ("v", 1, 50.0, 100.0, False), ("v", 2, 0.0, 100.0, True), ("v", 3, 0.0, 20.0, True), ("v", 3, 60.0, 100.0, False), ("v", 4, 0.0, 5.0, True), ("v", 4, 5.0, 100.0, False)]
    assert rows(ordered.fragments(d, ["vol"], ["page"], [], "role", "bottom", carry_open=False)) == sorted(want, key=str)
    more = [*want, ("v", 1, 0.0, 10.0, True), ("w", 1, 0.0, 30.0, True)]
    assert rows(ordered.fragments(d, ["vol"], ["page"], [], "role", "bottom")) == sorted(more, key=str)
