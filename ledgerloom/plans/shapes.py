"""Queries of boxes, reading order, ordered scans and lattices."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import curation, evaluate, geometry, lattice, ordered
from ledgerloom.plans.frames import BOXES_SQL, boxes
from ledgerloom.plans.registry import query
from ledgerloom.runtime import table

WITH = "WITH " + BOXES_SQL
EV_ORDER = ["event_id"]


@query(WITH + """, f AS (SELECT *, max(x2) OVER (PARTITION BY page ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far, max(x2) OVER (PARTITION BY page) AS pw FROM boxes),
 g AS (SELECT page, pw, x1, greatest(far, pw * 0.25) AS lo, least(x1, pw * 0.75) AS hi FROM f WHERE far < x1),
 b AS (SELECT page, pw, (lo + hi) / 2 AS split_x, hi - lo AS w FROM g WHERE hi > lo QUALIFY row_number() OVER (PARTITION BY page ORDER BY hi - lo DESC, x1) = 1)
 SELECT page, split_x FROM b WHERE w >= 0.03 * pw AND EXISTS (SELECT 1 FROM boxes x WHERE x.page = b.page AND (x1 + x2) / 2 < split_x) AND EXISTS (SELECT 1 FROM boxes x WHERE x.page = b.page AND (x1 + x2) / 2 >= split_x)""")
def gutter(spark, root):
    b = boxes(spark, root).withColumn("page_width", F.max("x2").over(W.partitionBy("page")))
    return geometry.gutters(b, ["page"])


@query(WITH + """, f AS (SELECT *, max(x2) OVER (PARTITION BY page) AS pw FROM boxes),
 wd AS (SELECT *, x2 - x1 > 0.7 * pw AS wide, sum(CASE WHEN x2 - x1 > 0.7 * pw THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y1, x1, idx) AS c FROM f),
 bd AS (SELECT *, CASE WHEN wide THEN c * 2 - 1 ELSE c * 2 END AS band FROM wd),
 fr AS (SELECT *, max(x2) OVER (PARTITION BY page, band ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM bd WHERE NOT wide),
 g AS (SELECT page, band, pw, x1, greatest(far, pw * 0.25) AS lo, least(x1, pw * 0.75) AS hi FROM fr WHERE far < x1),
 b AS (SELECT page, band, (lo + hi) / 2 AS sx FROM g WHERE hi > lo AND true QUALIFY row_number() OVER (PARTITION BY page, band ORDER BY hi - lo DESC, x1) = 1 AND hi - lo >= 0.03 * pw),
 ok AS (SELECT page, band, sx FROM b JOIN bd USING (page, band) WHERE NOT wide GROUP BY ALL HAVING min((x1 + x2) / 2) < sx AND max((x1 + x2) / 2) >= sx)
 SELECT page, idx, CAST(row_number() OVER (PARTITION BY page ORDER BY band, CASE WHEN sx IS NULL THEN 0 WHEN (x1 + x2) / 2 >= sx THEN 1 ELSE 0 END, y1, x1, idx) AS INTEGER) AS reading_pos FROM bd LEFT JOIN ok USING (page, band)""")
def reading_order(spark, root):
    b = boxes(spark, root).withColumn("page_width", F.max("x2").over(W.partitionBy("page")))
    return geometry.reading_order(b, ["page"]).select("page", "idx", "reading_pos")


@query(WITH + """ SELECT c.page, c.idx AS child, p.idx AS parent FROM boxes c JOIN boxes p ON c.page = p.page AND c.label = 'N' AND p.label = 'A' AND (c.x1 + c.x2) / 2 BETWEEN p.x1 AND p.x2 AND (c.y1 + c.y2) / 2 BETWEEN p.y1 AND p.y2
 QUALIFY row_number() OVER (PARTITION BY c.page, c.idx ORDER BY (p.x2 - p.x1) * (p.y2 - p.y1), p.idx) = 1""")
def containment_smallest(spark, root):
    b = boxes(spark, root)
    return geometry.smallest_parent(b.where("label = 'N'"), b.where("label = 'A'"), ["page"]).select("page", F.col("a_idx").alias("child"), F.col("b_idx").alias("parent"))


@query(WITH.replace("boxes AS (", "boxes AS MATERIALIZED (") + """, met AS MATERIALIZED (SELECT c.page, c.idx AS child, p.idx AS parent, (c.x1 + c.x2) / 2 AS cx, (c.y1 + c.y2) / 2 AS cy, p.x1, p.x2, p.y1, p.y2 FROM boxes c JOIN boxes p ON c.page = p.page WHERE c.label = 'N' AND p.label = 'A')
 SELECT page, child, parent FROM met WHERE cx >= x1 AND cx <= x2 AND cy >= y1 AND cy <= y2""")
def contained_grid(spark, root):
    """Containment of all parents through a grid of cells, for very full pages."""
    b = boxes(spark, root)
    return geometry.contained(b.where("label = 'N'"), b.where("label = 'A'"), ["page"], cell=150.0).select("page", F.col("a_idx").alias("child"), F.col("b_idx").alias("parent"))


OVER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
AREA = "({p}.x2 - {p}.x1) * ({p}.y2 - {p}.y1)"


@query(WITH + f""" SELECT page, idx FROM boxes a WHERE label = 'R' AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.page = a.page AND b.label = 'A' AND {OVER} >= 0.5 * least({AREA.format(p='a')}, {AREA.format(p='b')}))""")
def overlap_suppress(spark, root):
    b = boxes(spark, root)
    return geometry.suppressed(b.where("label = 'R'"), b.where("label = 'A'"), ["page"]).select("page", "idx")


@query(WITH + f""" SELECT DISTINCT a.page, CASE WHEN {AREA.format(p='a')} >= {AREA.format(p='b')} THEN a.idx ELSE b.idx END AS idx FROM boxes a JOIN boxes b ON a.page = b.page AND a.idx < b.idx AND {OVER} >= 0.6 * least({AREA.format(p='a')}, {AREA.format(p='b')})""")
def covered_duplicates(spark, root):
    return geometry.covered_duplicates(boxes(spark, root), ["page"], 0.6)


@query(WITH + """ SELECT page, label, greatest(min(x1) - 10, 0.0) AS x1, greatest(min(y1) - 10, 0.0) AS y1, least(max(x2) + 10, 900.0) AS x2, least(max(y2) + 10, 1200.0) AS y2 FROM boxes WHERE label IS NOT NULL GROUP BY 1, 2""")
def table_regions(spark, root):
    return geometry.table_regions(boxes(spark, root), ["page"], "label", 10.0, F.lit(900.0), F.lit(1200.0))


@query(WITH + """, m AS (SELECT page, idx, least(greatest(x1 * 0.5 - 20, 0), 300) AS x1, least(greatest(y1 * 2 - 15, 0), 800) AS y1, least(greatest(x2 * 0.5 - 20, 0), 300) AS x2, least(greatest(y2 * 2 - 15, 0), 800) AS y2 FROM boxes) SELECT * FROM m WHERE x2 > x1 AND y2 > y1""")
def scaled_and_clipped(spark, root):
    b = geometry.scale(boxes(spark, root).select("page", "idx", "x1", "y1", "x2", "y2"), F.lit(0.5), F.lit(2.0))
    return geometry.shift_and_clip(b, F.lit(-20.0), F.lit(-15.0), F.lit(300.0), F.lit(800.0))


@query(WITH + """ SELECT page, idx, greatest(0, CAST(trunc(x1 - 12.3) AS INTEGER)) AS l, greatest(0, CAST(trunc(y1 - 12.3) AS INTEGER)) AS t, least(700, CAST(round_even(x2 + 12.3, 0) AS INTEGER)) AS r, least(900, CAST(round_even(y2 + 12.3, 0) AS INTEGER)) AS b FROM boxes""")
def crop_rects(spark, root):
    c = geometry.crop_rect(F.lit(700), F.lit(900), 12.3)
    return boxes(spark, root).select("page", "idx", c.alias("c")).select("page", "idx", F.col("c.left").alias("l"), F.col("c.top").alias("t"), F.col("c.right").alias("r"), F.col("c.bottom").alias("b"))


LAT = """, cells AS (SELECT page, idx, CAST(floor(y1 / 200) AS INTEGER) AS super_row, CAST(floor(x1 / 150) AS INTEGER) AS super_column, x1, y1, x2, y2 FROM boxes)"""


def _lattice(spark, root):
    return boxes(spark, root).select("page", "idx", F.lit(0).alias("table"), F.floor(F.col("y1") / 200).cast("int").alias("super_row"), F.floor(F.col("x1") / 150).cast("int").alias("super_column"), "x1", "y1", "x2", "y2", "label")


@query(WITH + LAT + """, cb AS (SELECT page, super_column, floor(median(x1) + 0.5) AS lo, floor(median(x2) + 0.5) AS hi FROM cells GROUP BY 1, 2), cn AS (SELECT *, lead(lo) OVER (PARTITION BY page ORDER BY lo, super_column) AS nx FROM cb),
 rb AS (SELECT page, super_row, floor(median(y1) + 0.5) AS lo, floor(median(y2) + 0.5) AS hi FROM cells GROUP BY 1, 2), rn AS (SELECT *, lead(lo) OVER (PARTITION BY page ORDER BY lo, super_row) AS nx FROM rb)
 SELECT c.page, c.idx, cn.lo AS x1, rn.lo AS y1, coalesce(cn.nx, cn.hi) AS x2, coalesce(rn.nx, rn.hi) AS y2 FROM cells c JOIN cn USING (page, super_column) JOIN rn USING (page, super_row)""")
def snapped_lattice(spark, root):
    return geometry.snapped(_lattice(spark, root), ["page"]).select("page", "idx", "x1", "y1", "x2", "y2")


@query(WITH + """, o AS (SELECT page, x1, x2, max(x2) OVER (PARTITION BY page ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM boxes), i AS (SELECT *, sum(CASE WHEN far IS NULL OR x1 > far THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x1, x2 ROWS UNBOUNDED PRECEDING) AS g FROM o)
 SELECT page, min(x1) AS lo, max(x2) AS hi FROM i GROUP BY page, g""")
def interval_union(spark, root):
    return geometry.merged_intervals(boxes(spark, root).select("page", F.col("x1").alias("lo"), F.col("x2").alias("hi")), ["page"])


@query(WITH + """, o AS (SELECT page, x1, x2, max(x2) OVER (PARTITION BY page ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM boxes), i AS (SELECT *, sum(CASE WHEN far IS NULL OR x1 > far THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x1, x2 ROWS UNBOUNDED PRECEDING) AS g FROM o),
 u AS (SELECT page, min(x1) AS lo, max(x2) AS hi FROM i GROUP BY page, g), c AS (SELECT page, greatest(lo, 100) AS lo, least(hi, 700) AS hi FROM u WHERE greatest(lo, 100) < least(hi, 700)),
 e AS (SELECT page, lo, hi FROM c UNION ALL SELECT DISTINCT page, 700, 700 FROM boxes), l AS (SELECT page, coalesce(lag(hi) OVER (PARTITION BY page ORDER BY lo, hi), 100) AS lo, lo AS hi FROM e)
 SELECT page, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM l WHERE lo < hi""")
def interval_gaps(spark, root):
    b = boxes(spark, root)
    whole = b.select("page").distinct().select("page", F.lit(100.0).alias("lo"), F.lit(700.0).alias("hi"))
    return geometry.free_intervals(whole, b.select("page", F.col("x1").alias("lo"), F.col("x2").alias("hi")), ["page"])


@query(WITH + """ SELECT page, r, x1, x2, after FROM (SELECT page, CAST(floor(y1 / 100) AS INTEGER) AS r, x2 AS x1, lead(x1) OVER (PARTITION BY page, floor(y1 / 100) ORDER BY x1, idx) AS x2, idx AS after FROM boxes) WHERE x2 - x1 >= 8""")
def lattice_fill(spark, root):
    return geometry.filled_gaps(boxes(spark, root).withColumn("r", F.floor(F.col("y1") / 100).cast("int")), ["page", "r"])


@query(WITH + """, m AS (SELECT *, median(y2 - y1) OVER (PARTITION BY page) AS mh, max(y2) OVER (PARTITION BY page ORDER BY y1, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM boxes)
 SELECT page, idx, sum(CASE WHEN y1 - far >= greatest(3 * mh, 60) THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y1, idx)::BIGINT AS segment FROM m""")
def stacked_segments(spark, root):
    return geometry.stacked_segments(boxes(spark, root), ["page"]).select("page", "idx", "segment")


@query()
def lattice_coordinates(spark, root):
    """Rows and columns by overlapping intervals; each step depends on the ones before, tests hold small pages."""
    return lattice.coordinates(boxes(spark, root), ["page"])


@query()
def lattice_regions(spark, root):
    return lattice.regions(boxes(spark, root), ["page"])


@query()
def lattice_completed(spark, root):
    return lattice.completed(_lattice(spark, root), ["page"])


@query()
def trimmed_overlaps(spark, root):
    return lattice.trimmed(boxes(spark, root), ["page"])


@query()
def merged_same_label(spark, root):
    return lattice.merged_same_label(boxes(spark, root), ["page"])


@query()
def shapes_to_cells(spark, root):
    return lattice.cells_of(boxes(spark, root), ["page"])


@query()
def newspaper_flow(spark, root):
    return lattice.flow(boxes(spark, root).withColumn("label", F.when(F.col("label") == "A", "title").otherwise("text")), ["page"])


@query(WITH + LAT + """, r AS (SELECT page, super_row, count(DISTINCT super_column) AS n FROM cells GROUP BY 1, 2), m AS (SELECT page, max(n) AS most, min(super_row) AS f FROM r GROUP BY 1)
 SELECT page, coalesce(min(super_row) FILTER (n >= greatest(2.0, most * 0.6)), min(f)) AS start_row FROM r JOIN m USING (page) GROUP BY 1""")
def lattice_start_row(spark, root):
    return lattice.start_row(_lattice(spark, root).select("page", F.col("super_row").alias("row_idx"), F.col("super_column").alias("col_idx")), ["page"])


@query(WITH + LAT + """ SELECT page, sum(n)::BIGINT AS height FROM (SELECT page, super_row, max(idx % 4 + 1) AS n FROM cells GROUP BY 1, 2) GROUP BY 1""")
def page_height(spark, root):
    c = _lattice(spark, root).select("page", F.col("super_row").alias("row_idx"), (F.col("idx") % 4 + 1).alias("lines"))
    return lattice.page_height(c, ["page"], "lines")


EVENTS = """ev AS (SELECT event_id, user_id, event_type IN ('click', 'view') AS cont, CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN event_id % 40 END AS locked FROM events)"""


def _boxes_of_users(spark, root):
    e = table(spark, root, "events")
    return e.select("event_id", "user_id", F.col("event_type").isin("click", "view").alias("cont"), F.when((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0), F.col("event_id") % 40).alias("locked"))


@query("WITH " + EVENTS + """, n AS (SELECT *, locked IS NULL AND NOT (cont AND row_number() OVER w > 1) AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 c AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM n), m AS (SELECT *, greatest(0, coalesce(max(locked - k) OVER (PARTITION BY user_id ORDER BY event_id), 0)) AS mx FROM c),
 g AS (SELECT *, CASE WHEN locked IS NOT NULL THEN locked WHEN new THEN k + mx END AS gid FROM m)
 SELECT event_id, user_id, last_value(gid IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS record_id FROM g""")
def record_sweep(spark, root):
    return ordered.record_sweep(_boxes_of_users(spark, root), ["user_id"], EV_ORDER, "cont", "locked").select("event_id", "user_id", "record_id")


@query("""SELECT event_id, user_id, coalesce(last_value(CASE event_type WHEN 'click' THEN 'start' WHEN 'error' THEN 'stop' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 'start') = 'start' AS open_at_end FROM events""")
def carry_open(spark, root):
    e = table(spark, root, "events").withColumn("role", F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "error", "stop"))
    return ordered.open_role(e, ["user_id"], EV_ORDER, "role").select("event_id", "user_id", "open_at_end")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id % 100 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS issue FROM events""")
def issue_fill(spark, root):
    e = table(spark, root, "events")
    return ordered.filled_forward(e, ["user_id"], EV_ORDER, F.when(F.col("event_type") == "purchase", F.col("event_id") % 100), "issue").select("event_id", "user_id", "issue")


@query("""WITH m AS (SELECT user_id, event_id, value, CASE event_type WHEN 'click' THEN 'start' WHEN 'error' THEN 'stop' END AS role FROM events),
 k AS (SELECT user_id, event_id, role, lead(event_id) OVER w AS nx, row_number() OVER w AS rn FROM m WHERE role IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 SELECT user_id, CAST(event_id AS DOUBLE) AS y1, CAST(coalesce(nx, 1000000) AS DOUBLE) AS y2 FROM k WHERE role = 'start'""")
def fragment_spans(spark, root):
    e = table(spark, root, "events").select("user_id", F.lit(0).alias("column"), F.col("event_id").cast("double").alias("y1"), F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "error", "stop").alias("role"), F.lit(1000000.0).alias("bottom"))
    return ordered.fragments(e, ["user_id"], [], ["column"], "role", "bottom").where("not continuation").select("user_id", "y1", "y2")


@query("WITH " + EVENTS + """ SELECT user_id, n, first_page, last_page FROM (SELECT user_id, count(*) AS n, arg_min(event_id // 1000, event_id) AS first_page, arg_max(event_id // 1000, event_id) AS last_page FROM ev GROUP BY 1)""")
def record_collection(spark, root):
    e = _boxes_of_users(spark, root).withColumn("page", F.floor(F.col("event_id") / 1000)).withColumn("text", F.lit("x"))
    return ordered.records(e, [], "user_id", ["event_id"], "page", "text").select("user_id", F.col("n_fragments").alias("n"), "first_page", "last_page")


@query("""WITH p AS (SELECT o_orderstatus AS s, CASE WHEN o_orderkey % 97 = 0 THEN 'cover' ELSE 'page_' || (o_orderkey + 3 * (o_orderkey // 50) - o_orderkey % 13 // 12) END AS stem FROM orders),
 n AS (SELECT s, stem, TRY_CAST(nullif(regexp_extract(stem, '(\\d+)\\D*$', 1), '') AS BIGINT) AS k FROM p), d AS (SELECT DISTINCT s, k FROM n WHERE k IS NOT NULL), g AS (SELECT s, k, lag(k) OVER (PARTITION BY s ORDER BY k) AS b FROM d)
 SELECT s, 'not numbered' AS finding, stem AS value FROM n WHERE k IS NULL UNION ALL SELECT s, 'twice', CAST(k AS VARCHAR) FROM n WHERE k IS NOT NULL GROUP BY s, k HAVING count(*) > 1
 UNION ALL SELECT s, 'missing', CASE WHEN k - b = 2 THEN CAST(b + 1 AS VARCHAR) ELSE (b + 1) || '-' || (k - 1) END FROM g WHERE k - b > 1""")
def page_order(spark, root):
    o = table(spark, root, "orders")
    k = F.col("o_orderkey") + 3 * F.floor(F.col("o_orderkey") / 50) - F.floor(F.col("o_orderkey") % 13 / 12)
    stem = F.when(F.col("o_orderkey") % 97 == 0, "cover").otherwise(F.concat(F.lit("page_"), k.cast("string")))
    return ordered.page_order(o.select(F.col("o_orderstatus").alias("s"), stem.alias("stem")), ["s"])


@query("""WITH r AS (SELECT project, position, row_id, coalesce(hierarchy_level, 0) AS lv, CAST(row_id % 50 AS DOUBLE) AS v FROM grid_rows WHERE is_deleted = 0),
 s AS (SELECT *, sum(CASE WHEN lv >= 1 THEN 1 ELSE 0 END) OVER w - CASE WHEN lv >= 1 THEN 1 ELSE 0 END AS s1, sum(CASE WHEN lv >= 2 THEN 1 ELSE 0 END) OVER w - CASE WHEN lv >= 2 THEN 1 ELSE 0 END AS s2, sum(CASE WHEN lv >= 3 THEN 1 ELSE 0 END) OVER w - CASE WHEN lv >= 3 THEN 1 ELSE 0 END AS s3, sum(CASE WHEN lv >= 4 THEN 1 ELSE 0 END) OVER w - CASE WHEN lv >= 4 THEN 1 ELSE 0 END AS s4 FROM r WINDOW w AS (PARTITION BY project ORDER BY position, row_id)),
 c AS (SELECT *, sum(CASE WHEN lv = 0 THEN v END) OVER (PARTITION BY project, s1) AS c1, sum(CASE WHEN lv = 1 THEN v END) OVER (PARTITION BY project, s2) AS c2, sum(CASE WHEN lv = 2 THEN v END) OVER (PARTITION BY project, s3) AS c3, sum(CASE WHEN lv = 3 THEN v END) OVER (PARTITION BY project, s4) AS c4 FROM s)
 SELECT project, row_id, CAST(lv AS INTEGER) AS level, v AS stated, CASE lv WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 ELSE c4 END AS computed, abs(v - CASE lv WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 ELSE c4 END) <= 0.5 AS ok FROM c WHERE lv BETWEEN 1 AND 4 AND CASE lv WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 ELSE c4 END IS NOT NULL""")
def hierarchy_sums(spark, root):
    r = table(spark, root, "grid_rows").where("is_deleted = 0").withColumn("v", (F.col("row_id") % 50).cast("double"))
    return ordered.hierarchy_sums(r, ["project"], ["position", "row_id"], "hierarchy_level", "v").select("project", "row_id", "level", "stated", "computed", "ok")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_suppkey % 4 AS n FROM lineitem), k AS (SELECT l_orderkey, n, count(*) AS c FROM c GROUP BY 1, 2), m AS (SELECT l_orderkey, n AS usual FROM k QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, n) = 1)
 SELECT usual, count(*) AS n, count(*) FILTER (n <> usual) AS deviating FROM c JOIN m USING (l_orderkey) GROUP BY 1""")
def line_mode(spark, root):
    c = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 4).alias("n"))
    return ordered.line_mode(c, ["l_orderkey"], "n").groupBy("usual").agg(F.count("*").alias("n"), F.sum(F.col("deviates").cast("bigint")).alias("deviating"))


@query("""WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha1(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k FROM orders) SELECT o_orderkey FROM r, n WHERE k <= greatest(1, round_even(n * 0.1, 0))""")
def train_subset(spark, root):
    o = table(spark, root, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("stem"))
    return ordered.nested_subset(o, "stem", 0.1).select("o_orderkey")


@query("""WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders), a AS (SELECT DISTINCT CAST(round_even(k * (n - 1) / 49, 0) AS BIGINT) AS i FROM n, range(50) t(k)) SELECT o_orderkey FROM r JOIN a USING (i)""")
def frozen_set(spark, root):
    return ordered.evenly_spaced(table(spark, root, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], 50).select("o_orderkey")


def _predicted(spark, root):
    b = boxes(spark, root)
    return b.where("idx % 6 <> 5").withColumns({"x1": F.col("x1") + F.col("idx") % 4 * 3, "x2": F.col("x2") + F.col("idx") % 4 * 3})


@query()
def iou_match(spark, root):
    """Greedy matching of shifted boxes; the scan of a page and label is sequential, tests hold it against a direct version."""
    return evaluate.matched_boxes(boxes(spark, root), _predicted(spark, root), ["page"]).select("page", "label", "truth_idx", "predicted_idx", F.round("iou", 6).alias("iou"))


@query()
def corrections(spark, root):
    c = evaluate.corrections(boxes(spark, root), _predicted(spark, root), ["page"])
    return evaluate.corrections_rollup(c, "page")


@query(WITH + """, old AS (SELECT page, idx, score FROM boxes), new AS (SELECT page, idx + 100 AS idx, 0.5 AS score FROM boxes WHERE page % 2 = 0 AND idx < 3)
 SELECT page, count(*) AS n, count(*) FILTER (idx >= 100) AS fresh FROM (SELECT page, idx FROM old WHERE score IS NULL OR page NOT IN (SELECT page FROM new) UNION ALL SELECT page, idx FROM new) GROUP BY 1""")
def merge_children(spark, root):
    b = boxes(spark, root)
    new = b.where("page % 2 = 0 and idx < 3").withColumn("idx", F.col("idx") + 100).withColumn("score", F.lit(0.5))
    return evaluate.merged_children(b, new, ["page"]).groupBy("page").agg(F.count("*").alias("n"), F.sum((F.col("idx") >= 100).cast("bigint")).alias("fresh"))


@query(WITH + """, st AS (SELECT page, min(idx) AS pos FROM boxes WHERE label = 'A' GROUP BY 1), ev AS (SELECT page, idx AS o, 0 AS n, idx, label FROM boxes WHERE label <> 'A' UNION ALL SELECT b.page, coalesce(pos, 1073741824), 1, b.idx, b.label FROM boxes b LEFT JOIN st USING (page) WHERE label = 'A' AND idx % 2 = 0)
 SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY o, n, idx) - 1 AS INTEGER) AS idx, label FROM ev""")
def merge_labels(spark, root):
    b = boxes(spark, root)
    return evaluate.merged_labels(b, b.where("idx % 2 = 0"), ["page"], ["A"]).select("page", "idx", "label")


@query(WITH + """ SELECT page FROM boxes GROUP BY 1 HAVING page % 3 = 0 AND count(*) FILTER (idx = 0) > 0""")
def changed_pages(spark, root):
    b = boxes(spark, root)
    after = b.withColumn("x1", F.when((F.col("page") % 3 == 0) & (F.col("idx") == 0), F.col("x1") + 1).otherwise(F.col("x1")))
    return evaluate.changed_pages(b, after, ["page"])


@query(WITH + """ SELECT page, sha1(array_to_string(list_sort(list(label || ',' || CAST(x1 AS VARCHAR) || ',' || CAST(y1 AS VARCHAR) || ',' || CAST(x2 AS VARCHAR) || ',' || CAST(y2 AS VARCHAR))), ';')) AS hash FROM boxes GROUP BY 1""")
def page_hashes(spark, root):
    return evaluate.page_hash(boxes(spark, root), ["page"])


@query(WITH + """, i AS (SELECT page, row_number() OVER (ORDER BY page) AS image_id FROM (SELECT DISTINCT page FROM boxes)), c AS (SELECT * FROM (VALUES (1, 'A'), (2, 'N'), (3, 'R')) t(category_id, label))
 SELECT row_number() OVER (ORDER BY image_id, idx) AS id, image_id, category_id, (x2 - x1) * (y2 - y1) AS area FROM boxes JOIN i USING (page) JOIN c USING (label) WHERE x2 > x1 AND y2 > y1""")
def coco_export(spark, root):
    b = boxes(spark, root).withColumnRenamed("page", "stem")
    pages = b.select("stem", F.lit(800).alias("width"), F.lit(1100).alias("height"))
    return curation.coco(pages, b, ["A", "N", "R"])["annotations"].select("id", "image_id", "category_id", "area")


@query(WITH + """, s AS (SELECT page, idx, x1 FROM boxes WHERE idx % 5 <> 4), d AS (SELECT page, idx, CASE WHEN idx % 4 = 0 THEN x1 + 3 ELSE x1 END AS x1, idx % 8 = 0 AS h FROM boxes WHERE idx % 7 <> 6)
 SELECT state, count(*) AS n FROM (SELECT CASE WHEN d.page IS NULL THEN 'created' WHEN s.page IS NULL AND h THEN 'protected' WHEN s.page IS NULL THEN 'stale' WHEN abs(s.x1 - d.x1) <= 0.5 THEN 'unchanged' WHEN h THEN 'protected' ELSE 'refreshed' END AS state FROM s FULL JOIN d ON s.page = d.page AND s.idx = d.idx) GROUP BY 1""")
def derived_state(spark, root):
    b = boxes(spark, root).select("page", "idx", "x1", "y1", "x2", "y2")
    d = b.where("idx % 7 <> 6").withColumn("x1", F.when(F.col("idx") % 4 == 0, F.col("x1") + 3).otherwise(F.col("x1"))).withColumn("has_human_work", F.col("idx") % 8 == 0)
    return curation.derived_state(b.where("idx % 5 <> 4"), d, ["page", "idx"]).groupBy("state").agg(F.count("*").alias("n"))


@query(WITH + """, t AS (SELECT page, idx, CAST(idx % 3 AS INTEGER) AS tb FROM boxes), k AS (SELECT DISTINCT page, tb FROM t WHERE tb = 1 AND page % 2 = 0), m AS (SELECT page, max(tb) AS m FROM t GROUP BY 1)
 SELECT page, idx, CAST(CASE WHEN k.tb IS NULL THEN t.tb ELSE m + 1 END AS INTEGER) AS "table" FROM t LEFT JOIN k USING (page, tb) JOIN m USING (page)""")
def renumbered_tables(spark, root):
    b = boxes(spark, root).select("page", "idx", (F.col("idx") % 3).cast("int").alias("table"))
    return curation.renumbered_tables(b, ["page"], b.where("table = 1 and page % 2 = 0").select("page", "table").distinct())
