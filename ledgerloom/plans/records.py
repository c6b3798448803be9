"""Queries of text, dataset joins, review, resolution, edits and streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import numbers, parse, text
from ledgerloom.operators import curation, dataset, evaluate, history, mutate, ordered, resolve, review
from ledgerloom.plans.checks import VALUES_SQL
from ledgerloom.plans.frames import CELLS_SQL, folded, grid, latest
from ledgerloom.plans.registry import query
from ledgerloom.runtime import table
from ledgerloom.streaming import events as streams


# ---- text and layers

LAYERS_SQL = """lay AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'Value ' || (o_orderkey % 9) WHEN 1 THEN '  ' END AS human, CASE o_orderkey % 3 WHEN 0 THEN 'value  ' || (o_orderkey % 9) WHEN 1 THEN 'Value ' || (o_orderkey % 7) END AS llm,
  CASE o_orderkey % 2 WHEN 0 THEN 'Value ' || (o_orderkey % 9) ELSE '' END AS ocr, CASE WHEN o_orderkey % 7 < 3 THEN 'Value ' || (o_orderkey % 7) END AS pdf FROM orders)"""


def _layers(spark, root):
    k = F.col("o_orderkey")
    v = lambda m: F.concat(F.lit("Value "), (k % m).cast("string"))
    return table(spark, root, "orders").select(
        k.alias("k"), F.when(k % 5 == 0, v(9)).when(k % 5 == 1, "  ").alias("human"), F.when(k % 3 == 0, F.concat(F.lit("value  "), (k % 9).cast("string"))).when(k % 3 == 1, v(7)).alias("llm"), F.when(k % 2 == 0, v(9)).otherwise("").alias("ocr"), F.when(k % 7 < 3, v(7)).alias("pdf")
    )


@query("WITH " + LAYERS_SQL + " SELECT k, coalesce(CASE WHEN trim(human) <> '' THEN human END, CASE WHEN trim(llm) <> '' THEN llm END, CASE WHEN trim(ocr) <> '' THEN ocr END, CASE WHEN trim(pdf) <> '' THEN pdf END) AS best, CASE WHEN trim(human) <> '' THEN 'human' WHEN trim(ocr) <> '' THEN 'ocr' WHEN trim(llm) <> '' THEN 'llm' END AS source FROM lay")
def best_layer(spark, root):
    d = _layers(spark, root)
    return d.select("k", text.best_layer(F.col("human"), F.col("llm"), F.col("ocr"), F.col("pdf")).alias("best"), text.layer(F.col("human"), F.col("llm"), F.col("ocr"), "best_ocr")["source"].alias("source"))


@query("WITH " + LAYERS_SQL + " SELECT count(*) AS n FROM lay WHERE trim(coalesce(ocr, '')) <> '' AND trim(coalesce(llm, '')) <> '' AND lower(trim(regexp_replace(ocr, '\\s+', ' ', 'g'))) <> lower(trim(regexp_replace(llm, '\\s+', ' ', 'g')))")
def layers_disagree(spark, root):
    return _layers(spark, root).where(text.layers_disagree(F.col("ocr"), F.col("llm"))).agg(F.count("*").alias("n"))


@query("WITH " + LAYERS_SQL + """, v AS (SELECT k, trim(x) AS value FROM lay, unnest([llm, ocr, pdf]) t(x) WHERE trim(coalesce(x, '')) <> ''), c AS (SELECT k, value, count(*) AS votes, sum(count(*)) OVER (PARTITION BY k) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY votes DESC) AS r FROM c), t AS (SELECT *, count(*) OVER (PARTITION BY k, r) AS tied FROM r)
 SELECT k, value, votes FROM t WHERE r = 1 AND tied = 1 AND (votes >= 2 OR n = 1)""")
def majority_vote(spark, root):
    return review.majority(_layers(spark, root), ["k"], ["llm", "ocr", "pdf"])


@query("WITH " + LAYERS_SQL + """, v AS (SELECT k, trim(x) AS value FROM lay, unnest([llm, ocr, pdf]) t(x) WHERE trim(coalesce(x, '')) <> ''), c AS (SELECT k, value, count(*) AS votes, sum(count(*)) OVER (PARTITION BY k) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY votes DESC) AS r FROM c), t AS (SELECT *, count(*) OVER (PARTITION BY k, r) AS tied FROM r), w AS (SELECT k, value FROM t WHERE r = 1 AND tied = 1 AND (votes >= 2 OR n = 1))
 SELECT k, value FROM lay LEFT JOIN w USING (k)""")
def majority_vote_rowwise(spark, root):
    return _layers(spark, root).select("k", review.majority_rowwise([F.col("llm"), F.col("ocr"), F.col("pdf")]).alias("value"))


DOC_LINES = "SELECT doc_id, trim(x, ' ') AS line, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL AND text <> '')"


@query(f"WITH l AS ({DOC_LINES}) SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (length(line) >= 3 OR regexp_matches(line, '^[0-9]{{1,2}}$')), '') AS kept, count(*) FILTER (line <> '') AS n FROM documents d LEFT JOIN l USING (doc_id) GROUP BY 1")
def strip_short_lines(spark, root):
    d = table(spark, root, "documents")
    return d.select("doc_id", text.strip_short_lines(F.col("text")).alias("kept"), text.line_count(F.col("text")).cast("bigint").alias("n"))


@query("""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS n_lines, trim(string_split(trim(text, ' '), chr(10))[1], ' ')[1:80] AS first FROM documents""")
def lines_of_text(spark, root):
    d = table(spark, root, "documents")
    return d.select("doc_id", F.size(text.positioned_lines(F.col("text"))).cast("bigint").alias("n_lines"), text.first_line(F.col("text")).alias("first"))


@query(f"""SELECT doc_id FROM documents WHERE contains({folded('text')}, 'takarekpenztar')""")
def search(spark, root):
    return table(spark, root, "documents").where(F.contains(text.fold(F.col("text")), F.lit("takarekpenztar"))).select("doc_id")


@query("""WITH h AS (SELECT doc_id FROM documents WHERE contains(lower(translate(text, 'áéíóöőúüűÁÉÍÓÖŐÚÜŰ', 'aeiooouuuAEIOOOUUU')), 'gozmalom') AND source IN ('ledger_scan', 'directory_ocr')) SELECT doc_id, (SELECT count(*) FROM h) > 20 AS truncated FROM h ORDER BY doc_id LIMIT 20""")
def search_page(spark, root):
    """The first page of a search; the limit is what the page asks for."""
    d = table(spark, root, "documents").withColumnRenamed("source", "label")
    return review.search(d, "gőzmalom", ["text"], ["ledger_scan", "directory_ocr"], ["doc_id"], 20).select("doc_id", "truncated")


@query("WITH " + CELLS_SQL + """ SELECT variable, count(*) AS n FROM grid WHERE regexp_matches(trim(value), '^[„”“"''’〃»«,.\\s-]*[„”“"〃»«][„”“"''’〃»«,.\\s-]*$') OR lower(trim(value)) IN ('u.o.', 'u. o.', 'uo.', 'uo', 'ua.', 'u.a.', 'do.', 'dto.', 'dtto', 'id.', 'ugyanott', 'ugyanaz', 'detto', 'ditto', 'ibid.') GROUP BY 1""")
def ditto_marks(spark, root):
    return grid(spark, root).where(text.is_ditto(F.col("value"))).groupBy("variable").agg(F.count("*").alias("n"))


@query("WITH " + CELLS_SQL + """, c AS (SELECT l.project, r.position, l.row_id, r.page_stem, l.value FROM latest l JOIN grid_rows r USING (project, row_id) WHERE variable = 'county' AND r.is_deleted = 0)
 SELECT row_id, last_value(CASE WHEN regexp_matches(value, '[\\p{L}\\p{N}]') AND NOT regexp_matches(trim(value), '^[„”“"''’〃»«,.\\s-]*[„”“"〃»«][„”“"''’〃»«,.\\s-]*$') THEN value END IGNORE NULLS) OVER (PARTITION BY project, page_stem ORDER BY position, row_id) AS county FROM c""")
def ditto_fill(spark, root):
    rows = table(spark, root, "grid_rows").where("is_deleted = 0").select("project", "row_id", F.col("position").alias("pos"), "page_stem")
    c = latest(spark, root).where("variable = 'county'").join(rows, ["project", "row_id"])
    return ordered.ditto_filled(c, ["project"], ["pos", "row_id"], "value", text.is_ditto(F.col("value")), "county", ["page_stem"]).select("row_id", "county")


@query("""SELECT doc_id, CASE WHEN n = 0 THEN 'short' WHEN t > 80 THEN 'long' ELSE 'ok' END AS kind FROM (SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(project, ''), '\\s', '', 'g')) < 2 THEN 0 ELSE 1 END AS n, length(trim(project)) AS t FROM documents)""")
def resolvable(spark, root):
    d = table(spark, root, "documents").select("doc_id", "project")
    return d.select("doc_id", F.when(text.resolvable(F.col("project")), "ok").when(F.length(F.trim("project")) > 80, "long").otherwise("short").alias("kind"))


@query("""SELECT o_orderkey, string_agg(CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 12, '0') ELSE p END, '' ORDER BY i) AS key FROM (SELECT o_orderkey, unnest(regexp_extract_all('page_' || o_orderkey || 'b', '[0-9]+|[^0-9]+')) AS p, generate_subscripts(regexp_extract_all('page_' || o_orderkey || 'b', '[0-9]+|[^0-9]+'), 1) AS i FROM orders) GROUP BY 1""")
def natural_order(spark, root):
    return table(spark, root, "orders").select("o_orderkey", text.natural_key(F.concat(F.lit("Page_"), F.col("o_orderkey").cast("string"), F.lit("b"))).alias("key"))


@query("""SELECT event_id, 'check|' || event_type || '|None|' || user_id || '|' || CASE WHEN event_id % 3 = 0 THEN 'None' ELSE CAST(event_id AS VARCHAR) END AS flag FROM events""")
def flag_ids(spark, root):
    e = table(spark, root, "events")
    return e.select("event_id", text.flag_id(F.lit("check"), F.col("event_type"), F.lit(None), F.col("user_id"), F.when(F.col("event_id") % 3 != 0, F.col("event_id"))).alias("flag"))


DATES_SQL = """SELECT event_date AS d, entry_id FROM court_entries WHERE event_date IS NOT NULL"""


@query(f"""SELECT entry_id, CASE WHEN length(d) = 4 THEN d WHEN length(d) = 7 THEN d ELSE d END AS iso, CASE length(d) WHEN 10 THEN 'day' WHEN 7 THEN 'month' ELSE 'year' END AS precision FROM ({DATES_SQL})""")
def date_parse(spark, root):
    """Dates printed in words, made of the entries' dates, read back."""
    names = ["januárius", "február", "márczius", "április", "május", "június", "július", "augusztus", "szeptember", "október", "november", "deczember"]
    e = table(spark, root, "court_entries").where("event_date is not null").select("entry_id", F.split("event_date", "-").alias("p"))
    month = F.element_at(F.array(*[F.lit(n) for n in names]), F.try_element_at("p", F.lit(2)).cast("int"))
    words = F.when(F.size("p") == 1, F.concat(F.lit("kelt "), F.element_at("p", 1))).when(F.size("p") == 2, F.concat(F.element_at("p", 1), F.lit(". évi "), month)).otherwise(F.concat(F.element_at("p", 1), F.lit(". évi "), month, F.lit(" hó "), F.try_element_at("p", F.lit(3)).cast("int").cast("string"), F.lit("-én")))
    iso = parse.partial_date(words)
    return e.select("entry_id", iso.alias("iso")).withColumn("precision", parse.date_precision(F.col("iso")))


@query("""SELECT entity_id, as_of, seq, folio, sub FROM slices WHERE folio IS NOT NULL AND sub IS NOT NULL""")
def folio_parse(spark, root):
    s = table(spark, root, "slices").where("folio is not null and sub is not null")
    printed = F.concat(F.lit("Bejegyezve: "), F.col("folio").cast("string"), F.lit("/"), F.col("sub").cast("string"), F.lit(". lap, 1/2/3 alatt"))
    return s.select("entity_id", "as_of", "seq", parse.folio(printed).alias("f")).select("entity_id", "as_of", "seq", "f.folio", "f.sub")


@query()
def event_types(spark, root):
    """What the verbs of every document say happened. Closing letter-spaced print up is not in SQL; tests hold the parser by examples."""
    return table(spark, root, "documents").select("doc_id", parse.event_type(F.col("text")).alias("event"))


@query("""SELECT k, v FROM (VALUES (1, 1), (4, 4), (9, 9), (14, 14), (40, 40), (49, 49), (90, 90), (99, 99), (0, NULL)) t(k, v)""")
def roman_numerals(spark, root):
    d = spark.createDataFrame([(1, "i"), (4, "IV"), (9, "ix"), (14, "xiv"), (40, "xl"), (49, "xlix"), (90, "xc"), (99, "xcix"), (0, "abc")], "k int, s string")
    return d.select("k", parse.roman(F.col("s")).alias("v"))


@query("""SELECT k, issue, volume, volume_no, year, previous FROM (VALUES (1, 97, NULL, NULL, NULL, false), (2, 34, 'II', 2, NULL, false), (3, 8, NULL, NULL, 1924, false), (4, NULL, NULL, NULL, NULL, true)) t(k, issue, volume, volume_no, year, previous)""")
def issue_references(spark, root):
    rows = [(1, "(Lásd az eredeti bejegyzést »Közp. Ért.« 97. sz.)"), (2, "Lásd a II. évf. 34. számát"), (3, "(Lásd 1924. évf. 8.)"), (4, "(L á s d az előbbi bejegyzést.)"), (5, "14333. számú végzés")]
    d = spark.createDataFrame(rows, "k int, s string").select("k", parse.issue_reference(F.col("s")).alias("r"))
    return d.where("r is not null").select("k", "r.issue", "r.volume", "r.volume_no", "r.year", "r.previous")


# ---- dataset

@query("""SELECT l_orderkey AS k, seq, a, b FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, l_partkey AS a FROM lineitem WHERE l_linenumber % 2 = 0) x FULL JOIN (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, l_partkey AS b FROM lineitem WHERE l_linenumber % 2 = 1) y USING (l_orderkey, seq)""")
def positional_join(spark, root):
    li = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey")
    rec, _ = dataset.positional_join({"a": li.where("l_linenumber % 2 = 0"), "b": li.where("l_linenumber % 2 = 1")}, ["k"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey")
    return rec.select("k", F.col("seq").cast("bigint").alias("seq"), "a", "b")


@query("""WITH x AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1), y AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1)
 SELECT coalesce(x.k, y.k) AS k, 'b' AS slot, y.n AS n, x.n AS expected FROM x FULL JOIN y ON x.k = y.k WHERE y.n IS DISTINCT FROM x.n AND y.n IS NOT NULL""")
def positional_findings(spark, root):
    li = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey")
    _, bad = dataset.positional_join({"a": li.where("l_linenumber % 2 = 0"), "b": li.where("l_linenumber % 2 = 1")}, ["k"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey")
    return bad.where("slot is not null")


@query(f"""WITH p AS (SELECT p_partkey, p_name || (p_partkey % 300) AS key FROM part WHERE p_partkey % 2 = 0), s AS (SELECT p_partkey, upper(p_name) || (p_partkey % 400) AS key FROM part WHERE p_partkey % 2 = 1 OR p_partkey % 10 = 4),
 l AS (SELECT *, {folded('key')} AS f FROM p), r AS (SELECT *, {folded('key')} AS f FROM s), lc AS (SELECT *, count(*) OVER (PARTITION BY f) AS c FROM l), rc AS (SELECT *, count(*) OVER (PARTITION BY f) AS c FROM r)
 SELECT side, finding, count(*) AS n FROM (SELECT 'left' AS side, 'ambiguous' AS finding FROM lc WHERE c > 1 UNION ALL SELECT 'right', 'ambiguous' FROM rc WHERE c > 1 UNION ALL SELECT 'left', 'orphan' FROM lc WHERE c = 1 AND f NOT IN (SELECT f FROM r) UNION ALL SELECT 'right', 'orphan' FROM rc WHERE c = 1 AND f NOT IN (SELECT f FROM l)
 UNION ALL SELECT 'both', 'joined' FROM lc JOIN rc USING (f) WHERE lc.c = 1 AND rc.c = 1) GROUP BY 1, 2""")
def keyed_join(spark, root):
    p = table(spark, root, "part")
    k = lambda n, m: F.concat(n, (F.col("p_partkey") % m).cast("string")).alias("key")
    le = p.where("p_partkey % 2 = 0").select("p_partkey", k(F.col("p_name"), 300))
    ri = p.where("p_partkey % 2 = 1 or p_partkey % 10 = 4").select("p_partkey", k(F.upper("p_name"), 400))
    rec, bad = dataset.keyed_join(le, ri, "key")
    joined = rec.select(F.lit("both").alias("side"), F.lit("joined").alias("finding"))
    return bad.select("side", "finding").unionByName(joined).groupBy("side", "finding").agg(F.count("*").alias("n"))


@query("""SELECT project, CASE WHEN bool_or(name = 'Lóerő') AND bool_or(name = 'Község') THEN 'industry' END AS declaration, CASE WHEN bool_or(name = 'Lóerő') AND bool_or(name = 'Község') THEN 'covered' ELSE 'uncovered' END AS status FROM grid_columns GROUP BY 1""")
def header_scopes(spark, root):
    t = table(spark, root, "grid_columns").groupBy("project").agg(F.collect_set("name").alias("headers"))
    return dataset.header_scopes(t, [{"name": "industry", "patterns": ["^loero$", "^kozseg$"]}, {"name": "other", "patterns": ["^nincs$"]}], ["project"])


@query("""SELECT page_no, page_no % 5 IN (0, 2, 3) AS applies, CASE page_no % 5 WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS slot, page_no <= 3 OR page_no = 7 OR page_no >= 90 AS in_range FROM (SELECT DISTINCT page_no FROM documents WHERE page_no IS NOT NULL)""")
def page_patterns(spark, root):
    d = table(spark, root, "documents").where("page_no is not null").select("page_no").distinct()
    p = dataset.page_pattern(F.col("page_no"), [1, 0, 1, 1, 0])
    return d.select("page_no", p["applies"].alias("applies"), p["slot"].alias("slot"), dataset.page_ranges("-3, 7, 90-", F.col("page_no")).alias("in_range"))


# ---- review and curation


def _ascii(c):
    """Other characters as one '?', so that edits count characters in either engine."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "?")


@query("""SELECT project, count(*) FILTER (s = 'predicted') AS predicted, count(*) FILTER (s = 'in_progress') AS in_progress, count(*) FILTER (s = 'verified') AS verified, count(*) FILTER (s = 'skip') AS skip, count(*) FILTER (s <> 'skip') AS total_work
 FROM (SELECT project, CASE doc_id % 4 WHEN 0 THEN 'predicted' WHEN 1 THEN 'verified' WHEN 2 THEN 'skip' ELSE 'predicted' END AS s FROM documents) GROUP BY 1""")
def scoreboard(spark, root):
    k = F.col("doc_id") % 4
    d = table(spark, root, "documents").select("project", F.when(k == 1, "verified").when(k == 2, "skip").when(k == 3, "").alias("status"))
    return review.scoreboard(d, ["project"])


@query("""SELECT source, status, count(*) AS n FROM (SELECT source, CASE doc_id % 3 WHEN 0 THEN 'verified' ELSE 'predicted' END AS status FROM documents) GROUP BY CUBE (source, status)""")
def training_counts(spark, root):
    d = table(spark, root, "documents").select("source", F.when(F.col("doc_id") % 3 == 0, "verified").alias("status"))
    return curation.counts_by_source(d).select("source", "status", "n")


@query("""WITH l AS (SELECT user_id AS u, event_id // 7 AS stem, event_id AS ts, value AS n FROM events), o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY u, stem ORDER BY ts DESC, n DESC) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY ts DESC, stem DESC) AS k FROM o)
 SELECT u, count(*) AS pages, round(avg(n) FILTER (k <= 20), 6) AS mean FROM k GROUP BY 1""")
def corrections_window(spark, root):
    e = table(spark, root, "events").select(F.col("user_id").alias("u"), F.floor(F.col("event_id") / 7).alias("stem"), F.col("event_id").alias("ts"), F.col("value").alias("n"))
    return evaluate.moving_corrections(e, ["u"]).select("u", "pages", F.round("mean", 6).alias("mean"))


@query("WITH " + CELLS_SQL + """ SELECT variable, count(*) FILTER (t = g) AS exact, count(*) FILTER (g <> '' AND t <> g AND levenshtein(t, g) <= 1) AS near, count(*) FILTER (g <> '' AND levenshtein(t, g) > 1) AS wrong, count(*) FILTER (g = '') AS missing
 FROM (SELECT variable, trim(regexp_replace(original_value, '[^\\x00-\\x7F]', '?', 'g')) AS t, coalesce(trim(regexp_replace(value, '[^\\x00-\\x7F]', '?', 'g')), '') AS g FROM grid) WHERE coalesce(t, '') <> '' GROUP BY 1""")
def cell_accuracy(spark, root):
    return evaluate.cell_accuracy(grid(spark, root), ["variable"], _ascii("original_value"), _ascii("value"))


@query("WITH " + CELLS_SQL + """, v AS (SELECT cell_id, value AS v FROM latest WHERE variable = 'settlement'), s AS (SELECT cell_id, regexp_replace(v, '[^\\x00-\\x7F]', '?', 'g') AS v, regexp_replace(original_value, '[^\\x00-\\x7F]', '?', 'g') AS o FROM v JOIN cells USING (cell_id)) SELECT cell_id, round(CASE WHEN TRY_CAST(coalesce(o, '') AS DOUBLE) IS NOT NULL AND TRY_CAST(coalesce(v, '') AS DOUBLE) IS NOT NULL THEN pow(coalesce(abs(TRY_CAST(o AS DOUBLE) - TRY_CAST(v AS DOUBLE)) / nullif(greatest(abs(TRY_CAST(o AS DOUBLE)), abs(TRY_CAST(v AS DOUBLE))), 0), 0), 2)
  ELSE pow(coalesce(levenshtein(coalesce(o, ''), coalesce(v, '')) / nullif(greatest(length(coalesce(o, '')), length(coalesce(v, ''))), 0), 0), 2) END, 9) AS d FROM s""")
def line_distance(spark, root):
    c = latest(spark, root).where("variable = 'settlement'")
    return c.select("cell_id", F.round(evaluate.line_distance(_ascii("original_value"), _ascii("value")), 9).alias("d"))


@query("""WITH l AS (SELECT CAST(c_custkey AS VARCHAR) AS path, 'h' || (c_nationkey % 5) AS h FROM customer), r AS (SELECT CAST(o_custkey + 100 AS VARCHAR) AS path, 'h' || (min(o_orderkey) % 5) AS h FROM orders GROUP BY o_custkey)
 SELECT CASE WHEN r.h IS NULL THEN 'new' WHEN l.h IS NULL THEN 'remote_only' WHEN l.h = r.h THEN 'identical' ELSE 'differing' END AS state, count(*) AS n FROM l FULL JOIN r ON l.path = r.path GROUP BY 1""")
def sync_states(spark, root):
    h = lambda c: F.concat(F.lit("h"), (c % 5).cast("string"))
    local = table(spark, root, "customer").select(F.col("c_custkey").cast("string").alias("path"), h(F.col("c_nationkey")).alias("hash"))
    remote = table(spark, root, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("k")).select((F.col("o_custkey") + 100).cast("string").alias("path"), h(F.col("k")).alias("hash"))
    return curation.sync_state(local, remote).groupBy("state").agg(F.count("*").alias("n"))


@query("WITH " + VALUES_SQL.replace("FROM lineitem)", "FROM lineitem WHERE l_partkey % 9 <> 0 AND l_suppkey % 13 <> 0)") + """ SELECT 'layers disagree' AS reason, 4 AS severity, count(*) AS n FROM lineitem WHERE l_partkey % 9 <> 0 AND l_suppkey % 13 <> 0 AND l_partkey % 20 = 0 HAVING count(*) > 0
 UNION ALL SELECT 'outlier', 3, count(*) FROM tested JOIN q USING (variable) WHERE t < q1 - 3 * (q3 - q1) OR t > q3 + 3 * (q3 - q1) HAVING count(*) > 0""")
def review_queue(spark, root):
    """Cells to be looked at."""
    li = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("variable"), F.col("l_extendedprice").alias("value"), F.when(F.col("l_partkey") % 9 == 0, "x").alias("human"), F.col("l_partkey").cast("string").alias("llm"), F.when(F.col("l_partkey") % 20 == 0, "7").otherwise(F.col("l_partkey").cast("string")).alias("ocr"), (F.col("l_suppkey") % 13 == 0).alias("blank"))
    return review.queue(li, ["l_orderkey", "l_linenumber"]).groupBy("reason", "severity").agg(F.count("*").alias("n"))


# ---- resolution

NAMES_SQL = f"""ent AS (SELECT id AS entity, name FROM entities WHERE type <> 'firm' UNION ALL SELECT entity_id, name FROM aliases), rec AS (SELECT record_id AS record, seat AS q FROM identities WHERE seat IS NOT NULL),
 q AS (SELECT DISTINCT record, {folded('q')} AS q FROM rec WHERE {folded('q')} <> ''), e AS (SELECT DISTINCT entity, {folded('name')} AS e FROM ent WHERE {folded('name')} <> ''),
 p AS (SELECT DISTINCT q.q, e.e FROM (SELECT DISTINCT q FROM q) q, (SELECT DISTINCT e FROM e) e), s AS (SELECT q, e, 100.0 * (1 - levenshtein(q, e) / greatest(length(q), length(e))) AS score FROM p), m AS (SELECT record, entity, max(score) AS score FROM q JOIN s USING (q) JOIN e USING (e) WHERE score >= 70 GROUP BY 1, 2)"""


def _queries(spark, root):
    q = table(spark, root, "identities").where("seat is not null").select(F.col("record_id").alias("record"), F.col("seat").alias("query"))
    e = table(spark, root, "entities").where("type <> 'firm'").select(F.col("id").alias("entity"), "name")
    e = e.unionByName(table(spark, root, "aliases").select(F.col("entity_id").alias("entity"), "name"))
    return q, e


@query("WITH " + NAMES_SQL + " SELECT record, entity, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY score DESC, entity) AS rank FROM m) WHERE rank <= 8")
def fuzzy_candidates(spark, root):
    q, e = _queries(spark, root)
    c = resolve.candidates(q, e)
    return c.select("record", "entity", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH ent AS (SELECT id AS entity, name FROM entities WHERE type <> 'firm' UNION ALL SELECT entity_id, name FROM aliases), t AS (SELECT entity, unnest(string_split({folded('name')}, ' ')) AS token FROM ent), n AS (SELECT count(DISTINCT entity) AS n FROM ent)
 SELECT token, round(ln((n + 1) / (count(DISTINCT entity) + 1)) + 1, 6) AS weight FROM t, n WHERE token <> '' GROUP BY token, n""")
def token_weights(spark, root):
    _, e = _queries(spark, root)
    return resolve.token_weights(e, "entity", "name").select("token", F.round("weight", 6).alias("weight"))


AGREE_SQL = "CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} = {b} OR contains({a}, {b}) OR contains({b}, {a}) OR list_last(string_split({a}, ' ')) = list_last(string_split({b}, ' ')) OR 100.0 * (1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))) >= 85 END"


@query(f"""WITH q AS (SELECT DISTINCT entry_id AS record, {folded('firm_text')} AS q FROM court_entries WHERE {folded('firm_text')} <> ''), e AS (SELECT DISTINCT id AS entity, {folded('name')} AS e FROM entities WHERE type = 'firm' AND {folded('name')} <> ''),
 p AS (SELECT q.q, e.e, 100.0 * (1 - levenshtein(q.q, e.e) / greatest(length(q.q), length(e.e))) AS score FROM (SELECT DISTINCT q FROM q) q, (SELECT DISTINCT e FROM e) e), m AS (SELECT record, entity, max(score) AS score FROM q JOIN p USING (q) JOIN e USING (e) WHERE score >= 70 GROUP BY 1, 2),
 c AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY record ORDER BY score DESC, entity) <= 8),
 ls AS (SELECT entity_id AS entity, parent, attrs['legal_form'] AS form, as_of FROM slices QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY as_of DESC, recorded_at DESC, parent DESC NULLS LAST) = 1), fa AS (SELECT f.id AS entity, t.name AS seat, t.attrs['county'] AS county, ls.form, ls.as_of AS founded FROM entities f LEFT JOIN ls ON ls.entity = f.id LEFT JOIN entities t ON t.id = ls.parent),
 j AS (SELECT c.*, nullif({folded('r.seat')}, '') AS ra, nullif({folded('fa.seat')}, '') AS ea, r.founded = fa.founded AS ya, nullif({folded('r.county')}, '') = nullif({folded('fa.county')}, '') AS ca, nullif({folded('r.legal_form')}, '') = nullif({folded('fa.form')}, '') AS la FROM c JOIN court_entries r ON r.entry_id = c.record JOIN fa USING (entity)),
 b AS (SELECT *, {AGREE_SQL.format(a='ra', b='ea')} AS sa FROM j), k AS (SELECT *, score + CASE WHEN sa THEN 12 ELSE 0 END + CASE WHEN ya THEN 10 ELSE 0 END + CASE WHEN ca THEN 4 ELSE 0 END + CASE WHEN la THEN 3 ELSE 0 END AS ranked FROM b),
 o AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS s2, lead(ranked) OVER w AS r2 FROM k WINDOW w AS (PARTITION BY record ORDER BY ranked DESC, entity)),
 d AS (SELECT record, entity, CASE WHEN score >= 95 AND sa = false AND ya = false THEN 'seat and year contradict' WHEN score >= 85 AND score < 95 AND (sa = false OR ya = false) THEN 'a fact contradicts' WHEN score >= 70 AND score < 85 AND NOT coalesce(sa AND ya, false) THEN 'weak name' WHEN score < 70 THEN 'name too different' WHEN score - s2 < 5 AND ranked - r2 < 5 THEN 'ambiguous' WHEN score >= 95 THEN 'sure name' WHEN score >= 85 THEN 'good name' ELSE 'corroborated' END AS reason FROM o WHERE rank = 1)
 SELECT record, CASE WHEN reason IN ('sure name', 'good name', 'corroborated') THEN entity END AS entity, CASE WHEN reason IN ('sure name', 'good name', 'corroborated') THEN 'same' ELSE 'open' END AS decision, reason FROM d""")
def decisions(spark, root):
    """Court entries decided by the name, seat, year, county and legal form of the firms the list has; a firm's facts are those of its last slice, its seat the parent's name."""
    rec = table(spark, root, "court_entries").select(F.col("entry_id").alias("record"), F.col("firm_text").alias("query"), "seat", "founded", "county", "legal_form", F.lit(None).cast("string").alias("court"))
    ents = table(spark, root, "entities")
    last = table(spark, root, "slices").groupBy(F.col("entity_id").alias("entity")).agg(F.max_by(F.struct("parent", F.try_element_at("attrs", F.lit("legal_form")).alias("legal_form"), F.col("as_of").alias("founded")), F.struct("as_of", "recorded_at", "parent")).alias("s"))
    places = ents.select(F.col("id").alias("parent"), F.col("name").alias("seat"), F.try_element_at("attrs", F.lit("county")).alias("county"))
    named = ents.where("type = 'firm'").select(F.col("id").alias("entity"), "name")
    facts = named.select("entity").distinct().join(last, "entity", "left").select("entity", "s.*").join(places, "parent", "left").withColumn("court", F.lit(None).cast("string"))
    c = resolve.candidates(rec.select("record", "query"), named)
    return resolve.decide(resolve.boosted(c, rec, facts))


@query("""WITH RECURSIVE d AS (SELECT from_id AS id, arg_max(to_id, ts) AS nxt FROM edges WHERE type = 'duplicate_of' AND from_id <> to_id GROUP BY 1), c AS (SELECT id, nxt AS canonical, 1 AS k FROM d UNION ALL SELECT c.id, d.nxt, k + 1 FROM c JOIN d ON c.canonical = d.id WHERE k < 50)
 SELECT id, canonical FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1""")
def survivor_fold(spark, root):
    return history.canonical_ids(table(spark, root, "edges"))


@query("""WITH RECURSIVE d AS (SELECT from_id AS id, arg_max(to_id, ts) AS nxt FROM edges WHERE type = 'duplicate_of' AND from_id <> to_id GROUP BY 1), c AS (SELECT id, nxt AS canonical, 1 AS k FROM d UNION ALL SELECT c.id, d.nxt, k + 1 FROM c JOIN d ON c.canonical = d.id WHERE k < 50),
 m AS (SELECT id, canonical FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1), s AS (SELECT e.id, e.name, coalesce(m.canonical, e.id) AS canonical FROM entities e LEFT JOIN m USING (id)),
 cf AS (SELECT canonical, project FROM slices x JOIN s ON x.entity_id = s.id GROUP BY 1, 2 HAVING count(DISTINCT x.entity_id) > 1)
 SELECT canonical, count(DISTINCT id) AS members, (SELECT count(*) FROM cf WHERE cf.canonical = s.canonical) AS conflicts FROM s GROUP BY canonical""")
def folded_entities(spark, root):
    cells = table(spark, root, "slices").select(F.col("entity_id").alias("entity"), "project")
    f = resolve.folded(table(spark, root, "entities"), table(spark, root, "edges"), cells)
    return f.select("canonical", F.size("members").cast("bigint").alias("members"), F.size("conflicts").cast("bigint").alias("conflicts"))


@query("""WITH y AS (SELECT o_custkey AS entity, extract(year FROM o_orderdate) AS y, o_orderkey AS r FROM orders) SELECT CAST(c_custkey AS VARCHAR) AS entity, c_name AS name, coalesce(a, 0) AS "1995", coalesce(b, 0) AS "1996" FROM customer LEFT JOIN (SELECT entity, count(DISTINCT r) FILTER (y = 1995) AS a, count(DISTINCT r) FILTER (y = 1996) AS b FROM y GROUP BY 1) ON c_custkey = entity""")
def entity_by_year(spark, root):
    e = table(spark, root, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    h = table(spark, root, "orders").select(F.year("o_orderdate").cast("string").alias("project"), F.col("o_orderkey").alias("record"), F.col("o_custkey").cast("string").alias("entity"))
    s = h.select("entity", "project", "record")
    return resolve.entity_table(e, h, s, ["1995", "1996"]).select("entity", "name", "1995", "1996")


@query("""SELECT entity_id AS entity, count(*) AS n FROM slices GROUP BY 1 HAVING count(*) >= 2""")
def duplicates_report(spark, root):
    s = table(spark, root, "slices").select(F.col("entity_id").alias("entity"), F.concat_ws("/", "project", "stem").alias("place"))
    return resolve.places_of(s).select("entity", "n")


@query(f"""SELECT f AS folded, count(*) AS n, min(firm_text) AS sample FROM (SELECT firm_text, {folded('firm_text')} AS f FROM court_entries) WHERE f <> '' GROUP BY 1""")
def worklist(spark, root):
    return resolve.worklist(table(spark, root, "court_entries").select(F.col("firm_text").alias("text")))


@query(f"""SELECT entity, f AS folded, count(*) AS n, min(name) AS text FROM (SELECT entity_id AS entity, name, {folded('name')} AS f FROM slices) s WHERE f <> '' AND NOT EXISTS (SELECT 1 FROM entities e WHERE e.id = s.entity AND {folded('e.name')} = s.f) GROUP BY 1, 2""")
def alias_candidates(spark, root):
    c = table(spark, root, "slices").select(F.col("entity_id").alias("entity"), F.col("name").alias("text"))
    return resolve.alias_candidates(c, table(spark, root, "entities").select(F.col("id").alias("entity"), "name"))


@query("""SELECT entity_id AS entity, min(as_of) AS first_seen FROM slices GROUP BY 1""")
def first_seen(spark, root):
    none = spark.createDataFrame([], "entity string, founded int")
    return resolve.first_seen(table(spark, root, "slices"), none).select("entity", "first_seen")


@query("""WITH x AS (SELECT entity_id AS entity, as_of AS pos, recorded_at, k AS key, attrs[k] AS value FROM slices, unnest(map_keys(attrs)) t(k) UNION ALL SELECT id, -1, NULL, k, attrs[k] FROM entities, unnest(map_keys(attrs)) t(k))
 SELECT entity, key, value FROM x WHERE key IN ('legal_form', 'status', 'county') AND trim(coalesce(value, ''), ' ') <> '' QUALIFY row_number() OVER (PARTITION BY entity, key ORDER BY pos DESC, recorded_at DESC NULLS LAST, value DESC) = 1""")
def entity_facts(spark, root):
    return resolve.facts(table(spark, root, "slices"), table(spark, root, "entities"), ["legal_form", "status", "county"])


# ---- edits

@query("""SELECT cell_id, CASE WHEN cell_id % 10 = 0 AND coalesce(value, '') <> 'fixed' THEN 'fixed' ELSE value END AS value, CASE WHEN cell_id % 10 = 0 AND coalesce(value, '') <> 'fixed' THEN coalesce(original_value, value) ELSE original_value END AS original_value FROM cells""")
def cell_edits(spark, root):
    c = table(spark, root, "cells")
    e = c.where("cell_id % 10 = 0").select("cell_id", F.lit("fixed").alias("value"), F.lit(2).alias("ts")).unionByName(c.where("cell_id % 20 = 0").select("cell_id", F.lit("early").alias("value"), F.lit(1).alias("ts")))
    return mutate.edited_cells(c, e, ["cell_id"])[0].select("cell_id", "value", "original_value")


@query("""WITH m AS (SELECT max(CAST(id[2:] AS BIGINT)) AS m FROM entities WHERE id LIKE 'F%'), r AS (SELECT entry_id, firm_text AS name, row_number() OVER (ORDER BY entry_id) AS k FROM court_entries WHERE firm_text IS NOT NULL) SELECT entry_id, 'F' || lpad(CAST(m + k AS VARCHAR), 8, '0') AS id, name FROM r, m""")
def minted_entities(spark, root):
    r = table(spark, root, "court_entries").where("firm_text is not null").select("entry_id", F.col("firm_text").alias("name"))
    return mutate.minted(r, table(spark, root, "entities"), "F", 8, ["entry_id"]).select("entry_id", "id", "name")


@query("""SELECT event_id, CASE WHEN event_type IN ('click') THEN 'view' ELSE event_type END AS label FROM events""")
def label_rename(spark, root):
    return mutate.renamed_label(table(spark, root, "events").select("event_id", F.col("event_type").alias("label")), "click", "view")


@query("""SELECT row_id, CAST(CASE WHEN row_id % 5 = 0 THEN row_id * 2 ELSE position END AS DOUBLE) AS position FROM grid_rows""")
def row_reorder(spark, root):
    r = table(spark, root, "grid_rows")
    return mutate.reordered(r, r.where("row_id % 5 = 0").select("row_id", (F.col("row_id") * 2).alias("position")), "row_id").select("row_id", "position")


@query("""SELECT event_type AS label, count(DISTINCT user_id) AS pages, count(*) AS boxes FROM events GROUP BY 1""")
def label_use(spark, root):
    return review.label_use(table(spark, root, "events").select(F.col("event_type").alias("label"), F.col("user_id").alias("stem")))


# ---- streams, on batch frames

@query("""SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling(spark, root):
    t = streams.tumbling(table(spark, root, "events"), "1 hour")
    return t.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '2024-01-01') - INTERVAL '30 minutes']) AS start FROM events) GROUP BY 1, 2""")
def sliding(spark, root):
    return streams.sliding(table(spark, root, "events"), "1 hour", "30 minutes")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session(spark, root):
    return streams.sessions(table(spark, root, "events"), "2 hours")
