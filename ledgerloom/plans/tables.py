"""Queries of heads of records, views of the entity table, labels, tables and derived pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import numbers
from ledgerloom.operators import diagnostics, heads, history, labels, rules, tables
from ledgerloom.plans.checks import VALUES_SQL
from ledgerloom.plans.registry import query
from ledgerloom.runtime import table

NONE = "CAST([] AS VARCHAR[])"

# ---- heads of records

HEADS_SQL = """h AS (SELECT *, list_filter([{'q': CASE WHEN trim(name_hu) <> '' THEN name_hu END, 'lang': 'hu'}, {'q': CASE WHEN trim(name_de) <> '' THEN name_de END, 'lang': 'de'}] || list_transform(coalesce(other_names, []), lambda o: {'q': CASE WHEN trim(o.name) <> '' THEN o.name END, 'lang': o.lang}), lambda x: x.q IS NOT NULL) AS named FROM identities)"""


def _heads(spark, root):
    return table(spark, root, "identities").withColumn("name", F.col("address"))


@query("WITH " + HEADS_SQL + """, c AS (SELECT record_id, CASE WHEN len(named) > 0 THEN named WHEN trim(address) <> '' THEN [{'q': trim(address), 'lang': NULL::VARCHAR}] ELSE [] END AS l FROM h)
 SELECT record_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l).q AS query, unnest(l).lang AS lang FROM c""")
def record_queries(spark, root):
    return heads.queries_of(_heads(spark, root), "record_id")


@query("WITH " + HEADS_SQL + """ SELECT record_id, trim(coalesce(CASE WHEN trim(name_hu) <> '' THEN name_hu END, CASE WHEN trim(name_de) <> '' THEN name_de END, named[1].q, CASE WHEN trim(address) <> '' THEN address END, ''), ' ') AS name FROM h""")
def display_names(spark, root):
    return _heads(spark, root).select("record_id", heads.display_name().alias("name"))


@query("WITH " + HEADS_SQL + """ SELECT record_id, unnest(named).q AS name, unnest(named).lang AS lang, 'import' AS source FROM h""")
def record_aliases(spark, root):
    return heads.aliases_of(_heads(spark, root), "record_id", "import")


@query("""SELECT record_id, 1900 AS as_of, project AS source, coalesce(serial_no, folio, record_id) AS seq, list_aggregate(list_filter(['seat=' || CASE WHEN trim(seat) <> '' THEN seat END, 'county=' || CASE WHEN trim(county) <> '' THEN county END, 'founded=' || founded, 'court=' || CASE WHEN trim(court) <> '' THEN court END], lambda x: x IS NOT NULL), 'string_agg', '|') AS attrs, event_date, event_type AS event FROM identities""")
def record_slices(spark, root):
    r = _heads(spark, root).withColumn("as_of", F.lit(1900)).withColumn("sub", F.col("folio"))
    s = heads.slices_of(r, "record_id", ["seat", "county", "founded", "court"])
    said = F.array(*[F.concat(F.lit(f"{k}="), F.try_element_at("attrs", F.lit(k))) for k in ("seat", "county", "founded", "court")])
    return s.select("record_id", "as_of", "source", F.col("seq").cast("bigint").alias("seq"), F.nullif(F.array_join(F.filter(said, lambda x: x.isNotNull()), "|"), F.lit("")).alias("attrs"), "event_date", "event")


CHAINS = """d AS (SELECT from_id AS id, arg_max(to_id, ts) AS nxt FROM edges WHERE type = 'duplicate_of' AND from_id <> to_id GROUP BY 1), c AS (SELECT id, nxt AS canonical, 1 AS k FROM d UNION ALL SELECT c.id, d.nxt, k + 1 FROM c JOIN d ON c.canonical = d.id WHERE k < 50),
 m AS (SELECT id, canonical FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1), e AS (SELECT id, name, coalesce(canonical, id) AS c FROM entities LEFT JOIN m USING (id)), hd AS (SELECT c, name AS head FROM e WHERE id = c),
 al AS (SELECT c, list_sort(list_distinct(list(a))) AS aliases FROM (SELECT e.c, e.name AS a FROM e WHERE id <> c UNION ALL SELECT e.c, x.name FROM aliases x JOIN e ON x.entity_id = e.id) JOIN hd USING (c) WHERE a <> head GROUP BY 1),
 mg AS (SELECT c, list_sort(list(id)) AS merged FROM e WHERE id <> c GROUP BY 1), en AS (SELECT unnest([from_id, to_id]) AS id, type, from_id, to_id FROM edges),
 ed AS (SELECT e.c, list_sort(list_distinct(list(type))) AS edges FROM en JOIN e USING (id) JOIN e f ON f.id = from_id JOIN e t ON t.id = to_id WHERE NOT (type = 'duplicate_of' AND f.c = t.c) GROUP BY 1), ls AS (SELECT e.c, list_sort(list_distinct(list(project))) AS cells FROM slices s JOIN e ON s.entity_id = e.id GROUP BY 1),
 v AS (SELECT hd.c AS id, head AS name, coalesce(aliases, []) AS aliases, coalesce(merged, []) AS merged, coalesce(edges, []) AS edges, coalesce(cells, []) AS cells FROM hd LEFT JOIN al USING (c) LEFT JOIN mg USING (c) LEFT JOIN ed USING (c) LEFT JOIN ls USING (c))"""


def _rows(spark, root):
    t = lambda n: table(spark, root, n)
    return heads.entity_rows(t("entities"), t("aliases"), t("edges"), t("slices"), history.canonical_ids(t("edges")))


def _shown(rows):
    return rows.select("id", "name", *[F.array_join(c, "|").alias(c) for c in ("aliases", "merged", "edges")], F.size("cells").cast("bigint").alias("cells"))


SHOWN = " SELECT id, name, array_to_string(aliases, '|') AS aliases, array_to_string(merged, '|') AS merged, array_to_string(edges, '|') AS edges, len(cells) AS cells FROM v "


@query("WITH RECURSIVE " + CHAINS + SHOWN)
def entity_view(spark, root):
    return _shown(_rows(spark, root))


for _mode, _where in (("missing", "len(cells) < 3"), ("chain", "len(edges) > 0"), ("dup", "len(merged) > 0 OR list_contains(edges, 'duplicate_of')"), ("single", "len(cells) = 1")):
    query("WITH RECURSIVE " + CHAINS + SHOWN + f"WHERE {_where}", f"entity_view_{_mode}")(lambda spark, root, mode=_mode: _shown(heads.filtered(_rows(spark, root), mode=mode, columns=3)))


@query("WITH RECURSIVE " + CHAINS + SHOWN + "WHERE contains(lower(strip_accents(name)), 'halom') OR len(list_filter(aliases, lambda a: contains(lower(strip_accents(a)), 'halom'))) > 0")
def entity_view_text(spark, root):
    return _shown(heads.filtered(_rows(spark, root), "Hálom"))


@query("""SELECT entity_id AS id, array_to_string(list_filter([CASE WHEN trim(name) <> '' THEN name END, CASE WHEN len(al) > 0 THEN 'also ' || array_to_string(al[1:4], ' / ') END, 'seat ' || CASE WHEN trim(parent) <> '' THEN parent END, 'county ' || CASE WHEN trim(attrs['currency']) <> '' THEN attrs['currency'] END, 'founded ' || as_of, 'legal_form ' || CASE WHEN trim(attrs['legal_form']) <> '' THEN attrs['legal_form'] END], lambda x: x IS NOT NULL), '; ') AS brief, as_of, seq, recorded_at
 FROM slices LEFT JOIN (SELECT from_id, list_sort(list_distinct(list(to_id))) AS al FROM edges GROUP BY 1) ON from_id = entity_id""")
def candidate_briefs(spark, root):
    also = table(spark, root, "edges").groupBy("from_id").agg(F.sort_array(F.collect_set("to_id")).alias("aliases"))
    s = table(spark, root, "slices").join(also, F.col("from_id") == F.col("entity_id"), "left")
    c = s.select(F.col("entity_id").alias("id"), "name", "aliases", F.col("parent").alias("seat"), F.try_element_at("attrs", F.lit("currency")).alias("county"), F.col("as_of").alias("founded"), F.try_element_at("attrs", F.lit("legal_form")).alias("legal_form"), F.lit(None).cast("string").alias("seen_in"), "as_of", "seq", "recorded_at")
    return heads.briefs(c).select("id", "brief", "as_of", "seq", "recorded_at")


JUDGE = "j AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'none' ELSE 'F' || o_custkey END AS choice, (o_orderkey * 37 % 1000) / 1000.0::DOUBLE AS p, (o_orderkey * 53 % 1000) / 1000.0::DOUBLE AS s FROM orders)"


@query("WITH " + JUDGE + """ SELECT k, CASE WHEN choice IS NULL OR p < 0.85 THEN 'unsure' WHEN choice = 'none' THEN 'new' WHEN s >= 0.5 THEN 'successor' ELSE 'same' END AS verdict, CASE WHEN choice <> 'none' THEN choice END AS entity, CASE WHEN choice IS NULL THEN 0.0 ELSE round(p, 3) END AS confidence FROM j""")
def judge_verdicts(spark, root):
    o = table(spark, root, "orders")
    k = F.col("o_orderkey")
    choice = F.when(k % 5 == 1, "none").when(k % 5 > 1, F.concat(F.lit("F"), F.col("o_custkey").cast("string")))
    a = heads.answered(choice, (k * 37 % 1000) / 1000.0, (k * 53 % 1000) / 1000.0)
    return o.select(k.alias("k"), a.alias("a")).select("k", "a.verdict", "a.entity", "a.confidence")


@query("""WITH j AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'same' WHEN 1 THEN 'successor' WHEN 2 THEN 'new' WHEN 3 THEN 'unsure' WHEN 4 THEN 'odd' END AS v, 'F' || (o_orderkey % 4) AS e, CASE o_orderkey % 3 WHEN 0 THEN 'merger' WHEN 1 THEN 'odd' END AS g, CASE o_orderkey % 7 WHEN 0 THEN 'x' ELSE CAST((o_orderkey * 31 % 1500 - 200) / 1000.0 AS VARCHAR) END AS c FROM orders),
 w AS (SELECT *, CASE WHEN e IN ('F1', 'F2') THEN e END AS known FROM j), x AS (SELECT *, CASE WHEN v NOT IN ('same', 'successor', 'new', 'unsure') OR v IS NULL OR (v IN ('same', 'successor') AND known IS NULL) THEN 'unsure' ELSE v END AS verdict FROM w)
 SELECT k, verdict, known AS entity, CASE WHEN verdict = 'successor' AND g = 'merger' THEN g END AS edge, round(least(greatest(coalesce(TRY_CAST(c AS DOUBLE), 0), 0), 1), 3) AS confidence FROM x""")
def judged_answers(spark, root):
    k = F.col("o_orderkey")
    v = F.when(k % 6 == 0, "same").when(k % 6 == 1, "successor").when(k % 6 == 2, "new").when(k % 6 == 3, "unsure").when(k % 6 == 4, "odd")
    c = F.when(k % 7 == 0, "x").otherwise(((k * 31 % 1500 - 200) / 1000.0).cast("string"))
    j = heads.judged(v, F.concat(F.lit("F"), (k % 4).cast("string")), F.when(k % 3 == 0, "merger").when(k % 3 == 1, "odd"), c, F.array(F.lit("F1"), F.lit("F2")))
    return table(spark, root, "orders").select(k.alias("k"), j.alias("j")).select("k", "j.*")


@query("""SELECT name, year, CAST(row_number() OVER (ORDER BY year ASC NULLS LAST, name) AS INTEGER) AS place FROM (SELECT project AS name, CASE WHEN min(doc_id) % 3 > 0 THEN CAST(1870 + min(doc_id) % 9 AS INTEGER) END AS year FROM documents WHERE project IS NOT NULL GROUP BY 1)""")
def project_columns(spark, root):
    k = F.min("doc_id")
    p = table(spark, root, "documents").where("project is not null").groupBy(F.col("project").alias("name")).agg(F.when(k % 3 > 0, (1870 + k % 9).cast("int")).alias("year"))
    return heads.ordered_projects(p)


# ---- labels

NAMES_SQL = "n AS (SELECT DISTINCT x FROM (SELECT unnest([source, project, lang, source || ' ' || coalesce(project, ''), '_trash', '-' || lang, lang || ' ', NULL, '', 'a.b-c_d', 'a/b']) AS x FROM documents))"


@query("WITH " + NAMES_SQL + """ SELECT x, coalesce(regexp_full_match(x, '[A-Za-z0-9_.-]+'), false) AS label, coalesce(regexp_full_match(x, '[A-Za-z0-9_][A-Za-z0-9._ -]*') AND NOT ends_with(x, ' ') AND x <> '_trash', false) AS project FROM n""")
def valid_names(spark, root):
    d = table(spark, root, "documents")
    n = d.select(F.explode(F.array("source", "project", "lang", F.concat("source", F.lit(" "), F.coalesce("project", F.lit(""))), F.lit("_trash"), F.concat(F.lit("-"), "lang"), F.concat("lang", F.lit(" ")), F.lit(None), F.lit(""), F.lit("a.b-c_d"), F.lit("a/b"))).alias("x")).distinct()
    return n.select("x", labels.is_label(F.col("x")).alias("label"), labels.is_project(F.col("x")).alias("project"))


SETS_SQL = "s AS (SELECT project, list_sort(list_distinct(list(source))) AS ls, min(source) AS parent, max(source) AS top FROM documents WHERE project IS NOT NULL AND source IS NOT NULL GROUP BY 1)"


def _sets(spark, root):
    d = table(spark, root, "documents").where("project is not null and source is not null")
    return d.groupBy("project").agg(F.sort_array(F.collect_set("source")).alias("ls"), F.min("source").alias("parent"), F.max("source").alias("top"))


@query("WITH " + SETS_SQL + """ SELECT project, 'within:' || parent AS scope, 'within_' || parent AS slug, parent, nullif(array_to_string(list_filter(ls, lambda x: x <> parent), '|'), '') AS classes, array_to_string(list_filter(ls, lambda x: x NOT IN (top, 'web')), '|') AS missing, array_to_string(CASE WHEN list_contains(ls, 'extra') THEN ls ELSE ls || ['extra'] END, '|') AS palette,
 array_to_string(list_filter(list_filter(ls, lambda x: x IN ('ledger_scan', 'directory_ocr')), lambda x: x <> top) || [top], '|') AS regions FROM s""")
def label_scopes(spark, root):
    sc = F.concat(F.lit("  within: "), F.col("parent"))
    return _sets(spark, root).select(
        "project", labels.scope(sc).alias("scope"), labels.scope_slug(sc).alias("slug"), labels.parent_label(sc).alias("parent"), F.array_join(labels.scope_labels(F.col("ls"), sc), "|").alias("classes"), F.array_join(labels.missing_labels(F.col("ls"), F.array("top", F.lit("web"))), "|").alias("missing"),
        F.array_join(labels.with_label(F.col("ls"), F.lit("extra")), "|").alias("palette"), F.array_join(labels.with_region(F.lit(None).cast("array<string>"), F.col("ls"), F.col("top"), F.lit(True), ["ledger_scan", "directory_ocr"]), "|").alias("regions"),
    )


# ---- tables

@query("""WITH c AS (SELECT c.* FROM cells c JOIN grid_rows r USING (row_id) WHERE r.is_deleted = 0 QUALIFY row_number() OVER (PARTITION BY row_id, col_id ORDER BY updated_at DESC, cell_id DESC) = 1)
 SELECT row_id, count(*) AS cells, count(*) FILTER (coalesce(original_value, '') <> '' AND original_value IS DISTINCT FROM value) AS edited, string_agg(coalesce(value, ''), '|' ORDER BY col_id) AS shown FROM c GROUP BY 1""")
def table_payload(spark, root):
    p = tables.payload(table(spark, root, "cells"), table(spark, root, "grid_rows"))
    e = F.map_entries("cells")
    return p.select("row_id", F.size("cells").cast("bigint").alias("cells"), F.size(F.filter(e, lambda x: x["value"]["original_value"].isNotNull())).cast("bigint").alias("edited"), F.array_join(F.transform(F.array_sort(e), lambda x: F.coalesce(x["value"]["value"], F.lit(""))), "|").alias("shown"))


@query("""WITH e AS (SELECT project, col_id, 'col ' || col_id AS n, CASE WHEN col_id % 4 = 0 THEN 'v' || (col_id % 16) WHEN col_id % 4 = 2 THEN 'county' END AS v FROM grid_columns WHERE col_id % 2 = 0),
 bad AS (SELECT e.project, e.col_id FROM e JOIN grid_columns g ON g.project = e.project AND g.variable = e.v AND g.col_id <> e.col_id UNION SELECT project, col_id FROM (SELECT *, row_number() OVER (PARTITION BY project, v ORDER BY col_id) AS k FROM e WHERE v IS NOT NULL) WHERE k > 1)
 SELECT g.project, g.col_id, coalesce(e.n, g.name) AS name, CASE WHEN b.col_id IS NULL THEN coalesce(e.v, g.variable) ELSE g.variable END AS variable, b.col_id IS NOT NULL AS refused FROM grid_columns g LEFT JOIN e ON e.project = g.project AND e.col_id = g.col_id LEFT JOIN bad b ON b.project = g.project AND b.col_id = g.col_id""")
def column_edits(spark, root):
    g = table(spark, root, "grid_columns")
    c = F.col("col_id")
    v = F.when(c % 4 == 0, F.concat(F.lit("v"), (c % 16).cast("string"))).when(c % 4 == 2, "county")
    out, bad = tables.edited_columns(g, g.where("col_id % 2 = 0").select("project", "col_id", F.concat(F.lit("col "), c.cast("string")).alias("name"), v.alias("variable"), F.lit(None).cast("string").alias("role")), ["project"])
    b = bad.select("project", "col_id", F.lit(True).alias("refused"))
    return out.join(b, ["project", "col_id"], "left").select("project", "col_id", "name", "variable", F.coalesce("refused", F.lit(False)).alias("refused"))


@query("""SELECT event_id AS log_id, event_type AS action FROM events ORDER BY event_id DESC LIMIT 1000""")
def audit_tail(spark, root):
    return tables.audit_tail(table(spark, root, "events").select(F.col("event_id").alias("log_id"), F.col("event_type").alias("action")))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'deleted' ELSE s END AS status, s AS restored FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'deleted' END AS s FROM documents)""")
def pages_deleted(spark, root):
    k = F.col("doc_id")
    d = table(spark, root, "documents").select(k, F.when(k % 3 == 0, "verified").when(k % 3 == 1, "deleted").alias("status"))
    out, undo = tables.deleted(d, d.where("doc_id % 5 = 0"), ["doc_id"])
    return out.join(tables.undone(out, undo, ["doc_id"]).select("doc_id", F.col("status").alias("restored")), "doc_id")


@query("""SELECT c_custkey AS id, c_name AS title, greatest(max(o_orderdate), TIMESTAMP '1995-01-01') AS updated, count(o_orderkey) AS n_notes FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def topic_summaries(spark, root):
    t = table(spark, root, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.to_timestamp(F.lit("1995-01-01")).cast("timestamp_ntz").alias("created"))
    return tables.topic_summaries(t, table(spark, root, "orders").select(F.col("o_custkey").alias("topic"), F.col("o_orderdate").cast("timestamp_ntz").alias("updated")))


# ---- derived fragments and crops

@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 7 > 0 AND l_suppkey % 5 <> 1 AND NOT (l_partkey % 3 = 0) AND l_suppkey % 11 > 0 AND NOT (l_linenumber = 2) AND NOT (l_partkey % 13 = 0) AS replaceable FROM lineitem""")
def replaceable_fragments(spark, root):
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    box = F.array(*[(p % 100 + d).cast("double") for d in (0, 1, 20, 30)])
    moved = F.transform(box, lambda x: x + F.when(s % 5 == 1, 0.75).otherwise(0.25))
    b = table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", box.alias("box"), F.when(p % 7 > 0, moved).alias("derived_box"), (p % 3 == 0).alias("continuation"), F.lit(None).cast("boolean").alias("derived_continuation"), (s % 11 == 0).alias("locked"),
        F.when(n == 2, "text").otherwise("").alias("pdf_text"), F.lit(None).cast("boolean").alias("blank"), (p % 13 == 0).alias("cross_page"),
    )
    return b.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tables.is_replaceable(b).alias("replaceable"))


@query("""SELECT coalesce(w.k, d.k) AS k, CASE WHEN d.k IS NULL THEN 'created' WHEN w.k IS NULL THEN 'vanished' WHEN r IS NOT NULL AND d.k % 2 = 0 THEN 'kept' WHEN r IS NOT NULL THEN 'replaced' WHEN d.k % 4 = 0 THEN 'unchanged' ELSE 'refreshed' END AS action, r AS reason FROM
 (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 3) w FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 9 = 0 THEN 'no_provenance' WHEN o_orderkey % 9 = 1 THEN 'foreign' WHEN o_orderkey % 9 = 2 THEN 'moved' WHEN o_orderkey % 9 = 3 THEN 'reframed' END AS r FROM orders WHERE o_orderkey % 7 > 0) d ON w.k = d.k""")
def crop_states(spark, root):
    k = F.col("o_orderkey")
    four = lambda off: F.array(*[(k % 50 + d + off).cast("double") for d in (0, 0, 10, 10)])
    o = table(spark, root, "orders")
    w = o.where("o_orderkey % 10 <> 3").select(k.alias("k"), F.lit("mine").alias("owner"), four(F.lit(0.0)).alias("box"), four(F.lit(5.0)).alias("framing"), F.lit("f").alias("fields"))
    d = o.where("o_orderkey % 7 > 0").select(k.alias("k"), F.when(k % 9 == 1, "theirs").when(k % 9 > 0, "mine").alias("owner"), four(F.when(k % 9 == 2, 2.0).otherwise(0.4)).alias("box"), four(F.when(k % 9 == 3, 9.0).otherwise(5.0)).alias("framing"), F.when(k % 4 == 0, "f").otherwise("g").alias("fields"), (k % 2 == 0).alias("worked_on"))
    return tables.crop_diff(w, d, ["k"]).select("k", "action", "reason")


# ---- rules and diagnostics

@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey > 0 THEN 'trailing 1' END AS note FROM orders""")
def slip_notes(spark, root):
    k = F.col("o_orderkey").cast("double")
    return table(spark, root, "orders").select("o_orderkey", numbers.slip_note(F.when(F.col("o_orderkey") % 3 == 0, k * 10 + 1).otherwise(k * 10 + 2), k).alias("note"))


@query("""SELECT variable, round(CASE WHEN b > 0 THEN a / b END, 9) AS top_gap FROM (SELECT o_orderpriority AS variable, max(o_totalprice) AS a, list_sort(list(o_totalprice), 'DESC')[2] AS b FROM orders GROUP BY 1)""")
def top_gap(spark, root):
    v = table(spark, root, "orders").select(F.col("o_orderpriority").alias("variable"), F.col("o_totalprice").alias("value"))
    return diagnostics.top_gap(v).select("variable", F.round("top_gap", 9).alias("top_gap"))


@query("WITH " + VALUES_SQL.replace("ln(1 + value) AS t FROM vals", "CASE variable WHEN 'A' THEN value ELSE ln(1 + value) END AS t FROM vals WHERE variable <> 'N'") + """ SELECT variable, sev AS severity, count(*) AS n FROM (
  SELECT variable, CASE WHEN t < q1 - 3 * (q3 - q1) OR t > q3 + 3 * (q3 - q1) THEN 'extreme' WHEN t < q1 - 1.5 * (q3 - q1) OR t > q3 + 1.5 * (q3 - q1) THEN 'mild' WHEN abs(0.6745 * (t - med) / mad) > 3.5 THEN 'mild' END AS sev FROM tested JOIN q USING (variable) JOIN m USING (variable)) GROUP BY 1, 2""")
def declared_outliers(spark, root):
    """Outliers where one variable declares a raw scale and one takes no part."""
    v = table(spark, root, "lineitem").select(F.col("l_returnflag").alias("variable"), F.col("l_extendedprice").alias("value"))
    d = spark.createDataFrame([("A", "raw", None), ("N", None, False)], "variable string, scale string, stats boolean")
    return diagnostics.outliers(v, declared=d).groupBy("variable", "severity").agg(F.count("*").alias("n"))


CRAWL = [{"name": "sum", "lhs": "a + b", "operator": "=", "rhs": "c", "tol": 0.0}, {"name": "less", "lhs": "a", "operator": "<=", "rhs": "c", "tol": 0.0}]
CRAWL_SQL = """r AS (SELECT l_suppkey AS g, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS p, CAST(l_quantity AS BIGINT) AS a, CAST(l_linenumber AS BIGINT) AS b FROM lineitem),
 x AS (SELECT *, a + b AS c, count(*) OVER (PARTITION BY g) AS n FROM r), y AS (SELECT g, p, n, a, c, CASE WHEN g % 3 = 0 THEN CASE WHEN p < 4 THEN b ELSE lead(b) OVER w END WHEN g % 3 = 1 THEN CASE WHEN p < 4 THEN b WHEN p = 4 THEN 77 ELSE lag(b) OVER w END ELSE b END AS b FROM x WINDOW w AS (PARTITION BY g ORDER BY p))"""


@query("WITH " + CRAWL_SQL + """, q AS (SELECT x.g, x.p AS spot, sum(CASE WHEN v IS NULL THEN 0 ELSE CASE WHEN k.a + v <> k.c THEN 1 ELSE 0 END END + CASE WHEN k.a > k.c THEN 1 ELSE 0 END) AS cost FROM y x JOIN (SELECT *, lag(b) OVER (PARTITION BY g ORDER BY p) AS prv, lead(b) OVER (PARTITION BY g ORDER BY p) AS nxt FROM y) k ON k.g = x.g,
  LATERAL (SELECT CASE WHEN k.p < x.p THEN k.b WHEN x.g % 3 = 0 THEN CASE WHEN k.p = x.p THEN 0 ELSE k.prv END ELSE k.nxt END AS v) WHERE x.g % 3 < 2 AND (x.g % 3 = 0 OR x.b IS NOT NULL) GROUP BY 1, 2),
 now AS (SELECT g, sum(CASE WHEN b IS NOT NULL AND a + b <> c THEN 1 ELSE 0 END + CASE WHEN a > c THEN 1 ELSE 0 END) AS before FROM y GROUP BY 1)
 SELECT g, CAST(spot AS INTEGER) AS "position", CASE WHEN g % 3 = 0 THEN 'down' ELSE 'up' END AS direction, 'b' AS variables, CAST(before AS BIGINT) AS before, CAST(cost AS BIGINT) AS after FROM q JOIN now USING (g) WHERE cost < before QUALIFY row_number() OVER (PARTITION BY g ORDER BY cost, spot) = 1""")
def crawl_repairs(spark, root):
    """Columns that slipped against the others from their fourth line on: a line lost in every third group, one too many in every other."""
    from pyspark.sql import Window as W

    w = W.partitionBy("g").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    r = table(spark, root, "lineitem").withColumn("g", F.col("l_suppkey")).withColumn("p", F.row_number().over(w)).select("g", "p", F.col("l_quantity").cast("bigint").alias("a"), F.col("l_linenumber").cast("bigint").alias("b0")).withColumn("c", F.col("a") + F.col("b0"))
    v, kind = W.partitionBy("g").orderBy("p"), F.col("g") % 3
    b = F.when((kind == 2) | (F.col("p") < 4), F.col("b0")).when(kind == 0, F.lead("b0").over(v)).when(F.col("p") == 4, 77).otherwise(F.lag("b0").over(v))
    r = r.withColumn("b", b).drop("b0")
    n = r.groupBy("g").agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(c).alias("variable"), (F.col("n") + (F.when(kind == 0, -1).when(kind == 1, 1).otherwise(0) if c == "b" else F.lit(0))).alias("lines")) for c in "abc"])
    lines = n.select("g", F.explode(each).alias("e")).select("g", "e.*")
    out = rules.crawl_repairs(r, CRAWL, ["g"], ["p"], ["a", "b", "c"], lines)
    return out.select("g", F.col("position").cast("int").alias("position"), "direction", F.array_join("variables", "|").alias("variables"), "before", "after")
