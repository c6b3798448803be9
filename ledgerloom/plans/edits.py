"""Queries of layers of text, page edits, reviews, resolution by agreement and exports, each against the SQL it equals."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import numbers, parse, text
from ledgerloom.operators import curation, diagnostics, evaluate, geometry, heads, history, mutate, ordered, pages, resolve, review, rules
from ledgerloom.plans.frames import BOXES_SQL, boxes, folded
from ledgerloom.plans.records import LAYERS_SQL, _layers
from ledgerloom.plans.registry import query
from ledgerloom.runtime import table

WITH = "WITH " + BOXES_SQL

# ---- layers of text

LINES_SQL = "t AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a' || chr(10) || ' b ' || chr(10) || (o_orderkey % 7) WHEN 2 THEN 'long text' || chr(10) || chr(10) || 'x' ELSE '' END AS llm, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a' || chr(10) || 'b' || chr(10) || 'c' END AS ocr FROM orders)"


def _lines(spark, root):
    k = F.col("o_orderkey")
    llm = F.when(k % 4 == 0, None).when(k % 4 == 1, F.concat(F.lit("a\n b \n"), (k % 7).cast("string"))).when(k % 4 == 2, "long text\n\nx").otherwise("")
    return table(spark, root, "orders").select(k.alias("k"), llm.alias("llm"), F.when(k % 3 == 0, "a").when(k % 3 == 1, "a\nb\nc").alias("ocr"))


@query("WITH " + LINES_SQL + """, c AS (SELECT k, len(list_filter(string_split(coalesce(llm, ''), chr(10)), lambda x: trim(x) <> '')) AS a, len(list_filter(string_split(coalesce(ocr, ''), chr(10)), lambda x: trim(x) <> '')) AS b, llm FROM t)
 SELECT k, CAST(a AS BIGINT) AS lines, coalesce(a - b >= 2 OR len(list_filter(string_split(llm, chr(10)), lambda x: length(trim(x)) > 4)) > 0, false) AS too_much FROM c""")
def hallucinated_answers(spark, root):
    return _lines(spark, root).select("k", text.line_count(F.col("llm")).cast("bigint").alias("lines"), text.hallucinated(F.col("llm"), F.col("ocr")).alias("too_much"))


@query("WITH " + LINES_SQL + """, p AS (SELECT k, CASE WHEN coalesce(llm, '') = '' THEN [] ELSE list_transform(string_split(llm, chr(10)), lambda x: trim(x)) END AS p, CASE k % 2 WHEN 0 THEN ['', NULL, ' '] ELSE ['r', ''] END AS r FROM t)
 SELECT k, array_to_string(list_transform(CASE WHEN k % 2 = 0 AND len(p) = 3 THEN p ELSE r END, lambda x: coalesce(x, '-')), '|') AS joined FROM p""")
def rejoined_rows(spark, root):
    r = F.when(F.col("k") % 2 == 0, F.array(F.lit(""), F.lit(None), F.lit(" "))).otherwise(F.array(F.lit("r"), F.lit("")))
    return _lines(spark, root).select("k", F.array_join(F.transform(text.rejoin_rows(r, F.col("llm")), lambda x: F.coalesce(x, F.lit("-"))), "|").alias("joined"))


@query("WITH " + LAYERS_SQL + """ SELECT k, trim(string_split(trim(coalesce(human, llm, ocr, pdf, '')), chr(10))[1])[1:5] AS first, regexp_replace(trim('Lap ' || k || '/b é'), '[^\\w.\\-éáíóöőúüű]+', '_', 'g') AS file, 'p' || k || '__c' || lpad(CAST(k % 7 AS VARCHAR), 3, '0') AS stem, CAST(k % 7 AS INTEGER) AS crop, coalesce(pdf, 'predicted') AS status FROM lay""")
def names_of_files(spark, root):
    d = _layers(spark, root)
    k = F.col("k").cast("string")
    stem = text.crop_stem(F.concat(F.lit("p"), k), F.col("k") % 7)
    return d.select("k", text.first_line(F.coalesce("human", "llm", "ocr", "pdf", F.lit("")), 5).alias("first"), text.safe_filename(F.concat(F.lit("Lap "), k, F.lit("/b é"))).alias("file"), stem.alias("stem"), text.parse_crop_stem(stem)["k"].alias("crop"), text.page_status(F.col("pdf")).alias("status"))


@query("""SELECT event_id, array_to_string(list_distinct(list_filter([event_type, event_type, CASE WHEN user_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL AND x = event_type)), '|') || CASE WHEN user_id % 2 = 0 THEN '|even' ELSE '' END AS tags FROM events""")
def tags_cleaned(spark, root):
    e = table(spark, root, "events")
    return e.select("event_id", F.array_join(text.clean_tags(F.array(F.concat(F.lit(" "), "event_type"), F.col("event_type"), F.lit("  "), F.when(F.col("user_id") % 2 == 0, "even ").otherwise(""))), "|").alias("tags"))


# ---- numbers and rules

@query("""SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN o_orderkey + 0.5 WHEN 2 THEN NULL WHEN 3 THEN -o_orderkey ELSE 0.0 END::DOUBLE AS rule, CASE o_orderkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' WHEN 2 THEN 'error' WHEN 3 THEN 'ok' ELSE 'missing' END AS status FROM orders""")
def numbers_by_declaration(spark, root):
    k = F.col("o_orderkey")
    s = k.cast("string")
    c = F.when(k % 5 == 0, "-").when(k % 5 == 1, F.concat(s, F.lit(",5"))).when(k % 5 == 2, F.concat(s, F.lit("x"))).when(k % 5 == 3, F.concat(F.lit("-"), s)).otherwise(" ")
    return table(spark, root, "orders").select(k.alias("k"), numbers.rule_number(c).alias("rule"), numbers.declared_number(c, ["-"], ["."], ",")["status"].alias("status"))


@query("""SELECT rule, count(*) AS n, CAST(round(sum(d) * 100) AS BIGINT) AS total_cents FROM (SELECT 'net' AS rule, l_extendedprice * (1 - l_discount) - 1000 AS d FROM lineitem WHERE l_extendedprice * (1 - l_discount) < 1000 UNION ALL SELECT 'quantity', l_quantity - 40 FROM lineitem WHERE l_quantity > 40) GROUP BY 1""")
def violation_counts(spark, root):
    li = table(spark, root, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_quantity").alias("quantity"))
    v = rules.violation_counts(li, [{"name": "net", "lhs": "price * (1 - discount)", "operator": ">=", "rhs": "1000", "tol": 0.0}, {"name": "quantity", "lhs": "quantity", "operator": "<=", "rhs": "40", "tol": 0.0}], ["l_orderkey"])
    return v.select("rule", "n", F.round(F.col("total_delta") * 100).cast("bigint").alias("total_cents"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity = l_linenumber + 10 AS holds FROM lineitem""")
def numbered_columns(spark, root):
    li = table(spark, root, "lineitem")
    # Columns are named by number: the third is the sum of the first and the second.
    holds = rules.number_rule("1 + 2 = 3", {"1": F.col("l_linenumber"), "2": F.lit(10), "3": F.col("l_quantity")})
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", holds.alias("holds"))


@query("""SELECT user_id AS "check", event_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50""")
def run_history(spark, root):
    r = table(spark, root, "events").select(F.col("user_id").alias("check"), "ts", F.col("event_id").alias("run_id"))
    return diagnostics.run_history(r).select("check", "run_id", "rank")


# ---- agreement and resolution

NEXT_SQL = f"""p AS (SELECT record_id, seat AS rs, founded AS rf, lag(seat) OVER w AS es, lag(founded) OVER w AS ef FROM identities WINDOW w AS (PARTITION BY project ORDER BY record_id)),
 f AS (SELECT *, nullif({folded('rs')}, '') AS a, nullif({folded('es')}, '') AS b FROM p)"""


@query("WITH " + NEXT_SQL + """ SELECT record_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a = b OR contains(a, b) OR contains(b, a) OR list_last(string_split(a, ' ')) = list_last(string_split(b, ' ')) OR 100.0 * (1 - levenshtein(a, b) / greatest(length(a), length(b))) >= 85 END AS seats, rf = ef AS years FROM f""")
def seats_and_years(spark, root):
    """Whether the seat and year of each record agree with those of the record before it in its volume."""
    w = W.partitionBy("project").orderBy("record_id")
    r = table(spark, root, "identities").select("record_id", "seat", "founded", F.lag("seat").over(w).alias("es"), F.lag("founded").over(w).alias("ef"))
    return r.select("record_id", resolve.seats_agree(F.col("seat"), F.col("es")).alias("seats"), resolve.years_agree(F.col("founded").cast("string"), F.col("ef").cast("string")).alias("years"))


NOISE = "['kiralyi', 'kir', 'k', 'es', 'v', 'torvenyszek', 'torvenyszeki', 'torvenyszel', 'torveny', 'torv', 'tvszk', 'tszek', 'tszk', 'birosag', 'a', 'az', 'kereskedelmi', 'valto', 'ker', 'kerti']"


@query(f"""WITH c AS (SELECT entry_id, court, lag(court) OVER (PARTITION BY project ORDER BY entry_id) AS other FROM court_entries), k AS (SELECT entry_id, nullif(array_to_string(list_filter(string_split({folded('court')}, ' '), lambda w: NOT list_contains({NOISE}, w) AND length(w) > 1), ' '), '') AS x, nullif(array_to_string(list_filter(string_split({folded('other')}, ' '), lambda w: NOT list_contains({NOISE}, w) AND length(w) > 1), ' '), '') AS y FROM c),
 p AS (SELECT *, list_last(string_split(x, ' ')) AS u, list_last(string_split(y, ' ')) AS v FROM k)
 SELECT entry_id, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN contains(x, y) OR contains(y, x) OR (least(length(u), length(v)) >= 5 AND (ends_with(u, v) OR ends_with(v, u))) OR 100.0 * (1 - levenshtein(x, y) / greatest(length(x), length(y))) >= 85 END AS agree FROM p""")
def courts(spark, root):
    """Whether each entry is of the same court as the entry before it in its volume, however the courts are written."""
    other = F.lag("court").over(W.partitionBy("project").orderBy("entry_id"))
    c = table(spark, root, "court_entries").select("entry_id", "court", other.alias("other"))
    return c.select("entry_id", resolve.courts_agree(F.col("court"), F.col("other")).alias("agree"))


DECIDED_SQL = """c AS (SELECT o_orderkey AS record, 'F' || lpad(CAST(i AS VARCHAR), 2, '0') AS entity, 60.0 + (o_orderkey * 7 + i * 13) % 41 AS score FROM orders, range(1, 4) t(i)), e AS (SELECT *, CAST(substr(entity, 2) AS INTEGER) AS i FROM c),
 a AS (SELECT *, CASE (record + i) % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS seat, CASE (record + i) % 3 WHEN 0 THEN NULL ELSE (record + i) % 3 = 1 END AS year, CASE (record + 2 * i) % 5 WHEN 0 THEN NULL ELSE (record + 2 * i) % 5 <> 1 END AS court FROM e),
 r AS (SELECT *, score + CASE WHEN seat THEN 12 ELSE 0 END + CASE WHEN year THEN 10 ELSE 0 END + CASE WHEN court THEN 8 ELSE 0 END AS ranked FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY ranked DESC, entity) AS k FROM r), l AS (SELECT *, lead(score) OVER w AS s2, lead(ranked) OVER w AS r2 FROM k WINDOW w AS (PARTITION BY record ORDER BY k)),
 d AS (SELECT record, entity, CASE WHEN court = false THEN 'court differs' WHEN score >= 95 AND seat = false AND year = false THEN 'seat and year contradict' WHEN score >= 85 AND score < 95 AND (seat = false OR year = false) THEN 'a fact contradicts' WHEN score >= 70 AND score < 85 AND NOT coalesce(seat AND year, false) THEN 'weak name'
  WHEN score < 70 THEN 'name too different' WHEN score - s2 < 5 AND ranked - r2 < 5 THEN 'ambiguous' WHEN score >= 95 THEN 'sure name' WHEN score >= 85 THEN 'good name' ELSE 'corroborated' END AS reason FROM l WHERE k = 1)"""


@query("WITH " + DECIDED_SQL + " SELECT record, CASE WHEN reason IN ('sure name', 'good name', 'corroborated') THEN entity END AS entity, CASE WHEN reason IN ('sure name', 'good name', 'corroborated') THEN 'same' ELSE 'open' END AS decision, reason FROM d")
def decided_candidates(spark, root):
    """Three candidates for each order with facts that agree, differ or are missing, boosted, ranked and decided."""
    k, i = F.col("record"), F.col("i")
    c = table(spark, root, "orders").select(F.col("o_orderkey").alias("record"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("i"))
    c = c.withColumn("entity", F.concat(F.lit("F"), F.lpad(i.cast("string"), 2, "0"))).withColumn("score", 60.0 + (k * 7 + i * 13) % 41)
    said = lambda n, m: F.when(n == 0, None).otherwise(n != m)
    seat, year, court = said((k + i) % 4, 1), F.when((k + i) % 3 == 0, None).otherwise((k + i) % 3 == 1), said((k + 2 * i) % 5, 1)
    # Facts are written so that they agree or not; each pair of record and entity has its own.
    a = c.withColumns({"seat_agree": seat, "founded_agree": year, "court_agree": court, "cited": F.lit(False), "keyed": F.lit(False)})
    boost = F.when(F.col("seat_agree"), resolve.BOOSTS["seat"]).otherwise(0.0) + F.when(F.col("founded_agree"), resolve.BOOSTS["founded"]).otherwise(0.0) + F.when(F.col("court_agree"), resolve.BOOSTS["court"]).otherwise(0.0)
    r = a.withColumn("ranked", F.col("score") + boost)
    r = r.withColumn("rank", F.row_number().over(W.partitionBy("record").orderBy(F.col("ranked").desc(), "entity")))
    return resolve.decide(r)


@query("""WITH c AS (SELECT o_orderkey AS record, 'E' || (o_custkey % 40) AS entity, (o_orderkey % 30) + 70.0 AS score FROM orders), e AS (SELECT DISTINCT 'E' || (o_custkey % 40) AS entity, o_custkey % 40 AS n FROM orders),
 j AS (SELECT record, entity, score, CASE WHEN record % 9 > 0 THEN record % 2 = n % 2 END AS s, CASE WHEN n % 7 > 0 THEN record % 3 = n % 3 END AS f, record % 11 = n % 11 AS y FROM c JOIN e USING (entity))
 SELECT record, entity, s AS seat_agree, f AS founded_agree, CAST(score + CASE WHEN s THEN 12 ELSE 0 END + CASE WHEN f THEN 10 ELSE 0 END + CASE WHEN y THEN 4 ELSE 0 END + CASE WHEN record % 6 = 0 THEN 25 ELSE 0 END + CASE WHEN record % 15 = 0 THEN 40 ELSE 0 END AS DOUBLE) AS ranked FROM j""")
def boosted_candidates(spark, root):
    o = table(spark, root, "orders").select(F.col("o_orderkey").alias("record"), (F.col("o_custkey") % 40).alias("n"))
    c = o.select("record", F.concat(F.lit("E"), F.col("n").cast("string")).alias("entity"), (F.col("record") % 30 + 70.0).alias("score"), F.lit(1).alias("rank"))
    town = lambda n: F.when(n % 2 == 0, "Alsótelek").otherwise("Dombovár")
    r, n = F.col("record"), F.col("n")
    none = lambda: F.lit(None).cast("string")
    rec = o.select("record", F.when(r % 9 > 0, town(r)).alias("seat"), (1870 + r % 3).cast("string").alias("founded"), F.concat(F.lit("c"), (r % 11).cast("string")).alias("county"), none().alias("legal_form"), none().alias("court"))
    ent = o.select("n").distinct().select(F.concat(F.lit("E"), n.cast("string")).alias("entity"), town(n).alias("seat"), F.when(n % 7 > 0, (1870 + n % 3).cast("string")).alias("founded"), F.concat(F.lit("c"), (n % 11).cast("string")).alias("county"), none().alias("legal_form"), none().alias("court"))
    pairs = c.select("record", "entity")
    return resolve.boosted(c, rec, ent, pairs.where("record % 6 = 0"), pairs.where("record % 15 = 0")).select("record", "entity", "seat_agree", "founded_agree", "ranked")


CITED_SQL = "r AS (SELECT o_orderkey AS record, o_orderkey AS pos, CAST(extract(year FROM o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey % 50 AS INTEGER) END AS issue, CASE WHEN o_orderkey % 6 = 1 THEN CAST(o_custkey % 5 AS INTEGER) END AS volume_no, CASE WHEN o_orderkey % 6 = 2 THEN CAST(1993 + o_custkey % 4 AS INTEGER) END AS cited, o_orderkey % 3 = 0 AS previous FROM orders), i AS (SELECT DISTINCT CAST(1992 + s_suppkey % 7 AS INTEGER) AS year, CAST(s_suppkey % 50 AS INTEGER) AS issue, s_name AS entity, s_suppkey * 300 AS pos FROM supplier), v AS (SELECT CAST(n AS INTEGER) AS volume_no, CAST(1992 + n AS INTEGER) AS vy FROM range(0, 5) t(n))"


@query("WITH " + CITED_SQL + """, y AS (SELECT r.*, coalesce(cited, vy) AS y FROM r LEFT JOIN v USING (volume_no)) SELECT DISTINCT record, entity, lane FROM (SELECT record, entity, CASE WHEN y.y IS NOT NULL THEN 'named volume' WHEN i.year = y.year THEN 'this volume' ELSE 'volume before' END AS lane FROM y JOIN i ON i.issue = y.issue AND (CASE WHEN y.y IS NOT NULL THEN i.year = y.y ELSE i.year IN (y.year, y.year - 1) END)
 UNION ALL SELECT record, arg_max(entity, i.pos), 'entry above' FROM r JOIN i ON i.year = r.year AND i.pos < r.pos WHERE previous GROUP BY record)""")
def cited_entities(spark, root):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rec = table(spark, root, "orders").select(k.alias("record"), k.alias("pos"), F.year("o_orderdate").alias("year"), F.when(k % 3 > 0, (c % 50).cast("int")).alias("issue"), F.when(k % 6 == 1, (c % 5).cast("int")).alias("volume_no"), F.when(k % 6 == 2, (1993 + c % 4).cast("int")).alias("cited_year"), (k % 3 == 0).alias("previous"))
    s = F.col("s_suppkey")
    iss = table(spark, root, "supplier").select((1992 + s % 7).cast("int").alias("year"), (s % 50).cast("int").alias("issue"), F.col("s_name").alias("entity"), (s * 300).alias("pos"))
    vol = spark.range(5).select(F.col("id").cast("int").alias("volume_no"), (1992 + F.col("id")).cast("int").alias("year"))
    return resolve.citations(rec, iss, vol)


@query(f"""WITH f AS (SELECT DISTINCT firm_text, {folded('firm_text')} AS f FROM court_entries WHERE firm_text IS NOT NULL), b AS (SELECT firm_text, f, list_filter(string_split(trim(regexp_replace(f, '\\bals actiengesellschaft\\b', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'rt', 'tars')) AS w FROM f)
 SELECT firm_text, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE f END AS bare FROM b""")
def stripped_names(spark, root):
    f = table(spark, root, "court_entries").where("firm_text is not null").select("firm_text").distinct()
    return f.select("firm_text", resolve.stripped(F.col("firm_text"), ["rt", "tars"], ["als actiengesellschaft"]).alias("bare"))


# ---- edits

@query("""SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN 'second' WHEN p_partkey % 2 = 0 THEN 'first' ELSE p_brand END AS brand FROM part""")
def overlaid_parts(spark, root):
    p = table(spark, root, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    none = F.lit(None).cast("string").alias("name")
    ch = p.where("p_partkey % 2 = 0").select("p_partkey", F.lit(1).alias("ts"), none, F.lit("first").alias("brand")).unionByName(p.where("p_partkey % 4 = 0").select("p_partkey", F.lit(2).alias("ts"), none, F.lit("second").alias("brand")))
    return mutate.overlaid(p, ch, ["p_partkey"], ["name", "brand"])


@query("""SELECT * FROM (SELECT o_custkey AS entity, CAST(extract(year FROM o_orderdate) AS INTEGER) AS as_of, o_orderpriority AS source, o_orderkey AS seq FROM orders) QUALIFY row_number() OVER (PARTITION BY entity, as_of, source ORDER BY seq % 2 DESC, seq DESC) = 1""")
def slices_attached(spark, root):
    """New slices in the place of old ones of the same entity, year and source: orders of odd keys over those of even keys."""
    s = table(spark, root, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("as_of"), F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("recorded_at"))
    return mutate.attached(s.where("seq % 2 = 0"), s.where("seq % 2 = 1"), ["entity", "as_of", "source"]).drop("recorded_at")


@query("""WITH n AS (SELECT DISTINCT from_id, to_id, type FROM (SELECT to_id AS from_id, from_id AS to_id, type FROM edges UNION ALL SELECT from_id, to_id, type FROM edges) WHERE from_id <> to_id AND type IN ('rename', 'merger')), k AS (SELECT DISTINCT from_id, to_id, type FROM edges)
 SELECT type, count(*) AS n FROM (SELECT from_id, to_id, type FROM edges UNION ALL SELECT * FROM (SELECT * FROM n EXCEPT SELECT * FROM k)) GROUP BY 1""")
def edges_added(spark, root):
    e = table(spark, root, "edges")
    new = e.unionByName(e.withColumns({"from_id": F.col("to_id"), "to_id": F.col("from_id")}))
    return mutate.with_edges(e, new, ["rename", "merger"])[0].groupBy("type").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT DISTINCT greatest(from_id, to_id) AS from_id, least(from_id, to_id) AS to_id FROM edges WHERE type = 'rename' AND from_id <> to_id), u AS (SELECT DISTINCT from_id, to_id, 'duplicate_of' AS type FROM m) SELECT from_id, to_id, type FROM u WHERE hash(from_id) IS NOT NULL AND from_id NOT IN (SELECT max(from_id) FROM u)""")
def entities_merged_and_unmerged(spark, root):
    pairs = table(spark, root, "edges").where("type = 'rename'").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    m = mutate.merged_entities(pairs)
    last = m.agg(F.max("from_id").alias("from_id"))
    back = m.join(last, "from_id").select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))
    return mutate.unmerged(m, back)


@query(f"""SELECT entry_id, CASE WHEN {folded('firm_text')} LIKE '%gozmalom%' THEN 'E1' ELSE court END AS entity FROM court_entries""")
def worklist_applied(spark, root):
    c = table(spark, root, "court_entries").select("entry_id", "firm_text", F.col("court").alias("entity"))
    fixes = c.select(text.fold(F.col("firm_text")).alias("folded")).where("folded like '%gozmalom%'").distinct().withColumn("entity", F.lit("E1"))
    return mutate.applied_texts(c, fixes, text.fold(F.col("firm_text"))).select("entry_id", "entity")


@query("""SELECT o_orderkey AS record, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0 THEN 'P' WHEN o_orderkey % 5 = 0 THEN 'old' END AS entity, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0 THEN 'same' END AS outcome, CASE WHEN o_orderkey % 3 = 0 THEN 'human' WHEN o_orderkey % 4 = 0 THEN 'auto' END AS source FROM orders""")
def batch_decisions(spark, root):
    k = F.col("o_orderkey")
    o = table(spark, root, "orders")
    rec = o.select(k.alias("record"), F.when(k % 5 == 0, "old").alias("entity"), F.lit(None).cast("string").alias("outcome"), F.when(k % 3 == 0, "human").alias("source"))
    return mutate.decisions(rec, o.where("o_orderkey % 4 = 0").select(k.alias("record"), F.lit("P").alias("entity"), F.lit("same").alias("outcome")))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 8 <> 0 THEN 'v' END WHEN o_orderkey % 3 = 0 THEN 'was' END AS human, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 8 = 0 ELSE false END AS blank, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 = 0 THEN 'was' END AS before FROM orders""")
def reviews_accepted(spark, root):
    k = F.col("o_orderkey")
    b = table(spark, root, "orders").select(k.alias("k"), F.when(k % 3 == 0, "was").alias("human"), F.lit(False).alias("blank"))
    d = b.where("k % 4 = 0").select("k", F.when(F.col("k") % 8 == 0, "").otherwise("v").alias("value"))
    return mutate.accepted(b, d, ["k"]).select("k", "human", "blank", F.col("previous.human").alias("before"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN NOT (l_returnflag IN ('A', 'N') AND (l_linenumber > 4 OR l_linenumber IN (1, 2))) THEN 'o' END AS ocr, 'h' AS human FROM lineitem""")
def layers_cleared(spark, root):
    b = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("label"), F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber")).alias("super_column"), F.lit("o").alias("ocr"), F.lit("h").alias("human"))
    return mutate.cleared(b, ["ocr"], ["A", "N"], [1, 2]).drop("label", "super_column")


# ---- pages and crops

@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_min(list_transform(ps, lambda p: p[1])) AS x1, list_min(list_transform(ps, lambda p: p[2])) AS y1, list_max(list_transform(ps, lambda p: p[1])) AS x2, list_max(list_transform(ps, lambda p: p[2])) AS y2
 FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [[l_quantity, l_extendedprice], [l_quantity + l_linenumber, l_extendedprice - 5], [l_discount, l_tax]][1:CAST(1 + l_linenumber % 3 AS INTEGER)] AS ps FROM lineitem) WHERE len(ps) >= 2""")
def bounding_boxes(spark, root):
    q, e = F.col("l_quantity").cast("double"), F.col("l_extendedprice")
    ps = F.slice(F.array(F.array(q, e), F.array(q + F.col("l_linenumber"), e - 5), F.array("l_discount", "l_tax")), F.lit(1), 1 + F.col("l_linenumber") % 3)
    return geometry.from_points(table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ps.alias("points"))).drop("points")


@query(WITH + """ SELECT page, idx, coalesce(CASE WHEN page % 3 > 0 THEN CAST(1000 + page % 7 AS DOUBLE) END, max(x2) OVER (PARTITION BY page)) AS page_width FROM boxes""")
def page_widths(spark, root):
    b = boxes(spark, root).withColumn("stored", F.when(F.col("page") % 3 > 0, 1000 + F.col("page") % 7))
    return geometry.page_width(b, ["page"], "stored").select("page", "idx", "page_width")


@query(WITH + """, m AS (SELECT page, idx, greatest(x1 + 100, 100) AS x1, greatest(y1 + 50, 50) AS y1, least(x2 + 100, 700) AS x2, least(y2 + 50, 900) AS y2 FROM boxes) SELECT * FROM m WHERE x2 > x1 AND y2 > y1""")
def crops_onto_pages(spark, root):
    b = boxes(spark, root)
    c = b.select("page").distinct().select(F.col("page").alias("crop"), F.lit(100).alias("left"), F.lit(50).alias("top"), F.lit(700).alias("right"), F.lit(900).alias("bottom"))
    return pages.onto_page(b.withColumnRenamed("page", "crop"), c).select(F.col("crop").alias("page"), "idx", "x1", "y1", "x2", "y2")


@query(WITH + """ SELECT page, idx, last_value(CASE WHEN label = 'A' THEN 't' || idx END IGNORE NULLS) OVER (PARTITION BY page ORDER BY idx) AS heading FROM boxes""")
def propagated_headings(spark, root):
    b = boxes(spark, root).withColumn("text", F.concat(F.lit("t"), F.col("idx").cast("string")))
    return pages.propagated(b, ["page"], ["idx"], "A").select("page", "idx", "heading")


@query(WITH + """, h AS (SELECT *, 't' || idx AS text, last_value(CASE WHEN label = 'A' THEN 't' || idx END IGNORE NULLS) OVER (PARTITION BY page ORDER BY idx) AS h FROM boxes) SELECT page, idx, '{"label":"' || label || '","text":"' || text || '"' || CASE WHEN h IS NULL THEN '' ELSE ',"A":"' || h || '"' END || '}' AS json FROM h WHERE label = 'N'""")
def exported_records(spark, root):
    b = boxes(spark, root).withColumn("text", F.concat(F.lit("t"), F.col("idx").cast("string")))
    return pages.exported_records(b, ["page"], ["idx"], {"A": "propagate", "R": "ignore"}).select("page", "idx", "json")


@query(WITH + """ SELECT page, idx, label FROM boxes WHERE score IS NULL OR score >= 0.05""")
def score_filtered(spark, root):
    return review.score_filtered(boxes(spark, root), 0.05).select("page", "idx", "label")


@query(WITH + """ SELECT page, idx FROM boxes WHERE page % 4 = 1 AND page % 5 > 0""")
def applicable_predictions(spark, root):
    b = boxes(spark, root)
    p = b.select("page").distinct().withColumn("status", F.when(F.col("page") % 5 == 0, "skip"))
    return pages.applicable(b, p, b.where("page % 4 <> 1"), ["page"]).select("page", "idx")


@query(WITH + """ SELECT page, idx, CASE WHEN page % 3 = 1 THEN 'crop' ELSE 'page' END AS origin FROM boxes WHERE page % 3 = 1 OR NOT (label = 'A' AND page % 3 = 1)""")
def written_back(spark, root):
    """Crops of every page; on every third their parent is still there, and their boxes take the place of those that came from them."""
    b = boxes(spark, root)
    own = b.withColumn("crop_origin", F.when(F.col("label") == "A", "c"))
    crops = b.where("label = 'A'").withColumn("crop_origin", F.lit("c")).withColumn("parent_alive", F.col("page") % 3 == 1)
    out, _ = pages.written_back(own.withColumn("from", F.lit("page")), crops.withColumn("from", F.lit("crop")), ["page"])
    return out.select("page", "idx", F.when(F.col("page") % 3 == 1, "crop").otherwise("page").alias("origin"))


@query(WITH + """ SELECT page, idx, CAST(row_number() OVER (PARTITION BY page ORDER BY idx) AS INTEGER) AS pos, count(*) OVER (PARTITION BY page) > 12 AS truncated FROM boxes QUALIFY row_number() OVER (PARTITION BY page ORDER BY idx) <= 12""")
def record_inputs(spark, root):
    return pages.record_inputs(boxes(spark, root), ["page"], ["idx"], 12).select("page", "idx", "pos", "truncated")


@query(WITH + """, h AS (SELECT page, CAST(idx AS INTEGER) AS idx, CASE WHEN idx % 4 = 1 THEN 'start' WHEN idx % 4 = 3 THEN 'stop' END AS role FROM boxes) SELECT page, idx, coalesce(last_value(role IGNORE NULLS) OVER (PARTITION BY page ORDER BY idx), 'start') = 'start' AS open_at_end FROM h""")
def open_roles(spark, root):
    b = boxes(spark, root).withColumn("role", F.when(F.col("idx") % 4 == 1, "start").when(F.col("idx") % 4 == 3, "stop"))
    return ordered.open_role(b, ["page"], ["idx"], "role").select("page", "idx", "open_at_end")


@query(WITH + """ SELECT label, max(page) AS max_id, arg_max(page, (page, idx)) AS last_id FROM boxes WHERE page % 7 > 0 GROUP BY 1""")
def resweep_seeds(spark, root):
    b = boxes(spark, root).withColumn("id", F.when(F.col("page") % 7 > 0, F.col("page")))
    return ordered.resweep_seed(b, ["label"], ["page", "idx"], "id")


@query(WITH + """ SELECT state, count(*) AS n FROM (SELECT DISTINCT page, CASE WHEN page % 5 = 0 THEN 'missing' WHEN page % 5 = 1 AND mx THEN 'changed' ELSE 'unchanged' END AS state FROM (SELECT page, max(idx) OVER (PARTITION BY page) >= 0 AS mx FROM boxes)) GROUP BY 1""")
def frozen_drift(spark, root):
    b = boxes(spark, root)
    now = b.where("page % 5 > 0").withColumn("x1", F.when((F.col("page") % 5 == 1) & (F.col("idx") == 0), F.col("x1") + 1).otherwise(F.col("x1")))
    return evaluate.drift(evaluate.page_hash(b, ["page"]), now, ["page"]).groupBy("state").agg(F.count("*").alias("n"))


# ---- curation and caches

@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'no_source' WHEN o_orderkey % 7 = 0 THEN 'missing_pdf' WHEN o_orderkey % 5 = 0 THEN 'no_image' WHEN o_orderkey % 3 = 0 THEN 'altered' WHEN o_orderkey % 2 = 0 THEN 'up_to_date' ELSE 'to_render' END AS plan, round(least(greatest(2400.0::DOUBLE / (o_orderkey % 5000 + 100), 0.5), 12), 4) AS scale FROM orders""")
def render_plans(spark, root):
    k = F.col("o_orderkey")
    p = table(spark, root, "orders").select(k.alias("k"), F.when(k % 11 > 0, "a.pdf").alias("pdf_source"), (k % 7 > 0).alias("pdf_exists"), F.when(k % 5 > 0, 1000).alias("image_width"), F.when(k % 3 == 0, 990).otherwise(1000).alias("width"), F.when(k % 2 == 0, 2.0).alias("pdf_scale"))
    return curation.render_plan(p, F.lit(2.0)).select("k", "plan", curation.render_scale("longest", 2400, F.col("k") % 5000 + 100).alias("scale"))


@query("""SELECT 'd' || (o_custkey % 20) AS folder, count(*) AS files, CAST(sum(o_orderkey) AS BIGINT) AS bytes FROM orders WHERE o_custkey % 20 NOT IN (3, 4) GROUP BY 1""")
def inbox_folders(spark, root):
    o = table(spark, root, "orders").select(F.concat(F.lit("d"), (F.col("o_custkey") % 20).cast("string")).alias("top"), F.col("o_orderkey").alias("length"))
    files = curation.not_imported(o.withColumnRenamed("top", "stem"), o.where("top in ('d3', 'd4')").select(F.col("top").alias("stem")))
    return curation.folders(files.select(F.concat("stem", F.lit("/p"), F.col("length").cast("string"), F.lit(".jpg")).alias("path"), "length"))


@query("""SELECT o_orderkey AS k, o_orderkey % 4 = 0 AND o_orderkey % 6 > 0 AS restored FROM orders WHERE o_orderkey % 4 = 0""")
def restored_from_trash(spark, root):
    t = table(spark, root, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("k"))
    back, refused = curation.restorable(t, t.where("k % 6 = 0"), "k")
    return back.select("k", F.lit(True).alias("restored")).unionByName(refused.select("k", F.lit(False).alias("restored")))


@query("""SELECT k, answer FROM (SELECT o_orderkey AS k, sha256('m' || chr(31) || o_orderpriority || chr(31) || '100' || chr(31) || chr(0) || chr(31) || '') AS key FROM orders) JOIN (SELECT DISTINCT sha256('m' || chr(31) || o_orderpriority || chr(31) || '100' || chr(31) || chr(0) || chr(31) || '') AS key, 'a' || o_orderpriority AS answer FROM orders WHERE o_orderpriority < '3') USING (key)""")
def cached_answers(spark, root):
    key = lambda m: review.answer_key(F.lit(m), F.col("o_orderpriority"), F.lit(100), F.lit(None), F.lit(""))
    o = table(spark, root, "orders")
    cache = o.where("o_orderpriority < '3'").select(key("other/m").alias("key"), F.concat(F.lit("a"), "o_orderpriority").alias("answer")).distinct()
    return review.from_cache(o.select(F.col("o_orderkey").alias("k"), key("vendor/m").alias("key")), cache)[0].select("k", "answer")


@query("WITH " + LAYERS_SQL + """ SELECT 'pdf_has_digits' AS condition, count(*) FILTER (regexp_matches(pdf, '[0-9]')) AS n FROM lay UNION ALL SELECT 'pdf_has_chars', count(*) FILTER (regexp_matches(pdf, '[A-Za-z]')) FROM lay UNION ALL SELECT 'pdf_has_any', count(*) FILTER (trim(pdf) <> '') FROM lay UNION ALL SELECT 'rows_llm_empty', count(*) FILTER (trim(coalesce(llm, '')) = '') FROM lay UNION ALL SELECT 'skip_blank', count(*) FILTER (k % 5 <> 2) FROM lay""")
def batch_conditions(spark, root):
    d = _layers(spark, root).withColumn("blank", F.when(F.col("k") % 5 == 2, True))
    out = None
    for c in ("pdf_has_digits", "pdf_has_chars", "pdf_has_any", "rows_llm_empty", "skip_blank"):
        n = review.batch_filter(d, c).agg(F.count("*").alias("n")).select(F.lit(c).alias("condition"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("""SELECT entry_id, event_date AS said, CASE WHEN folio IS NOT NULL THEN folio END AS folio, CASE WHEN event_type = 'deleted' THEN 'deleted' ELSE 'registered' END AS event FROM court_entries WHERE event_date IS NOT NULL""")
def derived_fields(spark, root):
    """What named parsers read from several columns, one below the other."""
    e = table(spark, root, "court_entries").where("event_date is not null")
    lines = [F.concat(F.lit("kelt "), F.col("event_date")), F.coalesce(F.concat(F.col("folio").cast("string"), F.lit("/1")), F.lit("")), F.when(F.col("event_type") == "deleted", "kitöröltetett").otherwise("új czég")]
    return e.select("entry_id", parse.derive(lines, "date").alias("said"), parse.derive(lines, "folio")["folio"].alias("folio"), parse.derive(lines, "event").alias("event"))


@query("""SELECT o_orderkey AS k, array_to_string(list_filter(['h' || CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, CASE WHEN o_orderkey % 3 = 0 THEN 'l' ELSE 'o' END, NULL], lambda x: x IS NOT NULL), chr(10)) AS text FROM orders""")
def texts_of_rows(spark, root):
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    row = lambda h, m, o: F.struct(h.alias("human"), m.alias("llm"), o.alias("ocr"))
    rows = F.array(row(F.when(k % 2 == 0, F.concat(F.lit("h"), F.col("o_custkey").cast("string"))), F.lit(" "), none), row(F.lit(""), F.when(k % 3 == 0, "l"), F.lit("o")), row(none, none, F.lit("  ")))
    return table(spark, root, "orders").select(k.alias("k"), text.rows_text(rows).alias("text"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND s <> 'verified' THEN 'skip' WHEN s <> 'predicted' THEN s END AS status FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'in_progress' ELSE 'predicted' END AS s FROM documents)""")
def statuses_set(spark, root):
    k = F.col("doc_id")
    d = table(spark, root, "documents").select(k, F.when(k % 3 == 0, "verified").when(k % 3 == 1, "in_progress").alias("status"))
    return mutate.with_status(d, d.where("doc_id % 2 = 0"), ["doc_id"], "skip", ["verified"])


@query("""SELECT 'u' || (user_id % 50) AS entry, count(*) AS files, CAST(sum(event_id) AS BIGINT) AS bytes, max(ts) AS changed FROM events GROUP BY 1""")
def trash_inventory(spark, root):
    e = table(spark, root, "events")
    return curation.trash_entries(e.select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string"), F.lit("/"), F.col("event_id").cast("string")).alias("path"), F.col("event_id").alias("length"), F.col("ts").alias("mtime")))


@query("""WITH RECURSIVE d AS (SELECT from_id AS id, arg_max(to_id, ts) AS nxt FROM edges WHERE type = 'duplicate_of' AND from_id <> to_id GROUP BY 1), c AS (SELECT id, nxt AS canonical, 1 AS k FROM d UNION ALL SELECT c.id, d.nxt, k + 1 FROM c JOIN d ON c.canonical = d.id WHERE k < 50),
 m AS (SELECT id, canonical FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1), e AS (SELECT id, coalesce(canonical, id) AS t, k, attrs[k] AS v FROM (SELECT id, attrs, unnest(map_keys(attrs)) AS k FROM entities) LEFT JOIN m USING (id)), f AS (SELECT t, k, v FROM e WHERE trim(coalesce(v, '')) <> '' QUALIFY row_number() OVER (PARTITION BY t, k ORDER BY id <> t, id) = 1)
 SELECT id, coalesce((SELECT string_agg(k || '=' || v, '|' ORDER BY k) FROM f WHERE f.t = entities.id), '') AS attrs FROM entities WHERE id NOT IN (SELECT id FROM m)""")
def facts_merged(spark, root):
    f = heads.merged_facts(table(spark, root, "entities"), history.canonical_ids(table(spark, root, "edges")))
    return f.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda x: F.concat_ws("=", x["key"], x["value"])), "|").alias("attrs"))
