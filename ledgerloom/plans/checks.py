"""Queries of rules, diagnostics and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import numbers
from ledgerloom.operators import diagnostics, rules
from ledgerloom.plans.frames import CELLS_SQL, LINE_ORDER, latest, printed
from ledgerloom.plans.registry import query
from ledgerloom.runtime import table

RULES = [
    {"name": "net", "lhs": "price * (1 - discount)", "operator": ">=", "rhs": "1000", "tol": 0.0},
    {"name": "tax", "lhs": "discount + tax", "operator": "<=", "rhs": "0.15", "tol": 1e-9},
    {"name": "unit", "lhs": "int(price / quantity)", "operator": "=", "rhs": "int(price / (quantity + 0))", "tol": 0.5},
    {"name": "none", "lhs": "price / (quantity - quantity)", "operator": "=", "rhs": "0", "tol": 0.5},
]


@query("""SELECT rule, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, sum(CAST(round(delta * 100) AS BIGINT))::BIGINT AS total_delta_cents FROM (
  SELECT 'net' AS rule, l_shipdate, l_extendedprice * (1 - l_discount) - 1000 AS delta FROM lineitem WHERE l_extendedprice * (1 - l_discount) - 1000 < 0
  UNION ALL SELECT 'tax', l_shipdate, l_discount + l_tax - 0.15 FROM lineitem WHERE l_discount + l_tax - CAST(0.15 AS DOUBLE) > 1e-9) GROUP BY ALL""")
def rule_violations(spark, root):
    li = table(spark, root, "lineitem").select("l_shipdate", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("quantity"))
    v = rules.violations(li, RULES, ["l_shipdate"])
    return v.groupBy("rule", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("delta") * 100).cast("bigint")).alias("total_delta_cents"))


def _wide(spark, root):
    names = ["workers", "horsepower", "output", "total"]
    c = latest(spark, root).where(F.col("variable").isin(names)).withColumn("num", numbers.printed_number(F.col("value")))
    return rules.wide(c, "row_id", "variable", "num", names)


WIDE_SQL = CELLS_SQL + f""", nums AS (SELECT row_id, variable, {printed('value')} AS num FROM latest),
 wide AS (SELECT row_id, max(num) FILTER (variable = 'workers') AS workers, max(num) FILTER (variable = 'horsepower') AS horsepower, max(num) FILTER (variable = 'output') AS output, max(num) FILTER (variable = 'total') AS total
   FROM nums WHERE variable IN ('workers', 'horsepower', 'output', 'total') GROUP BY row_id)"""


@query("WITH " + CELLS_SQL + f" SELECT variable, count(*) AS n, count({printed('value')}) AS numbers, sum(CAST({printed('value')} AS BIGINT))::BIGINT AS total FROM latest WHERE variable IN ('workers', 'horsepower', 'total') GROUP BY 1")
def number_parse(spark, root):
    c = latest(spark, root).where(F.col("variable").isin("workers", "horsepower", "total")).withColumn("num", numbers.printed_number(F.col("value")))
    return c.groupBy("variable").agg(F.count("*").alias("n"), F.count("num").alias("numbers"), F.sum(F.round("num").cast("bigint")).alias("total"))


@query("WITH " + WIDE_SQL + """ SELECT CASE WHEN total IS NULL OR workers IS NULL OR horsepower IS NULL THEN 'untestable' WHEN abs(workers + horsepower - total) <= 0.51 THEN 'ok' ELSE 'mismatch' END AS status, count(*) AS n,
  count(CASE WHEN total IS NOT NULL AND workers IS NOT NULL AND horsepower IS NOT NULL AND abs(workers + horsepower - total) > 0.51 AND
    (CASE WHEN levenshtein(CAST(CAST(total AS BIGINT) AS VARCHAR), CAST(CAST(workers + horsepower AS BIGINT) AS VARCHAR)) = 1 THEN 1 ELSE 0 END
     + CASE WHEN total - horsepower >= 0 AND levenshtein(CAST(CAST(workers AS BIGINT) AS VARCHAR), CAST(CAST(total - horsepower AS BIGINT) AS VARCHAR)) = 1 THEN 1 ELSE 0 END
     + CASE WHEN total - workers >= 0 AND levenshtein(CAST(CAST(horsepower AS BIGINT) AS VARCHAR), CAST(CAST(total - workers AS BIGINT) AS VARCHAR)) = 1 THEN 1 ELSE 0 END) = 1 THEN 1 END) AS explained
 FROM (SELECT round(workers) AS workers, round(horsepower) AS horsepower, round(total) AS total FROM wide) GROUP BY 1""")
def identity_check(spark, root):
    w = _wide(spark, root).select("row_id", *[F.round(c).alias(c) for c in ("workers", "horsepower", "total")])
    return diagnostics.identities(w, "total", ["workers", "horsepower"]).groupBy("status").agg(F.count("*").alias("n"), F.count("culprit").alias("explained"))


@query("WITH " + WIDE_SQL + """ , runs AS (SELECT count(*) FILTER (workers IS NOT NULL AND horsepower IS NOT NULL AND total IS NOT NULL) AS tested, count(*) FILTER (abs(workers + horsepower - total) <= 0.51) AS held FROM wide)
 SELECT 'total' AS total, 'workers+horsepower' AS parts, tested, held FROM runs WHERE held / tested >= 0.8""")
def identity_discovery(spark, root):
    w = _wide(spark, root).select("workers", "horsepower", "total")
    return _discovered(w)


def _discovered(w):
    from ledgerloom.operators.dataset import suggested_identities

    return suggested_identities(w, ["workers", "horsepower", "total"]).where("total = 'total'").select("total", F.array_join("parts", "+").alias("parts"), "tested", "held")


TOTALS_SQL = f""", li AS (SELECT l_suppkey AS g, row_number() OVER (PARTITION BY l_suppkey ORDER BY {LINE_ORDER}) AS pos, CAST(l_quantity AS BIGINT) AS a, CAST(l_discount * 100 AS BIGINT) AS b, CAST(l_tax * 100 AS BIGINT) AS c FROM lineitem),
 seq AS (SELECT *, pos % 7 = 0 AS is_total FROM li),
 sums AS (SELECT *, sum(CASE WHEN is_total THEN 0 ELSE a END) OVER w AS sa, sum(CASE WHEN is_total THEN 0 ELSE b END) OVER w AS sb, sum(CASE WHEN is_total THEN 0 ELSE c END) OVER w AS sc FROM seq
   WINDOW w AS (PARTITION BY g ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
 tot AS (SELECT g, pos, is_total, CASE WHEN is_total THEN sa + CASE WHEN pos % 3 = 0 THEN 5 ELSE 0 END ELSE a END AS a, CASE WHEN is_total THEN sb ELSE b END AS b, CASE WHEN is_total THEN sc + CASE WHEN pos % 5 = 0 THEN 1 ELSE 0 END ELSE c END AS c FROM sums)"""


@query("WITH dummy AS (SELECT 1)" + TOTALS_SQL + """, pairs AS (SELECT t.g, t.pos, t.pos - d.pos AS k, t.a AS ta, t.b AS tb, t.c AS tc, sum(d.a) OVER w AS sa, sum(d.b) OVER w AS sb, sum(d.c) OVER w AS sc
   FROM tot t JOIN tot d ON d.g = t.g AND NOT d.is_total AND d.pos < t.pos AND d.pos > t.pos - 7 WHERE t.is_total WINDOW w AS (PARTITION BY t.g, t.pos ORDER BY d.pos DESC)),
 best AS (SELECT g, pos, k, (CASE WHEN abs(sa - ta) <= 0.51 THEN 1 ELSE 0 END + CASE WHEN abs(sb - tb) <= 0.51 THEN 1 ELSE 0 END + CASE WHEN abs(sc - tc) <= 0.51 THEN 1 ELSE 0 END) AS m FROM pairs
   QUALIFY row_number() OVER (PARTITION BY g, pos ORDER BY (CASE WHEN abs(sa - ta) <= 0.51 THEN 1 ELSE 0 END + CASE WHEN abs(sb - tb) <= 0.51 THEN 1 ELSE 0 END + CASE WHEN abs(sc - tc) <= 0.51 THEN 1 ELSE 0 END) DESC, k) = 1)
 SELECT g, pos, CASE WHEN m > 0 THEN k END AS k, m AS matches, m >= 3 AS anchored FROM best""")
def printed_totals(spark, root):
    from pyspark.sql import Window as W

    w = W.partitionBy("g").orderBy(*LINE_ORDER.split(", "))
    li = table(spark, root, "lineitem").withColumn("g", F.col("l_suppkey"))
    seq = li.select("g", F.row_number().over(w).cast("bigint").alias("pos"), F.col("l_quantity").cast("bigint").alias("a"), F.round(F.col("l_discount") * 100).cast("bigint").alias("b"), F.round(F.col("l_tax") * 100).cast("bigint").alias("c"))
    seq = seq.withColumn("is_total", F.col("pos") % 7 == 0)
    before = W.partitionBy("g").orderBy("pos").rowsBetween(-6, -1)
    s = {c: F.sum(F.when(~F.col("is_total"), F.col(c)).otherwise(0)).over(before) for c in "abc"}
    off = {"a": F.when(F.col("pos") % 3 == 0, 5).otherwise(0), "b": F.lit(0), "c": F.when(F.col("pos") % 5 == 0, 1).otherwise(0)}
    rows = seq.select("g", "pos", "is_total", *[F.when(F.col("is_total"), s[c] + off[c]).otherwise(F.col(c)).alias(c) for c in "abc"])
    t = diagnostics.printed_totals(rows, ["g"], ["pos"], "is_total", ["a", "b", "c"])
    return t.select("g", "pos", F.col("k").cast("bigint").alias("k"), F.col("matches").cast("int").alias("matches"), "anchored")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN c_acctbal IS NULL OR c_acctbal <= 0 THEN 'untestable' WHEN o_totalprice / c_acctbal < 10 THEN 'low' WHEN o_totalprice / c_acctbal > 100 THEN 'high' ELSE 'ok' END AS status
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey) GROUP BY 1""")
def ratio_bounds(spark, root):
    o = table(spark, root, "orders").select("o_custkey", "o_totalprice")
    j = o.join(table(spark, root, "customer").select("c_custkey", "c_acctbal"), o["o_custkey"] == F.col("c_custkey"), "left")
    return diagnostics.ratio_bounds(j, F.col("o_totalprice"), F.col("c_acctbal"), 10, 100).groupBy("status").agg(F.count("*").alias("n"))


VALUES_SQL = """vals AS (SELECT l_returnflag AS variable, l_extendedprice AS value FROM lineitem),
 tested AS (SELECT variable, value, ln(1 + value) AS t FROM vals),
 q AS (SELECT variable, quantile_cont(t, 0.25) AS q1, quantile_cont(t, 0.5) AS med, quantile_cont(t, 0.75) AS q3, quantile_cont(length(CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR))::DOUBLE, 0.5) AS md FROM tested GROUP BY 1),
 m AS (SELECT variable, quantile_cont(abs(t - med), 0.5) AS mad FROM tested JOIN q USING (variable) GROUP BY 1)"""


def _prices(spark, root):
    return table(spark, root, "lineitem").select(F.col("l_returnflag").alias("variable"), F.col("l_extendedprice").alias("value"))


@query("WITH " + VALUES_SQL + """ SELECT variable, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3, round(mad, 6) AS mad, md AS med_digits FROM q JOIN m USING (variable)""")
def fences(spark, root):
    f = diagnostics.fences(diagnostics.population(_prices(spark, root)))
    return f.select("variable", *[F.round(c, 6).alias(c) for c in ("q1", "med", "q3", "mad")], "med_digits")


@query("WITH " + VALUES_SQL + """ SELECT variable, sev AS severity, count(*) AS n, count(*) FILTER (long) AS long_numbers FROM (
  SELECT variable, CASE WHEN t < q1 - 3 * (q3 - q1) OR t > q3 + 3 * (q3 - q1) THEN 'extreme' WHEN t < q1 - 1.5 * (q3 - q1) OR t > q3 + 1.5 * (q3 - q1) THEN 'mild' WHEN abs(0.6745 * (t - med) / mad) > 3.5 THEN 'mild' END AS sev,
    length(CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR)) >= md + 2 AS long FROM tested JOIN q USING (variable) JOIN m USING (variable)) GROUP BY 1, 2""")
def outliers(spark, root):
    o = diagnostics.outliers(_prices(spark, root))
    return o.groupBy("variable", "severity").agg(F.count("*").alias("n"), F.sum(F.col("long_number").cast("bigint")).alias("long_numbers"))


@query("""SELECT variable, side, rank, value, k FROM (
  SELECT o_orderstatus AS variable, 'top' AS side, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_totalprice AS value, o_orderkey AS k FROM orders
  UNION ALL SELECT o_orderstatus, 'bottom', row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey), o_totalprice, o_orderkey FROM orders) WHERE rank <= 5""")
def top_bottom_n(spark, root):
    o = table(spark, root, "orders").select(F.col("o_orderstatus").alias("variable"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("k"))
    return diagnostics.extremes(o, ["k"], 5).select("variable", "side", F.col("rank").cast("bigint").alias("rank"), "value", "k")


@query("WITH " + VALUES_SQL + """, s AS (SELECT variable, min(t) AS lo, (max(t) - min(t)) / 24 AS w FROM tested GROUP BY 1)
 SELECT variable, CAST(least(23, floor((t - lo) / w)) AS INTEGER) AS bin, count(*) AS n FROM tested JOIN s USING (variable) GROUP BY 1, 2""")
def histogram_log(spark, root):
    return diagnostics.histogram(diagnostics.population(_prices(spark, root)))


@query("""SELECT variable, page, k, n, round(k / n, 6) AS share FROM (SELECT l_returnflag AS variable, l_suppkey AS page, count(*) FILTER (d = 1) AS k, count(*) AS n FROM (
  SELECT *, CAST(regexp_extract(CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS VARCHAR), '(\\d)\\D*$', 1) AS INTEGER) AS d FROM lineitem) WHERE d > 0 AND length(CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS VARCHAR)) >= 2 GROUP BY 1, 2)""")
def trailing_one(spark, root):
    v = table(spark, root, "lineitem").select(F.col("l_returnflag").alias("variable"), F.col("l_suppkey").alias("page"), F.col("l_extendedprice").alias("value"))
    t = diagnostics.trailing_one(v, "page", F.col("value").cast("bigint").cast("string"))
    return t.select("variable", "page", "k", "n", F.round("share", 6).alias("share"))


@query("""WITH d AS (SELECT l_returnflag AS variable, l_suppkey AS page, CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS VARCHAR) || CASE WHEN l_suppkey = 7 AND l_returnflag = 'N' THEN '1' ELSE '' END AS t, length(CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS VARCHAR)) AS digits FROM lineitem),
 c AS (SELECT variable, page, count(*) FILTER (right(t, 1) = '1') AS k, count(*) AS n FROM d WHERE digits >= 2 AND right(t, 1) <> '0' GROUP BY 1, 2), m AS (SELECT greatest(count(*), 1) AS tests FROM c WHERE n >= 30),
 p AS (SELECT *, least(1.0, tests * list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(1.0::DOUBLE / 9) + (n - i) * ln(8.0::DOUBLE / 9))))) AS p_adj FROM c, m WHERE n >= 30)
 SELECT variable, page, k, n, round(p_adj, 9) AS p_adj FROM p WHERE p_adj < 0.01 AND k / n >= 2.0 / 9""")
def trailing_one_flags(spark, root):
    """Pages whose numbers end in 1 too often, one page made so."""
    v = table(spark, root, "lineitem").select(F.col("l_returnflag").alias("variable"), F.col("l_suppkey").alias("page"), F.col("l_extendedprice").alias("value"))
    v = v.withColumn("txt", F.when((F.col("page") == 7) & (F.col("variable") == "N"), F.concat(F.col("value").cast("bigint").cast("string"), F.lit("1"))).otherwise(F.col("value").cast("bigint").cast("string")))
    return diagnostics.trailing_one(v, "page", F.col("txt")).where("flagged").select("variable", "page", "k", "n", F.round("p_adj", 9).alias("p_adj"))


@query()
def esd_outliers(spark, root):
    """Rosner's test on the account balances of each market segment; iterative, held against a direct version in tests."""
    c = table(spark, root, "customer").select(F.col("c_mktsegment").alias("variable"), "c_custkey", F.when(F.col("c_custkey") % 500 == 3, F.col("c_acctbal") * 20).otherwise(F.col("c_acctbal")).alias("value"))
    return diagnostics.esd_outliers(c, "c_custkey")


@query("""WITH now AS (SELECT 'c' || (o_orderkey % 3) AS "check", 'f' || o_orderkey AS flag_id, CAST(o_orderkey % 11 AS VARCHAR) AS text FROM orders WHERE o_totalprice > 300000),
 was AS (SELECT 'c' || (o_orderkey % 3) AS "check", 'f' || o_orderkey AS flag_id FROM orders WHERE o_totalprice > 250000 AND o_totalprice < 310000),
 conf AS (SELECT 'f' || o_orderkey AS flag_id, CAST(o_orderkey % 7 AS VARCHAR) AS text FROM orders WHERE o_orderkey % 2 = 0)
 SELECT coalesce(a."check", b."check") AS "check", coalesce(flagged, 0) AS flagged, coalesce(confirmed, 0) AS confirmed, coalesce(flagged, 0) - coalesce(confirmed, 0) AS open, coalesce(corrected, 0) AS corrected FROM
 (SELECT n."check", count(*) AS flagged, count(c.flag_id) AS confirmed FROM now n LEFT JOIN conf c ON n.flag_id = c.flag_id AND n.text = c.text GROUP BY 1) a
 FULL JOIN (SELECT "check", count(*) AS corrected FROM was WHERE flag_id NOT IN (SELECT flag_id FROM now) GROUP BY 1) b ON a."check" = b."check" """)
def adjudication(spark, root):
    o = table(spark, root, "orders")
    base = o.select(F.concat(F.lit("c"), (F.col("o_orderkey") % 3).cast("string")).alias("check"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("flag_id"), (F.col("o_orderkey") % 11).cast("string").alias("text"), "o_totalprice", "o_orderkey")
    conf = base.where("o_orderkey % 2 = 0").select("flag_id", (F.col("o_orderkey") % 7).cast("string").alias("text"))
    return diagnostics.adjudicate(base.where("o_totalprice > 300000"), conf, base.where("o_totalprice > 250000 and o_totalprice < 310000"))


REPAIR = [{"name": "sum", "lhs": "a + b", "operator": "=", "rhs": "c", "tol": 0.0}, {"name": "double", "lhs": "2 * a + 2 * b", "operator": "=", "rhs": "2 * c", "tol": 0.0}, {"name": "least", "lhs": "a", "operator": ">=", "rhs": "0", "tol": 0.0}]


def _slips(spark, root):
    w = _wide(spark, root).where("workers is not null and horsepower is not null and total is not null")
    return w.select("row_id", *[F.round(F.col(c)).cast("bigint").alias(n) for c, n in (("workers", "a"), ("horsepower", "b"), ("total", "c"))])


@query("WITH " + WIDE_SQL + """, r AS (SELECT row_id, CAST(round(workers) AS BIGINT) AS a, CAST(round(horsepower) AS BIGINT) AS b, CAST(round(total) AS BIGINT) AS c FROM wide WHERE workers IS NOT NULL AND horsepower IS NOT NULL AND total IS NOT NULL),
 need AS (SELECT row_id, 'a' AS variable, a AS old, c - b AS new FROM r WHERE a + b <> c UNION ALL SELECT row_id, 'b', b, c - a FROM r WHERE a + b <> c UNION ALL SELECT row_id, 'c', c, a + b FROM r WHERE a + b <> c)
 SELECT row_id, variable, CAST(old AS VARCHAR) AS old, CAST(new AS VARCHAR) AS new FROM need WHERE new >= 0 AND levenshtein(CAST(old AS VARCHAR), CAST(new AS VARCHAR)) = 1""")
def single_digit_repairs(spark, root):
    e = rules.single_edits(_slips(spark, root), REPAIR, ["row_id"], ["a", "b", "c"])
    return e.where("fixed = 2 and broken = 0").select("row_id", "variable", "old", "new")


@query()
def fewest_edits(spark, root):
    """The fewest one-digit edits that satisfy all rules; a bounded search per row."""
    return rules.fewest_edits(_slips(spark, root), REPAIR, ["row_id"], ["a", "b", "c"])


@query()
def batch_clean(spark, root):
    """The audit of repeated repairs."""
    return rules.batch_clean(_slips(spark, root), REPAIR, ["row_id"], ["a", "b", "c"])[1]


@query("""SELECT o_orderkey, CASE WHEN d10 THEN 'factor' WHEN levenshtein(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) = 1 THEN 'one character' WHEN a <> b AND (a - b) % 9 = 0 THEN 'transposed' END AS hint FROM (
  SELECT o_orderkey, o_orderkey AS a, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey * 10 WHEN 1 THEN o_orderkey + 9 WHEN 2 THEN o_orderkey + 100 ELSE o_orderkey + 27 END AS b, o_orderkey <> 0 AND (o_orderkey % 4 = 0 OR (o_orderkey % 4 = 1 AND o_orderkey + 9 IN (o_orderkey * 10, o_orderkey * 100)) OR (o_orderkey % 4 = 2 AND o_orderkey + 100 IN (o_orderkey * 10, o_orderkey * 100, o_orderkey * 1000)) OR (o_orderkey % 4 = 3 AND o_orderkey + 27 IN (o_orderkey * 10, o_orderkey * 100))) AS d10 FROM orders)""")
def difference_hints(spark, root):
    o = table(spark, root, "orders").select("o_orderkey")
    a = F.col("o_orderkey").cast("double")
    m = F.col("o_orderkey") % 4
    b = F.when(m == 0, a * 10).when(m == 1, a + 9).when(m == 2, a + 100).otherwise(a + 27)
    return o.select("o_orderkey", numbers.difference_hint(a, b).alias("hint"))


@query("""WITH a AS (SELECT DISTINCT l_linenumber AS element, l_suppkey AS p FROM lineitem), c AS (SELECT element, p, CASE WHEN element <> 3 OR p < 40 THEN p * 7 % 4 WHEN p = 40 THEN 9 ELSE (p - 1) * 7 % 4 END AS n FROM a),
 m AS (SELECT p, n AS m FROM (SELECT p, n, count(*) AS k FROM c GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY p ORDER BY k DESC, n) = 1), j AS (SELECT element, p, (n <> m)::INT AS bad, coalesce((lead(n) OVER (PARTITION BY element ORDER BY p) <> m)::INT, 1) AS after FROM c JOIN m USING (p)),
 t AS (SELECT element, p, sum(bad) OVER (PARTITION BY element) AS now, coalesce(sum(bad) OVER (PARTITION BY element ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(after) OVER (PARTITION BY element ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cost FROM j)
 SELECT element, CAST(p AS INTEGER) AS best_position FROM t WHERE cost < now QUALIFY row_number() OVER (PARTITION BY element ORDER BY cost, p) = 1""")
def crawl(spark, root):
    """Line counts of the columns of a page, of which one has a line too many in the middle: taking that out makes it fit the others."""
    at = table(spark, root, "lineitem").select(F.col("l_linenumber").cast("int").alias("element"), F.col("l_suppkey").alias("p")).distinct()
    usual = lambda p: p * 7 % 4
    p = F.col("p")
    n = F.when((F.col("element") != 3) | (p < 40), usual(p)).when(p == 40, 9).otherwise(usual(p - 1))
    return rules.crawl_shift(at.withColumn("n", n), ["element"], "p", "n").select("element", F.col("best_position").cast("int").alias("best_position"))
