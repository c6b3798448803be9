"""Queries of the core operators for problems 1 and 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import history, nested
from ledgerloom.runtime import table


def p1_found(spark, root):
    return history.versions(table(spark, root, "slices"), table(spark, root, "edges"))


def p1_history(spark, root):
    """The versions with their content; attrs as one text of sorted entries."""
    h = history.history(table(spark, root, "slices"), table(spark, root, "edges"))
    entries = F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return h.select("entity_id", "valid_from", "valid_to", "name", "parent", F.array_join(entries, "|").alias("attrs"))


def p3_found(spark, root):
    return nested.flat_parts(table(spark, root, "page_docs"))


def _p3_table(kind: str, *columns: str):
    def run(spark, root):
        return nested.subtype(nested.shred(table(spark, root, "page_docs"), content=True), kind).select("save_id", "shape_idx", *columns)

    return run


p3_boxes = _p3_table("shape", "project", "stem", "variant", "group_id", "label", "human")
p3_points = _p3_table("point", "item_path", "variant", "x", "y")
p3_rows = _p3_table("row", "item_path", "variant", "y0", "y1", "text", "entity")
p3_candidates = _p3_table("candidate", "item_path", "parent_path", "variant", "score", "entity")
p3_names = _p3_table("other_name", "item_path", "variant", "name", "lang")


def p3_variants(spark, root):
    """Every subtype table the documents hold, by kind and structural variant, with its rows."""
    tables = nested.subtype_tables(table(spark, root, "page_docs"))
    out = spark.createDataFrame([], "kind string, variant string, n bigint")
    for (kind, variant), t in tables.items():
        out = out.unionByName(t.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(variant).alias("variant"), "n"))
    return out


BARE = "lower(regexp_replace(v, '[\\s\\x{00A0}\\x{2009}\\x{202F}]+', '', 'g'))"
#: The versions of firms by plain windows: what a firm states is compared with what it stated last.
P1_SQL = f"""WITH RECURSIVE d AS (SELECT from_id AS id, arg_max(to_id, ts) AS nxt FROM edges WHERE type = 'duplicate_of' AND from_id <> to_id GROUP BY 1), c AS (SELECT id, nxt AS canonical, 1 AS k FROM d UNION ALL SELECT c.id, d.nxt, k + 1 FROM c JOIN d ON c.canonical = d.id WHERE k < 50),
 m AS (SELECT id, canonical FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1),
 l AS (SELECT coalesce(m.canonical, s.entity_id) AS e, as_of, name, parent, attrs FROM slices s LEFT JOIN m ON s.entity_id = m.id QUALIFY row_number() OVER (PARTITION BY coalesce(m.canonical, s.entity_id), as_of ORDER BY recorded_at DESC) = 1),
 f AS (SELECT e, as_of, 'name' AS k, name AS v FROM l UNION ALL SELECT e, as_of, 'parent', parent FROM l UNION ALL SELECT e, as_of, 'attr ' || k, attrs[k] FROM l, unnest(map_keys(attrs)) t(k)),
 b AS (SELECT e, as_of, k, {BARE} AS v FROM f WHERE v IS NOT NULL),
 n AS (SELECT e, as_of, k, CASE WHEN regexp_matches(v, '^[0-9]{{1,3}}([.,][0-9]{{3}})+$') THEN regexp_replace(v, '[.,]', '', 'g') WHEN regexp_matches(v, '^[0-9]+[.,]0+$') THEN regexp_replace(v, '[.,]0+$', '') ELSE v END AS v FROM b WHERE v <> '' UNION ALL SELECT e, as_of, 'seen', '' FROM l),
 w AS (SELECT *, lag(v) OVER (PARTITION BY e, k ORDER BY as_of) AS was FROM n),
 g AS (SELECT DISTINCT e, as_of FROM w WHERE (k = 'seen' AND was IS NULL) OR was <> v),
 x AS (SELECT coalesce(m.canonical, from_id) AS e, as_of AS y FROM edges LEFT JOIN m ON from_id = m.id WHERE type IN ('rename', 'merger', 'legal_form', 'successor') AND as_of IS NOT NULL)
 SELECT e AS entity_id, as_of AS valid_from, coalesce(lead(as_of) OVER (PARTITION BY e ORDER BY as_of), (SELECT min(y) FROM x WHERE x.e = g.e AND y >= g.as_of), 9999)::INTEGER AS valid_to FROM g"""

#: What was last stated of each field before the next version began.
P1_HISTORY = P1_SQL.split(" SELECT e AS entity_id")[0] + """, sp AS (SELECT e, as_of AS vf, lead(as_of) OVER (PARTITION BY e ORDER BY as_of) AS nx, coalesce(lead(as_of) OVER (PARTITION BY e ORDER BY as_of), (SELECT min(y) FROM x WHERE x.e = g.e AND y >= g.as_of), 9999)::INTEGER AS vt FROM g),
 ct AS (SELECT sp.e, vf, k, arg_max(v, f.as_of) AS v FROM sp JOIN f ON f.e = sp.e AND (nx IS NULL OR f.as_of < nx) WHERE trim(v) <> '' GROUP BY 1, 2, 3)
 SELECT sp.e AS entity_id, sp.vf AS valid_from, vt AS valid_to, max(v) FILTER (k = 'name') AS name, max(v) FILTER (k = 'parent') AS parent, coalesce(string_agg(k[6:] || '=' || v, '|' ORDER BY k) FILTER (starts_with(k, 'attr ')), '') AS attrs FROM sp LEFT JOIN ct ON ct.e = sp.e AND ct.vf = sp.vf GROUP BY 1, 2, 3"""

#: The parts of pages by DuckDB's JSON functions, for the forms the test tables have.
P3_WITH = """WITH v AS (SELECT save_id, project, stem, saved_at, doc::JSON AS d FROM (SELECT * FROM page_docs WHERE json_valid(doc)) QUALIFY row_number() OVER (PARTITION BY project, stem ORDER BY saved_at DESC, save_id DESC) = 1),
 o AS (SELECT save_id, CASE WHEN json_type(d) = 'ARRAY' THEN d->0 ELSE d END AS d FROM v), p AS (SELECT save_id, CASE WHEN json_type(d, '$.page') = 'OBJECT' THEN d->'page' ELSE d END AS d FROM o),
 l AS (SELECT save_id, from_json(d->'shapes', '["JSON"]') AS l FROM p WHERE json_type(d, '$.shapes') = 'ARRAY'), s AS (SELECT save_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM l),
 b AS (SELECT save_id, i, s, coalesce(CASE WHEN TRY_CAST(s->>'group_id' AS DOUBLE) = floor(TRY_CAST(s->>'group_id' AS DOUBLE)) THEN TRY_CAST(TRY_CAST(s->>'group_id' AS DOUBLE) AS BIGINT) END, -1) AS group_id, coalesce(s->>'label', '') AS label,
   CASE WHEN json_type(s, '$.row_struct') = 'VARCHAR' THEN (s->>'row_struct')::JSON ELSE s->'row_struct' END AS rs, s->'structured'->'data'->'other_names' AS n FROM s WHERE json_type(s) = 'OBJECT'),
 pt AS (SELECT *, from_json(s->'points', '["JSON"]') AS l FROM b WHERE json_type(s, '$.points') = 'ARRAY'),
 pc AS (SELECT *, CASE WHEN json_type(l[1]) IN ('ARRAY', 'OBJECT') THEN len(l) ELSE len(l) // 2 END AS c FROM pt),
 rl AS (SELECT *, from_json(CASE json_type(rs) WHEN 'OBJECT' THEN rs->'rows' ELSE rs END, '["JSON"]') AS l FROM b WHERE json_type(CASE json_type(rs) WHEN 'OBJECT' THEN rs->'rows' ELSE rs END) = 'ARRAY'),
 rw AS (SELECT *, unnest(l) AS r, generate_subscripts(l, 1) - 1 AS k FROM rl),
 cl AS (SELECT *, from_json(r->'authority'->'candidates', '["JSON"]') AS cs FROM rw WHERE json_type(r, '$.authority.candidates') = 'ARRAY'), cd AS (SELECT *, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS j FROM cl),
 nl AS (SELECT *, CASE json_type(n) WHEN 'ARRAY' THEN from_json(n, '["JSON"]') ELSE [n] END AS l FROM b WHERE json_type(n) IN ('ARRAY', 'OBJECT', 'VARCHAR')), nm AS (SELECT *, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS k FROM nl)"""
P3_SQL = P3_WITH + """ SELECT save_id, CAST(i AS INTEGER) AS shape_idx, kind, item_path, group_id, label FROM (
  SELECT save_id, i, 'shape' AS kind, '' AS item_path, group_id, label FROM b UNION ALL SELECT save_id, i, 'point', CAST(unnest(range(c)) AS VARCHAR), group_id, label FROM pc
  UNION ALL SELECT save_id, i, 'row', CAST(k AS VARCHAR), group_id, label FROM rw WHERE json_type(r) <> 'NULL' UNION ALL SELECT save_id, i, 'candidate', k || '.' || j, group_id, label FROM cd WHERE json_type(c) <> 'NULL'
  UNION ALL SELECT save_id, i, 'other_name', CAST(k AS VARCHAR), group_id, label FROM nm WHERE json_type(x) <> 'NULL')"""
def _number(c: str) -> str:
    return f"TRY_CAST(replace(trim({c}), ',', '.') AS DOUBLE)"


FLAT = "json_type(l[1]) NOT IN ('ARRAY', 'OBJECT')"
P3_BOXES = P3_WITH + f""" SELECT save_id, CAST(i AS INTEGER) AS shape_idx, project, stem, CASE json_type(s, '$.points') WHEN 'ARRAY' THEN CASE WHEN len(l) = 0 THEN 'empty_list' WHEN {FLAT} AND len(l) = 2 THEN 'pair' WHEN {FLAT} THEN 'flat_numbers' ELSE 'points' END ELSE 'null' END AS variant,
  group_id, label, s->'human_output'->>'human_corrected_text' AS human FROM (SELECT *, from_json(CASE json_type(s, '$.points') WHEN 'ARRAY' THEN s->'points' ELSE '[]'::JSON END, '["JSON"]') AS l FROM b) JOIN (SELECT save_id, project, stem FROM v) USING (save_id)"""
P3_POINTS = P3_WITH + f""" , pe AS (SELECT *, unnest(range(c)) AS k FROM pc), xy AS (SELECT *, CASE json_type(l[1]) WHEN 'ARRAY' THEN l[k + 1]->>0 WHEN 'OBJECT' THEN l[k + 1]->>'x' ELSE l[2 * k + 1]->>'$' END AS x0, CASE json_type(l[1]) WHEN 'ARRAY' THEN l[k + 1]->>1 WHEN 'OBJECT' THEN l[k + 1]->>'y' ELSE l[2 * k + 2]->>'$' END AS y0 FROM pe)
 SELECT save_id, CAST(i AS INTEGER) AS shape_idx, CAST(k AS VARCHAR) AS item_path, CASE json_type(l[1]) WHEN 'ARRAY' THEN 'pair' WHEN 'OBJECT' THEN 'corner' ELSE CASE len(l) WHEN 2 THEN 'pair_alone' ELSE 'flat' END END AS variant, {_number('x0')} AS x, {_number('y0')} AS y FROM xy"""
P3_ROWS = P3_WITH + f""" SELECT save_id, CAST(i AS INTEGER) AS shape_idx, CAST(k AS VARCHAR) AS item_path, CASE json_type(rs) WHEN 'OBJECT' THEN 'in_object' ELSE 'bare_list' END AS variant, {_number("r->>'y0'")} AS y0, {_number("r->>'y1'")} AS y1,
  coalesce(CASE WHEN trim(r->>'human') <> '' THEN r->>'human' END, CASE WHEN trim(r->>'llm') <> '' THEN r->>'llm' END, CASE WHEN trim(r->>'ocr') <> '' THEN r->>'ocr' END) AS text, r->'authority'->>'id' AS entity FROM rw WHERE json_type(r) <> 'NULL'"""
P3_CANDIDATES = P3_WITH + f""" SELECT save_id, CAST(i AS INTEGER) AS shape_idx, k || '.' || j AS item_path, CAST(k AS VARCHAR) AS parent_path, CASE WHEN {_number("c->>'score'")} IS NOT NULL THEN 'candidate_scored' ELSE 'candidate' END AS variant, {_number("c->>'score'")} AS score, c->>'id' AS entity FROM cd WHERE json_type(c) <> 'NULL'"""
P3_NAMES = P3_WITH + """ SELECT save_id, CAST(i AS INTEGER) AS shape_idx, CAST(k AS VARCHAR) AS item_path, CASE json_type(x) WHEN 'OBJECT' THEN CASE WHEN json_exists(x, '$.lang') THEN 'name_with_language' ELSE 'name' END ELSE 'word' END AS variant,
  CASE json_type(x) WHEN 'OBJECT' THEN x->>'name' ELSE x->>'$' END AS name, CASE json_type(x) WHEN 'OBJECT' THEN x->>'lang' END AS lang FROM nm WHERE json_type(x) <> 'NULL'"""

P3_VARIANTS = " UNION ALL ".join(f"SELECT '{kind}' AS kind, variant, count(*) AS n FROM ({sql}) GROUP BY variant" for kind, sql in (("shape", P3_BOXES), ("point", P3_POINTS), ("row", P3_ROWS), ("candidate", P3_CANDIDATES), ("other_name", P3_NAMES)))

ORACLE = {"p1_found": P1_SQL, "p1_history": P1_HISTORY, "p3_found": P3_SQL, "p3_variants": P3_VARIANTS, "p3_boxes": P3_BOXES, "p3_points": P3_POINTS, "p3_rows": P3_ROWS, "p3_candidates": P3_CANDIDATES, "p3_names": P3_NAMES}
QUERIES = {"p1_found": p1_found, "p1_history": p1_history, "p3_found": p3_found, "p3_variants": p3_variants, "p3_boxes": p3_boxes, "p3_points": p3_points, "p3_rows": p3_rows, "p3_candidates": p3_candidates, "p3_names": p3_names}
