"""Heads of records: what a record says of its entity, what it is looked up by, briefs and verdicts of judges, and views of the entity table.

Texts that are null or blank say nothing. Columns of a record are name, name_hu, name_de, other_names (name, lang) and those of FACTS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import filled, fold

# The facts a slice keeps, those an entity keeps, and those a candidate is briefed by.
FACTS = "seat county founded charter_until legal_form capital_nominal capital_paid_in currency address serial_no name_de notes court".split()
LASTING = "legal_form founded seat court".split()
BRIEFED = "seat founded legal_form county".split()
# What a judge may say, the kinds of edges, and from which probability an answer counts.
VERDICTS, EDGES = ("same", "successor", "new", "unsure"), ("rename", "merger", "split", "legal_form", "successor")
CERTAIN, EVEN = 0.85, 0.5


def queries_of(records: DataFrame, key: str) -> DataFrame:
    """(key, pos, query, lang): what a record is looked up by: its Hungarian name, its German one, others, or its own text where it has none of these."""
    q = lambda name, lang: F.struct(filled(name).alias("query"), lang.alias("lang"))
    others = F.transform(F.coalesce("other_names", F.array().cast("array<struct<name:string,lang:string>>")), lambda o: q(o["name"], o["lang"]))
    named = F.filter(F.concat(F.array(q(F.col("name_hu"), F.lit("hu")), q(F.col("name_de"), F.lit("de"))), others), lambda x: x["query"].isNotNull())
    own = F.filter(F.array(q(F.trim(F.col("name")), F.lit(None).cast("string"))), lambda x: x["query"].isNotNull())
    return records.select(key, F.posexplode(F.when(F.size(named) > 0, named).otherwise(own)).alias("pos", "q")).select(key, "pos", "q.query", "q.lang")


def display_name() -> Column:
    """The first name a record has: Hungarian, German, any other, its own text."""
    other = F.get(F.filter(F.transform(F.coalesce("other_names", F.array().cast("array<struct<name:string,lang:string>>")), lambda o: filled(o["name"])), lambda x: x.isNotNull()), 0)
    return F.trim(F.coalesce(filled(F.col("name_hu")), filled(F.col("name_de")), other, filled(F.col("name")), F.lit("")))


def aliases_of(records: DataFrame, key: str, source: str) -> DataFrame:
    """(key, name, lang, source): the names of a record as aliases; its own text is none."""
    return queries_of(records.withColumn("name", F.lit(None).cast("string")), key).select(key, F.col("query").alias("name"), "lang", F.lit(source).alias("source"))


def stated(names: list[str]) -> Column:
    """A map of those columns that say something."""
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), filled(F.col(n).cast("string")).alias("v")) for n in names])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def slices_of(records: DataFrame, key: str, facts: list[str] = FACTS) -> DataFrame:
    """(key, as_of, source, name, attrs, event_date, event, seq): the slice a resolution writes; its number is the record's, else that of its register position, else its key."""
    seq = F.coalesce("serial_no", "sub", F.col(key))
    return records.select(key, "as_of", F.col("project").alias("source"), F.nullif(display_name(), F.lit("")).alias("name"), stated(facts).alias("attrs"), filled(F.col("event_date")).alias("event_date"), filled(F.col("event_type")).alias("event"), seq.alias("seq"))


def briefs(candidates: DataFrame) -> DataFrame:
    """`candidates` with brief: the name and what is known of a candidate in one line, at most four of its aliases."""
    also = F.when(F.size("aliases") > 0, F.concat(F.lit("also "), F.array_join(F.slice("aliases", 1, 4), " / ")))
    known = [F.concat(F.lit(f"{c} "), filled(F.col(c).cast("string"))) for c in ("seat", "county", "founded", "legal_form", "seen_in")]
    return candidates.withColumn("brief", F.concat_ws("; ", filled(F.col("name")), also, *known))


def answered(choice: Column, probability: Column, successor: Column, threshold: float = CERTAIN) -> Column:
    """(verdict, entity, confidence, reason) of a judge who chose a candidate or 'none': below the threshold it only leans to it."""
    p = F.coalesce(probability, F.lit(0.0))
    sure, none = p >= threshold, choice == "none"
    kind = F.when(F.coalesce(successor, F.lit(0.0)) >= EVEN, "successor").otherwise("same")
    verdict = F.when(choice.isNull() | ~sure, "unsure").when(none, "new").otherwise(kind)
    reason = F.when(choice.isNull(), "no answer").when(none & sure, "none of the candidates").when(none, "leaning to none").when(sure, F.concat(choice, F.lit(" is "), kind)).otherwise(F.concat(F.lit("leaning to "), choice))
    return F.struct(verdict.alias("verdict"), F.when(~none, choice).alias("entity"), F.round(F.when(choice.isNotNull(), p).otherwise(0.0), 3).alias("confidence"), reason.alias("reason"))


def judged(verdict: Column, entity: Column, edge: Column, confidence: Column, candidates: Column) -> Column:
    """(verdict, entity, edge, confidence) of a written answer, held against the candidates: what is not among the choices counts as unsure or null."""
    known = F.when(F.array_contains(candidates, entity), entity)
    v = F.when(verdict.isin(*VERDICTS), verdict).otherwise("unsure")
    v = F.when(v.isin("same", "successor") & known.isNull(), "unsure").otherwise(v)
    c = F.coalesce(confidence.try_cast("double"), F.lit(0.0))
    return F.struct(v.alias("verdict"), known.alias("entity"), F.when((v == "successor") & edge.isin(*EDGES), edge).alias("edge"), F.round(F.least(F.greatest(F.when(F.isnan(c), 0.0).otherwise(c), F.lit(0.0)), F.lit(1.0)), 3).alias("confidence"))


def ordered_projects(projects: DataFrame) -> DataFrame:
    """`projects` (name, year) with place: by year, those without one last, then by name. There are as many rows as projects."""
    return projects.withColumn("place", F.row_number().over(W.orderBy(F.col("year").asc_nulls_last(), "name")))


def filtered(rows: DataFrame, query: str | None = None, mode: str | None = None, columns: int = 0) -> DataFrame:
    """Rows of the entity table (id, name, aliases, merged, edges, cells) by text and by mode.

    A text is sought in names and aliases, or is an id. Modes: missing (fewer cells than columns), chain (has edges), dup (merged, or has a
    duplicate_of edge), single (one cell). `edges` has the types of an entity's edges, `cells` the projects that list it.
    """
    if query:
        q = fold(F.lit(query))
        holds = F.contains(fold(F.col("name")), q) | F.exists("aliases", lambda a: F.contains(fold(a), q))
        rows = rows.where(F.coalesce(holds, F.lit(False)) | (fold(F.col("id")) == q) | F.exists("merged", lambda m: fold(m) == q))
    n = F.size("cells")
    by = {None: F.lit(True), "missing": n < columns, "chain": F.size("edges") > 0, "dup": (F.size("merged") > 0) | F.array_contains("edges", "duplicate_of"), "single": n == 1}
    if mode not in by:
        raise ValueError(f"no such mode: {mode!r}")
    return rows.where(by[mode])


def entity_rows(entities: DataFrame, aliases: DataFrame, edges: DataFrame, slices: DataFrame, canonical: DataFrame) -> DataFrame:
    """(id, name, aliases, merged, edges, cells): one row for each entity that stands, with all that was folded into it.

    `canonical` is (id, canonical) of the folded ones; names of folded entities are aliases; the edges that fold them into it are no edges of its own.
    """
    c = canonical.select("id", "canonical")
    at = lambda d, col: d.join(c.withColumnRenamed("id", col), col, "left").withColumn("__c", F.coalesce("canonical", col)).drop("canonical")
    every = at(entities.select("id", "name"), "id")
    heads = every.where("id = __c").select("__c", F.col("name").alias("head"))
    merged = every.where("id <> __c").groupBy("__c").agg(F.sort_array(F.collect_set("id")).alias("merged"))
    said = every.where("id <> __c").select("__c", F.col("name").alias("alias")).unionByName(at(aliases.select(F.col("entity_id").alias("id"), F.col("name").alias("alias")), "id").select("__c", "alias"))
    called = said.join(heads, "__c").where("alias <> head").groupBy("__c").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id"), "type", "from_id", "to_id")
    both = at(at(at(ends, "id").withColumnRenamed("__c", "__at"), "from_id").withColumnRenamed("__c", "__f"), "to_id").withColumnRenamed("__c", "__t")
    linked = both.where("not (type = 'duplicate_of' and __f = __t)").groupBy(F.col("__at").alias("__c")).agg(F.sort_array(F.collect_set("type")).alias("edges"))
    listed = at(slices.select(F.col("entity_id").alias("id"), "project"), "id").groupBy("__c").agg(F.sort_array(F.collect_set("project")).alias("cells"))
    out = heads
    for d in (called, merged, linked, listed):
        out = out.join(d, "__c", "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("__c").alias("id"), F.col("head").alias("name"), *[F.coalesce(k, none).alias(k) for k in ("aliases", "merged", "edges", "cells")])


def merged_facts(entities: DataFrame, canonical: DataFrame) -> DataFrame:
    """(id, attrs): the facts of each entity that stands: its own, and where it says nothing those of the entities folded into it, the least id first."""
    e = entities.select("id", F.explode("attrs").alias("key", "value")).where(F.coalesce(F.trim("value"), F.lit("")) != "")
    j = e.join(canonical.select("id", "canonical"), "id", "left").withColumn("to", F.coalesce("canonical", "id"))
    first = j.groupBy("to", "key").agg(F.min_by("value", F.struct((F.col("id") != F.col("to")).alias("folded"), "id")).alias("value"))
    facts = first.groupBy(F.col("to").alias("id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("attrs"))
    stand = entities.select("id").join(canonical.select("id"), "id", "left_anti")
    return stand.join(facts, "id", "left").select("id", F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"))
