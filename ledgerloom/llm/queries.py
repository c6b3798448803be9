"""Queries of the operators of this subpackage and the SQL they equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.llm import canon_list, cutoff, firms, leakage, linkage, lookalikes, tokens
from ledgerloom.operators import nested
from ledgerloom.runtime import table


def _lists(spark, root):
    return [table(spark, root, t) for t in ("cells", "grid_columns", "entities", "aliases")]


def p2_found(spark, root):
    return canon_list.resolve(*_lists(spark, root))


def p2_unmatched(spark, root):
    return canon_list.unmatched(*_lists(spark, root))


def _values(spark, root):
    return lookalikes.values_of(table(spark, root, "identities"), nested.shred(table(spark, root, "page_docs")))


def p5_found(spark, root):
    return lookalikes.found(_values(spark, root))


def p5_plain(spark, root):
    return lookalikes.normalized(_values(spark, root))


def p4_found(spark, root):
    return p4_confidence(spark, root).select("record_id", "entry_id")


def p4_confidence(spark, root):
    return linkage.link(*[table(spark, root, t) for t in ("identities", "court_entries", "entities", "aliases")])


def p6_found(spark, root):
    return firms.variants(*[table(spark, root, t) for t in ("identities", "entities", "aliases")])


def p7_ids(spark, root):
    return tokens.encode(table(spark, root, "documents"))


def p8_found(spark, root):
    return leakage.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_scored(spark, root):
    return leakage.scored(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_found(spark, root):
    return cutoff.truncated(table(spark, root, "documents"))


def p9_sources(spark, root):
    return cutoff.by_source(table(spark, root, "documents"))


QUERIES = {"p2_found": p2_found, "p2_unmatched": p2_unmatched, "p5_found": p5_found, "p5_plain": p5_plain, "p4_found": p4_found, "p4_confidence": p4_confidence, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p8_scored": p8_scored, "p9_found": p9_found, "p9_sources": p9_sources}
ORACLE: dict[str, str] = {}
