"""History of changing entity attributes, built from unordered yearly snapshots by Merkle comparison.

A snapshot is what was delivered for one `as_of`; what a delivery leaves unstated keeps its last value. Entities fall into
hash buckets, which are the leaves of a 16-ary tree over each snapshot. The hash of a leaf is the exclusive or of the hashes
of what its entities state, that of an inner node the exclusive or of its children's. Each node is compared with itself in
the snapshot it was last delivered in. The comparison starts at the roots and goes down only where hashes differ; only rows
of leaves that differ are taken apart into fields and compared. A leaf that is equal states again what it stated last, so
leaving it out loses no change and no last value.

Edge cases, all defined: rows without entity or as_of are left out; of rows with one entity and as_of and the
same recorded_at the one with the greater content hash counts; a null recorded_at is older than any other;
null maps state nothing; extra columns are ignored; empty tables give an empty result; a chain of
duplicate_of edges that runs in a circle stands for the smallest id on it; of several duplicate_of edges of
one id the one recorded last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerloom.runtime import cut

#: Edges that end the history of the firm they come from.
ENDING = ("rename", "merger", "legal_form", "successor")
OPEN_END = 9999
#: A node has 16 children; leaves are as many as leave about PER_LEAF entities to each.
FANOUT_BITS, PER_LEAF = 4, 32
#: A field that every delivery states; its first statement opens the history.
SEEN = "\x00seen"
BLANKS = r"[\s\p{Z}\x{200B}\x{FEFF}]+"


def comparable(value: Column) -> Column:
    """One form for values that differ in case, blanks or the way a number is written."""
    bare = F.lower(F.regexp_replace(value, BLANKS, ""))
    grouped = bare.rlike(r"^[+-]?\d{1,3}([.,'’]\d{3})+([.,]\d{1,2})?$")
    plain = bare.rlike(r"^[+-]?\d+([.,]\d+)?$")
    fraction = F.regexp_extract(bare, r"[.,](\d{1,2})$", 1)
    whole = F.regexp_replace(F.when(fraction != "", F.regexp_replace(bare, r"[.,]\d{1,2}$", "")).otherwise(bare), r"[.,'’]", "")
    tail = F.regexp_replace(fraction, "0+$", "")
    as_grouped = F.concat(F.regexp_replace(whole, r"^\+?0*(?=\d)", ""), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""))
    dotted = F.regexp_replace(bare, ",", ".")
    as_plain = F.regexp_replace(F.regexp_replace(dotted, r"^\+?0*(?=\d)", ""), r"(\.\d*?)0+$", "$1")
    as_plain = F.regexp_replace(as_plain, r"\.$", "")
    return F.when(grouped, as_grouped).when(plain, as_plain).otherwise(bare)


def _pointers(edges: DataFrame, kind: str) -> tuple[DataFrame, bool]:
    """((id, to, least) with `to` as far along the chain as it goes, whether what is left runs in circles).

    Pointer doubling: after round r every pointer spans 2^r edges, so a chain of n edges takes log2(n) joins of
    the edge list with itself. Each pointer carries the least id it has passed, which names circles.
    """
    one = (
        edges.where((F.col("type") == kind) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & (F.col("from_id") != F.col("to_id")))
        .groupBy(F.col("from_id").alias("id"))
        .agg(F.max_by("to_id", F.struct("ts", "to_id")).alias("to"))
    )
    hop = cut(one.select("id", "to", F.least("id", "to").alias("least")))
    rounds = max(1, hop.count()).bit_length() + 1
    for _ in range(rounds):
        nxt = hop.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        if nxt.join(hop, "to", "left_semi").limit(1).count() == 0:
            return hop, False
        hop = cut(hop.join(nxt, "to", "left").select("id", F.coalesce("to2", "to").alias("to"), F.least("least", "least2").alias("least")))
    return hop, True


def canonical_ids(edges: DataFrame, kind: str = "duplicate_of") -> DataFrame:
    """(id, canonical): the end of the chain of `kind` edges of every id that has one; a circle stands for its least id."""
    hop, round_ = _pointers(edges, kind)
    if not round_:
        return hop.select("id", F.col("to").alias("canonical"))
    circle = hop.select(F.col("id").alias("to"), F.col("least").alias("circle"))
    return hop.join(circle, "to", "left").select("id", F.coalesce("circle", "to").alias("canonical"))


def circles(edges: DataFrame, kind: str = "duplicate_of") -> DataFrame:
    """(id, circle): the ids whose chain of `kind` edges comes back to them, with the least id of their circle.

    A pointer that has gone farther than any chain is long stands on a circle, and all places of a circle are stood on.
    """
    hop, round_ = _pointers(edges, kind)
    on = hop.select(F.col("to").alias("id")).distinct()
    out = hop.join(on, "id", "left_semi").select("id", F.col("least").alias("circle"))
    return out if round_ else out.limit(0)


def _fold(rows: DataFrame, canon: DataFrame, key: str) -> DataFrame:
    c = canon.select(F.col("id").alias(key), F.col("canonical").alias("__canon"))
    return rows.join(c, key, "left").withColumn(key, F.coalesce("__canon", key)).drop("__canon")


def _states(slices: DataFrame, canon: DataFrame) -> DataFrame:
    """One row per entity and as_of with the stated fields as a map, the one recorded last."""
    attrs = F.coalesce(F.col("attrs"), F.create_map().cast("map<string,string>"))
    fields = F.map_filter(
        F.map_concat(
            F.create_map(F.lit("\x00name"), F.col("name"), F.lit("\x00parent"), F.col("parent")), attrs
        ),
        lambda k, v: v.rlike(r"[^\s\p{Z}\x{200B}\x{FEFF}]"),
    )
    base = slices.where(F.col("entity_id").isNotNull() & F.col("as_of").isNotNull()).select("entity_id", "as_of", "recorded_at", fields.alias("f"))
    # The order of the entries of a map says nothing; sorted, equal deliveries are equal bytes.
    base = base.withColumn("f", F.array_sort(F.map_entries("f")))

    def last(df: DataFrame) -> DataFrame:
        rank = F.struct("recorded_at", F.xxhash64("f"))
        return df.groupBy("entity_id", "as_of").agg(F.max_by(F.struct("f", "recorded_at"), rank).alias("s")).select("entity_id", "as_of", "s.f", "s.recorded_at")

    # The first grouping bounds every id to one row a year before ids are joined; a hot id then can't skew the join.
    return last(_fold(last(base), canon, "entity_id")).select("entity_id", "as_of", "f")


def levels_for(entities: int) -> int:
    """Levels of the tree below its root that bring a leaf to PER_LEAF entities or fewer on average."""
    return max(1, -(-max(1, entities // PER_LEAF).bit_length() // FANOUT_BITS))


def leaf_of(entity: str, levels: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(entity), 64 - levels * FANOUT_BITS).cast("bigint")


def merkle_changes(rows: DataFrame, levels: int) -> DataFrame:
    """The (as_of, leaf) whose hash differs from that of the leaf in the snapshot it was last delivered in.

    `rows` has as_of, leaf and `h`, the hash of what an entity states. Only node hashes are shuffled, summed up before it.
    """
    level = rows.groupBy("as_of", "leaf").agg(F.bit_xor("h").alias("h"))
    tree = [level]
    for _ in range(levels):
        level = level.groupBy("as_of", F.shiftright("leaf", FANOUT_BITS).alias("leaf")).agg(F.bit_xor("h").alias("h"))
        tree.append(level)
    before = F.lag("h").over(W.partitionBy("leaf").orderBy("as_of"))
    differing = None
    for nodes in reversed(tree):
        differs = nodes.withColumn("was", before).where(F.col("was").isNull() | (F.col("was") != F.col("h"))).select("as_of", "leaf")
        if differing is not None:
            up = differing.withColumnRenamed("leaf", "up")
            differs = differs.withColumn("up", F.shiftright("leaf", FANOUT_BITS)).join(up, ["as_of", "up"], "left_semi").drop("up")
        differing = differs
    return differing


def changed_fields(states: DataFrame, levels: int) -> DataFrame:
    """(entity_id, as_of, key, value, was, ...): the fields of the rows in leaves that differ, each with what was last stated before."""
    placed = states.withColumn("leaf", leaf_of("entity_id", levels))
    differing = merkle_changes(placed.select("as_of", "leaf", "h"), levels)
    seen = F.array(F.struct(F.lit(SEEN).alias("key"), *[F.lit("").alias(c) for c in states.schema["f"].dataType.elementType.names[1:]]))
    rows = placed.join(differing, ["as_of", "leaf"], "left_semi").select("entity_id", "as_of", F.explode(F.concat("f", seen)).alias("e")).select("entity_id", "as_of", "e.*")
    return rows.withColumn("was", F.lag("value").over(W.partitionBy("entity_id", "key").orderBy("as_of")))


def _begun(fields: DataFrame) -> DataFrame:
    opens = (F.col("key") == SEEN) & F.col("was").isNull()
    return fields.where(opens | (F.col("was") != F.col("value"))).select("entity_id", F.col("as_of").alias("valid_from")).distinct()


def _ended(begins: DataFrame, edges: DataFrame, canon: DataFrame) -> DataFrame:
    ends = (
        _fold(edges.where(F.col("type").isin(*ENDING) & F.col("as_of").isNotNull()).select(F.col("from_id").alias("entity_id"), "as_of"), canon, "entity_id")
        .groupBy("entity_id")
        .agg(F.array_sort(F.collect_set("as_of")).alias("ends"))
    )
    following = F.lead("valid_from").over(W.partitionBy("entity_id").orderBy("valid_from"))
    out = begins.withColumn("nxt", following).join(ends, "entity_id", "left")
    end = F.try_element_at(F.filter("ends", lambda y: y >= F.col("valid_from")), F.lit(1))
    return out.select("entity_id", F.col("valid_from").cast("int"), F.coalesce("nxt", end, F.lit(OPEN_END)).cast("int").alias("valid_to"))


def _snapshots(slices: DataFrame, edges: DataFrame, raw: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """(canonical ids, (entity_id, as_of, f, h) of every delivery that counts, levels of the tree): f has the stated fields in comparable form, `raw` as stated too."""
    canon = cut(canonical_ids(edges))
    entries = F.transform("f", lambda e: F.struct(e["key"].alias("key"), comparable(e["value"]).alias("value"), *([e["value"].alias("raw")] if raw else [])))
    states = _states(slices, canon).select("entity_id", "as_of", entries.alias("f"))
    content = F.transform("f", lambda e: F.struct(e["key"], e["value"])) if raw else F.col("f")
    # Written once: the tree and the rows of its differing leaves both come from it.
    states = cut(states.withColumn("h", F.xxhash64("entity_id", content)))
    return canon, states, levels_for(states.agg(F.approx_count_distinct("entity_id")).first()[0])


def versions(slices: DataFrame, edges: DataFrame, levels: int | None = None) -> DataFrame:
    """(entity_id, valid_from, valid_to): the periods in which the attributes of an entity held."""
    canon, states, least = _snapshots(slices, edges)
    return _ended(_begun(changed_fields(states, levels or least)), edges, canon)


def history(slices: DataFrame, edges: DataFrame, levels: int | None = None) -> DataFrame:
    """(entity_id, valid_from, valid_to, name, parent, attrs): `versions` with what was last stated of each field by the end of the version."""
    canon, states, least = _snapshots(slices, edges, raw=True)
    fields = cut(changed_fields(states, levels or least))
    spans = cut(_ended(_begun(fields), edges, canon))
    # Every statement belongs to the last version that had begun; an ordered union carries the version's beginning to it.
    at = spans.select("entity_id", F.col("valid_from").alias("as_of"), "valid_from", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("raw"))
    said = fields.where(F.col("key") != SEEN).select("entity_id", "as_of", F.lit(None).cast("int").alias("valid_from"), "key", "raw")
    order = W.partitionBy("entity_id").orderBy("as_of", F.col("valid_from").isNull())
    filled = at.unionByName(said).withColumn("valid_from", F.last("valid_from", True).over(order)).where("key is not null")
    last = filled.groupBy("entity_id", "valid_from", "key").agg(F.max_by("raw", "as_of").alias("raw")).groupBy("entity_id", "valid_from").agg(F.map_from_entries(F.collect_list(F.struct("key", "raw"))).alias("m"))
    none = F.create_map().cast("map<string,string>")
    upto = spans.join(last, ["entity_id", "valid_from"], "left").withColumn("ms", F.collect_list(F.coalesce("m", none)).over(W.partitionBy("entity_id").orderBy("valid_from")))
    merged = F.aggregate("ms", none, lambda s, m: F.map_concat(F.map_filter(s, lambda k, _: ~F.map_contains_key(m, k)), m))
    out = upto.select("entity_id", "valid_from", "valid_to", merged.alias("m"))
    attrs = F.map_filter("m", lambda k, _: ~k.isin("\x00name", "\x00parent"))
    return out.select("entity_id", "valid_from", "valid_to", F.try_element_at("m", F.lit("\x00name")).alias("name"), F.try_element_at("m", F.lit("\x00parent")).alias("parent"), attrs.alias("attrs"))
