"""Records resolved to shared entities: candidates, agreements, decisions, folds and the entity table.

Comparisons are three-valued: true, false, or null where a side says nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import fold
from ledgerloom.operators.history import canonical_ids

# What an agreement adds to a candidate's score.
BOOSTS = {"seat": 12.0, "founded": 10.0, "county": 4.0, "legal_form": 3.0, "court": 8.0}
BOOST_ISSUE, BOOST_KEY = 25.0, 40.0
# The tiers of a name's score, the gap to the runner-up, and how many candidates are kept.
SURE, GOOD, WEAK, MARGIN, FLOOR, TOP = 95.0, 85.0, 70.0, 5.0, 70.0, 8
# Words of a court's name that tell no court from another.
COURT_WORDS = "kiralyi kir k es v torvenyszek torvenyszeki torvenyszel torveny torv tvszk tszek tszk birosag a az kereskedelmi valto ker kerti".split()


def similarity(a: Column, b: Column) -> Column:
    """0 to 100 by edit distance over the longer text."""
    return F.when(F.greatest(F.length(a), F.length(b)) == 0, 0.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))))


def year(c: Column) -> Column:
    return F.left(F.trim(c.cast("string")), F.lit(4)).try_cast("int")


def years_agree(a: Column, b: Column) -> Column:
    return year(a) == year(b)


def seats_agree(a: Column, b: Column) -> Column:
    """Equal, one within the other, the same last word, or spelled nearly alike."""
    x, y = F.nullif(fold(a), F.lit("")), F.nullif(fold(b), F.lit(""))
    last = lambda c: F.element_at(F.split(c, " "), -1)
    return F.when(x.isNull() | y.isNull(), None).otherwise((x == y) | F.contains(x, y) | F.contains(y, x) | (last(x) == last(y)) | (similarity(x, y) >= 85))


def court_key(c: Column) -> Column:
    """The words of a court's name that tell which court it is, null if there are none."""
    words = F.filter(F.split(fold(c), " "), lambda w: ~w.isin(*COURT_WORDS) & (F.length(w) > 1))
    return F.nullif(F.array_join(words, " "), F.lit(""))


def courts_agree(a: Column, b: Column, tail: int = 5) -> Column:
    """Equal, one within the other, the last word of one the end of the other's (from `tail` letters on), or spelled nearly alike."""
    x, y = court_key(a), court_key(b)
    u, v = (F.element_at(F.split(k, " "), -1) for k in (x, y))
    ends = (F.least(F.length(u), F.length(v)) >= tail) & (F.endswith(u, v) | F.endswith(v, u))
    return F.when(x.isNotNull() & y.isNotNull(), F.contains(x, y) | F.contains(y, x) | ends | (similarity(x, y) >= 85))


def registry_agrees(court_a: Column, folio_a: Column, court_b: Column, folios_b: Column) -> Column:
    """Whether an entity holds a row's folio at its court: false where it holds another, null where either says nothing."""
    return F.when(courts_agree(court_a, court_b) & folio_a.isNotNull() & (F.size(folios_b) > 0), F.array_contains(folios_b, folio_a))


def token_weights(names: DataFrame, key: str, name: str) -> DataFrame:
    """(token, weight): the rarer among entities, the heavier."""
    t = names.select(F.col(key), F.explode(F.split(fold(F.col(name)), " ")).alias("token")).where("token <> ''")
    n = names.select(key).distinct().agg(F.count("*").alias("__n"))
    return t.groupBy("token").agg(F.countDistinct(key).alias("df")).join(F.broadcast(n)).select("token", (F.log((F.col("__n") + 1) / (F.col("df") + 1)) + 1).alias("weight"))


def _letters(c: Column) -> list[Column]:
    """Bits of a folded text: which letters and digits it has once, and which letters twice, three and four times or more."""
    count = lambda ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    bit = lambda yes, i: F.when(yes, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    abc, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    low = [bit(count(ch) >= n, i + 26 * (n - 1)) for n in (1, 2) for i, ch in enumerate(abc)] + [bit(count(ch) >= 1, 52 + i) for i, ch in enumerate(digits)]
    high = [bit(count(ch) >= n, i + 26 * (n - 3)) for n in (3, 4) for i, ch in enumerate(abc)]
    return [sum(bits[1:], bits[0]) for bits in (low, high)]


def similar_texts(left: DataFrame, right: DataFrame, floor: float, salts: int = 16) -> DataFrame:
    """(q, e, score): all pairs of the folded texts `left` (q) and `right` (e) whose similarity is `floor` or more; none is left out.

    Texts meet by length: with d edits over the longer text at most (1 - floor / 100), the shorter has at least floor / 100 of its length. An
    edit takes away and adds at most one letter, so pairs whose letters differ more are dropped by their bits before the edit distance is taken.
    """
    if not 0 < floor <= 100:
        raise ValueError("floor is above 0 and at most 100")
    share, near = floor / 100, 1e-9
    l1, l2 = _letters(F.col("q"))
    r1, r2 = _letters(F.col("e"))
    n = F.length("q")
    # A length is spread over `salts` keys, so that the most frequent one is not one task's.
    le = left.select("q").distinct().withColumns({"q1": l1, "q2": l2, "salt": F.pmod(F.xxhash64("q"), F.lit(salts)).cast("int")})
    le = le.withColumn("n", F.explode(F.sequence(F.ceil(n * share - near).cast("int"), F.floor(n / share + near).cast("int"))))
    ri = right.select("e").distinct().withColumns({"e1": r1, "e2": r2, "n": F.length("e")}).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    borne = F.floor((1 - share) * F.greatest(F.length("q"), F.col("n")) + near).cast("int")
    more = lambda a, b: F.bit_count(F.col(f"{a}1").bitwiseAND(F.bitwise_not(F.col(f"{b}1")))) + F.bit_count(F.col(f"{a}2").bitwiseAND(F.bitwise_not(F.col(f"{b}2"))))
    parts = 4 * salts
    met = le.repartition(parts, "n", "salt").join(ri.repartition(parts, "n", "salt").hint("shuffle_hash"), ["n", "salt"]).where((more("q", "e") <= borne) & (more("e", "q") <= borne))
    return met.select("q", "e", similarity(F.col("q"), F.col("e")).alias("score")).where(F.col("score") >= floor)


def candidates(queries: DataFrame, names: DataFrame, floor: float = FLOOR, top: int = TOP, rescore=None) -> DataFrame:
    """(record, entity, score, rank): the entities with a name that scores `floor` or more against a query, the best score of all queries each.

    `queries` is (record, query), `names` (entity, name). The score is the similarity of the whole folded names; a common token is not needed, and how frequent
    a token is plays no part. `rescore`, a function of the two folded names and the score, may put another score in its place; what then falls below the floor goes.
    """
    q = queries.select("record", F.nullif(fold(F.col("query")), F.lit("")).alias("q")).where("q is not null").distinct()
    e = names.select("entity", F.nullif(fold(F.col("name")), F.lit("")).alias("e")).where("e is not null").distinct()
    scored = similar_texts(q, e, floor)
    if rescore is not None:
        scored = scored.withColumn("score", rescore(F.col("q"), F.col("e"), F.col("score"))).where(F.col("score") >= floor)
    met = q.join(scored, "q").join(e, "e").groupBy("record", "entity").agg(F.max("score").alias("score"))
    return met.withColumn("rank", F.row_number().over(W.partitionBy("record").orderBy(F.col("score").desc(), "entity"))).where(F.col("rank") <= top)


def boosted(cands: DataFrame, records: DataFrame, entities: DataFrame, cited: DataFrame | None = None, keyed: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """Candidates with agreements, boost, ranked score and rank. `cited` and `keyed` are pairs (record, entity) that a citation or registry position speaks for."""
    r = records.select(F.col("record"), *[F.col(c).alias(f"r_{c}") for c in BOOSTS])
    e = entities.select(F.col("entity"), *[F.col(c).alias(f"e_{c}") for c in BOOSTS])
    d = cands.drop("rank").join(r, "record").join(e, "entity")
    agree = {"seat": seats_agree(F.col("r_seat"), F.col("e_seat")), "founded": years_agree(F.col("r_founded"), F.col("e_founded")), "county": F.nullif(fold(F.col("r_county")), F.lit("")) == F.nullif(fold(F.col("e_county")), F.lit("")), "legal_form": F.nullif(fold(F.col("r_legal_form")), F.lit("")) == F.nullif(fold(F.col("e_legal_form")), F.lit("")), "court": courts_agree(F.col("r_court"), F.col("e_court"))}
    d = d.withColumns({f"{k}_agree": c for k, c in agree.items()})
    for name, pairs in (("cited", cited), ("keyed", keyed)):
        d = d.withColumn(name, F.lit(False)) if pairs is None else d.join(pairs.select("record", "entity").distinct().withColumn(name, F.lit(True)), ["record", "entity"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    boost = sum((F.when(F.col(f"{k}_agree"), v).otherwise(0.0) for k, v in BOOSTS.items()), F.lit(0.0)) + F.when(F.col("cited"), BOOST_ISSUE).otherwise(0.0) + F.when(F.col("keyed"), BOOST_KEY).otherwise(0.0)
    d = d.withColumn("boost", boost).withColumn("ranked", F.col("score") + F.col("boost"))
    w = W.partitionBy("record").orderBy(F.col("ranked").desc(), "entity")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop(*[f"r_{k}" for k in BOOSTS], *[f"e_{k}" for k in BOOSTS])


def decide(ranked: DataFrame, floor: float = GOOD, margin: float = MARGIN) -> DataFrame:
    """(record, entity, decision, reason) of each record from its best candidate and the runner-up."""
    w = W.partitionBy("record").orderBy("rank")
    d = ranked.withColumn("__s2", F.lead("score").over(w)).withColumn("__r2", F.lead("ranked").over(w)).where("rank = 1")
    sure, weak = floor + (SURE - GOOD), floor - (GOOD - WEAK)
    s, sa, ya = F.col("score"), F.col("seat_agree"), F.col("founded_agree")
    no = lambda c: F.coalesce(~c, F.lit(False))
    close = F.coalesce((s - F.col("__s2") < margin) & (F.col("ranked") - F.col("__r2") < margin), F.lit(False))
    folio = F.col("folio_agree") if "folio_agree" in ranked.columns else F.lit(None).cast("boolean")
    reason = (
        F.when(no(F.col("court_agree")), "court differs").when(no(folio), "registry position differs").when(F.col("keyed"), "registry key")
        .when((s >= sure) & no(sa) & no(ya), "seat and year contradict").when((s >= floor) & (s < sure) & (no(sa) | no(ya)), "a fact contradicts").when((s >= weak) & (s < floor) & ~F.coalesce(sa & ya, F.lit(False)), "weak name")
        .when(s < weak, "name too different").when(close, "ambiguous").when(s >= sure, "sure name").when(s >= floor, "good name").otherwise("corroborated")
    )
    same = F.col("reason").isin("registry key", "sure name", "good name", "corroborated")
    return d.withColumn("reason", reason).select("record", F.when(same, F.col("entity")).alias("entity"), F.when(same, "same").otherwise("open").alias("decision"), "reason")


def not_of_source(cands: DataFrame, slices: DataFrame, source: str) -> DataFrame:
    """Candidates without entities that another record of the same source already stands for."""
    taken = slices.where(F.col("source") == source).select("entity", F.col("record").alias("__own")).distinct()
    j = cands.join(taken, (cands["entity"] == taken["entity"]) & (cands["record"] != taken["__own"]), "left_anti")
    return j


def survivors(entities: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """`entities` with canonical, the entity they were folded into (themselves if none)."""
    c = canonical_ids(edges).withColumnRenamed("id", key)
    return entities.join(c, key, "left").withColumn("canonical", F.coalesce("canonical", key))


def folded(entities: DataFrame, edges: DataFrame, cells: DataFrame) -> DataFrame:
    """(canonical, members, aliases, conflicts): one row per firm; conflicts are the projects that list two of its entities.

    `cells` is (entity, project, ...). Names of merged entities become aliases.
    """
    s = survivors(entities, edges)
    head = s.where("id = canonical").select("canonical", F.col("name").alias("head"))
    group = s.groupBy("canonical").agg(F.array_sort(F.collect_set("id")).alias("members"), F.array_sort(F.collect_set("name")).alias("names"))
    per = cells.join(s.select(F.col("id").alias("entity"), "canonical"), "entity").groupBy("canonical", "project").agg(F.countDistinct("entity").alias("n"))
    conflicts = per.where("n > 1").groupBy("canonical").agg(F.array_sort(F.collect_list("project")).alias("conflicts"))
    out = group.join(head, "canonical", "left").join(conflicts, "canonical", "left")
    return out.select("canonical", "members", F.array_except("names", F.array("head")).alias("aliases"), F.coalesce("conflicts", F.array().cast("array<string>")).alias("conflicts"))


def entity_table(entities: DataFrame, heads: DataFrame, slices: DataFrame, projects: list[str]) -> DataFrame:
    """One row per entity with the number of live records in each project and the projects whose slice points at none any more.

    `heads` is (project, record, entity), `slices` (entity, project, record).
    """
    live = heads.where("entity is not null").groupBy("entity").pivot("project", projects).agg(F.countDistinct("record"))
    gone = slices.join(heads.select("entity", "project").distinct(), ["entity", "project"], "left_anti").groupBy("entity").agg(F.array_sort(F.collect_set("project")).alias("stale"))
    out = entities.select(F.col("id").alias("entity"), "name").join(live, "entity", "left").join(gone, "entity", "left")
    return out.select("entity", "name", *[F.coalesce(F.col(p), F.lit(0)).alias(p) for p in projects], F.coalesce("stale", F.array().cast("array<string>")).alias("stale"))


def facts(slices: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """(entity, key, value): the value stated last for each fact, the entity's own attrs counting as the oldest."""
    base = entities.select(F.col("id").alias("entity"), F.lit(-1).alias("pos"), F.explode("attrs").alias("key", "value"))
    later = slices.select(F.col("entity_id").alias("entity"), F.col("as_of").alias("pos"), "recorded_at", F.explode("attrs").alias("key", "value"))
    every = base.withColumn("recorded_at", F.lit(None).cast("timestamp")).unionByName(later)
    said = every.where(F.col("key").isin(keys) & (F.coalesce(F.trim("value"), F.lit("")) != ""))
    return said.groupBy("entity", "key").agg(F.max_by("value", F.struct("pos", "recorded_at", "value")).alias("value"))


def first_seen(slices: DataFrame, founded: DataFrame) -> DataFrame:
    """(entity, first_seen, founded_after_seen): the earliest year an entity was met, and whether it says to have been founded later."""
    f = slices.groupBy(F.col("entity_id").alias("entity")).agg(F.min("as_of").alias("first_seen"))
    return f.join(founded, "entity", "left").withColumn("founded_after_seen", F.col("founded") > F.col("first_seen"))


def places_of(marks: DataFrame) -> DataFrame:
    """(entity, n, places): entities that stand in two places or more."""
    return marks.where("entity is not null").groupBy("entity").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("place")).alias("places")).where("n >= 2")


def worklist(texts: DataFrame) -> DataFrame:
    """(folded, n, sample): unresolved texts under one folded form, the most frequent first."""
    f = texts.withColumn("folded", fold(F.col("text"))).where("folded <> ''")
    return f.groupBy("folded").agg(F.count("*").alias("n"), F.min("text").alias("sample")).orderBy(F.col("n").desc(), "folded")


def alias_candidates(confirmed: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity, text, n): texts people confirmed for an entity that its aliases don't hold."""
    c = confirmed.withColumn("folded", fold(F.col("text"))).where("folded <> ''")
    known = aliases.select("entity", fold(F.col("name")).alias("folded")).distinct()
    return c.join(known, ["entity", "folded"], "left_anti").groupBy("entity", "folded").agg(F.count("*").alias("n"), F.min("text").alias("text"))


def citations(records: DataFrame, issues: DataFrame, volumes: DataFrame) -> DataFrame:
    """(record, entity, lane): what a record's citation of an earlier issue points at: in its own volume, in the volume before, in the year of a numbered volume, or the entry above.

    `records` is (record, pos, year, issue, volume_no, cited_year, previous), `issues` (year, issue, entity, pos), `volumes` (volume_no, year).
    """
    r = records.join(volumes.select(F.col("volume_no"), F.col("year").alias("__vy")), "volume_no", "left").withColumn("__y", F.coalesce("cited_year", "__vy"))
    i = issues.select(F.col("year").alias("__iy"), F.col("issue").alias("__ii"), "entity")
    met = r.join(i, (F.col("issue") == F.col("__ii")) & F.when(F.col("__y").isNotNull(), F.col("__iy") == F.col("__y")).otherwise(F.col("__iy").isin(F.col("year"), F.col("year") - 1)))
    lane = F.when(F.col("__y").isNotNull(), "named volume").when(F.col("__iy") == F.col("year"), "this volume").otherwise("volume before")
    # The entry printed above is the last one before the record in an ordered union of both.
    both = issues.select("year", "pos", F.lit(None).cast(dict(records.dtypes)["record"]).alias("record"), "entity", F.lit(False).alias("previous"), F.lit(1).alias("__k")).unionByName(
        records.select("year", "pos", "record", F.lit(None).cast(dict(issues.dtypes)["entity"]).alias("entity"), "previous", F.lit(0).alias("__k")))
    above = F.last("entity", True).over(W.partitionBy("year").orderBy("pos", "__k").rowsBetween(W.unboundedPreceding, W.currentRow))
    top = both.withColumn("entity", above).where("record is not null and previous and entity is not null").select("record", "entity", F.lit("entry above").alias("lane"))
    return met.select("record", "entity", lane.alias("lane")).unionByName(top).distinct()


def stripped(name: Column, tokens: list[str], phrases: list[str], trailing: list[str] = ()) -> Column:
    """A folded name without words and phrases that tell no firm from another, and without `trailing` words at its end; a name that is nothing else keeps its words."""
    f = fold(name)
    bare = f
    for p in phrases:
        bare = F.regexp_replace(bare, rf"\b{p}\b", " ")
    left = F.array_join(F.filter(F.split(F.trim(bare), r"\s+"), lambda w: ~w.isin(list(tokens)) & (w != "")), " ")
    left = F.regexp_replace(left, rf"(?:(?:^|\s)(?:{'|'.join(trailing)}))+$", "") if trailing else left
    return F.when(left != "", left).otherwise(f)


def weighted_scores(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """`pairs` (q, e) with score: 100 times the weight of the words they share over that of all their words, so that a rare word counts most.

    Words that no entity has weigh as much as the rarest.
    """
    most = weights.agg(F.max("weight").alias("__most"))
    t = pairs.select("q", "e").distinct()
    words = t.select("q", "e", F.explode(F.array_union(F.split("q", " "), F.split("e", " "))).alias("token"))
    both = F.array_contains(F.split("q", " "), F.col("token")) & F.array_contains(F.split("e", " "), F.col("token"))
    w = words.join(weights.select("token", "weight"), "token", "left").join(F.broadcast(most)).withColumn("weight", F.coalesce("weight", "__most", F.lit(1.0)))
    return w.groupBy("q", "e").agg((100 * F.sum(F.when(both, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("score"))
