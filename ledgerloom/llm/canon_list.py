"""Free-entered values mapped to the entries of a canonical list, by a partition-based pigeonhole join.

Every distinct value gets one key: folded, without the notes that stand behind a name, with inverted and
abbreviated parts written out. Keys equal to a key of the list are done. The rest goes through the pigeonhole
join: a reference key that is to be found within k edits is cut into k+1 segments, one of which must stand
unchanged in the value, shifted by at most k positions. Segments and substrings meet in an equality join on
(type, substring, position); the built-in levenshtein verifies what meets. Keys that end in an abbreviation
point are also met as the beginning of a reference key. What no join reaches is reported by an anti-join. All of
it is built of SQL expressions.

Edge cases, all defined: null and blank values and values of dashes alone give no row; cells without a column
description give no row; entries that share a name are told apart by the county cell of the row (the one
updated last), or else by the county noted in the value, or else the least id is taken; repeated aliases count
once; repeated rows give one row per cell_id; extra columns are ignored; an empty list leaves every value 'none'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ledgerloom.runtime import cut

# Accented letters and what they fold to.
ACCENTED = "áàâäãåāéèêëēíìîïīóòôöőõōúùûüűūýÿçčćñńšśșşžźżțţłđ"
FOLDED = "aaaaaaaeeeeeiiiiiooooooouuuuuuyyccčnnssssžžžttld".replace("č", "c").replace("ž", "z")
# Short forms before a name and notes behind it.
SHORT = (("nagy", "n"), ("kis", "k"), ("also", "a"), ("felso", "f"), ("szent", "sz"), ("uj", "u"), ("sankt", "st"), ("gross", "gr"), ("klein", "kl"), ("ober", "ob"), ("unter", "unt"))
NOTES = r"(\s*,\s*(nagykozseg|kozseg|kisipar|gyaripar|puszta|varos)|\s+(kozseg|nagykozseg|mezovaros|mvaros|varos|rtv|kgs|uzem|gyartelep|puszta|p\.\s*u|sz\.\s*k\.\s*v|r\.\s*t\.\s*v|mint mellekfogl\w*|es mellekagai)|\s*\((gyar|puszta|uzem|kozseg|varos)\))\s*[.,;:]*\s*$"
DASHES = r"^[\s\p{Z}\-\x{2010}-\x{2015}\x{2212}]*$"
MAX_K = 3
#: References up to which their segments are broadcast; a longer list is joined by shuffle.
BROADCAST_REFERENCES = 50_000


def fold(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, FOLDED), "ß", "ss")


def letters(c: Column) -> Column:
    """Letters and digits only, with what scans misread brought to one form."""
    k = F.regexp_replace(F.translate(c, "01q", "olg"), "[^a-z0-9]", "")
    return F.regexp_replace(F.regexp_replace(k, "rn", "m"), "lc", "k")


def edits(length: Column) -> Column:
    """How many edits a key of a length may be away."""
    return F.when(length <= 3, 0).when(length <= 4, 1).when(length <= 8, 2).otherwise(MAX_K)


def references(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(type, key, entity_id, county): every spelling of every entry."""
    e = entities.select(F.col("id").alias("entity_id"), "type", "name", F.try_element_at("attrs", F.lit("county")).alias("county"))
    a = aliases.select("entity_id", F.col("name").alias("alias"))
    names = e.select("entity_id", "type", "county", "name").unionByName(e.drop("name").join(a, "entity_id").withColumnRenamed("alias", "name"))
    return names.select("type", letters(fold(F.col("name"))).alias("key"), "entity_id", letters(fold(F.col("county"))).alias("county")).where("key <> ''").distinct()


def keyed(values: DataFrame) -> DataFrame:
    """`values` (type, value) with key, county_note and is_short (whether it ends in an abbreviation point)."""
    f = F.regexp_replace(F.trim(F.regexp_replace(fold(F.col("value")), r"[\s\p{Z}]+", " ")), r"[\s,;:]+$", "")
    f = F.regexp_replace(F.regexp_replace(f, NOTES, ""), NOTES, "")
    v = values.select("type", "value", F.regexp_replace(f, r"([.;:,])[\s.;:,]+$", "$1").alias("f"))
    # Places and trades are written out in two branches, each a plain chain of expressions.
    in_list = r",\s*([^,]+?)\s+(v?m|megye|varmegye|comitat)\b[.]*$"
    in_brackets = r"\s*\(([^()]+?)\)[.,;]*$"
    places = v.where("type = 'settlement'")
    county = F.coalesce(F.nullif(F.regexp_extract("f", in_brackets, 1), F.lit("")), F.nullif(F.regexp_extract("f", in_list, 1), F.lit("")))
    bare = F.regexp_replace(F.regexp_replace("f", in_brackets, ""), in_list, "")
    # "Szilefalva, Új-" and "gyártás (bőr)" name the head first.
    bare = F.regexp_replace(bare, r"^([^,]+?)\s*,\s*([^,]+?)\s*-[.,;]*$", "$2-$1")
    for full, short in SHORT:
        bare = F.regexp_replace(bare, rf"^{short}\.\s*-?\s*(?=[a-z])", f"{full}-")
    trades = v.where("type <> 'settlement'")
    turned = F.regexp_replace("f", r"^([a-z]+)\s*\(([a-z ]+)\)[.,;]*$", "$2$1")
    both = places.select("type", "value", letters(county).alias("county_note"), bare.alias("f")).unionByName(trades.select("type", "value", F.lit(None).cast("string").alias("county_note"), turned.alias("f")))
    return both.select("type", "value", "county_note", F.col("f").rlike(r"[a-z]\.$").alias("is_short"), letters(F.col("f")).alias("key"))


def _segments(refs: DataFrame) -> DataFrame:
    """(type, part, at, key, k): the segments of every reference key at every position they may be shifted to."""
    r = refs.select("type", "key").distinct().withColumn("n", F.length("key")).withColumn("k", edits(F.col("n"))).where("n > k and k > 0")
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    start = F.floor(F.col("i") * F.col("n") / (F.col("k") + 1))
    end = F.floor((F.col("i") + 1) * F.col("n") / (F.col("k") + 1))
    r = r.withColumn("start", start.cast("int")).withColumn("size", (end - start).cast("int"))
    r = r.withColumn("part", F.substring("key", F.col("start") + 1, F.col("size")))
    return r.select("type", "part", F.explode(F.sequence(F.greatest(F.lit(0), F.col("start") - F.col("k")), F.col("start") + F.col("k"))).alias("at"), "key", "k")


def _substrings(keys: DataFrame, sizes: list[int]) -> DataFrame:
    """(type, word, part, at): the substrings of every key in the sizes that segments have."""
    def of(size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.length("word") - F.lit(size)), lambda p: F.struct(F.substring(F.col("word"), p + 1, F.lit(size)).alias("part"), p.alias("at")))

    none = F.array().cast("array<struct<part:string,at:int>>")
    guarded = [F.when(F.length("word") >= size, of(size)).otherwise(none) for size in sizes]
    return keys.select("type", "word", F.explode(F.concat(*guarded)).alias("s")).select("type", "word", "s.part", "s.at")


def match_keys(keys: DataFrame, refs: DataFrame) -> DataFrame:
    """(type, word, key, distance) of the nearest reference keys of every word of `keys` (type, word)."""
    small = refs.count() <= BROADCAST_REFERENCES
    hint = F.broadcast if small else (lambda x: x)
    names = refs.select("type", "key").distinct()
    exact = keys.join(hint(names.withColumn("word", F.col("key"))), ["type", "word"]).select("type", "word", "key", F.lit(0).alias("distance"))
    rest = keys.join(hint(names.withColumnRenamed("key", "word")), ["type", "word"], "left_anti")
    segments = _segments(refs)
    sizes = [r[0] for r in segments.select(F.length("part").alias("n")).distinct().orderBy("n").collect()]
    if not sizes:
        return exact
    met = _substrings(rest, sizes).join(hint(segments), ["type", "part", "at"]).where(F.abs(F.length("word") - F.length("key")) <= F.col("k"))
    near = met.withColumn("distance", F.levenshtein("word", "key", MAX_K)).where("distance >= 0 and distance <= k").select("type", "word", "key", "distance").distinct()
    best = F.min("distance").over(W.partitionBy("type", "word"))
    return exact.unionByName(near.withColumn("best", best).where("distance = best").drop("best"))


def _beginnings(short: DataFrame, refs: DataFrame) -> DataFrame:
    """(type, word, key, distance 0) of the reference keys that begin with an abbreviated word of four letters or more."""
    starts = refs.select("type", "key").distinct().select("type", "key", F.explode(F.sequence(F.lit(4), F.greatest(F.lit(4), F.length("key") - 1))).alias("n"))
    starts = starts.where("n < length(key)").select("type", "key", F.expr("substring(key, 1, n)").alias("word"))
    return short.where(F.length("word") >= 4).join(starts, ["type", "word"]).select("type", "word", "key", F.lit(0).alias("distance"))


def _wanted(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(project, row_id, cell_id, type, value) of the cells of entity columns that say something."""
    cols = columns.where("dtype = 'entity'").select("project", "col_id", F.col("variable").alias("type")).distinct()
    return cells.where(F.col("value").isNotNull() & ~F.col("value").rlike(DASHES)).select("project", "col_id", "row_id", "cell_id", "value").join(cols, ["project", "col_id"])


def _by_value(wanted: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(type, value, county_note, entries): every distinct value with the entries of the list it may stand for, null if there are none."""
    # Distinct values and references are far smaller than the cells. Written once, they keep every later plan short.
    refs = cut(references(entities, aliases))
    words = cut(keyed(wanted.select("type", "value").distinct()))
    short = words.where("is_short").select("type", F.col("key").alias("word")).distinct()
    exact = refs.select("type", F.col("key").alias("word")).distinct()
    begun = _beginnings(short.join(exact, ["type", "word"], "left_anti"), refs)
    left = words.where("key <> ''").select("type", F.col("key").alias("word")).distinct().join(begun.select("type", "word").distinct(), ["type", "word"], "left_anti")
    met = match_keys(left, refs).unionByName(begun)
    ids = met.join(refs, ["type", "key"]).groupBy("type", "word").agg(F.array_sort(F.collect_set(F.struct("entity_id", "county"))).alias("entries"))
    return cut(words.join(ids.withColumnRenamed("word", "key"), ["type", "key"], "left").select("type", "value", "county_note", "entries"))


def resolve(cells: DataFrame, columns: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(cell_id, entity_id) of every cell of an entity column; 'none' where the list has no such entry."""
    wanted = _wanted(cells, columns)
    by_value = _by_value(wanted, entities, aliases)
    found = wanted.join(by_value, ["type", "value"], "left")
    sure = found.where("entries is null or size(entries) = 1").select("cell_id", F.coalesce(F.expr("entries[0].entity_id"), F.lit("none")).alias("entity_id"))
    # The few cells whose name several entries share are used twice below.
    unsure = cut(found.where("size(entries) > 1"))
    county_cols = columns.where("variable = 'county'").select("project", "col_id").distinct()
    counties = (
        cells.where(F.col("value").isNotNull() & ~F.col("value").rlike(DASHES)).join(F.broadcast(county_cols) if columns.count() <= BROADCAST_REFERENCES else county_cols, ["project", "col_id"])
        .join(unsure.select("project", "row_id").distinct(), ["project", "row_id"], "left_semi")
        .groupBy("project", "row_id").agg(F.max_by("value", F.struct("updated_at", "cell_id")).alias("county_value"))
    )
    told = unsure.join(counties, ["project", "row_id"], "left")
    bare = F.regexp_replace(F.regexp_replace(fold(F.col("county_value")), r"(\s|\b)(v?m|megye|varmegye|comitat)\b\.?\s*$", ""), r"er\s*$", "")
    told = told.withColumn("said", F.coalesce(F.nullif(letters(bare), F.lit("")), F.col("county_note"), F.lit("")))

    def far(e: Column) -> Column:
        head = F.levenshtein(F.substring(e["county"], F.lit(1), F.length("said")), F.col("said"))
        return F.struct(F.when((F.col("said") == "") | e["county"].isNull(), 99).when(F.length("said") >= 3, F.least(head, F.levenshtein(e["county"], F.col("said")))).otherwise(99).alias("d"), e["entity_id"].alias("entity_id"))

    chosen = told.select("cell_id", F.array_min(F.transform("entries", far))["entity_id"].alias("entity_id"))
    return sure.unionByName(chosen).distinct()


def unmatched(cells: DataFrame, columns: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(type, value, cells): the values the list has no entry for and how many cells hold them, by an anti-join of distinct values."""
    wanted = _wanted(cells, columns)
    listed = _by_value(wanted, entities, aliases).where("entries is not null").select("type", "value")
    return wanted.groupBy("type", "value").agg(F.countDistinct("cell_id").alias("cells")).join(listed, ["type", "value"], "left_anti")
