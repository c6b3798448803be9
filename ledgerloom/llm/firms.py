"""Variant spellings of firms' names, linked by a pigeonhole segment join.

Every record gives the own words of all its names in one phonetic alphabet; words that a share of all records in many
seats have count only where one of two records has no rarer word. A word of which k edits are to be borne is cut into k+1 segments; an inverted index holds the
segments with their positions. Words look up their substrings, those that stand at most k positions away meet, and what meets is
verified by the edit distance. Words meet
within a seat and line of business, or within a seat where no business is named; records that name no seat meet the others
within a line of business, and those that name neither meet all. A pair of records is one firm if an own word fits and nothing that both state (line of business,
seat, given name, kind of owners) speaks against it.

Edge cases, all defined: null, empty and invisible names say nothing, and records without an own word are in no
pair; repeated records pair like others, a record never with itself; very long names are parsed whole, of them
the own words count; extra columns are ignored; empty tables give no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import names
from ledgerloom.runtime import cut, shuffled

PROFILE = "id bigint, words array<string>, business string, seat string, given string, owners string, county string, founded int, form string, street string, number string, capital double"
# Beginnings of legal forms.
FORMS = (("rt", ("reszv", "rt", "act", "akt", "ag")), ("egylet", ("egyl", "egyes", "ver")), ("szov", ("szov", "mintszov", "gen")), ("bt", ("bet", "bt", "comm")), ("kkt", ("koz", "kkt", "off")), ("egyeni", ("egyeni", "einz")))
STREET = re.compile(r"[\s-]*(utcza|utca|u\.|u\b|gasse|strasse)[\s.,-]*", re.I)
MAX_GAZETTEER = 200_000
#: Edits up to which a word is told by itself.
CLOSE = 2
#: Share of rows and number of seats from which a word is common.
COMMON_SHARE, COMMON_SEATS = 0.01, 20


def legal_form(text: str | None) -> str | None:
    t = re.sub(r"[^a-z]", "", names.plain(text or ""))
    return next((k for k, starts in FORMS if t.startswith(starts)), None) if t else None


def address(text: str | None) -> tuple[str | None, str | None]:
    p = names.plain(text or "")
    number = re.search(r"\d+", p)
    street = re.sub(r"[^a-z]", "", STREET.sub(" ", re.sub(r"\bsz\b\.?", " ", re.sub(r"\d+", " ", p))))
    return (names.sound(street) or None, number.group() if number else None)


class Counties:
    def __init__(self, known: list[str]) -> None:
        self.known = {re.sub(r"[^a-z]", "", names.plain(c)): c for c in sorted(known)}

    def find(self, text: str | None) -> str | None:
        t = re.sub(r"\b(v?m|megye|varmegye|comitat|kir|tszek|torvenyszek|valtotorvenyszek)\b\.?", " ", names.plain(text or ""))
        t = re.sub(r"[^a-z]", "", t)
        if not t:
            return None
        for form in (t, t.removesuffix("er"), t.removesuffix("i")):
            if form in self.known:
                return self.known[form]
        fits = [c for k, c in self.known.items() if len(t) >= 3 and k.startswith(t)]
        if len(fits) == 1:
            return fits[0]
        near = sorted((min(names.edit_distance(form, k, 2) for form in (t, t.removesuffix("er"), t.removesuffix("i"))), c) for k, c in self.known.items())
        return near[0][1] if near and near[0][0] <= (1 if len(t) < 7 else 2) and len(t) >= 4 else None


def gazetteer(entities: DataFrame, aliases: DataFrame):
    """The places with all their names, and the counties, as a broadcast value. The list is fixed; its size is checked."""
    places = entities.where("type = 'settlement'").select("id", "name", F.try_element_at("attrs", F.lit("county")).alias("county"))
    named = aliases.select("entity_id", F.col("name").alias("alias")).join(places, F.col("entity_id") == F.col("id")).select(F.col("alias").alias("name"), F.col("name").alias("seat"), "county")
    every = places.select("name", F.col("name").alias("seat"), "county").unionByName(named).where("name is not null").distinct()
    if every.count() > MAX_GAZETTEER:
        raise ValueError("the list of places is larger than what may be broadcast")
    rows = every.collect()
    value = (sorted({(r["name"], r["seat"]) for r in rows if r["seat"]}), sorted({r["county"] for r in rows if r["county"]}))
    return entities.sparkSession.sparkContext.broadcast(value)


def profiles(rows: DataFrame, places) -> DataFrame:
    """What each row (id, names, seat, county, court, founded, legal_form, address, capital_nominal) says of its firm."""

    def read(batches: Iterator):
        import pandas as pd

        seats, counties = names.Seats(places.value[0]), Counties(places.value[1])
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                said = [p for n in (r.names if r.names is not None else ()) if n and (p := names.parse(n, seats))]
                first = {k: next((p[k] for p in said if p[k]), None) for k in ("business", "seat", "owners")}
                given = [p["given"] for p in said if p["given"]]
                given = next((g for g in given if len(g) > 1), given[0] if given else None)
                seat = (seats.find(re.sub(r"[^a-z]", "", names.written_out(r.seat))) if r.seat else None) or first["seat"]
                words = sorted({w for p in said for w in p["words"] if not seats.is_form(w, seat)})
                county = counties.find(r.county) or counties.find(r.court)
                founded = None if r.founded is None or r.founded != r.founded else int(r.founded)
                capital = None if r.capital_nominal is None or r.capital_nominal != r.capital_nominal else float(r.capital_nominal)
                out.append((r.id, words, first["business"], seat, given, first["owners"], county, founded, legal_form(r.legal_form), *address(r.address), capital))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in PROFILE.split(", ")])
            frame["founded"] = frame["founded"].astype("Int32")
            yield frame

    return rows.select("id", "names", "seat", "county", "court", "founded", "legal_form", "address", "capital_nominal").mapInPandas(read, PROFILE)


def common_words(found: DataFrame, share: float = COMMON_SHARE, seats: int = COMMON_SEATS) -> list[str]:
    """The words that a share of all rows and many seats have. A firm that stands in very many rows keeps its word, as its rows are of one seat.

    At most 1 / `share` words a row's word count can be common.
    """
    n = found.count()
    each = found.select("seat", F.explode("words").alias("word")).groupBy("word", "seat").agg(F.count("*").alias("n"))
    common = each.groupBy("word").agg(F.sum("n").alias("n"), F.count("seat").alias("seats")).where((F.col("n") > share * n) & (F.col("seats") >= seats))
    return sorted(r.word for r in common.collect())


def set_apart(found: DataFrame, common: list[str]) -> DataFrame:
    """Profiles with their common words in a column `common` instead of `words`; as they are if no word is common."""
    if not common:
        return found
    shared = F.array(*map(F.lit, common))
    return found.withColumn("common", F.array_intersect("words", shared)).withColumn("words", F.array_except("words", shared))


def own_words(found: DataFrame, share: float = COMMON_SHARE, seats: int = COMMON_SEATS) -> DataFrame:
    """Profiles with the words that a share of all rows and many seats have set apart: whatever the language, such words name a firm only where it has no other."""
    return set_apart(found, common_words(found, share, seats))


def met_words(p: DataFrame, left: bool) -> Column:
    """(way, word) of the words by which a row looks for others (`left`) or is found.

    Rare words meet rare words, which is way 0. A row without a rare word is known by its common ones, so it meets all words of every other: way 1
    where it looks, way 2 where it is found. Two rows that both have rare words are told by these.
    """
    way = lambda k, words: F.transform(words, lambda w: F.struct(F.lit(k).alias("way"), w.alias("word")))
    if "common" not in p.columns:
        return way(0, F.col("words"))
    every = F.concat("words", "common")
    known_by_common = F.when(F.size("words") == 0, F.col("common")).otherwise(F.array().cast("array<string>"))
    return F.concat(way(0, F.col("words")), way(1, known_by_common if left else every), way(2, every if left else known_by_common))


def by_way(block: Column, way: Column) -> Column:
    """`block` for the words of one way only."""
    return F.when(way == 0, block).otherwise(F.xxhash64(block, way))


def of_identities(identities: DataFrame) -> DataFrame:
    every = F.concat(F.array("name_hu", "name_de"), F.coalesce(F.transform("other_names", lambda o: o["name"]), F.array().cast("array<string>")))
    return identities.select(F.col("record_id").alias("id"), every.alias("names"), "seat", "county", "court", "founded", "legal_form", "address", "capital_nominal")


def of_entries(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("entry_id").alias("id"), F.array("firm_text").alias("names"), "seat", "county", "court", "founded", "legal_form", "address", "capital_nominal")


def bearable(n: Column) -> Column:
    """Edits that a word of a length may be away."""
    return F.when(n <= 4, 0).when(n <= 6, 1).when(n <= 9, 2).otherwise(3)


def letters(word: Column) -> Column:
    """The set of a word's letters as bits."""
    bits = F.transform(F.split(word, ""), lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(c).bitwiseAND(63)))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda x, y: x.bitwiseOR(y))


def similar_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(block, a, b): the words of `left` and `right` (block bigint, word) that fit within a block: as many edits apart as the longer of the two bears, or fewer.

    A right word is cut for every number of edits that it and a word it may fit can bear. Segments and substrings are met by one hash of block
    and letters; where they stand is compared after that, so a segment is one row of the index wherever it may be shifted to. An edit brings in and takes
    out at most one letter, so words whose letters differ more are told apart before their distance is taken.
    """
    left, right = left.withColumn("la", letters(F.col("word"))), right.withColumn("lb", letters(F.col("word")))
    n, m = F.length("word"), lambda d: F.length("word") + d
    longer = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda d: F.when(d <= bearable(m(d)), bearable(m(d))))
    r = right.withColumn("k", F.explode(F.array_distinct(F.filter(longer, lambda k: k.isNotNull())))).where(n > F.col("k"))
    start = lambda i: F.floor(i * F.length("word") / (F.col("k") + 1)).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.struct(start(i).alias("at"), F.substring(F.col("word"), start(i) + 1, start(i + 1) - start(i)).alias("part")))
    index = r.select("block", F.col("word").alias("b"), "lb", F.explode(F.array_distinct(cuts)).alias("c")).select(F.xxhash64("block", "c.part").alias("key"), F.col("c.at").cast("short").alias("at"), "block", "b", "lb").distinct()
    # The lengths of a word that may fit decide how long its segments can be.
    fits = F.filter(F.transform(F.sequence(F.greatest(F.lit(1), n - 3), n + 3), lambda x: F.struct(x.alias("n"), bearable(F.greatest(x, n)).alias("k"))), lambda x: (F.abs(x["n"] - n) <= x["k"]) & (x["n"] > x["k"]))
    sizes = F.array_distinct(F.flatten(F.transform(fits, lambda x: F.array(F.floor(x["n"] / (x["k"] + 1)).cast("int"), F.ceil(x["n"] / (x["k"] + 1)).cast("int")))))
    look = left.withColumn("size", F.explode(sizes)).where("size > 0 and size <= length(word)")
    look = look.withColumn("p", F.explode(F.sequence(F.lit(0), n - F.col("size"))))
    look = look.select(F.expr("xxhash64(block, substring(word, p + 1, size))").alias("key"), F.col("p").cast("short").alias("p"), F.col("word").alias("a"), "la")
    most = bearable(F.greatest(F.length("a"), F.length("b")))
    other = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y)))) <= most
    met = look.join(shuffled(index), "key").where((F.abs(F.length("a") - F.length("b")) <= most) & (F.abs(F.col("p") - F.col("at")) <= most) & other("la", "lb") & other("lb", "la"))
    d = F.levenshtein("a", "b", 3)
    return met.where((d >= 0) & (d <= most)).select("block", "a", "b").distinct()


def _against(a: str, b: str) -> Column:
    """Whether what both sides state of one thing differs."""
    return F.coalesce(F.col(a) != F.col(b), F.lit(False))


def _given_differs(a: str, b: str) -> Column:
    short = (F.length(a) == 1) | (F.length(b) == 1)
    return F.coalesce(F.when(short, F.lit(False)).otherwise(F.col(a) != F.col(b)), F.lit(False))


def _blocks(p: DataFrame, left: bool) -> DataFrame:
    """`p` once for each block it meets others in. Names of one seat in different lines of business can't be one firm, so those meet apart; a name that
    states no business meets its whole seat, one without a seat its line of business, and one with neither all."""
    seat, business = F.col("seat"), F.col("business")
    key = lambda on, *parts: F.when(on, F.xxhash64(*parts))
    both, only_seat, only_business, neither = seat.isNotNull() & business.isNotNull(), seat.isNotNull() & business.isNull(), seat.isNull() & business.isNotNull(), seat.isNull() & business.isNull()
    keys = [
        key(both, F.lit(1), seat, business), key(only_seat if left else seat.isNotNull(), F.lit(2), seat), key(only_business if left else business.isNotNull(), F.lit(3), business),
        key(neither if left else F.lit(True), F.lit(4)), key(seat.isNull() if left else business.isNull(), F.lit(5)),
    ]
    return p.withColumn("block", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())))


def same_firm(records: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b) of the profiles that name one firm."""
    p = lambda left: records.select("id", "business", "seat", "given", "owners", "county", "founded", F.explode(met_words(records, left)).alias("m"))
    side = lambda left: _blocks(p(left), left).withColumn("block", by_way(F.col("block"), F.col("m.way"))).withColumn("word", F.col("m.word")).drop("m")
    le, ri = cut(side(True)), side(False)
    # Blocks in which no record looks for another are left out of the index.
    ri = cut(ri.join(shuffled(le.select("block").distinct()), "block", "left_semi"))
    words = cut(similar_words(le.select("block", "word").distinct(), ri.select("block", "word").distinct()))
    a = le.select(*[F.col(c).alias(f"a_{c}") for c in le.columns if c != "block"], "block").withColumnRenamed("a_word", "a")
    b = ri.select(*[F.col(c).alias(f"b_{c}") for c in ri.columns if c != "block"], "block").withColumnRenamed("b_word", "b")
    pairs = a.join(shuffled(words), ["block", "a"]).join(shuffled(b), ["block", "b"])
    against = _against("a_business", "b_business") | _against("a_seat", "b_seat") | _against("a_owners", "b_owners") | _given_differs("a_given", "b_given")
    for_it = [F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False)) for c in ("business", "seat", "county", "founded", "given")]
    some = for_it[0] | for_it[1] | for_it[2] | for_it[3] | for_it[4]
    # A word spelled far otherwise needs the year to speak for it where no seat does, and no other year against it where the seat does.
    close = F.levenshtein("a", "b") <= F.least(F.lit(CLOSE), bearable(F.least(F.length("a"), F.length("b"))))
    apart = F.abs(F.col("a_founded") - F.col("b_founded"))
    far = F.when(for_it[1], F.coalesce(apart <= 1, F.lit(True))).otherwise(F.coalesce(apart <= 1, F.lit(False)))
    kept = pairs.where((F.col("a_id") != F.col("b_id")) & ~against & some & (close | far))
    return kept.select(F.least("a_id", "b_id").alias("record_id_a"), F.greatest("a_id", "b_id").alias("record_id_b")).distinct()


def variants(identities: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """The pairs of records of `identities` that name the same firm."""
    return same_firm(own_words(cut(profiles(of_identities(identities), gazetteer(entities, aliases)))))
