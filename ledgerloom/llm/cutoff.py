"""Text cut off by field limits.

A stack automaton reads each text once and keeps what is open: brackets, quotes, markup. With the way the text
ends (broken multibyte sequence or escape, cut mark, terminator, a line that needs none such as a table row or
a signature) this gives the evidence of a cut. What single texts leave open is decided by the baseline of their
source, taken over all documents: lengths at which a source's unfinished texts gather are its field limits, a missing terminator tells
a cut where the source as a rule sets one, and an opener still open tells a cut where it is no farther from the end than what
the source closes is long.

Edge cases, all defined: null, empty and blank texts are not cut; a null source is a source of its own; repeated
rows give one row; very long texts are read in one pass; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import cut, spread

# What opens and closes, what a cut is marked with, and short forms no sentence ends on.
OPENS = {"(": ")", "[": "]", "{": "}", "„": "”“", "«": "»", "‚": "’‘"}
CLOSERS = "\"'”“»)]}*_~`›’"
MARK = re.compile(r"(\.\.\.+|…|\[(…|\.\.\.|cut|truncated|more)\]|\((…|\.\.\.)\)|[.…]{2,}\s*(>>|»|\[\+\]|\(more\)))$")
BROKEN = re.compile(r"(�+|[\ud800-\udfff]|\\(u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|%[0-9A-Fa-f]?|&(#?\w{0,8})|</?\w{0,12})$")
SHORT = re.compile(r"(^|[\s(])(Nr|Dr|kir|évi|fl|Str|ifj|özv|id|sz|No|Hr|bzw|vm|kr|cs|ú|l|vgl|pl|ill)\.$")
DAY_OR_YEAR = re.compile(r"(^|[\s(])(am \d{1,2}|1[5-9]\d\d|vom \d{1,2})\.$")
TOKENS = re.compile(r"[()\[\]{}„”“«»\"]|</?[A-Za-z][^<>]*>|\*\*|`+")
PAGE = re.compile(r"^\W*\d{1,5}\W*$|^(\d+\. (lap|oldal)|S\. \d+|p\. \d+|(Seite|page|oldal|lap) \d+)\.?$", re.I)
SIGNED = re.compile(r"^(Dr\.?|ifj\.|id\.|özv\.|gez\.|Signed:?) ?([A-ZÁÉÍÓÖŐÚÜŰ]\w*\.? ?){1,4}$|, (közjegyző|jegyző|elnök|titkár|bíró|igazgató|Notar|Richter|Präsident|notary|clerk|secretary)\.?$|bíróság$|^(s\. k\.|m\. p\.)$")
DATED = re.compile(r"^\S[^.,]{0,40}, (am |den |on )?(\d{4}\. (évi )?\w+ \d{1,2}\.?(-án|-én)?|\d{1,2}\. \w+ \d{4}|\w+ \d{1,2}, \d{4})\.?$")
HEADING = re.compile(r"^(#+ .*|={2,}.*|(?=.*[A-ZÁÉÍÓÖŐÚÜŰ])[^a-záéíóöőúüű]*+)$")
#: The longest thing BROKEN tells from a text's end.
TORN = 16
SHARE, LEAST = 0.2, 4
#: Share of open ends, and texts it takes, from which a source is one that doesn't end its texts with a mark.
UNMARKED, ENOUGH = 0.9, 50
# Fixed value: the reach of an opener where its source closes none.
REACH = 26


def read_marks(text: str) -> tuple[list[tuple[str, int]], int, int]:
    """What is open at the end of a text (what would close it, where it stands), how many marks have no partner before the last one, and the longest closed span."""
    stack: list[tuple[str, int]] = []
    lost, longest = 0, 0

    def close(k: int, end: int) -> None:
        nonlocal lost, longest
        lost, longest = lost + len(stack) - k - 1, max(longest, end - stack[k][1])
        del stack[k:]

    for m in TOKENS.finditer(text):
        t = m.group()
        if t in OPENS:
            stack.append((OPENS[t], m.start()))
        elif t[0] == "<":
            if t[1] == "/":
                name = t[2:-1].strip().lower()
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                if at is None:
                    lost += 1
                else:
                    close(at, m.end())
            elif not t.endswith("/>") and t[1:3].lower() != "br":
                stack.append((re.match(r"\w+", t[1:]).group().lower(), m.start()))
        elif t in ('"', "**") or t[0] == "`":
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == t), None)
            if at is None:
                stack.append((t, m.start()))
            else:
                close(at, m.end())
        else:
            at = next((k for k in range(len(stack) - 1, -1, -1) if t in stack[k][0]), None)
            if at is None:
                lost += 1
            else:
                close(at, m.end())
    return stack, lost, longest


def still_open(text: str) -> int:
    """How many brackets, quotes and tags are open at the end."""
    return len(read_marks(text)[0])


def ending(text: str) -> str:
    """How a text ends: broken, mark, short, number, row, short_row, line (needs no terminator), end, closed or open."""
    t = text.rstrip()
    # The last lines, however long they are.
    lines = [x.strip() for x in t.rsplit("\n", 4)]
    last = lines[-1].lstrip("> ").strip()
    if BROKEN.search(t[-TORN:]):
        return "broken"
    if MARK.search(t):
        return "mark"
    if "|" in last:
        cells = last.strip("|").count("|")
        above = [x.strip("|> ").count("|") for x in lines[-4:-1] if "|" in x]
        return "short_row" if last.endswith(" |") and not last.startswith("|") or above and cells < above[-1] else "row"
    bare = t.rstrip(CLOSERS).rstrip()
    if SHORT.search(bare):
        return "short"
    if bare[-1:] in ".!?" or t[-1:] in ".!?":
        return "number" if DAY_OR_YEAR.search(bare) else "end"
    if len(lines) > 1 and (PAGE.match(last) or SIGNED.search(last) or DATED.match(last) or HEADING.match(last)):
        return "line"
    if PAGE.match(last) or DATED.match(last) or last.startswith("#"):
        return "line"
    return "closed" if bare != t else "open"


def structure(documents: DataFrame) -> DataFrame:
    """(doc_id, source, chars, bytes, ending, opened, since, lost, longest): what the automaton finds in each text that isn't blank.

    `since` is the length from the last opener still open to the end, `lost` counts marks without a partner, `longest` is the longest closed span.
    """

    def read(batches: Iterator):
        import pandas as pd

        for b in batches:
            rows = []
            for i, s, t in zip(b["doc_id"], b["source"], b["text"]):
                if t is not None and t.strip():
                    stack, lost, longest = read_marks(t)
                    since = len(t.rstrip()) - stack[-1][1] if stack else 0
                    rows.append((i, s, len(t), len(t.encode("utf-8", "replace")), ending(t), len(stack), since, lost, longest))
            yield pd.DataFrame(rows, columns=["doc_id", "source", "chars", "bytes", "ending", "opened", "since", "lost", "longest"]).astype({"source": object})

    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")).mapInPandas(read, "doc_id bigint, source string, chars bigint, bytes bigint, ending string, opened int, since int, lost int, longest int")


def limits(found: DataFrame) -> DataFrame:
    """(source, unit, at): the lengths in characters or bytes at which the unfinished texts of a source gather."""
    unfinished = found.where(F.col("ending").isin("open", "mark", "broken"))
    each = unfinished.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("at")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("at")))).alias("u"))
    counted = each.groupBy("source", "u.unit", "u.at").agg(F.count("*").alias("n"))
    totals = unfinished.groupBy("source").agg(F.count("*").alias("all"))
    joined = counted.join(totals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return joined.where((F.col("n") >= LEAST) & (F.col("n") >= SHARE * F.col("all"))).select("source", "unit", "at")


def reach(found: DataFrame) -> DataFrame:
    """(source, reach): the length that nine in ten of a source's sound texts don't exceed in their longest bracket, quote or tag."""
    return found.where("longest > 0 and lost = 0 and opened = 0").groupBy("source").agg(F.percentile_approx("longest", 0.9).alias("reach"))


def unmarked(found: DataFrame) -> DataFrame:
    """(source, unmarked): whether the texts of a source as a rule end on no mark, so that a missing one says nothing there."""
    open_ = F.sum((F.col("ending") == "open").cast("bigint"))
    return found.groupBy("source").agg(((F.count("*") >= ENOUGH) & (open_ >= UNMARKED * F.count("*"))).alias("unmarked"))


def judged(documents: DataFrame) -> DataFrame:
    """`structure` with at_limit and is_cut."""
    found = cut(structure(documents))
    lim = limits(found).groupBy("source").agg(F.collect_set(F.when(F.col("unit") == "chars", F.col("at"))).alias("cs"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("at"))).alias("bs"))
    at = F.coalesce(F.array_contains("cs", F.col("chars")), F.lit(False)) | F.coalesce(F.exists("bs", lambda x: F.col("bytes").between(x - 3, x)), F.lit(False))
    out = found.join(lim.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").withColumn("at_limit", at)
    out = out.join(reach(found).withColumnRenamed("source", "z"), F.col("source").eqNullSafe(F.col("z")), "left")
    out = out.join(unmarked(found).withColumnRenamed("source", "y"), F.col("source").eqNullSafe(F.col("y")), "left")
    # A missing mark is a cut where the source sets marks, or at a limit, or with a bracket, quote or tag still open.
    sure = F.col("ending").isin("mark", "broken", "short", "short_row") | (F.col("ending") == "open") & (~F.coalesce("unmarked", F.lit(False)) | F.col("at_limit") | (F.col("opened") > 0))
    unsure = F.col("ending").isin("closed", "number") & F.col("at_limit")
    # One opener, no farther from the end than what a source closes is long; a text that lost marks elsewhere tells nothing by one more.
    inside = F.col("ending").isin("closed", "number", "end") & (F.col("opened") == 1) & (F.col("lost") == 0) & (F.col("since") <= F.coalesce("reach", F.lit(REACH)))
    return out.withColumn("is_cut", sure | unsure | inside).drop("s", "cs", "bs", "z", "reach", "y", "unmarked")


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents that were cut."""
    return judged(documents).where("is_cut").select("doc_id").distinct()


def by_source(documents: DataFrame) -> DataFrame:
    """(source, documents, cut): how often each source cuts."""
    return judged(documents).groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("is_cut").cast("bigint")).alias("cut"))
