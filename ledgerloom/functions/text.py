"""Text functions on columns: layers and lines of a cell, folding, keys. Everything stays in the JVM.

Nulls: unless said otherwise a null input gives null; functions that choose among layers skip nulls and blanks.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and the letter each is without them, by Unicode's decompositions.
_BARE = {chr(o): unicodedata.normalize("NFD", chr(o))[0] for block in ((0xC0, 0x250), (0x1E00, 0x1F00)) for o in range(*block) if unicodedata.normalize("NFD", chr(o))[0].isascii()}
# Letters that Unicode doesn't decompose and what they are read as.
_BARE |= {"ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ı": "i", "ħ": "h", "Ħ": "H"}
ACCENTS_FROM, ACCENTS_TO = "".join(_BARE), "".join(_BARE.values())
# Printed marks that repeat the cell above, and their short forms.
DITTO_GLYPHS = r"^[„”“\"'’〃»«,.\s-]*[„”“\"〃»«][„”“\"'’〃»«,.\s-]*$"
DITTO_WORDS = ("u.o.", "u. o.", "uo.", "uo", "ua.", "u.a.", "do.", "dto.", "dtto", "id.", "ugyanott", "ugyanaz", "detto", "ditto", "ibid.")


def unaccent(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, ACCENTS_FROM, ACCENTS_TO), "ß", "ss")


def fold(c: Column) -> Column:
    """Lower case without accents, every run of other characters one blank."""
    return F.trim(F.regexp_replace(F.lower(unaccent(c)), "[^a-z0-9]+", " "))


def filled(c: Column) -> Column:
    """The text, or null where it is empty or blank."""
    return F.when(F.trim(c) != "", c)


def best_layer(human: Column, llm: Column, *ocr: Column) -> Column:
    """The text of the most trusted layer that has any."""
    return F.coalesce(*[filled(c) for c in (human, llm, *ocr)])


def layer(human: Column, llm: Column, ocr: Column, which: str) -> Column:
    """(text, source) of one layer or of the best of several."""
    orders = {"human": ("human",), "llm": ("llm",), "ocr": ("ocr",), "best_llm": ("human", "llm", "ocr"), "best_ocr": ("human", "ocr", "llm")}
    cols = {"human": human, "llm": llm, "ocr": ocr}
    picked = [F.when(filled(cols[k]).isNotNull(), F.struct(cols[k].alias("text"), F.lit(k).alias("source"))) for k in orders[which]]
    return F.coalesce(*picked, F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("source")))


def rows_text(rows: Column) -> Column:
    """The text of a box's internal rows (human, llm, ocr): the best layer of each, one a line; rows without text are left out."""
    best = F.transform(rows, lambda r: F.coalesce(filled(r["human"]), filled(r["llm"]), filled(r["ocr"])))
    return F.array_join(F.filter(best, lambda x: x.isNotNull()), "\n")


def first_line(c: Column, limit: int = 80) -> Column:
    """The first line of a text, at most `limit` characters of it."""
    return F.left(F.trim(F.element_at(F.split(F.trim(c), "\n"), 1)), F.lit(limit))


def lines(c: Column) -> Column:
    """The lines of a cell, trimmed, without blank lines at the end; at least one."""
    trimmed = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x))
    keep = F.size(F.split(F.regexp_replace(F.array_join(trimmed, "\n"), r"\n+$", ""), "\n"))
    return F.slice(trimmed, 1, F.greatest(keep, F.lit(1)))


def positioned_lines(c: Column) -> Column:
    """The lines of a text with blank ones in place; none for null or empty."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(c, "\n"), lambda x: F.trim(x)))


def line_count(c: Column) -> Column:
    """How many lines are not blank."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x) != ""))


def strip_short_lines(c: Column, least: int = 3) -> Column:
    """Without blank lines and lines under `least` characters, numbers of one or two digits excepted."""
    kept = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) >= least) | x.rlike(r"^\d{1,2}$"))
    return F.array_join(kept, "\n")


def rejoin_rows(rows: Column, flat: Column) -> Column:
    """Row texts filled from the flat text where all rows are empty and the counts of lines agree."""
    parts = positioned_lines(flat)
    empty = ~F.exists(rows, lambda r: F.coalesce(F.trim(r), F.lit("")) != "")
    return F.when(empty & (F.size(parts) == F.size(rows)), parts).otherwise(rows)


def resolvable(c: Column) -> Column:
    """Whether a text can name an entity: two characters that are not blank and no more than 80 in all."""
    return F.coalesce((F.length(F.regexp_replace(c, r"\s", "")) >= 2) & (F.length(F.trim(c)) <= 80), F.lit(False))


def is_ditto(c: Column) -> Column:
    """Whether a text only repeats the cell above."""
    t = F.trim(c)
    return F.coalesce(t.rlike(DITTO_GLYPHS) | F.lower(t).isin(*DITTO_WORDS), F.lit(False))


def layers_disagree(a: Column, b: Column) -> Column:
    """Whether two layers differ in more than blanks and case; a missing layer agrees."""
    same = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.coalesce((same(a) != "") & (same(b) != "") & (same(a) != same(b)), F.lit(False))


def hallucinated(llm: Column, ocr: Column, more: int = 2, longest: int = 4) -> Column:
    """Whether a model answered with too many lines or, for narrow cells, with too long ones."""
    return F.coalesce(((line_count(llm) - line_count(ocr)) >= more) | F.exists(F.split(llm, "\n"), lambda x: F.length(F.trim(x)) > longest), F.lit(False))


def natural_key(c: Column, width: int = 12) -> Column:
    """A key whose order is that of people: numbers by value, letters without case. Numbers of more digits than `width` follow in the order of their length."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    longer = lambda p: F.concat(F.lit(":"), F.lpad(F.length(p).cast("string"), 10, "0"), F.lit(":"), p)
    bare = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    number = lambda p: F.when(F.length(bare(p)) > width, longer(bare(p))).otherwise(F.lpad(bare(p), width, "0"))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(p)), "")


def clean_tags(tags: Column) -> Column:
    """Tags trimmed, without blanks, each once in the order of its first."""
    return F.array_distinct(F.filter(F.transform(tags, lambda x: F.trim(x)), lambda t: t != ""))


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"(?U)[^\w.\-]+", "_")


def crop_stem(stem: Column, k: Column) -> Column:
    return F.concat(stem, F.lit("__c"), F.lpad(k.cast("string"), 3, "0"))


def parse_crop_stem(c: Column) -> Column:
    """(stem, k) of a crop's stem, null if it is none."""
    return F.when(c.rlike(r"^.+__c\d+$"), F.struct(F.regexp_extract(c, r"^(.+)__c(\d+)$", 1).alias("stem"), F.regexp_extract(c, r"^(.+)__c(\d+)$", 2).cast("int").alias("k")))


def flag_id(check: Column, variable: Column, stem: Column, idx: Column, row_i: Column) -> Column:
    """The key of a finding. What is missing reads 'None', so that keys of equal findings are equal."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("None")) for c in (check, variable, stem, idx, row_i)])


def page_status(c: Column) -> Column:
    return F.coalesce(F.when(c != "", c), F.lit("predicted"))


def full_text_match(text: Column, query: str) -> Column:
    """Whether a text holds the query, whatever case and accents."""
    return F.coalesce(F.contains(F.lower(unaccent(text)), F.lower(unaccent(F.lit(query)))), F.lit(False))


#: A blank between two single characters of a run of three or more; doubled blanks and line breaks end a run.
SPACED = r"(?<=(?:^|\s)\S \S) (?=\S(?:\s|$))|(?<=(?:^|\s)\S) (?=\S \S(?:\s|$))"


def unspaced(c: Column) -> Column:
    """Letter-spaced print closed up: runs of three or more single characters become one word, blanks between words one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), SPACED, ""), r"\s+", " "))
