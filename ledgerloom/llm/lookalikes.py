"""Visually identical text with different characters, brought to one form.

Words that are plain by themselves (single accented letters, one script, nothing unseen, no compatibility forms) form
vocabulary tries. A weighted edit automaton runs along a trie for every word that may not be plain: characters that cannot
be seen cost nothing to drop, look-alike letters, other blanks and hyphens, compatibility forms and split accents cost
nothing to exchange, everything else costs 1. What a word reaches within the budget (0: what looks the same) are its
canonical spellings; itself is taken if it is among them, else the one in the script most of its letters are of, then the one
of the most occurrences. The automaton thus decides for every word that the vocabulary has; only words that reach no
spelling are normalised by table.

Tries are built for buckets of words that share what they look like, so each task holds one small trie at a
time and nothing is broadcast.

Edge cases, all defined: null and empty values are no cases and stay as they are; doubled blanks, typographic
quotes and dashes and words wholly in another script stay as they are; repeated rows give one row; a very long
value is just many words; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like the Latin letter after them.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ғ": "F",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ɡ": "g", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "Ӏ": "I",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "β": "b", "η": "n", "ε": "e", "σ": "o", "ω": "w",
}
ARMENIAN = {"ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ռ": "n", "զ": "q", "յ": "j", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L"}
LATIN = {"ɡ": "g", "ı": "i", "ɑ": "a", "ɩ": "i", "ʏ": "y", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ſ": "s", "ǃ": "!"}
HYPHENS = "‐‑­﹣－⁃˗"
#: Characters that are kept although they have a compatibility form.
KEPT = "…„“”‚‘’«»‹›–—―−"
TO_LATIN = CYRILLIC | GREEK | ARMENIAN | LATIN
TO_CYRILLIC = {v: k for k, v in reversed(list(CYRILLIC.items())) if k not in "ɡ"}
TO_GREEK = {v: k for k, v in reversed(list(GREEK.items()))}
#: What surely needs no look: everything else makes a word a suspect.
SURE_CHARS = r"\x21-\x7e¡§«°±¶»¿-İĴ-ľŁ-ňŊ-ž–—‘-„…−"
SURE = f"^[{SURE_CHARS}]*$"
CLEAN = re.compile(f"[ {SURE_CHARS}]*")
FIELDS = ("field", "row_key", "shape_idx")


def script(c: str) -> str:
    o = ord(c)
    if not c.isalpha():
        return ""
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0x250 <= o < 0x2B0 or 0x1D00 <= o < 0x1D80 or 0xA720 <= o < 0xA800:
        return "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    return "armenian" if 0x530 <= o < 0x590 else "other"


def unseen(c: str) -> bool:
    """Whether a character leaves no mark."""
    o = ord(c)
    return unicodedata.category(c) in ("Cf", "Cc") and c not in "\t\n\r" or o == 0x34F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or 0x180B <= o <= 0x180D or o in (0x115F, 0x1160, 0x3164, 0xFFA0)


def flat(c: str) -> str:
    """The character without what its compatibility form or kind of blank or hyphen adds."""
    if c in "\t\n\r" or c in KEPT:
        return c
    if c in HYPHENS:
        return "" if c == "­" else "-"
    if unseen(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    return unicodedata.normalize("NFKC", c) if unicodedata.normalize("NFKD", c) != unicodedata.normalize("NFD", c) else c


def is_plain(word: str) -> bool:
    """Whether a word is written with nothing but what it shows: the vocabulary's condition."""
    if CLEAN.fullmatch(word):
        return True
    if not unicodedata.is_normalized("NFC", word) or any(flat(c) != c for c in word):
        return False
    scripts = {script(c) for c in word} - {""}
    return len(scripts) < 2 and not ("latin" in scripts and any(c in LATIN for c in word))


def by_table(word: str) -> str:
    """The plain form of a word: no unseen characters, one script, single accented letters."""
    if CLEAN.fullmatch(word):
        return word
    bare = unicodedata.normalize("NFC", "".join(flat(c) for c in word))
    return " ".join(_one_script(w) for w in bare.split(" "))


def _one_script(word: str) -> str:
    counts: dict[str, int] = {}
    for c in word:
        if s := script(c):
            counts[s] = counts.get(s, 0) + 1
    word = "".join(LATIN.get(c, c) for c in word) if counts.get("latin") else word
    if len(counts) < 2:
        return word
    for target, table in sorted((("latin", TO_LATIN), ("cyrillic", TO_CYRILLIC), ("greek", TO_GREEK)), key=lambda t: -counts.get(t[0], 0)):
        fits = "".join(_exchange(c, target, table) for c in word)
        if len({script(c) for c in fits} - {""}) == 1:
            return unicodedata.normalize("NFC", fits)
    return word


def _exchange(c: str, target: str, table: dict[str, str]) -> str:
    if script(c) in ("", target):
        return c
    d = unicodedata.normalize("NFD", c)
    head = TO_LATIN.get(d[0], d[0]) if target != "latin" else d[0]
    return unicodedata.normalize("NFC", table.get(head, d[0]) + d[1:])


def looks(word: str) -> str:
    """A key that all words which look the same share."""
    d = unicodedata.normalize("NFD", "".join(flat(c) for c in word))
    return "".join(TO_LATIN.get(c, c) for c in d)


class Trie:
    """A vocabulary, and what an edit automaton reaches in it."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, n: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", word):
            node = node.setdefault(c, {})
        node.setdefault("", []).append((n, word))

    def reach(self, word: str, budget: int = 0) -> list[tuple[int, int, str]]:
        """(cost, occurrences, spelling) of all words within the budget."""
        cells = unicodedata.normalize("NFD", "".join(flat(c) for c in word))
        live: list[tuple[dict, int]] = [(self.root, 0)]
        for c in cells:
            nxt: dict[int, tuple[dict, int]] = {}

            def go(node: dict, cost: int, nxt: dict = nxt) -> None:
                if cost <= budget and (id(node) not in nxt or nxt[id(node)][1] > cost):
                    nxt[id(node)] = (node, cost)

            seen = TO_LATIN.get(c, c)
            for node, cost in live:
                for edge, child in node.items():
                    if edge:
                        go(child, cost + (edge != c and TO_LATIN.get(edge, edge) != seen))
                if budget:
                    go(node, cost + 1)
            live = list(nxt.values())
            if not live:
                return []
        return [(cost, n, w) for node, cost in live for n, w in node.get("", ())]


def main_script(word: str) -> str:
    """The script most letters of a word are of; Latin before others where they are as many."""
    counts: dict[str, int] = {}
    for c in word:
        if s := script(c):
            counts[s] = counts.get(s, 0) + 1
    return min(counts, key=lambda s: (-counts[s], s != "latin", s), default="")


def canonical(word: str, trie: Trie, budget: int = 0) -> str:
    """The spelling of the vocabulary that a word reaches, by the table if it reaches none."""
    reached = trie.reach(word, budget)
    if not reached:
        return by_table(word)
    if len(reached) == 1:
        return reached[0][2]
    own = main_script(word)
    return min(reached, key=lambda x: (x[0], x[2] != word, main_script(x[2]) != own, -x[1], x[2]))[2]


def _words(values: DataFrame) -> DataFrame:
    """(keys, pos, word) of all values, split at ordinary blanks."""
    v = values.where(F.col("value").isNotNull() & (F.col("value") != ""))
    return v.select(*FIELDS, F.posexplode(F.split("value", " ")).alias("pos", "word"))


def suspect(word: Column) -> Column:
    return ~word.rlike(SURE)


def spellings(values: DataFrame, buckets: int = 1 << 16) -> DataFrame:
    """(word, canonical) of every suspect word of `values` (field, row_key, shape_idx, value)."""
    counted = _words(values).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).withColumn("suspect", suspect(F.col("word")))

    def key(batches: Iterator):
        for b in batches:
            b["looks"] = [w if not s and w.isascii() else looks(w) for w, s in zip(b["word"], b["suspect"])]
            b["plain"] = [not s or is_plain(w) for w, s in zip(b["word"], b["suspect"])]
            yield b

    keyed = counted.mapInPandas(key, "word string, n bigint, suspect boolean, looks string, plain boolean")
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("looks"), F.lit(buckets)))
    keyed = keyed.repartition("bucket").sortWithinPartitions("bucket").drop("looks")

    def match(batches: Iterator):
        import pandas as pd

        at, trie, waiting = None, Trie(), []

        def settled() -> list:
            return [(w, canonical(w, trie)) for w in waiting]

        for b in batches:
            out = []
            for word, n, sus, plain, bucket in zip(b["word"], b["n"], b["suspect"], b["plain"], b["bucket"]):
                if bucket != at:
                    out += settled()
                    at, trie, waiting = bucket, Trie(), []
                if plain:
                    trie.add(word, n)
                if sus:
                    waiting.append(word)
            yield pd.DataFrame(out, columns=["word", "canonical"])
        yield pd.DataFrame(settled(), columns=["word", "canonical"])

    return keyed.mapInPandas(match, "word string, canonical string")


def found(values: DataFrame) -> DataFrame:
    """(field, row_key, shape_idx) of the values that are not their plain form."""
    changed = spellings(values).where("canonical <> word").select("word")
    return _words(values).where(suspect(F.col("word"))).join(changed, "word", "left_semi").select(*FIELDS).distinct()


def normalized(values: DataFrame) -> DataFrame:
    """(field, row_key, shape_idx, value, plain): the one form of every value, in which equal-looking texts are equal."""
    forms = spellings(values)
    v = values.distinct()
    odd = v.where(F.col("value").isNotNull() & F.exists(F.split("value", " "), suspect))
    w = odd.select(*FIELDS, "value", F.posexplode(F.split("value", " ")).alias("pos", "word"))
    w = w.join(forms, "word", "left").groupBy(*FIELDS, "value").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("canonical", "word").alias("w")))).alias("ws"))
    fixed = w.select(*FIELDS, "value", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("plain"))
    rest = v.where(F.col("value").isNull() | ~F.exists(F.split("value", " "), suspect)).select(*FIELDS, "value", F.col("value").alias("plain"))
    return fixed.unionByName(rest)


def values_of(identities: DataFrame, boxes: DataFrame) -> DataFrame:
    """The name_hu of the records and the human text of the boxes as (field, row_key, shape_idx, value)."""
    names = identities.select(F.lit("name_hu").alias("field"), F.col("record_id").alias("row_key"), F.lit(-1).alias("shape_idx"), F.col("name_hu").alias("value"))
    human = boxes.where("kind = 'shape'").select(F.lit("human").alias("field"), F.col("save_id").alias("row_key"), "shape_idx", F.col("human").alias("value"))
    return names.unionByName(human)
