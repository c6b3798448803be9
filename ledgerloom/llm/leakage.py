"""Evaluation passages inside training text.

Both sides become streams of letters and digits without case, accents, markup, punctuation, blanks and the
differences between letters that are misread for each other, so that word division and line ends vanish too.
n-grams that are rare among all items are seeds; of `WORDS` words that have too few of them, all n-grams are. Where the
seeds of an item gather on neighbouring diagonals of a document, the seeds are first extended word by word; what is not
a plain copy is aligned by Smith-Waterman in a band around them. A document gives an item away where the alignment covers
at least `WORDS` consecutive words of it; `scored` reports every alignment with what it covers, so that copies edited
word by word are seen too.

Seeds are kept as hashes and looked up for whole batches of documents at once, and a batch's alignments are made together.
Items of up to BROADCAST_LETTERS letters are broadcast as an index (their letters are counted first) and documents are
searched where they lie. More items become a table of seeds that is joined by hash with the documents' n-grams; a filter
of fixed size keeps n-grams of no item from being shuffled, and only documents that share enough seeds with an item are
moved. Either way rarity is counted over all items, and the same pairs are aligned.

Edge cases, all defined: null and empty texts hold nothing; items of fewer than `WORDS` words are not found; items
with equal text are found together; repeated documents give one row per id; long texts are read whole; rows without an
id are left out; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import cut, spread

GRAM, RARE, WORDS = 8, 2, 12
#: Seeds that must lie together, and how far apart their diagonals may be.
TOGETHER, NEAR = 9, 24
#: Letters of all items up to which their index is broadcast: about 60 bytes a letter.
BROADCAST_LETTERS = 4_000_000
#: Bits of the filter of seeds, letters searched at once, and cells of the alignments made at once.
FILTER_BITS, CHUNK, CELLS = 27, 1 << 20, 1 << 22
#: Letters of an item that are aligned at once.
LONG = 4000
# Letters and digits that scans misread for each other.
ALIKE = str.maketrans({"i": "l", "j": "l", "1": "l", "0": "o", "6": "o", "5": "s", "8": "b", "c": "e", "q": "g", "9": "g", "ß": "s", "ı": "l", "ø": "o"})
PAIRS = (("rn", "m"), ("lc", "k"), ("vv", "w"))
#: Tags with their attributes, entities and escapes.
MARKUP = re.compile(r"""</?[A-Za-z][\w:-]*+(?:\s++[\w:-]++\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s<>"']++))*+(?:\s++[\w:-]++){0,2}+\s*+/?>|&#?\w{1,8};|\\[nrt]""")
OTHER = re.compile(r"[\W_]+")
MATCH, MISS, GAP = 2, -2, 2
BASE = np.uint64(0x9E3779B97F4A7C15)


class _Plain(dict):
    """What each character is without case, marks and compatibility forms; nothing for all that is no letter or digit."""

    def __missing__(self, code: int) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if not unicodedata.combining(c))
        self[code] = out = OTHER.sub("", bare)
        return out


PLAIN = _Plain()


def fold(text: str) -> str:
    """The stream of what a text says, without what a scan or an edit of its form may change."""
    t = MARKUP.sub(" ", text).translate(PLAIN)
    for a, b in PAIRS:
        t = t.replace(a, b)
    return t.translate(ALIKE)


def words_of(text: str | None) -> tuple[str, ...]:
    return tuple(w for w in map(fold, (text or "").split()) if w)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(stream: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the n-gram at every position that has one."""
    n = len(stream) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = h * BASE + stream[j : j + n]
    return h ^ (h >> np.uint64(29))


def word_starts(words: tuple[str, ...]) -> list[int]:
    return [0, *accumulate(map(len, words))]


def seed_positions(starts: list[int], rare: np.ndarray) -> np.ndarray:
    """Where an item's seeds stand: its rare n-grams, and all n-grams of `WORDS` words that have fewer than TOGETHER rare ones."""
    take, upto = rare.copy(), np.concatenate([[0], np.cumsum(rare)])
    for a, b in zip(starts, starts[WORDS:]):
        if b - a >= GRAM and upto[b - GRAM + 1] - upto[a] < TOGETHER:
            take[a : b - GRAM + 1] = True
    return np.flatnonzero(take)


class Index:
    """Item texts with the seeds that lead to them: `texts` is a list of (ids, words, seed positions)."""

    def __init__(self, texts: list[tuple[list[int], tuple[str, ...], np.ndarray]]) -> None:
        self.ids = [i for i, _, _ in texts]
        self.starts = [word_starts(w) for _, w, _ in texts]
        self.streams = ["".join(w) for _, w, _ in texts]
        self.coded = [codes(s) for s in self.streams]
        self.far = [max((b - a for a, b in zip(s, s[WORDS:])), default=0) for s in self.starts]
        hashes = [gram_hashes(c)[at] for c, (_, _, at) in zip(self.coded, texts)]
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        k = np.repeat(np.arange(len(texts)), [len(x) for x in hashes]) if hashes else np.empty(0, np.int64)
        q = np.concatenate([at for _, _, at in texts]) if texts else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.seed, first = np.unique(h[order], return_index=True)
        self.k, self.q, self.bounds = k[order].astype(np.int64), q[order].astype(np.int64), np.append(first, len(h)).astype(np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.seed >> np.uint64(44)).astype(np.int64)] = True

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> "Index":
        """The index of items whose rarity is counted among themselves."""
        by_text: dict[tuple[str, ...], list[int]] = {}
        for i, text in items:
            words = words_of(text)
            if len(words) >= WORDS:
                by_text.setdefault(words, []).append(i)
        hashes = [gram_hashes(codes("".join(w))) for w in by_text]
        seen, n = np.unique(np.concatenate([np.unique(h) for h in hashes]), return_counts=True) if hashes else (np.empty(0, np.uint64), np.empty(0, int))
        return cls([(sorted(ids), w, seed_positions(word_starts(w), n[np.searchsorted(seen, h)] <= RARE)) for (w, ids), h in zip(by_text.items(), hashes)])

    def _hits(self, docs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """(doc, k, p, q) of every seed of an item in a document."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ends = np.cumsum([len(d) for d in docs])
        stream = np.concatenate(docs) if docs else np.empty(0, np.uint32)
        for lo in range(0, len(stream), CHUNK):
            h = gram_hashes(stream[lo : lo + CHUNK + GRAM - 1])
            at = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
            if len(at) and len(self.seed):
                s = np.minimum(np.searchsorted(self.seed, h[at]), len(self.seed) - 1)
                ok = self.seed[s] == h[at]
                at, s = at[ok] + lo, s[ok]
                doc = np.searchsorted(ends, at, "right")
                ok = at + GRAM <= ends[doc]
                found.append((doc[ok], at[ok] - (ends[doc[ok]] - np.array([len(docs[d]) for d in doc[ok]], np.int64)), s[ok]))
        if not found:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        doc, p, s = (np.concatenate(x) for x in zip(*found))
        n = self.bounds[s + 1] - self.bounds[s]
        each = np.repeat(self.bounds[s] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(doc, n), self.k[each], np.repeat(p, n), self.q[each]

    def groups(self, docs: list[np.ndarray]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(doc, k, diagonals, q) of the seeds of an item that gather on neighbouring diagonals of a document, enough different ones of them."""
        doc, k, p, q = self._hits(docs)
        d = p - q
        order = np.lexsort((q, d, k, doc))
        doc, k, d, q = doc[order], k[order], d[order], q[order]
        if not len(doc):
            return []
        new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(k) != 0) | (np.diff(d) > NEAR)])
        at = np.append(np.flatnonzero(new), len(doc))
        wide = np.flatnonzero(np.diff(at) >= TOGETHER)
        return [(int(doc[a]), int(k[a]), d[a:b], q[a:b]) for a, b in zip(at[wide], at[wide + 1]) if len(np.unique(q[a:b])) >= TOGETHER]

    def copied(self, k: int, diagonal: int, doc: np.ndarray) -> bool:
        """Whether enough consecutive words stand unchanged on one diagonal."""
        item, starts = self.coded[k], self.starts[k]
        lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
        if hi <= lo:
            return False
        other = np.ones(len(item), np.int32)
        other[lo:hi] = item[lo:hi] != doc[lo + diagonal : hi + diagonal]
        run = 0
        for wrong in np.add.reduceat(other, starts[:-1]).tolist():
            run = 0 if wrong else run + 1
            if run >= WORDS:
                return True
        return False

    def windows(self, group: tuple[int, int, np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(from, to, least, greatest diagonal) of the parts of an item to be aligned: `WORDS` words that hold a seed reach no farther from it than `far`.

        A long stretch is aligned in parts of LONG letters that overlap by `far`, each in the band of its own seeds.
        """
        _, k, d, q = group
        far, a, b = self.far[k], max(0, int(q.min()) - self.far[k]), min(len(self.coded[k]), int(q.max()) + GRAM + self.far[k])
        for at in range(a, b, LONG if b - a > 2 * LONG else b - a):
            x, y = (a, b) if b - a <= 2 * LONG else (max(a, at - far), min(b, at + LONG + far))
            own = d[(q >= x) & (q < y)]
            if len(own):
                yield x, y, int(own.min()) - 2 * NEAR, int(own.max()) + 2 * NEAR

    def align(self, groups: list, docs: list[np.ndarray]) -> Iterator[tuple[tuple, np.ndarray]]:
        """Each group with the partner in the document of every letter of its item, -1 where it has none."""
        sized = sorted(((w[3] - w[2] + 1, w[1] - w[0], n, w) for n, g in enumerate(groups) for w in self.windows(g)))
        partners = [np.full(len(self.coded[g[1]]), -1, np.int64) for g in groups]
        batch: list = []
        rows = 0
        for wide, long, n, w in sized:
            if batch and (len(batch) + 1) * wide * max(rows, long) > CELLS:
                self._aligned(batch, groups, docs, partners)
                batch, rows = [], 0
            batch.append((n, *w))
            rows = max(rows, long)
        if batch:
            self._aligned(batch, groups, docs, partners)
        return zip(groups, partners)

    def _aligned(self, batch: list, groups: list, docs: list[np.ndarray], partners: list[np.ndarray]) -> None:
        left, right, widths = [], [], []
        for n, a, b, lo, hi in batch:
            doc = docs[groups[n][0]]
            take = np.zeros(b - a + hi - lo, np.uint32)
            x, y = max(0, a + lo), max(0, min(len(doc), b + hi))
            take[x - a - lo : max(x, y) - a - lo] = doc[x:y]
            left.append(self.coded[groups[n][1]][a:b])
            right.append(take)
            widths.append(hi - lo + 1)
        for (n, a, b, lo, _), at in zip(batch, smith_waterman(left, right, widths)):
            own = partners[n][a:b]
            own[at >= 0] = at[at >= 0] + a + lo

    def words_held(self, k: int, partner: np.ndarray, doc: np.ndarray) -> tuple[int, int, float]:
        """(consecutive words, words, share of equal letters from the first to the last of them) that an alignment covers."""
        starts, item = self.starts[k], self.coded[k]
        has = partner >= 0
        same = has & (doc[np.maximum(partner, 0)] == item) if len(doc) else has
        n, held_n, equal = np.diff(starts), np.add.reduceat(has, starts[:-1], dtype=np.int64), np.add.reduceat(same, starts[:-1], dtype=np.int64)
        # Of a word of three letters or fewer one misread letter is half of it: that it is aligned is enough.
        held = (10 * equal >= 6 * n) | ((n <= 3) & (held_n > 0))
        best = run = 0
        last = None
        for w, ok in enumerate(held.tolist()):
            at = partner[starts[w] : starts[w + 1]]
            at = at[at >= 0]
            if ok and last is not None and len(at) and at[0] - last > 2 * NEAR:
                run = 0
            run = run + 1 if ok else 0
            last = int(at[-1]) if len(at) else last
            best = max(best, run)
        which = np.flatnonzero(held)
        share = float(same[starts[which[0]] : starts[which[-1] + 1]].mean()) if len(which) else 0.0
        return best, len(which), share

    def found(self, texts: list[str]) -> set[tuple[int, int]]:
        """(place of the text, k) of the texts that hold enough consecutive words of an item."""
        docs = [codes(fold(t)) for t in texts]
        every = self.groups(docs)
        out = {(d, k) for d, k, diagonals, _ in every if any(self.copied(k, x, docs[d]) for x in np.unique(diagonals).tolist())}
        for (d, k, _, _), partner in self.align([g for g in every if g[:2] not in out], docs):
            if (d, k) not in out and self.words_held(k, partner, docs[d])[0] >= WORDS:
                out.add((d, k))
        return out

    def scores(self, texts: list[str]) -> dict[tuple[int, int], tuple[int, float]]:
        """(place of the text, k) -> (words, score) of the best alignment of each item that covers `WORDS` words, consecutive or not."""
        docs = [codes(fold(t)) for t in texts]
        best: dict[tuple[int, int], tuple[int, float]] = {}
        for (d, k, _, _), partner in self.align(self.groups(docs), docs):
            _, words, share = self.words_held(k, partner, docs[d])
            if words >= WORDS:
                best[d, k] = max(best.get((d, k), (0, 0.0)), (words, round(share, 6)))
        return best


def smith_waterman(left: list[np.ndarray], right: list[np.ndarray], widths: list[int]) -> list[np.ndarray]:
    """For each letter of every `left` its partner in `right` in the best local alignment, -1 if it has none.

    Letter i may meet the letters from i to i + width - 1. All pairs are aligned side by side, one row of letters at a time.
    """
    t, n, w = len(left), max(map(len, left)), max(widths)
    kind = np.int16 if MATCH * n + GAP * w < 32_000 else np.int32
    a, b = np.full((n, t), 0xFFFFFFFF, np.uint32), np.zeros((n + w, t), np.uint32)
    for k, (x, y) in enumerate(zip(left, right)):
        y = y[: len(x) + widths[k] - 1]
        a[: len(x), k], b[: len(y), k] = x, y
    inside = (np.arange(w)[:, None] < np.array(widths)).astype(kind)
    h = np.zeros((n + 1, w + 1, t), kind)
    slope = (np.arange(w, dtype=kind) * GAP)[:, None]
    row, up = np.empty((w, t), kind), np.empty((w, t), kind)
    for i in range(n):
        np.multiply(b[i : i + w] == a[i], kind(MATCH - MISS), out=row, casting="unsafe")
        row += h[i, :w]
        row += kind(MISS)
        np.subtract(h[i, 1:], kind(GAP), out=up)
        np.maximum(row, up, out=row)
        np.maximum(row, 0, out=row)
        row += slope
        # The running maximum along a row, by doubled steps.
        step = 1
        while step < w:
            np.maximum(row[step:], row[:-step], out=row[step:])
            step *= 2
        row -= slope
        np.multiply(row, inside, out=h[i + 1, :w])
    # The first of the best cells, by letter of `left` and then of `right`.
    top = h.max(axis=1)
    i = top.argmax(axis=0)
    at = np.arange(t)
    j = h[i, :, at].argmax(axis=1)
    partner = np.full((t, n), -1, np.int64)
    while True:
        here = h[i, j, at]
        live = (here > 0) & (i > 0)
        if not live.any():
            break
        at, i, j, here = at[live], i[live], j[live], here[live]
        straight = here == h[i - 1, j, at] + np.where(a[i - 1, at] == b[i - 1 + j, at], MATCH, MISS)
        over = ~straight & (here == h[i - 1, j + 1, at] - GAP)
        partner[at[straight], i[straight] - 1] = (i + j - 1)[straight]
        i = i - (straight | over)
        j = j + over - ~(straight | over)
    return [partner[k, : len(x)] for k, x in enumerate(left)]


def _searched(docs: DataFrame, index, search: str, schema: str) -> DataFrame:
    """The rows of `schema` (item_id, doc_id and what the method `search` of an Index gives) for all documents, where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator):
        import pandas as pd

        for b in batches:
            ids, texts = b["doc_id"].tolist(), b["text"].tolist()
            hits = getattr(shared.value, search)(texts)
            yield pd.DataFrame([(i, ids[d], *(hits[d, k] if isinstance(hits, dict) else ())) for d, k in sorted(hits) for i in shared.value.ids[k]], columns=names)

    return docs.mapInPandas(run, schema)


def _item_seeds(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, ids) and (k, words, seeds, hashes) of the different item texts, rarity counted over all of them."""

    def read(batches: Iterator):
        for b in batches:
            b["words"] = [list(words_of(t)) for t in b["text"]]
            yield b[["item_id", "words"]]

    folded = wanted.mapInPandas(read, "item_id bigint, words array<string>").where(F.size("words") >= WORDS)
    texts = cut(folded.groupBy("words").agg(F.min("item_id").alias("k"), F.sort_array(F.collect_set("item_id")).alias("ids")))

    def grams(batches: Iterator):
        import pandas as pd

        for b in batches:
            hashes = [gram_hashes(codes("".join(w))).view(np.int64) for w in b["words"]]
            yield pd.DataFrame({"k": np.repeat(b["k"].to_numpy(), [len(h) for h in hashes]), "q": np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else [], "h": np.concatenate(hashes) if hashes else []}).astype({"q": "int32", "h": "int64"})

    each = texts.select("k", "words").mapInPandas(grams, "k bigint, q int, h bigint")
    counted = each.select("k", "h").distinct().groupBy("h").agg(F.count("*").alias("n"))
    rare = each.join(counted, "h").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("q", (F.col("n") <= RARE).alias("rare")))).alias("g"))

    def choose(batches: Iterator):
        import pandas as pd

        for b in batches:
            out = []
            for k, words, flags in zip(b["k"], b["words"], b["rare"]):
                at = seed_positions(word_starts(tuple(words)), np.array(flags, bool))
                out.append((k, list(words), at.astype(np.int32), gram_hashes(codes("".join(words))).view(np.int64)[at]))
            yield pd.DataFrame(out, columns=["k", "words", "seeds", "hashes"])

    chosen = texts.select("k", "words").join(rare.select("k", F.col("g.rare").alias("rare")), "k").mapInPandas(choose, "k bigint, words array<string>, seeds array<int>, hashes array<bigint>")
    return texts.select("k", "ids"), cut(chosen)


def _joined(docs: DataFrame, wanted: DataFrame, search: str, schema: str) -> DataFrame:
    """As `_searched`, for items of any number: seeds and n-grams of documents are joined by hash."""
    ids, seeds = _item_seeds(wanted)
    bits = FILTER_BITS - 6
    by_hash = seeds.select("k", F.explode("hashes").alias("h"))
    place = lambda h: F.shiftrightunsigned(h, 64 - bits)
    # At most 2^21 words of 64 bits, whatever the number of items.
    filled = by_hash.groupBy(place(F.col("h")).cast("bigint").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b")).toPandas()
    words = np.zeros(1 << bits, np.uint64)
    words[filled["at"].to_numpy(np.int64)] = filled["b"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def emit(batches: Iterator):
        import pandas as pd

        for b in batches:
            for i, t in zip(b["doc_id"], b["text"]):
                stream = codes(fold(t))
                for lo in range(0, max(1, len(stream)), CHUNK):
                    h = gram_hashes(stream[lo : lo + CHUNK + GRAM - 1])
                    h = h[(shared.value[(h >> np.uint64(64 - bits)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1]
                    yield pd.DataFrame({"doc_id": i, "h": h.view(np.int64)}).astype({"doc_id": "int64"})

    met = docs.mapInPandas(emit, "doc_id bigint, h bigint").join(by_hash, "h").groupBy("doc_id", "k").agg(F.count("*").alias("n")).where(F.col("n") >= TOGETHER).select("doc_id", "k")
    rows = docs.join(met, "doc_id").join(seeds.select("k", "words", "seeds"), "k")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def judge(batches: Iterator):
        import pandas as pd

        for b in batches:
            items = b.drop_duplicates("k")
            index = Index([([int(k)], tuple(w), np.array(s, np.int64)) for k, w, s in zip(items["k"], items["words"], items["seeds"])])
            texts = b.drop_duplicates(["doc_id", "text"])
            own = texts["doc_id"].tolist()
            hits = getattr(index, search)(texts["text"].tolist())
            yield pd.DataFrame([(index.ids[k][0], own[d], *(hits[d, k] if isinstance(hits, dict) else ())) for d, k in sorted(hits)], columns=["k", *names[1:]])

    out = rows.mapInPandas(judge, schema.replace("item_id", "k", 1))
    return out.join(ids, "k").select(F.explode("ids").alias("item_id"), *names[1:])


def _pairs(documents: DataFrame, items: DataFrame, search: str, schema: str, most: int) -> DataFrame:
    docs = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null"))
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    if size <= most:
        return _searched(docs, Index.of([(r.item_id, r.text) for r in wanted.collect()]), search, schema)
    return _joined(docs, wanted, search, schema)


def leaks(documents: DataFrame, items: DataFrame, most: int = BROADCAST_LETTERS) -> DataFrame:
    """(item_id, doc_id) of every document that holds at least `WORDS` consecutive words of an item."""
    return _pairs(documents, items, "found", "item_id bigint, doc_id bigint", most).distinct()


def scored(documents: DataFrame, items: DataFrame, most: int = BROADCAST_LETTERS) -> DataFrame:
    """(item_id, doc_id, words, score): the words of the item that its best alignment with the document covers, consecutive or not, and the share of
    equal letters from the first to the last of them. Pairs with at least `WORDS` words; a copy in which single words were changed is among them."""
    s = _pairs(documents, items, "scores", "item_id bigint, doc_id bigint, words int, score double", most)
    return s.groupBy("item_id", "doc_id").agg(F.max(F.struct("words", "score")).alias("s")).select("item_id", "doc_id", "s.words", "s.score")
