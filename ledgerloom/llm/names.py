"""What a firm's name says: the word or owner it is known by, line of business, seat, given name, kind of owners.

Names are brought to one form first (lookalikes), then to one phonetic alphabet, so that Hungarian, German and
Cyrillic spellings of a word come close. Words that many names share are told by table, with the edits that
misprints need; what is left over is the name's own word.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from ledgerloom.llm.lookalikes import by_table

# Words of a line of business, Hungarian and German, full and short.
BUSINESS = {
    "mill": "gozmalom gozm malom dampfmuhle dampfm muhle",
    "brick": "teglagyar teglagy ziegelfabrik ziegeleifabrik ziegelei ziegelfbk",
    "sugar": "cukorgyar czukorgyar czgyar cukorgy czukorgy zuckerfabrik zuckerfbk",
    "credit": "hitelbank hitelb creditbank kreditbank",
    "savings": "takarekpenztar takptar tkptar takpenzt takarekpenzt sparcassa sparkassa sparcasse sparkasse",
    "insurance": "biztosito bizt assecuranz assekuranz versicherung",
    "print": "konyvnyomda kvnyomda nyomda buchdruckerei buchdr",
    "spin": "fonoda fonogyar spinnerei spinn spinnereifabrik",
    "beer": "sorfozde sorf sorgyar bierbrauerei brauerei",
    "spirit": "szeszgyar szeszfozde szeszgy spiritusfabrik spiritusfbk branntweinbrennerei",
    "machine": "gepgyar gepgy maschinenfabrik maschfabrik maschinenfbk",
    "rail": "vasut vaspalya eisenbahn bahn",
}
# Kinds of owners, and words that tell firms apart in no way.
OWNERS = {
    "sons": "fiai sohne",
    "widow": "ozvegye ozv witwe wwe",
    "bros": "testverek testv gebruder gebr bruder",
    "comp": "tarsa tsa comp compagnie",
}
COMMON = (
    "reszvenytarsasag reszvenytarsulat rt reszv actiengesellschaft aktiengesellschaft aktienges actienges ag egylet egyl egyesulet verein ver szovetkezet szov szovetk "
    "genossenschaft genossensch gen beteti tarsasag tars bet commanditgesellschaft commges kozkereseti kozker kkt egyeni czeg ceg einzelfirma offene off handelsgesellschaft handelsges als mint "
    "nepies kozos uj egyesult altalanos keruleti elso volks bezirks vereinigte neue allgemeine gemeinsame erste es und in lasd ott l ifj id dr gyar fabrik parni mlin stedionica knjizara knizsara sinovi sinovi jun sen"
)
# Given names as Hungarian, German and familiar forms of one name.
GIVEN = (
    "lajos ludwig lajcsi lali", "odon edmund odi", "janos johann jancsi jani", "henrik heinrich heni", "karoly karl karcsi", "david davidka dodi", "istvan stefan pista", "jozsef josef joska", "gyorgy georg gyuri",
    "vilmos wilhelm vili", "terez therese trezsi", "erzsebet elisabeth erzsi", "mihaly michael misi miska", "antal anton toni", "peter peti", "zsigmond sigmund zsiga", "ferencz ferenc franz feri", "benedek benedikt bene",
)
SIZES = "also felso kis nagy uj szent o unter ober klein gross neu sankt alt".split()
SERBIAN = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "ђ": "gy", "е": "e", "ж": "zs", "з": "z", "и": "i", "ј": "j", "к": "k", "л": "l", "љ": "ly", "м": "m", "н": "n", "њ": "ny", "о": "o", "п": "p", "р": "r", "с": "sz", "т": "t", "ћ": "ty", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "cs", "џ": "dzs", "ш": "s"}
#: Sounds that are written in several ways, as one letter each, the longest first.
SOUNDS = (("tsch", "c"), ("sch", "x"), ("cs", "c"), ("zs", "x"), ("sz", "s"), ("gy", "q"), ("dj", "q"), ("ny", "w"), ("nj", "w"), ("ly", "j"), ("ts", "c"), ("y", "i"), ("ck", "k"), ("w", "v"))


class _Bare(dict):
    """What each lower-case character is without accents, in Latin letters."""

    def __missing__(self, code: int) -> str:
        kd = unicodedata.normalize("NFKD", SERBIAN.get(chr(code), chr(code)))
        self[code] = out = "".join(c for c in kd if not unicodedata.combining(c)).replace("ß", "ss")
        return out


BARE = _Bare()


def plain(text: str) -> str:
    """Lower case without accents, Cyrillic in Latin letters."""
    return by_table(text).lower().translate(BARE)


def sound(word: str) -> str:
    w = word.replace("1", "l").replace("0", "o")
    w = w.replace("ny", "\x01").replace("nj", "\x01")
    for a, b in SOUNDS:
        if a not in ("ny", "nj"):
            w = w.replace(a, b)
    w = w.replace("\x01", "w")
    return re.sub(r"(.)\1+", r"\1", w)


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein in a band of `most` on either side of the diagonal; most + 1 if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        if lo == 1:
            new[0] = i
        least = most + 1
        for j in range(lo, hi + 1):
            d = row[j - 1] + (x != b[j - 1])
            if row[j] + 1 < d:
                d = row[j] + 1
            if new[j - 1] + 1 < d:
                d = new[j - 1] + 1
            new[j] = d
            if d < least:
                least = d
        if least > most:
            return most + 1
        row = new
    return min(row[len(b)], most + 1)


def _table() -> dict[str, tuple[str, str]]:
    t: dict[str, tuple[str, str]] = {w: ("common", "") for w in COMMON.split()}
    t |= {w: ("business", k) for k, v in BUSINESS.items() for w in v.split()}
    t |= {w: ("owners", k) for k, v in OWNERS.items() for w in v.split()}
    t |= {w: ("given", v.split()[0]) for v in GIVEN for w in v.split()}
    return t


TABLE = _table()
LONG = [w for w in TABLE if len(w) >= 5]


def letters(word: str) -> int:
    """The set of a word's letters as bits."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


def borne(word: str) -> int:
    """Edits that a misprint of a table word may be away."""
    return 2 if len(word) >= 8 else 1


#: The table's long words by their length, with their letters and their place in the table.
BY_LENGTH: dict[int, list[tuple[int, int, str]]] = {}
for _n, _w in enumerate(LONG):
    BY_LENGTH.setdefault(len(_w), []).append((_n, letters(_w), _w))


def near(word: str, most: int) -> list[str]:
    """The table's long words that may be within `most` edits and what they bear, in the order of the table: an edit brings in and takes out at most one letter."""
    has, out = letters(word), []
    for n in range(len(word) - most, len(word) + most + 1):
        for place, own, w in BY_LENGTH.get(n, ()):
            k = min(most, borne(w))
            if abs(n - len(word)) <= k and (has & ~own).bit_count() <= k and (own & ~has).bit_count() <= k:
                out.append((place, w))
    return [w for _, w in sorted(out)]


@lru_cache(200_000)
def told(word: str) -> tuple[str, str] | None:
    """What the table says of a word, with one edit from five letters on and two from eight: the first of its words that is near enough."""
    word = word.replace("1", "l").replace("0", "o")
    if word in TABLE:
        return TABLE[word]
    if len(word) < 5 or len(word) > 40:
        return None
    for w in near(word, 2):
        k = borne(w)
        if edit_distance(word, w, k) <= k:
            return TABLE[w]
    r = word.replace("rn", "m").replace("lc", "k")
    if r != word:
        for w in near(r, 1):
            if TABLE[w][0] == "business" and len(w) >= 8 and edit_distance(r, w, 1) <= 1:
                return TABLE[w]
    return None


class Seats:
    """The seats of the gazetteer with their adjectives in both languages; one edit away is found too."""

    def __init__(self, names: list[tuple[str, str]]) -> None:
        self.exact: dict[str, str] = {}
        self.near: dict[str, str] = {}
        for name, seat in sorted(names):
            k = sound(re.sub(r"[^a-z]", "", plain(name)))
            if len(k) > 3:
                self.exact.setdefault(k, seat)
        for k, seat in self.exact.items():
            for i in range(len(k)):
                self.near.setdefault(k[:i] + k[i + 1 :], seat)
        self.of: dict[str, list[str]] = {}
        for k, seat in self.exact.items():
            self.of.setdefault(seat, []).append(k)
        self.find = lru_cache(100_000)(self._find)
        self.is_form = lru_cache(100_000)(self._is_form)

    def _is_form(self, word: str, seat: str | None) -> bool:
        """Whether a word is one of the seat's names or adjectives, up to two misprints."""
        return any(edit_distance(word, k + end, 2) <= (2 if len(k) >= 6 else 1) for k in self.of.get(seat or "", ()) for end in ("", "i", "er", "ban"))

    def _find(self, word: str) -> str | None:
        w = sound(re.sub(r"[^a-z]", "", word))
        forms = [w]
        for end in ("i", "er", "ban", "ben", "on", "en", "n", "oni"):
            if w.endswith(end) and len(w) - len(end) > 3:
                forms.append(w[: -len(end)])
        for f in forms:
            if f in self.exact:
                return self.exact[f]
        for f in forms:
            if len(f) >= 7:
                if f in self.near:
                    return self.near[f]
                for i in range(len(f)):
                    g = f[:i] + f[i + 1 :]
                    if g in self.exact:
                        return self.exact[g]
                    if len(f) >= 8 and g in self.near:
                        return self.near[g]
        return None


def parse(name: str, seats: Seats) -> dict | None:
    """words (sounds of the name's own words), business, seat, given, owners of one name; None if it says nothing."""
    p = plain(name)
    p = re.sub(r"\(.*?\)?$", " ", p) if "lasd" in p else p
    p = re.sub(r"[’'`´]s\w{0,2}che[nrs]?\b", "", p)
    raw = [w for w in re.split(r"[^\w.\-]+", p) if w.strip(".-_")]
    words: list[str] = []
    k = 0
    while k < len(raw):
        w = raw[k]
        bare = re.sub(r"[^a-z0-9]", "", w)
        if bare in SIZES and k + 1 < len(raw) and (bare not in ("uj",) or seats.find(bare + raw[k + 1])):
            joined = bare + raw[k + 1]
            if seats.find(joined):
                words.append(joined)
                k += 2
                continue
        words.append(w)
        k += 1
    out = {"business": None, "seat": None, "given": None, "owners": None}
    own: list[str] = []
    k = 0
    while k < len(words):
        w = words[k]
        bare = re.sub(r"[^a-z0-9]", "", w)
        nxt = re.sub(r"[^a-z0-9]", "", words[k + 1]) if k + 1 < len(words) else ""
        says = TABLE.get(bare)
        if says is None or says[0] == "common":
            both = TABLE.get(bare + nxt) if nxt else None
            if both is None and nxt and len(bare) >= 2 and len(bare + nxt) >= 7 and not (says or TABLE.get(nxt)):
                t = told(bare + nxt)
                both = t if t and t[0] == "business" else None
            if both and both[0] == "business":
                out["business"] = out["business"] or both[1]
                k += 2
                continue
        if says is None:
            says = told(bare)
        if says is None and len(bare) == 1 and w.endswith("."):
            out["given"] = out["given"] or bare
        elif says is None or says[0] == "common" and len(bare) > 5 and seats.find(bare) and bare not in TABLE:
            seat = seats.find(bare)
            if seat:
                out["seat"] = out["seat"] or seat
            elif len(bare) >= 4:
                own.append(bare)
        elif says[0] != "common":
            out[says[0]] = out[says[0]] or says[1]
        k += 1
    out["words"] = [x for w in own if len(x := sound(w)) >= 4]
    return out if out["words"] or out["business"] or out["seat"] else None


def written_out(seat: str) -> str:
    """A seat's name with its short first part written out."""
    p = plain(seat)
    for full, short in (("nagy", "n"), ("kis", "k"), ("also", "a"), ("felso", "f"), ("szent", "sz"), ("uj", "u")):
        p = re.sub(rf"^{short}\.\s*-?\s*(?=[a-z])", full, p)
    return re.sub(r"\s+(v|vm|m|kozseg|varos|mvaros|rtv|kgs)\.?$", "", p.strip())
