"""Parsers of a printed register: dates, citations, folios, events, roman numerals. All are column expressions.

A text is cut into tokens (ISO dates, runs of letters, runs of digits, single marks; points and blanks part tokens and are
dropped), each token is told what it can be (year, number, month, volume, words that name an issue), and a parser picks the
first place where the tokens it needs stand side by side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import unaccent, unspaced

# The months' names and short forms as the registers print them, accents left out.
MONTHS = (
    "januar jan", "februar febr feb", "marczius martius marcius marcz marc mart", "aprilis apr", "majus maj", "junius jun", "julius jul", "augusztus aug",
    "szeptember september szept sept szep", "oktober october okt oct", "november nov", "deczember december decz dec",
)
# Verbs that tell what happened, by kind of event; the first kind of which a verb stands in the text counts.
EVENTS = {
    "deleted": "toroltetett kitoroltetett torlese kitorlese megszunt megszunese megszuntnek",
    "transferred": "atvezettetett atvezetes athelyeztetett",
    "bankruptcy": "csod",
    "dissolved": "feloszlott feloszlat felszamolas_ala",
    "changed": "bejegyeztetett bejegyeztetik kilepett belepett modosit valtoz elhalalozas meghalt atalakult",
}
# Words that point at the entry printed before.
BEFORE = ("elobbi", "elozo", "fennebbi", "fentebbi", "fenti")
NUMERALS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
TOKEN = r"\b\d{4}-\d\d(?:-\d\d)?\b|[a-z]+|\d+|[^\s.\w]"


def printed(c: Column) -> Column:
    """Lower case without accents, letter-spacing and words broken at a line end closed up."""
    return F.lower(F.regexp_replace(unaccent(unspaced(c)), r"(?U)(\w)-\s+(\w)", "$1$2"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(printed(c), F.lit(TOKEN), 0)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def _first(toks: Column, says: Callable[[Callable[[int], Column], Column], Column]) -> Column:
    """What `says` makes of the first place where it isn't null; it is given the tokens from that place on by their distance."""
    places = F.transform(toks, lambda _, i: says(lambda k: F.get(toks, i + k)))
    return F.try_element_at(F.filter(places, lambda x: x.isNotNull()), F.lit(1))


def _is_year(t: Column) -> Column:
    return t.rlike(r"^\d{4}$") & t.between("1600", "2099")


def _number(t: Column, digits: int) -> Column:
    return F.when(t.rlike(rf"^\d{{1,{digits}}}$"), t.cast("int"))


def month(word: Column) -> Column:
    """The month a word names: it begins with a short form of three letters, or with a longer form, or is the beginning of one."""
    heads, long = {}, {}
    for k, forms in enumerate(MONTHS, 1):
        for f in forms.split():
            if len(f) == 3:
                heads[f] = k
            else:
                long.setdefault(f[:3], (k, []))[1].append(f)
    by_head = F.create_map(*[F.lit(x) for kv in heads.items() for x in kv])
    by_form = F.create_map(*[x for h, (k, forms) in long.items() for x in (F.lit(h), F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, forms)).alias("forms")))])
    head = F.left(word, F.lit(3))
    named = F.try_element_at(by_form, head)
    fits = F.exists(named["forms"], lambda f: F.startswith(word, f) | F.startswith(f, word))
    return F.when(F.length(word) >= 3, F.coalesce(F.try_element_at(by_head, head), F.when(fits, named["k"])))


def _dated(year: Column, mon: Column, day: Column) -> Column:
    two = lambda n: F.format_string("%02d", n)
    return F.when(mon.isNull(), year).when(day.between(1, 31), F.concat_ws("-", year, two(mon), two(day))).otherwise(F.concat_ws("-", year, two(mon)))


def partial_date(c: Column) -> Column:
    """A date as far as it is printed: YYYY, YYYY-MM or YYYY-MM-DD; null without a year."""

    def iso(at) -> Column:
        part = F.split(at(0), "-")
        mon, day = F.get(part, 1).try_cast("int"), F.get(part, 2).try_cast("int")
        return F.when(at(0).contains("-") & _is_year(F.get(part, 0)) & mon.between(1, 12), _dated(F.get(part, 0), mon, day))

    def worded(at) -> Column:
        """A year with a word behind it; 'évi' before and 'hó' behind the month's name are passed over."""
        word = lambda t: t.rlike("^[a-z]{3,}$")
        skip = (at(1) == "evi") & F.coalesce(word(at(2)), F.lit(False))
        name, behind, later = F.when(skip, at(2)).otherwise(at(1)), F.when(skip, at(3)).otherwise(at(2)), F.when(skip, at(4)).otherwise(at(3))
        return F.when(_is_year(at(0)) & word(name), _dated(at(0), month(name), _number(F.when(behind == "ho", later).otherwise(behind), 2)))

    def bare(at) -> Column:
        return F.when(_is_year(F.left(at(0), F.lit(4))) & at(0).rlike(r"^\d{4}(-|$)"), F.left(at(0), F.lit(4)))

    return _let(tokens(c), lambda toks: F.coalesce(_first(toks, iso), _first(toks, worded), _first(toks, bare)))


def date_precision(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\d$"), "day").when(c.rlike(r"^\d{4}-\d\d$"), "month").when(c.rlike(r"^\d{4}$"), "year")


def folio(c: Column) -> Column:
    """(folio, sub) of a register position such as 32/2: the first chain of exactly two numbers, of at most five and three digits."""
    chains = F.transform(F.regexp_extract_all(c, F.lit(r"/?\d+(\s*/\s*\d+)*/?"), 0), lambda s: F.split(F.regexp_replace(s, r"\s", ""), "/"))
    two = F.filter(chains, lambda p: (F.size(p) == 2) & F.get(p, 0).rlike(r"^\d{1,5}$") & F.get(p, 1).rlike(r"^\d{1,3}$"))
    return F.get(F.transform(two, lambda p: F.struct(F.get(p, 0).cast("int").alias("folio"), F.get(p, 1).cast("int").alias("sub"))), 0)


def event_type(c: Column) -> Column:
    """What the verbs of a notice say happened, 'registered' if none does."""
    t = F.regexp_replace(printed(c), r"\s+", "_")
    said = [F.when(t.rlike("|".join(verbs.split())), kind) for kind, verbs in EVENTS.items()]
    return F.coalesce(*said, F.lit("registered"))


def roman(c: Column) -> Column:
    """The value of a numeral of i, v, x, l and c; null if it is none. A letter before a greater one counts against it."""
    low = F.lower(c)
    value = F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv])
    worth = F.transform(F.regexp_extract_all(low, F.lit("[ivxlc]"), 0), lambda d: value[d])
    less = F.zip_with(worth, F.slice(worth, F.lit(2), F.size(worth)), lambda a, b: F.when(a < b, 2 * a).otherwise(0))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, v: s + v)
    return F.when(low.rlike("^[ivxlc]+$"), total(worth) - total(less))


def issue_reference(c: Column) -> Column:
    """(issue, volume, volume_no, year, previous, gazette) of the publication a notice cites behind the word 'lásd', null if none.

    What stands before that word and behind the bracket that closes is no citation.
    """

    def cited(toks: Column) -> Column:
        """The tokens behind the word 'lásd', which may be spaced in any way, up to the bracket that closes; null without that word."""
        parts = lambda i: F.coalesce(*[F.when(F.array_join(F.slice(toks, i + 1, F.lit(n)), "") == "lasd", i + n + 1) for n in (2, 3, 4)])
        see = F.array_min(F.filter(F.transform(toks, lambda t, i: F.when(F.contains(t, F.lit("lasd")), i + 2).otherwise(parts(i))), lambda x: x.isNotNull()))
        upto = lambda rest: F.when(F.array_position(rest, ")") > 1, F.slice(rest, F.lit(1), F.array_position(rest, ")").cast("int") - 1)).otherwise(rest)
        return _let(F.slice(toks, see, F.size(toks)), upto)

    def issue_of(seg: Column) -> Column:
        behind = lambda at: F.when(at(1) == "ik", at(2)).otherwise(at(1))
        return F.coalesce(
            _first(seg, lambda at: F.when(F.startswith(behind(at), F.lit("szam")) | (behind(at) == "sz"), _number(at(0), 3))),
            _first(seg, lambda at: F.when(at(0) == "evf", _number(at(1), 3))),
        )

    def said(seg: Column, issue: Column, volume: Column) -> Column:
        year = _first(seg, lambda at: F.when(_is_year(at(0)) & at(1).rlike("^ev[if]"), at(0).cast("int")))
        before = issue.isNull() & F.exists(seg, lambda t: t.isin(*BEFORE))
        gazette = F.exists(seg, lambda t: F.startswith(t, F.lit("kozpert"))) | _first(seg, lambda at: F.when((at(0) == "kozp") & F.startswith(at(1), F.lit("ert")), F.lit(True))).isNotNull()
        out = F.struct(issue.alias("issue"), F.upper(volume).alias("volume"), roman(volume).alias("volume_no"), year.alias("year"), before.alias("previous"), gazette.alias("gazette"))
        return F.when(seg.isNotNull() & (issue.isNotNull() | before), out)

    volume_of = lambda seg: _first(seg, lambda at: F.when(at(0).rlike("^[ivxl]{1,5}$") & F.startswith(at(1), F.lit("evf")), at(0)))
    whole = lambda seg: _let(F.struct(issue_of(seg).alias("issue"), volume_of(seg).alias("volume")), lambda x: said(seg, x["issue"], x["volume"]))
    return _let(tokens(c), lambda toks: _let(cited(toks), whole))


def issue_number(c: Column) -> Column:
    """The number an issue's masthead prints: one of at most three digits before the word 'szám', however that is spaced."""
    before = lambda at: F.when(F.startswith(F.concat_ws("", at(1), at(2), at(3), at(4)), F.lit("szam")), _number(at(0), 3))
    return _let(F.filter(tokens(c), lambda t: t != ","), lambda toks: _first(toks, before))


#: Parsers a declaration may name. More are added by name.
PARSERS: dict[str, Callable[[Column], Column]] = {"date": partial_date, "issue_ref": issue_reference, "folio": folio, "event": event_type}


def derive(sources: list[Column], parser: str) -> Column:
    """What a named parser reads from several columns, one per line; an unknown parser reads null, and so do sources that are all blank."""
    fn = PARSERS.get(parser)
    joined = F.concat_ws("\n", *sources)
    return F.lit(None) if fn is None else F.when(F.trim(F.regexp_replace(joined, r"\s+", " ")) != "", fn(joined))
