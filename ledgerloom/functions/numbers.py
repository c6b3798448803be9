"""Numbers as print writes them, and small statistics, as columns.

`printed_number` follows the data it is made for: points and commas group thousands, so '12.5' reads 125.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that stand for nothing in a column of numbers.
NOUGHT = r"^[\s\-–—−_.·•*:;x×=~]*[\-–—−_·•*:;x×=~][\s\-–—−_.·•*:;x×=~]*$"


def printed_number(c: Column) -> Column:
    """A printed number as double: dashes are 0, separators go, what is no number is null."""
    bare = F.regexp_replace(c, r"[.,\s\x{00A0}\x{2009}\x{202F}]", "")
    return F.when(c.isNull() | (F.trim(c) == ""), None).when(c.rlike(NOUGHT), 0.0).when(bare.rlike(r"^[+-]?\d+$"), bare.try_cast("decimal(38,0)").cast("double")).otherwise(F.trim(c).try_cast("double"))


def rule_number(c: Column, nought: str = "-") -> Column:
    """A number in a rule: empty and `nought` are 0, the first comma is the point, else null."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")
    dotted = F.regexp_replace(t, r"^([^,]*),", "$1.")
    return F.when((t == "") | F.lit(nought).contains(t), 0.0).when(dotted.rlike(r"^-?\d+(\.\d+)?$"), dotted.try_cast("double"))


def declared_number(c: Column, missing: list[str], thousands: list[str], decimal: str) -> Column:
    """(status, value) under a declared way of writing: ok, missing or error."""
    t = F.trim(F.coalesce(c, F.lit("")))
    bare = t
    for mark in thousands:
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    bare = F.replace(bare, F.lit(decimal), F.lit("."))
    value = F.when(bare.rlike(r"^[+-]?\d+(\.\d+)?$"), bare.try_cast("double"))
    blank = t.isin("", *missing)
    return F.struct(F.when(blank, "missing").when(value.isNull(), "error").otherwise("ok").alias("status"), F.when(~blank, value).alias("value"))


def int_digits(x: Column) -> Column:
    return F.length(F.abs(x).cast("bigint").cast("string"))


def last_digit(c: Column) -> Column:
    """The last digit of a text, whatever punctuation follows it."""
    return F.regexp_extract(c, r"(\d)\D*$", 1).try_cast("int")


def number_text(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def one_char_apart(a: Column, b: Column) -> Column:
    """One substitution, insertion or deletion; a transposition is two."""
    return F.levenshtein(a, b) == 1


def difference_hint(printed: Column, computed: Column) -> Column:
    """What the difference of a printed and a computed number looks like; a nought on either side explains nothing."""
    some = (printed != 0) & (computed != 0)
    d = F.abs(printed - computed)
    times = lambda k: ((printed == computed * k) | (computed == printed * k)) & (printed != 0) & (computed != 0)
    return (
        F.when(~some, None).when(times(10) | times(100) | times(1000), "factor")
        .when(one_char_apart(number_text(printed), number_text(computed)), "one character")
        .when((d > 0) & (d == F.floor(d)) & (F.pmod(d, F.lit(9)) == 0), "transposed")
    )


def slip_note(current: Column, wanted: Column) -> Column:
    """'trailing 1' where the printed number is the wanted one with a 1 behind it, as a column rule is misread; else null."""
    return F.when(number_text(current) == F.concat(number_text(wanted), F.lit("1")), "trailing 1")


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series from 16 on, by the sum of logs below."""
    x = F.greatest(n, F.lit(16)).cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    small = F.element_at(F.array(*[F.lit(math.lgamma(k + 1)) for k in range(16)]), F.least(n, F.lit(15)).cast("int") + 1)
    return F.when(n < 16, small).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X >= k) of a binomial, by the ratio of its terms from the one at k away from the mean.

    The first term comes from logs, so that many trials don't make it nought; terms fall off, and those of more than 40 deviations are below what a
    double can show.
    """
    k, n = k.cast("bigint"), n.cast("bigint")
    term = lambda i: F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) + i * math.log(p) + (n - i) * math.log(1 - p))
    reach = (40 * F.sqrt(n * p * (1 - p)) + 200).cast("bigint")
    up, down = (lambda i: (n - i + 1) / i * (p / (1 - p))), (lambda i: (i + 1) / (n - i) * ((1 - p) / p))

    def total(first: Column, steps: Column, ratio) -> Column:
        begin = F.struct(first.alias("term"), first.alias("sum"))
        step = lambda s, i: F.struct((s["term"] * ratio(i)).alias("term"), (s["sum"] + s["term"] * ratio(i)).alias("sum"))
        return F.aggregate(steps, begin, step, lambda s: s["sum"])

    none = F.array().cast("array<bigint>")
    last, least = F.least(n, k + reach), F.greatest(F.lit(0).cast("bigint"), k - 1 - reach)
    above = total(term(k), F.when(last > k, F.sequence(k + 1, last)).otherwise(none), up)
    below = total(term(k - 1), F.when(k - 1 > least, F.sequence(k - 2, least, F.lit(-1).cast("bigint"))).otherwise(none), down)
    return F.when(k <= 0, 1.0).when(k > n, 0.0).when(k > n * p, F.least(F.lit(1.0), above)).otherwise(F.greatest(F.lit(0.0), 1.0 - below))


def digit_edits(c: Column) -> Column:
    """All numbers one digit away: replaced, dropped or put in, without leading noughts."""
    n = F.length(c)
    at = F.sequence(F.lit(0), n)
    digits = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string"))
    head, tail = (lambda i: F.substring(c, F.lit(1), i)), (lambda i, k: F.substring(c, i + k, n))
    replaced = F.flatten(F.transform(F.slice(at, F.lit(1), n), lambda i: F.transform(digits, lambda d: F.concat(head(i), d, tail(i, 2)))))
    put_in = F.flatten(F.transform(at, lambda i: F.transform(digits, lambda d: F.concat(head(i), d, tail(i, 1)))))
    dropped = F.transform(F.slice(at, F.lit(1), n), lambda i: F.concat(head(i), tail(i, 2)))
    valid = F.filter(F.array_distinct(F.concat(replaced, put_in, dropped)), lambda s: (s != c) & s.rlike(r"^(0|[1-9]\d*)$"))
    return F.when(c.rlike(r"^\d+$"), F.array_sort(valid))


def overlap_interval(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1))
