"""Names and label sets: what may be a name, scopes of detection, palettes and regions. All are column expressions.

A scope is 'page' or 'within:<label>'. Null where something is no scope; a null or blank scope is the page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE, WITHIN = "page", "within:"
# The characters a label and a project's name may have, and the project name that is taken.
LABEL_CHARS, PROJECT_CHARS, RESERVED = "A-Za-z0-9_.-", "A-Za-z0-9._ -", "_trash"


def is_label(c: Column) -> Column:
    """Whether a text can be a label: labels are listed with blanks and commas between them, so they have none themselves."""
    return F.coalesce(c.rlike(f"^[{LABEL_CHARS}]+$"), F.lit(False))


def is_project(c: Column) -> Column:
    """Whether a text can be a project's name: no blank at its ends, no point or hyphen first, not the reserved one."""
    return F.coalesce(c.rlike(f"^[{PROJECT_CHARS}]+$") & c.rlike("^[A-Za-z0-9_]") & ~c.endswith(" ") & (c != RESERVED), F.lit(False))


def scope(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    parent = F.trim(F.substring(t, len(WITHIN) + 1, 1 << 20))
    return F.when(t.isin("", PAGE), PAGE).when(F.startswith(t, F.lit(WITHIN)) & (parent != ""), F.concat(F.lit(WITHIN), parent))


def parent_label(c: Column) -> Column:
    """The label a nested scope lies within, null for the page."""
    return F.when(F.startswith(scope(c), F.lit(WITHIN)), F.substring(scope(c), len(WITHIN) + 1, 1 << 20))


def scope_slug(c: Column) -> Column:
    return F.replace(scope(c), F.lit(":"), F.lit("_"))


def scope_labels(labels: Column, c: Column) -> Column:
    """What a model predicts under a scope: all labels but the parent, which is given. Null where nothing is left."""
    left = F.filter(labels, lambda x: ~F.coalesce(x == parent_label(c), F.lit(False)))
    return F.when(F.size(left) > 0, left)


def missing_labels(source: Column, target: Column) -> Column:
    """The labels of `source` that `target` lacks, in their order."""
    have = F.coalesce(target, F.array().cast("array<string>"))
    return F.filter(F.coalesce(source, F.array().cast("array<string>")), lambda x: ~F.array_contains(have, x))


def with_label(labels: Column, label: Column) -> Column:
    """A palette with one more label, at its end, unless it is there."""
    return F.when(F.array_contains(labels, label), labels).otherwise(F.array_append(labels, label))


def with_region(regions: Column, labels: Column, label: Column, on: Column, defaults: list[str]) -> Column:
    """The region labels after one is switched on or off; a project that has named none starts from the defaults it uses."""
    start = F.coalesce(regions, F.filter(labels, lambda x: x.isin(defaults)))
    others = F.filter(start, lambda x: x != label)
    return F.when(on, F.array_append(others, label)).otherwise(others)
