"""Species names: composite labels, taxonomy and join keys."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from strikehaz.fixed_values import LARGE_BODIED_GROUPS, TAXONOMY, UNKNOWN_GROUP
from strikehaz.functions.coerce import strip, tidy_upper


def join_key(c: Column) -> Column:
    """Case- and padding-insensitive species key."""
    return tidy_upper(c)


def plain_names(label: Column) -> Column:
    """Array of the plain names behind a label.

    A trailing '(...)' tag goes; 'A/B Suffix' lends everything after B's first
    word to A; two full names stay as they are.
    """
    name = strip(F.regexp_replace(label, r"\s*\([^)]*\)\s*$", ""))
    left = strip(F.substring_index(name, "/", 1))
    right = strip(F.regexp_extract(name, r"^[^/]*/(.*)$", 1))
    shared = F.regexp_extract(right, r"^\S+ (.*)$", 1)
    borrows = ~left.contains(" ") & right.contains(" ")
    first = F.when(borrows, F.concat_ws(" ", left, shared)).otherwise(left)
    return F.when(name.contains("/"), F.array(first, right)).otherwise(F.array(name))


def _lookup(position: int) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(t[0]), F.lit(t[position])) for t in TAXONOMY))


def species_group(scientific: Column) -> Column:
    """Documented group of a scientific name; anything else is 'unknown', never guessed."""
    return F.coalesce(F.try_element_at(_lookup(2), strip(scientific)), F.lit(UNKNOWN_GROUP))


def species_common_name(scientific: Column) -> Column:
    return F.try_element_at(_lookup(1), strip(scientific))


def is_large_bird(scientific: Column) -> Column:
    """Large-bodied groups."""
    return species_group(scientific).isin(LARGE_BODIED_GROUPS)
