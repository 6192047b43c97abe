"""Column expressions on ids, names and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id prefixes and the registry number format.
COMPOUND_PREFIX = "DTXCID"
SUBSTANCE_PREFIX = "DTXSID"
REGISTRY_NUMBER = r"^\d{2,7}-\d{2}-\d\b"

# Fixed value: name shown for an entity without one.
UNNAMED = "Unnamed chemical"


def promoted_id(*fields: Column) -> Column:
    """First non-empty of the ordered id fields."""
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in fields))


def id_kind(text: Column) -> Column:
    prefix = F.upper(F.substring(text, 1, 6))
    return (
        F.when(prefix == COMPOUND_PREFIX, "cid")
        .when(prefix == SUBSTANCE_PREFIX, "sid")
        .when(text.rlike(REGISTRY_NUMBER), "casrn")
        .otherwise("name")
    )


def id_key(text: Column) -> Column:
    """Form in which an id is stored: prefixed ids in upper case, other texts as they are."""
    return F.when(id_kind(text).isin("cid", "sid"), F.upper(text)).otherwise(text)


def feature_name(*parts: Column, missing: str = "None") -> Column:
    return F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit(missing)) for p in parts))


def class_label(prefix: str, label: Column) -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(F.trim(label), r"\s+", "_"))


def placeholder_name(name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(UNNAMED))


def label_parts(label: Column) -> tuple[Column, Column]:
    """Study and lower-cased organ of a ``study:organ`` label."""
    pieces = F.split(label, ":", 2)
    return F.get(pieces, 0), F.lower(F.get(pieces, 1))


def match_score(value: Column, wanted: Column) -> Column:
    """struct(grade, unmatched, text), smaller is better.

    Grade 0 equal, 1 shares the first two characters (then fewer unmatched
    characters win), 2 contains the wanted text, 3 no match on this value.
    ``wanted`` is lower case.
    """
    text = F.lower(value)
    shared = F.size(
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(text), F.length(wanted)))),
            lambda i: F.left(text, i) == F.left(wanted, i),
        )
    )

    def score(grade: int, unmatched: Column) -> Column:
        return F.struct(F.lit(grade).alias("grade"), unmatched.alias("unmatched"), text.alias("text"))

    return (
        F.when(text == wanted, score(0, F.lit(0)))
        .when(F.left(text, F.lit(2)) == F.left(wanted, F.lit(2)), score(1, F.length(wanted) - shared))
        .when(F.contains(text, wanted), score(2, F.lit(0)))
        .otherwise(score(3, F.lit(0)))
    )


def observation_text(obs: Column, dose: Column, unit: Column) -> Column:
    amount = F.concat_ws(" ", dose.cast("string"), unit)
    return (
        F.when(obs.isNull(), "no_data")
        .when(obs == 0, "no_effect")
        .when(dose.isNotNull(), amount)
        .otherwise("hit")
    )


def observation_class(text: Column) -> Column:
    return F.when(text.isin("no_data", "no_effect"), text).otherwise("pos_effect")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
