"""Bit strings and feature lists over an ordered vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def features_of_bits(bits: Column, vocabulary: Column) -> Column:
    marked = F.transform(vocabulary, lambda name, i: F.when(F.substr(bits, i + 1, F.lit(1)) == "1", name))
    return F.array_compact(marked)


def bits_of_features(features: Column, vocabulary: Column) -> Column:
    flags = F.transform(vocabulary, lambda name: F.when(F.array_contains(features, name), "1").otherwise("0"))
    return F.concat_ws("", flags)
