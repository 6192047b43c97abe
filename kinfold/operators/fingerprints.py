"""Fingerprint builders and statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.text import class_label
from kinfold.operators.distribution import bounded_lists, exact_median, numbered

HASHED_BITS = 2048
MATRIX_LIMIT = 10_000
#: Entities of one list of an inverted index, about.
LIST = 10_000


@dataclass(frozen=True)
class FingerprintSpec:
    """What a fingerprint is: its metric, an optional lower threshold, and how it is built."""

    fp_id: str
    builder: Callable[..., DataFrame]
    metric: str = "jaccard"
    cutoff: float | None = None


REGISTRY: dict[str, FingerprintSpec] = {}


def register(spec: FingerprintSpec) -> FingerprintSpec:
    if spec.fp_id in REGISTRY:
        raise ValueError(f"fingerprint {spec.fp_id} is registered already")
    REGISTRY[spec.fp_id] = spec
    return spec


# ---- filters ---------------------------------------------------------------


def usable_structure(identity: Column, structure: Column) -> Column:
    """Entity with an id and a structure text that is neither a pattern nor a failure."""
    return (
        identity.isNotNull() & structure.isNotNull() & ~structure.rlike(r"[|*]")
        & (structure != "FAIL") & (F.trim(structure) != "")
    )


def usable_fingerprint(path: Column, identity: Column, fail: Column) -> Column:
    return path.isNotNull() & identity.isNotNull() & fail.isNull()


def of_vendor(endpoint: Column, vendor: str) -> Column:
    return F.startswith(endpoint, F.lit(vendor + "_"))


def certain_label(bit: Column) -> Column:
    return ~F.lower(bit).rlike("unknown|uncertain")


def missing_ids(possible: DataFrame, existing: DataFrame) -> DataFrame:
    return possible.select("id").distinct().join(existing, "id", "left_anti")


def in_every_table(base: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        base = base.join(other.select("id").distinct(), "id", "left_semi")
    return base


# ---- sets ------------------------------------------------------------------


def set_fingerprints(bits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(id, ds, n) from tall (id, bit): distinct features per entity; entities with none are absent."""
    return (
        bits.where(F.col("bit").isNotNull()).groupBy(*(keys or ["id"]))
        .agg(F.sort_array(F.collect_set("bit")).alias("ds")).withColumn("n", F.size("ds"))
    )


def signed_sets(hits: DataFrame, hit: Column, miss: Column) -> DataFrame:
    """(id, pos, neg, n_pos, n_neg): features hit and missed; they may overlap."""
    sets = hits.groupBy("id").agg(
        F.sort_array(F.collect_set(F.when(hit, F.col("bit")))).alias("pos"),
        F.sort_array(F.collect_set(F.when(miss, F.col("bit")))).alias("neg"),
    )
    return sets.withColumn("n_pos", F.size("pos")).withColumn("n_neg", F.size("neg"))


def effect_sets(effects: DataFrame, bit: str) -> DataFrame:
    """(id, pos, neg): class 1 features, and class 0 features without those of class 1."""
    named = effects.withColumn("bit", F.col(bit))
    sets = signed_sets(named, F.col("effect_class") == 1, F.col("effect_class") == 0)
    return sets.select("id", "pos", F.sort_array(F.array_except("neg", "pos")).alias("neg"))


def hit_records(hits: DataFrame, record: list[str]) -> DataFrame:
    """(id, part, hits): the hit records of each entity as sorted lists of bounded length."""
    return bounded_lists(hits, ["id"], record, "hits")


def grouped_hits(hits: DataFrame, keys: list[str], cutoff: float, approach: str, record: list[str]) -> DataFrame:
    """Hits at or above the cutoff per key: distinct endpoints of one approach, and the records."""
    kept = hits.where(F.col("hitcall") >= cutoff)
    features = kept.groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.when(F.col("approach") == approach, F.col("endpoint")))).alias("ds")
    )
    return features.withColumn("n", F.size("ds")).join(bounded_lists(kept, keys, record, "hits"), keys)


def top_features(hits: DataFrame, sizes: list[int], cutoffs: list[float]) -> DataFrame:
    """(id, cell_type, size, cutoff, ds, n): strongest features after a median over repeats.

    Per (id, cell type, endpoint) the strength is |median(top)| and the potency
    median(bmd). For each cutoff features with bmd within it count, and of
    those the ``size`` strongest are kept, in order.
    """
    keys = ["id", "cell_type", "endpoint"]
    merged = exact_median(hits, keys, "top", "top").withColumn("top", F.abs("top")).join(
        exact_median(hits, keys, "bmd", "bmd"), keys
    )
    strongest = W.partitionBy("id", "cell_type", "cutoff").orderBy(F.desc("top"), "endpoint")
    ranked = (
        merged.withColumn("cutoff", F.explode(F.array(*(F.lit(float(c)) for c in cutoffs))))
        .where(F.col("bmd") <= F.col("cutoff"))
        .withColumn("_r", F.row_number().over(strongest)).where(F.col("_r") <= max(sizes))
        .withColumn("size", F.explode(F.array(*(F.lit(s) for s in sizes)))).where(F.col("_r") <= F.col("size"))
    )
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_r", "endpoint"))), lambda e: e["endpoint"])
    return ranked.groupBy("id", "cell_type", "size", "cutoff").agg(in_order.alias("ds")).withColumn("n", F.size("ds"))


def class_bits(classes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Tall (id, bit) of prefixed class labels; an unknown label carries the id, so it never matches."""
    bits = []
    for prefix, column in columns.items():
        label = class_label(prefix, F.col(column))
        unknown = F.lower(column).rlike("unknown|uncertain")
        bits.append(F.when(unknown, F.concat_ws("_", label, F.col("id"))).otherwise(label))
    return classes.select("id", F.explode(F.array_compact(F.array(*bits))).alias("bit"))


def hashed_positions(tokens: Column, bits: int = HASHED_BITS) -> Column:
    """Distinct positions of the tokens: the first 32 bits of their MD5, modulo ``bits``, which any engine can repeat."""
    head = lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long")
    return F.sort_array(F.array_distinct(F.transform(F.array_distinct(tokens), lambda t: (head(t) % bits).cast("int"))))


def hashed_fingerprints(texts: DataFrame, tokens: Column, prefix: str, bits: int = HASHED_BITS) -> DataFrame:
    """(id, ds, n): tokens hashed into named bits ``prefix_N``."""
    named = F.transform(hashed_positions(tokens, bits), lambda i: F.concat_ws("_", F.lit(prefix), i))
    return texts.select("id", named.alias("ds")).withColumn("n", F.size("ds")).where("n > 0")


def numeric_fingerprints(properties: DataFrame, wanted: list[str]) -> DataFrame:
    """One double column per property from tall (id, prop_id, value); all present or the entity is dropped."""
    return properties.groupBy("id").pivot("prop_id", wanted).agg(F.max("value")).dropna(subset=wanted)


# ---- vocabulary and statistics ----------------------------------------------


def vocabulary(bits: DataFrame, by_number: bool = False) -> DataFrame:
    """Sorted distinct features, or ordered by their numeric suffix."""
    found = bits.select("bit").distinct()
    if by_number:
        return found.orderBy(F.regexp_extract("bit", r"(\d+)$", 1).try_cast("long"), "bit")
    return found.orderBy("bit")


def feature_matrix(bits: DataFrame, columns: list[str], fill: int = 0) -> DataFrame:
    """Entity x feature 0/1 columns in the given order, for a vocabulary that fits a schema."""
    if len(columns) > MATRIX_LIMIT:
        raise ValueError(f"{len(columns)} features are too many for columns; block_matrix takes any number")
    return bits.groupBy("id").pivot("bit", columns).agg(F.lit(1)).fillna(fill)


def block_matrix(bits: DataFrame, width: int = 1000) -> DataFrame:
    """(id, block, places): the feature matrix of a vocabulary of any size, ``width`` columns a block, only blocks and places that are set.

    Columns are numbered by the order of the features; no schema and no driver holds them.
    """
    names = numbered(bits.select("bit").distinct(), ["bit"])
    placed = bits.select("id", "bit").distinct().join(names, "bit")
    block = F.floor(F.col("position") / width)
    return placed.groupBy("id", block.alias("block")).agg(F.sort_array(F.collect_list((F.col("position") % width).cast("int"))).alias("places"))


def fingerprint_sizes(ids: DataFrame, sizes: DataFrame, fp_ids: list[str], floor: DataFrame | None = None) -> DataFrame:
    """(id, fp_id, n) for every asked pair, 0 when absent.

    ``sizes`` has (id, fp_id, n), several rows for positive and negative parts.
    ``floor`` optionally lists the (id, fp_id) that count.
    """
    if floor is not None:
        sizes = sizes.join(floor, ["id", "fp_id"], "left_semi")
    asked = ids.select("id").distinct().withColumn("fp_id", F.explode(F.array(*(F.lit(f) for f in fp_ids))))
    total = sizes.groupBy("id", "fp_id").agg(F.sum("n").alias("n"))
    return asked.join(total, ["id", "fp_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def summary_pivot(counts: DataFrame, columns: list[str], nearest: DataFrame) -> DataFrame:
    """One count column per table, smallest on duplicates, 0 fill, outer-joined to the neighbours (id)."""
    wide = counts.groupBy("id").pivot("prop", columns).agg(F.min("n"))
    return nearest.select("id").distinct().join(wide, "id", "full").fillna(0, columns)


def bit_frequency(bits: DataFrame) -> DataFrame:
    return bits.groupBy("bit").agg(F.count(F.lit(1)).alias("df"))


def inverted_index(bits: DataFrame) -> DataFrame:
    """(bit, part, ids): entities per feature as sorted lists of bounded length."""
    # only features with more than one list need a size, so the facts are moved once; at most 1 in LIST of them is broadcast
    long = bits.groupBy("bit").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LIST)
    long = F.broadcast(long.select(F.col("bit").alias("_long"), F.ceil(F.col("_n") / LIST).alias("_parts")))
    dealt = bits.join(long, F.col("bit") == F.col("_long"), "left")
    part = F.pmod(F.xxhash64("id"), F.coalesce("_parts", F.lit(1)))
    return dealt.groupBy("bit", part.alias("part")).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def mean_set_sizes(hits: DataFrame) -> DataFrame:
    """Mean number of distinct features over entities by hit class and model class."""
    per_id = hits.groupBy("id", "hit", "modl").agg(F.countDistinct("bit").alias("n"))
    return per_id.groupBy("hit", "modl").agg(F.avg("n").alias("mean_n"), F.count(F.lit(1)).alias("entities"))


def stacked_bits(parts: dict[str, DataFrame]) -> DataFrame:
    """Features of several fingerprints as one tall table (fp_id, id, bit)."""
    stacked = [bits.select(F.lit(fp_id).alias("fp_id"), "id", "bit") for fp_id, bits in parts.items()]
    return reduce(DataFrame.unionByName, stacked)
