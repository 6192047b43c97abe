"""Sets as short binaries: about a byte for each frequent feature, so that copies of a set are cheap to move.

A feature is a 64-bit number. Those of a bounded dictionary, the most frequent first, are gaps between their ranks; all
others stay whole. The dictionary only steers the coding: nothing is lost whatever it holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Features that have a code, and the rows whose features are counted for that, about.
DICTIONARY, COUNTED = 65_536, 20_000
#: A byte that adds so much to the gap and ends none.
SKIP = 255
HEAD = 8
ROW = 20


def numbers(df: DataFrame, column: str) -> Column:
    """Features as 64-bit numbers: integers themselves, others hashed; two of a million texts meet with a probability of 3e-8."""
    kind = df.schema[column].dataType.elementType
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.col(column).cast("array<bigint>")
    return F.transform(column, lambda x: F.xxhash64(x))


def learn(df: DataFrame, column: str) -> np.ndarray:
    """The frequent features, by their counts in about COUNTED rows."""
    every = max(1, df.count() // COUNTED)
    some = df.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(F.explode(numbers(df, column)).alias("bit"))
    found = some.where("bit IS NOT NULL").groupBy("bit").count().orderBy(F.desc("count"), "bit").limit(DICTIONARY)
    return found.select("bit").toArrow()["bit"].to_numpy().astype(np.int64)


def pack(df: DataFrame, column: str, words: np.ndarray) -> DataFrame:
    """The column of sets as binaries; equal sets are equal binaries, null stays null."""

    @F.arrow_udf(T.BinaryType())
    def packed(sets: pa.Array) -> pa.Array:
        return pack_sets(sets, words)

    return df.withColumn(column, packed(numbers(df, column)))


def is_packed(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.BinaryType)


def size(column: str) -> Column:
    """Number of features of a packed set."""
    return F.coalesce(F.conv(F.hex(F.substring(column, 1, 4)), 16, 10).cast("int"), F.lit(0))


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of consecutive runs."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def pack_sets(sets: pa.ListArray, words: np.ndarray) -> pa.Array:
    if isinstance(sets, pa.ChunkedArray):
        sets = sets.combine_chunks()
    rows = len(sets)
    row = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    flat = sets.flatten()
    row, flat = row[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null().to_numpy()
    order = np.argsort(words)
    at = np.searchsorted(words[order], flat)
    at[at == len(words)] = 0
    coded = words[order][at] == flat if len(words) else np.zeros(len(flat), bool)
    key = np.unique(row[coded] << ROW | order[at[coded]])
    c_row, code = key >> ROW, key & ((1 << ROW) - 1)
    gap = np.diff(code, prepend=-1) - 1
    first = np.diff(c_row, prepend=-1) > 0
    gap[first] = code[first]
    width = gap // SKIP + 1
    body = np.full(int(width.sum()), SKIP, np.uint8)
    body[np.cumsum(width) - 1] = gap % SKIP
    o_row, other = row[~coded], flat[~coded]
    sort = np.lexsort((other, o_row))
    o_row, other = o_row[sort], other[sort]
    once = (np.diff(o_row, prepend=-1) > 0) | np.append(True, other[1:] != other[:-1])[: len(other)]
    o_row, other = o_row[once], other[once]

    valid = sets.is_valid().to_numpy(zero_copy_only=False)
    others = np.bincount(o_row, minlength=rows)
    head = np.stack([others + np.bincount(c_row, minlength=rows), others], axis=1).astype(">u4")[valid]
    bodies = np.bincount(c_row, weights=width, minlength=rows).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(np.where(valid, HEAD + 8 * others + bodies, 0))))
    data = np.empty(int(offsets[-1]), np.uint8)
    start = offsets[:-1]
    data[_spans(start[valid], np.full(int(valid.sum()), HEAD))] = np.ascontiguousarray(head).view(np.uint8).ravel()
    data[_spans(start + HEAD, 8 * others)] = np.ascontiguousarray(other).view(np.uint8)
    data[_spans(start + HEAD + 8 * others, bodies)] = body
    made = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pc.if_else(pa.array(valid), made, pa.scalar(None, pa.binary()))


def unpack_sets(packed: pa.Array, words: np.ndarray) -> pa.ListArray:
    """The sets of 64-bit numbers; null is an empty set."""
    rows = len(packed)
    if not rows:
        return pa.array([], pa.list_(pa.int64()))
    _, ends, data = packed.buffers()
    ends = np.frombuffer(ends, np.int32)[packed.offset : packed.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    length = np.where(packed.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    has, start = length > 0, ends[:-1]
    total, others = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    head = data[_spans(start[has], np.full(int(has.sum()), HEAD))].view(">u4").reshape(-1, 2)
    total[has], others[has] = head[:, 0], head[:, 1]
    bodies = np.where(has, length - HEAD - 8 * others, 0)
    other = data[_spans(start + HEAD, 8 * others)].view(np.int64)
    body = data[_spans(start + HEAD + 8 * others, bodies)]
    ends_code = body < SKIP
    run = np.concatenate(([0], np.cumsum(body.astype(np.int32) + ends_code, dtype=np.int64)))
    before = run[np.concatenate(([0], np.cumsum(bodies)))[:-1]]
    code = run[1:][ends_code] - np.repeat(before, total - others) - 1
    offsets = np.concatenate(([0], np.cumsum(total)))
    values = np.empty(int(offsets[-1]), np.int64)
    values[_spans(offsets[:-1], others)] = other
    values[_spans(offsets[:-1] + others, total - others)] = words[code] if len(words) else code
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
