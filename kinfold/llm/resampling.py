"""Resampling of documents towards a target by the importance of their hashed n-grams.

The bucket of an n-gram is the CRC of its bytes. Each text is brought to words with
one separator before each and scanned once, which leaves the running CRC behind every
byte. The CRC of any run of words then follows from two of these prefixes: the
earlier one, shifted over GF(2) by the length of the run, cancels out of the later one. So
no n-gram is ever built as a string, and one, two and three words cost the same.

A first pass counts the buckets, a table of fixed size whatever the corpus. The second
gives each document the sum of its n-grams' gains and a seeded Gumbel term, and the
highest scores are drawn: a sample without replacement by importance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import LOWER, arrow_map, chunks, cut_lineage, narrow

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: The reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Bytes that are stepped over together, and lengths with a shift table of their own.
WIDTH, NEAR = 256, 64
#: Relative error of the quantile that sets most rows aside before the drawn ones are ranked.
ACCURACY, SLACK = 10_000, 0.01

_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_LOWER = np.frombuffer(LOWER, np.uint8)


def _step_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> 1) ^ np.where(value & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return value


STEP = _step_table()


def _zeros_after(value: np.ndarray) -> np.ndarray:
    """The register after one more zero byte."""
    return STEP[value & 255] ^ (value >> 8)


def _near_tables() -> np.ndarray:
    """[length, byte of the register, value of the byte]: what the byte becomes after so many zero bytes."""
    tables = np.empty((NEAR, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, NEAR):
        tables[n] = _zeros_after(tables[n - 1])
    return tables


_near = _near_tables()
#: Tables for NEAR zero bytes, twice as many, and so on: each is the one before it applied to itself.
_far: list[np.ndarray] = [_zeros_after(_near[NEAR - 1])]


def _looked_up(tables: np.ndarray, value: np.ndarray, base: np.ndarray | int = 0) -> np.ndarray:
    flat = tables.ravel()
    out = flat[base + (value & 255)]
    for k in (1, 2, 3):
        out ^= flat[base + 256 * k + ((value >> (8 * k)) & 255)]
    return out


def shifted(crcs: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The part that a prefix with this CRC has in the CRC of a text that goes on for ``by`` more bytes."""
    out = _looked_up(_near, crcs, (by % NEAR) * 1024)
    far, k = by // NEAR, 0
    while far.any():
        if k == len(_far):
            _far.append(_looked_up(_far[-1], _far[-1]))
        at = np.flatnonzero(far & 1)
        out[at] = _looked_up(_far[k], out[at])
        far, k = far >> 1, k + 1
    return out


def running_crcs(data: bytes) -> np.ndarray:
    """CRC-32 of each prefix, the empty one first: rows of WIDTH bytes start from their own CRC and advance together."""
    n = len(data)
    starts = list(accumulate((data[k : k + WIDTH] for k in range(0, n, WIDTH)), lambda c, part: crc32(part, c), initial=0))
    rows = len(starts) - 1
    padded = np.zeros(rows * WIDTH, np.uint8)
    padded[:n] = np.frombuffer(data, np.uint8)
    columns = np.ascontiguousarray(padded.reshape(rows, WIDTH).T)
    state = ~np.array(starts[:-1], np.uint32)
    out = np.empty((WIDTH, rows), np.uint32)
    for j in range(WIDTH):
        state = STEP[(state ^ columns[j]) & 255] ^ (state >> 8)
        out[j] = state
    return np.append(np.uint32(0), ~out.T.ravel()[:n])


def normalised(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(words with one space before each, starts, ends, first word of each text and the end of the last one)."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    word = _WORD[data]
    first = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    keep = word.copy()
    keep[first - 1] = True
    kept = np.where(word, _LOWER[data], np.uint8(32))[keep]
    spaces = np.flatnonzero(kept == 32)
    ends = np.append(spaces[1:], len(kept))[: len(spaces)]
    bounds = np.searchsorted(first, 1 + np.append(0, np.cumsum([len(r) + 1 for r in raw])))
    return kept.tobytes(), spaces + 1, ends, bounds


def features(texts: list[str], buckets: int, longest: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """([(first word, bucket) of every run of 1, 2, ... words within one text], first words of the texts)."""
    data, starts, ends, bounds = normalised(texts)
    crcs = running_crcs(data)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    out = []
    for n in range(1, longest + 1):
        last = len(starts) - n + 1
        at = np.flatnonzero(text[:last] == text[n - 1 :]) if last > 0 else np.zeros(0, np.int64)
        s, e = starts[at], ends[at + n - 1]
        out.append((at, ((crcs[e] ^ shifted(crcs[s], e - s)) % np.uint32(buckets)).astype(np.int64)))
    return out, bounds


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Features of all texts in each bucket. A task sends one row for each bucket at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, batch in chunks(batches):
            for _, bucket in features(batch, buckets, longest)[0]:
                total += np.bincount(bucket, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed ratio of a bucket's shares, rounded down."""
    k, s, t = len(corpus), corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weighted(texts: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every text."""
    sent = texts.sparkSession.sparkContext.broadcast(gain)

    def of_chunk(ids: list, batch: list[str]) -> dict:
        found, bounds = features(batch, len(sent.value), longest)
        per_word = np.zeros(bounds[-1] + 1, np.int64)
        for at, bucket in found:
            per_word[at + 1] += sent.value[bucket]
        n, total = np.diff(bounds), np.cumsum(per_word)
        return {"doc_id": ids, "n_words": n, "n_features": sum(np.maximum(0, n - k) for k in range(longest)), "weight": total[bounds[1:]] - total[bounds[:-1]]}

    return arrow_map(texts, of_chunk, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, ... for the ``drawn`` highest scores, ties to smaller ids; null for the others.

    A quantile of all rows leaves a little more than the drawn ones, those are dealt out by ranges
    of the order, and a row's rank is its place in its range after the sizes of the ranges before.
    """
    entered = rows.where("entered")
    if not drawn:
        return rows.drop("entered").withColumn("rank", F.lit(None).cast("long"))
    found = entered.agg(F.count("*").alias("n"), F.percentile_approx("score", F.lit(max(0.0, 1 - drawn / max(1, entered.count()) - SLACK)), ACCURACY).alias("cut")).first()
    high = F.col("entered") & (F.col("score") >= found.cut)
    if rows.where(high).count() < drawn:
        high = F.col("entered")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")]
    dealt = rows.where(high).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))))
    # one row for each range
    sizes = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())
    before = list(accumulate((n for _, n in sizes), initial=0))
    offsets = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part int, before long")
    rank = F.col("before") + F.col("place") + 1
    top = dealt.join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= drawn, rank))
    columns = [c for c in rows.columns if c != "entered"]
    return top.select(*columns, "rank").unionAll(rows.where(~high).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST,
    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; a rank is given to the documents that are drawn.

    Words are runs of letters and digits, of ASCII, and of all other characters; A-Z are lower-cased.
    Of the documents with ``least_words`` words or more, ``percent`` of a hundred are drawn, rounded down: the
    highest scores, ties to smaller ids. Null texts are empty; a text without words has weight 0. Each row is a document:
    rows with one id share their Gumbel term, those without an id share that of the empty id and come last among ties. An
    empty target gives gains against a flat one; an empty table gives no rows.
    """
    texts = narrow(docs, id_col, text_col)
    aims = target.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(F.col(target_text), F.lit("")).alias("text"))
    gain = gains(bucket_counts(texts, buckets, longest), bucket_counts(aims, buckets, longest))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    unit = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    score = F.col("weight") + F.floor(F.log(-F.log(unit)) * -1000)
    rows = cut_lineage(weighted(texts, gain, longest).select("doc_id", "n_features", "weight", score.cast("long").alias("score"), (F.col("n_words") >= least_words).alias("entered")))
    return ranked(rows, rows.where("entered").count() * percent // 100)
