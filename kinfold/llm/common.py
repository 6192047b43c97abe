"""What the operators share: reading, chunking, word hashes, lineage."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.session import cut_lineage, ship

__all__ = ["CHUNK_BYTES", "LOWER", "WORD_BREAK", "arrow_map", "chunks", "cut_lineage", "distinct", "documents", "filtered", "likely_least", "narrow", "parts", "pieces", "release", "shingle_hashes", "text_of", "word_hashes", "word_hashes_of"]

#: Separators of words: space and the controls 9 to 13.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
#: Lower-cases A-Z and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Texts are worked on in chunks of about this many bytes; a longer text is a chunk by itself.
CHUNK_BYTES = 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def documents(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_of(column: str = "text"):
    """The text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) alone, so that no other column of the input can clash."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def likely_least(rows: DataFrame, unit: Column, n: int) -> DataFrame:
    """About 4 n of the rows, those with the least ``unit``, a hash spread over 0 to 1; all of a smaller table.

    Taken before a sample of n rows in the order of the hash, so that tasks send the driver a few
    rows in all instead of n each. The n least are among them unless chance left less than a quarter below the cut.
    """
    share = 4 * n / max(1, rows.count())
    return rows.where(unit < share) if share < 1 else rows


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of at most CHUNK_BYTES characters, or of one longer text."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            t = t.as_py()
            if texts and size + len(t) > CHUNK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i.as_py())
            texts.append(t)
            size += len(t)
    if texts:
        yield ids, texts


def pieces(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, in lists of at most CHUNK_BYTES characters or one longer text; null as empty."""
    part: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if part and size + len(t) > CHUNK_BYTES:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def release(df: DataFrame) -> DataFrame:
    """``df``, after the driver has let go of what it no longer refers to.

    Spark removes the shuffle files and checkpoints of a round when the driver's garbage is collected, by itself every
    half hour. An iterative job would keep the files of all its rounds until then.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about CHUNK_BYTES, or of one larger row: Python never holds a whole batch as objects."""
    sizes = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)), np.zeros(batch.num_rows, np.int64))
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK_BYTES)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if j > i:
            yield batch.slice(i, j - i)


def arrow_map(docs: DataFrame, of_chunk: Callable, schema: str) -> DataFrame:
    """``of_chunk(ids, texts)`` gives columns by name for each chunk of (id, text) rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            columns = of_chunk(ids, texts)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in kinds], schema=kinds)

    return docs.mapInArrow(run, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes_of(texts: list[str]) -> list[np.ndarray]:
    """For each text, a hash for each of its words, A-Z lower-cased: eight bytes of all words at a time."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer((b" ".join(raw) + b" " * 9).translate(LOWER), np.uint8)
    ends = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
    starts = np.append(0, ends[:-1] + 1)
    words = ends > starts
    starts, size = starts[words], (ends - starts)[words]
    value = size.astype(np.uint64) * MIX
    eights = np.lib.stride_tricks.sliding_window_view(data, 8)
    at, left, which = starts.copy(), size.copy(), np.flatnonzero(size <= LONG_WORD)
    while len(which):
        part = np.ascontiguousarray(eights[at[which]]).view(np.uint64).ravel()
        bits = (np.minimum(left[which], 8) * 8).astype(np.uint64)
        part = part << (np.uint64(64) - bits)
        value[which] = mixed(value[which] ^ part)
        at[which] += 8
        left[which] -= 8
        which = which[left[which] > 0]
    for k in np.flatnonzero(size > LONG_WORD):
        value[k] = _xxh64(data[starts[k] : starts[k] + size[k]].tobytes())
    first = np.cumsum([len(r) + 1 for r in raw])
    return np.split(value, np.searchsorted(starts, first[:-1]))


def _xxh64(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def word_hashes(text: str) -> np.ndarray:
    return word_hashes_of([text])[0]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def bucket_ids(words: list[bytes], bits: int) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint32, len(words)) & np.uint32((1 << bits) - 1)


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """A hash for each run of n words; a shorter text is one run, an empty one has none."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    size = len(words) - n + 1
    with np.errstate(over="ignore"):
        total = np.full(size, n, np.uint64)
        for k in range(n):
            total = total * MIX + (words[k : k + size] ^ (words[k : k + size] >> np.uint64(31)))
        return mixed(total)


def filtered(docs: DataFrame, keep: Callable, columns: list[str]) -> DataFrame:
    """The rows of ``docs`` for which ``keep(values of each column)`` is true, a list for each part of a batch."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in parts(batch):
                yield b.filter(pa.array(keep(*[b.column(c).to_pylist() for c in columns]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
