"""Removal of long repeats by fingerprints over a difference cover of positions.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else too. Repeats of a fixed length
need equality only, so the sort of the difference-cover method is replaced by grouping: no suffix is put in order,
and equality is that of 64-bit fingerprints, not of bytes compared one by one.

1. A filter that loses nothing: each window of LENGTH bytes is known by the least
   hash of its grams; equal windows have equal ones, so windows whose
   least hash is found once only cannot repeat.
2. Sampled positions are those with remainder 1 or 2 by three in their text, a difference cover: of any
   two positions, both or the next or the second next ones are sampled. The name of a sample stands for LENGTH - 2
   bytes and is made of the names of three shorter triples, recursively.
3. Samples are dealt out by name. The windows that begin at a sample, or one or two
   bytes before one, are known by its name and the two bytes beside it.
4. Windows of equal names and bytes repeat.

Equal texts are one text with a count, and equal samples of one chunk of texts are
sent once, so that no group of copies meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import MIX, chunks, cut_lineage, mixed, narrow

LENGTH = 400
GRAM = 64
#: Bytes of text in a chunk, samples in a bucket, and values sent to all executors at most.
CHUNK, BUCKET, BROADCAST_VALUES = 2_000_000, 1_000_000, 2_000_000
#: Stands for a byte before the first or behind the last; no byte of UTF-8.
OUTSIDE = 0xFF
ROLL = np.uint64(0x2545F4914F6CDD1D)
UNROLL = np.uint64(pow(int(ROLL), -1, 2**64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse, at least n of each."""
    if not _powers or max(_powers) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        both = []
        for base in (ROLL, UNROLL):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers.clear()
        _powers[size] = tuple(both)
    return next(iter(_powers.values()))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram at each start."""
    n = len(data)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mixed((total[gram:] - total[:-gram]) * down[: n - gram + 1])


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width hashes: of a block's end and the next one's beginning."""
    n = len(hashes) - width + 1
    blocks = np.full(-(-len(hashes) // width) * width, np.uint64(2**64 - 1))
    blocks[: len(hashes)] = hashes
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def least_hashes(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The value that each window of ``length`` bytes is known by."""
    return window_minima(gram_hashes(data, gram), length - gram + 1)


def own_values(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values of a text's windows, whether the text itself has a value at two places)."""
    hashes, width = gram_hashes(data, gram), length - gram + 1
    least = window_minima(hashes, width)
    # the greatest of the least values of the windows that hold a gram: the gram's own if it is the least of one
    around = np.full(len(least) + 2 * (width - 1), np.uint64(2**64 - 1))
    around[width - 1 : width - 1 + len(least)] = ~least
    values, counts = np.unique(hashes[hashes == ~window_minima(around, width)], return_counts=True)
    return values, counts > 1


def names(data: np.ndarray, size: int) -> np.ndarray:
    """Name of the ``size`` bytes at each start: triples of names, and two of them that overlap for the full size."""
    name, span = mixed(data.astype(np.uint64) + np.uint64(257)), 1
    while span * 3 <= size:
        a, b, c = name[: -2 * span], name[span:-span], name[2 * span :]
        name, span = mixed((a * MIX + b) * MIX + c + np.uint64(span)), span * 3
    rest = size - span
    return mixed(name[:-rest] * MIX + name[rest:]) if rest else name


def samples(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, names, contexts) of the samples near the marked starts; a context is two bytes before and two behind."""
    n, size = len(data), length - 2
    near = np.zeros(n - size + 1, bool)
    for k in range(3):
        at = starts + k
        near[at[at < len(near)]] = True
    near[::3] = False
    at = np.flatnonzero(near)
    beside = np.full(n + 4, OUTSIDE, np.uint64)
    beside[2 : n + 2] = data
    context = beside[at] << np.uint64(24) | beside[at + 1] << np.uint64(16) | beside[at + size + 2] << np.uint64(8) | beside[at + size + 3]
    return at, names(data, size)[at], context


#: Bytes of a context that count for a start 0, 1 or 2 bytes before the sample.
MASKS = tuple(np.uint64(m) for m in (0x0000FFFF, 0x00FFFF00, 0xFFFF0000))


def start_keys(name: np.ndarray, context: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the suffixes k bytes before samples, which of them lie within their text for the full length)."""
    used = context & MASKS[k]
    inside = np.ones(len(name), bool)
    for shift in (0, 8, 16, 24):
        byte = np.uint64(0xFF) << np.uint64(shift)
        if MASKS[k] & byte:
            inside &= (context & byte) != byte
    return mixed(name + mixed(used + np.uint64(k << 40))), inside


def covered(starts: np.ndarray, n: int, length: int) -> tuple[int, int, np.ndarray]:
    """(bytes, spans, mask of bytes) that strings at the sorted starts cover."""
    mask = np.zeros(n + 1, np.int32)
    np.add.at(mask, starts, 1)
    np.add.at(mask, starts + length, -1)
    mask = np.cumsum(mask)[:n] > 0
    return int(mask.sum()), int((mask & ~np.append(False, mask[:-1])).sum()), mask


class Chunk:
    """Samples of a chunk of texts, equal ones once, in an order that repeats."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        order = np.argsort(np.array(table.column("key").to_pylist(), object), kind="stable")
        self.keys = [table.column("key")[int(i)].as_py() for i in order]
        self.data = [np.frombuffer(table.column("text")[int(i)].as_py().encode(), np.uint8) for i in order]
        at, name, context = [], [], []
        for k, i in enumerate(order):
            wanted = table.column("values")[int(i)].values.to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.isin(least_hashes(self.data[k], length, gram), wanted))
            parts = samples(self.data[k], starts, length)
            for own, part in zip((at, name, context), parts, strict=True):
                own.append(part)
        self.at, self.sizes = np.concatenate(at), [len(x) for x in at]
        name, context = np.concatenate(name), np.concatenate(context)
        _, first, self.inverse, counts = np.unique(mixed(name) + context * MIX, return_index=True, return_inverse=True, return_counts=True)
        self.name, self.context = name[first], context[first] | (counts > 1).astype(np.uint64) << np.uint64(32)

    def dealt(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, positions among the distinct samples)."""
        where = (mixed(self.name) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        found, first = np.unique(where[order], return_index=True)
        for b, part in zip(found, np.split(order, first[1:]), strict=True):
            yield int(b), part


def _repeated_values(texts: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """(doc_id, value) of the windows' values that are found twice."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, batch in chunks(batches):
            value, doc = [], []
            for i, text in zip(ids, batch, strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                if len(data) >= length:
                    found, twice = own_values(data, length, gram)
                    # a value that a text has twice is sent twice
                    found = np.concatenate([found, found[twice]])
                    value.append(found)
                    doc.append(np.full(len(found), i, np.int64))
            if value:
                v, d = np.concatenate(value), np.concatenate(doc)
                where = (mixed(v) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                found, first = np.unique(where[order], return_index=True)
                parts = np.split(order, first[1:])
                blobs = [np.concatenate([v[p], d[p].view(np.uint64)]).tobytes() for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def shared(table: pa.Table) -> pa.Table:
        v, d = np.concatenate([np.frombuffer(b.as_py(), np.uint64).reshape(2, -1) for b in table.column("blob")], axis=1)
        _, inverse, counts = np.unique(v, return_inverse=True, return_counts=True)
        live = counts[inverse] > 1
        return pa.table({"doc_id": d[live].view(np.int64), "value": v[live].view(np.int64)})

    sent = texts.mapInArrow(emit, "bucket long, blob binary")
    return sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(shared, "doc_id long, value long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; ``with_text`` adds the bytes that are left.

    Texts are UTF-8 bytes and whole; null counts as empty. Matches lie within one text
    each, may overlap, and are judged on the input. Texts under ``length`` bytes lose nothing; all
    bytes of equal texts of that length go. Rows with one id, or with none, are texts of their own. An empty table gives no rows.
    """
    texts = narrow(docs, id_col, text_col).withColumn("own", F.coalesce("doc_id", F.xxhash64("text")))
    rows = cut_lineage(texts.select("doc_id", "own", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("key")))
    distinct = rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("own").alias("rep"))
    size = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first().n
    marked = cut_lineage(rows.join(distinct, "key"))
    # an id that has several texts stays if one of them is represented by it
    others = marked.groupBy("own").agg(F.max(F.col("own") == F.col("rep")).alias("any")).where("NOT any").select("own")
    few = others.count() <= BROADCAST_VALUES
    reps = texts.join(F.broadcast(others) if few else others, "own", "left_anti").select(F.col("own").alias("doc_id"), "text")
    buckets = int(max(48, size // 200 // BUCKET))
    values = cut_lineage(_repeated_values(reps, length, gram, buckets).distinct().groupBy("doc_id").agg(F.collect_list("value").alias("values")))
    many = values.agg(F.coalesce(F.sum(F.size("values")), F.lit(0)).alias("n")).first().n
    some = reps.join(F.broadcast(values) if many <= BROADCAST_VALUES else values, "doc_id").where(F.octet_length("text") >= length)
    some = some.select(F.sha2("text", 256).alias("key"), "text", "values").dropDuplicates(["key"])
    left = marked.where("own = rep").join(values.select(F.col("doc_id").alias("own")), "own").agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first().n
    n_chunks, deals = int(max(12, left // CHUNK)), int(max(48, left // BUCKET))
    held = cut_lineage(some.select(F.pmod(F.xxhash64("key"), F.lit(n_chunks)).alias("chunk"), "key", "text", "values"))

    def emit(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, length, gram)
        bucket, blobs = [], []
        for b, part in chunk.dealt(deals):
            bucket.append(b)
            blobs.append(chunk.name[part].tobytes() + (chunk.context[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + np.packbits((chunk.context[part] >> np.uint64(32)).astype(np.uint8)).tobytes())
        c = table.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "chunk": pa.array([c] * len(bucket), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def compared(table: pa.Table) -> pa.Table:
        name, context, twice = [], [], []
        for blob in table.column("blob"):
            blob = blob.as_py()
            # 12 bytes and a bit for each sample
            m = len(blob) * 8 // 97
            name.append(np.frombuffer(blob, np.uint64, m))
            context.append(np.frombuffer(blob, np.uint32, m, 8 * m).astype(np.uint64))
            twice.append(np.unpackbits(np.frombuffer(blob, np.uint8, offset=12 * m), count=m))
        sizes = [len(x) for x in name]
        name, context, twice = np.concatenate(name), np.concatenate(context), np.concatenate(twice)
        bits = []
        for k in range(3):
            keys, inside = start_keys(name, context, k)
            order = np.argsort(keys)
            keys = keys[order]
            equal = np.append(keys[1:] == keys[:-1], False)
            again = np.empty(len(keys), bool)
            again[order] = equal | np.append(False, equal[:-1])[: len(keys)]
            bits.append((again | twice.astype(bool)) & inside)
        ends = np.cumsum(sizes)
        out = [b"".join(np.packbits(b[e - s : e]).tobytes() for b in bits) for s, e in zip(sizes, ends, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(out, pa.binary())})

    samples_sent = held.groupBy("chunk").applyInArrow(emit, "bucket long, chunk long, blob binary")
    judged = cut_lineage(samples_sent.repartition(deals, "bucket").groupBy("bucket").applyInArrow(compared, "chunk long, bucket long, bits binary"))

    def removed(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"key": pa.array([], pa.string()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "sha": pa.array([], pa.string()), "kept": pa.array([], pa.binary())})
        chunk = Chunk(table, length, gram)
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        repeats = np.zeros((3, len(chunk.name)), bool)
        for b, part in chunk.dealt(deals):
            m = len(part)
            repeats[:, part] = np.unpackbits(np.frombuffer(bits[b], np.uint8).reshape(3, -1), axis=1, count=m)
        repeats = repeats[:, chunk.inverse]
        out, at = [], 0
        for key, data, size in zip(chunk.keys, chunk.data, chunk.sizes, strict=True):
            own, r = chunk.at[at : at + size], repeats[:, at : at + size]
            at += size
            starts = np.unique(np.concatenate([own[r[k]] - k for k in range(3)]))
            n, spans, mask = covered(starts, len(data), length)
            kept = data[~mask].tobytes()
            out.append((key, n, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return pa.table({c: pa.array([o[k] for o in out], t) for k, (c, t) in enumerate((("key", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("sha", pa.string()), ("kept", pa.binary())))})

    result = held.groupBy("chunk").cogroup(judged.groupBy("chunk")).applyInArrow(removed, "key string, n_removed long, n_spans long, sha string, kept binary")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    joined = marked.join(cut_lineage(result), "key", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = joined.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.coalesce("sha", "key")).alias("kept_sha256"), "kept", whole.alias("whole"), "key",
    )
    if not with_text:
        return out.drop("kept", "whole", "key")
    originals = texts.select(F.sha2("text", 256).alias("key"), F.encode("text", "UTF-8").alias("original")).dropDuplicates(["key"])
    kept = F.when(F.col("whole"), F.lit(b"")).otherwise(F.coalesce("kept", "original"))
    return out.join(originals, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", kept.alias("kept"))
