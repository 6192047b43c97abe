"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the last
sum is 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), linear in the features of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isfinite
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import LOWER, bucket_ids, chunks, filtered, parts, text_of
from kinfold.session import ship

BITS = 15
FACTORS = 8
#: Labelled rows the model is fitted on at most.
MAX_TRAIN = 6000
EPOCHS = 10
THRESHOLD = 0.3
SYMBOLS, SHOUT, PIPE = b"#*$%&<>", b"!", b"|"
UPPER, DIGITS, STOPS = bytes(range(65, 91)), b"0123456789", b".,;:?"
N_STATS = 13
#: Classes of a metadata column: the binary order of its size, and one for null.
META_CLASSES = 64
STATS_AT = 1 << BITS
META_AT = STATS_AT + N_STATS


class Model(NamedTuple):
    w0: float
    w: np.ndarray
    v: np.ndarray
    centre: np.ndarray
    spread: np.ndarray


class Rows(NamedTuple):
    """Sparse rows: features, their values, the start of each row; and the statistics before scaling."""

    index: np.ndarray
    value: np.ndarray
    start: np.ndarray
    stats: np.ndarray


def statistics(raw: bytes, words: list[bytes], ids: np.ndarray) -> list[float]:
    """Structure of a text. All are 0 for a text without words."""
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * N_STATS
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    lines = raw.split(b"\n")
    triples = ids[:-2].astype(np.uint64) << np.uint64(2 * BITS) | ids[1:-1].astype(np.uint64) << np.uint64(BITS) | ids[2:] if n > 2 else ids[:0]
    return [
        np.log1p(n), min(size / n, 50.0), len(set(words)) / n, share(SYMBOLS), share(SHOUT), share(PIPE), share(UPPER), share(DIGITS), share(STOPS),
        len(lines) / n, 1 - len(set(lines)) / len(lines), float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        1 - len(np.unique(triples)) / len(triples) if len(triples) else 0.0,
    ]


def order_of(x: float | None) -> int:
    """Class of a metadata value: its binary order of magnitude, and one class for nulls, NaN and infinite ones."""
    return META_CLASSES - 1 if x is None or not isfinite(x) else min(META_CLASSES - 2, int(abs(x)).bit_length())


def features(texts: list[str], meta: list[list]) -> Rows:
    """Rows of a chunk. ``meta``: the metadata columns, nulls allowed."""
    index, value, start, stats, at = [], [], [], [], 0
    for k, text in enumerate(texts):
        raw = text.encode()
        words = raw.translate(LOWER).split()
        ids = bucket_ids(words, BITS)
        found, counts = np.unique(ids, return_counts=True)
        tf = np.sqrt(counts) / np.sqrt(max(1, len(words)))
        orders = [META_AT + META_CLASSES * c + order_of(m[k]) for c, m in enumerate(meta)]
        index += [found.astype(np.int64), np.arange(STATS_AT, STATS_AT + N_STATS), np.array(orders, np.int64)]
        value += [tf.astype(np.float32), np.zeros(N_STATS, np.float32), np.ones(len(orders), np.float32)]
        start.append(at)
        at += len(found) + N_STATS + len(orders)
        stats.append(statistics(raw, words, ids))
    return Rows(np.concatenate(index), np.concatenate(value), np.array(start), np.array(stats, np.float32))


def scaled(rows: Rows, model: Model) -> Rows:
    value = rows.value.copy()
    # statistics of every row, in order
    value[(rows.index >= STATS_AT) & (rows.index < META_AT)] = np.clip((rows.stats - model.centre) / model.spread, -4, 4).ravel() / np.float32(2)
    return rows._replace(value=value)


def raw_scores(rows: Rows, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(scores before the sigmoid, sum of factors of each row)."""
    part = model.v[rows.index] * rows.value[:, None]
    sums = np.add.reduceat(part, rows.start)
    squares = np.add.reduceat(part * part, rows.start)
    linear = np.add.reduceat(model.w[rows.index] * rows.value, rows.start)
    return model.w0 + linear + 0.5 * (sums * sums - squares).sum(1), sums


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def taken(rows: Rows, which: np.ndarray) -> Rows:
    ends = np.append(rows.start[1:], len(rows.index))
    sizes = ends[which] - rows.start[which]
    at = np.concatenate([np.arange(rows.start[i], ends[i]) for i in which])
    return Rows(rows.index[at], rows.value[at], np.concatenate([[0], np.cumsum(sizes)[:-1]]), rows.stats[which])


def fitted(rows: Rows, labels: np.ndarray, width: int, seed: int = 7) -> Model:
    """Adagrad on the log loss, in batches of 128 rows in seeded order."""
    rng = np.random.default_rng(seed)
    centre, spread = rows.stats.mean(0), rows.stats.std(0) + 1e-3
    model = Model(0.0, np.zeros(width, np.float32), rng.normal(0, 0.02, (width, FACTORS)).astype(np.float32), centre, spread)
    rows = scaled(rows, model)
    w0, g0 = 0.0, 1e-6
    seen_w, seen_v = np.full(width, 1e-6, np.float32), np.full((width, FACTORS), 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 128):
            part = order[at : at + 128]
            batch = taken(rows, part)
            raw, sums = raw_scores(batch, model._replace(w0=w0))
            error = (sigmoid(raw) - labels[part]).astype(np.float32) / len(part)
            of_row = np.repeat(np.arange(len(part)), np.diff(np.append(batch.start, len(batch.index))))
            x = batch.value
            gw = error[of_row] * x
            gv = (error[of_row] * x)[:, None] * (sums[of_row] - model.v[batch.index] * x[:, None])
            by = np.argsort(batch.index, kind="stable")
            keys, first = np.unique(batch.index[by], return_index=True)
            gw, gv = np.add.reduceat(gw[by], first) + 1e-5 * model.w[keys], np.add.reduceat(gv[by], first) + 1e-5 * model.v[keys]
            seen_w[keys] += gw * gw
            seen_v[keys] += gv * gv
            model.w[keys] -= 0.1 * gw / np.sqrt(seen_w[keys])
            model.v[keys] -= 0.03 * gv / np.sqrt(seen_v[keys])
            g = float(error.sum())
            g0 += g * g
            w0 -= 0.1 * g / g0**0.5
    return model._replace(w0=w0)


def remainder(column: str):
    return F.crc32(F.col(column).cast("string")) % 5


def train(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("n_chars",), max_rows: int = MAX_TRAIN) -> Model:
    """Model of the rows of ``labels`` (doc_id, quality) whose id has a remainder other than 0.

    At most ``max_rows`` of them, chosen by a hash of the id, are read by the driver as
    features. Rows without a label or text are left out. Without any label of both kinds every text scores 0.5.
    """
    ship(docs.sparkSession)
    known = labels.where((remainder("doc_id") != 0) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    # at most max_rows pairs of numbers
    numbers = [F.col(m).cast("double").alias(f"meta_{k}") for k, m in enumerate(metadata)]
    rows = docs.select("doc_id", "text", *numbers).join(F.broadcast(known), "doc_id").where(F.col("text").isNotNull())
    # of the rows of one id the least by its text's hash, so that the model repeats
    row = F.struct("text", "quality", *(f"meta_{k}" for k in range(len(metadata))))
    rows = rows.groupBy("doc_id").agg(F.min_by(row, F.struct(F.xxhash64("text"), row)).alias("r")).select("doc_id", "r.*")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in parts(batch)):
            texts, quality = b.column(1).to_pylist(), b.column(2).to_pylist()
            meta = [b.column(3 + k).to_pylist() for k in range(len(metadata))]
            for k, text in enumerate(texts):
                r = features([text], [[m[k]] for m in meta])
                yield pa.RecordBatch.from_pydict({"id": [b.column(0)[k].as_py()], "label": [float(quality[k])], "i": [r.index.astype(np.int32).tobytes()], "x": [r.value.tobytes()], "s": [r.stats.tobytes()]})

    got = sorted(rows.mapInArrow(of_batches, "id long, label double, i binary, x binary, s binary").collect(), key=lambda r: r.id)
    width = META_AT + META_CLASSES * len(metadata)
    y = np.array([r.label for r in got])
    if len(set(y)) < 2:
        return Model(0.0, np.zeros(width, np.float32), np.zeros((width, FACTORS), np.float32), np.zeros(N_STATS, np.float32), np.ones(N_STATS, np.float32))
    index = [np.frombuffer(r.i, np.int32) for r in got]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in index])[:-1]])
    value = np.concatenate([np.frombuffer(r.x, np.float32) for r in got])
    stats = np.stack([np.frombuffer(r.s, np.float32) for r in got])
    return fitted(Rows(np.concatenate(index).astype(np.int64), value, starts, stats), y, width)


def score(docs: DataFrame, model: Model, metadata: tuple[str, ...] = ("n_chars",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Reads whole texts. Null texts count as empty; empty texts have a score by their
    metadata and the means of the model; equal rows score equally; rows without an id are not held out; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), *[F.col(m).cast("double").alias(f"meta_{k}") for k, m in enumerate(metadata)])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            meta = [b.column(2 + k).to_pylist() for k in range(len(metadata))]
            for ids, texts in chunks([b]):
                part = features(texts, [m[at : at + len(texts)] for m in meta])
                raw, _ = raw_scores(scaled(part, sent.value), sent.value)
                at += len(texts)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "score": sigmoid(raw.astype(np.float64))})

    scored = rows.mapInArrow(of_batches, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model predicts to be good."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list, *meta: list) -> list[bool]:
        out = []
        for k, text in enumerate(texts):
            raw, _ = raw_scores(scaled(features([text or ""], [[m[k]] for m in meta]), sent.value), sent.value)
            out.append(bool(sigmoid(raw.astype(np.float64))[0] >= THRESHOLD))
        return out

    return filtered(docs, keep, ["text", *metadata])
