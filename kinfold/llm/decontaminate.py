"""Benchmark decontamination: size-partitioned MinHash containment search.

Short items hide in long texts, so whole texts are not compared. Items are
partitioned by size; for a partition of items of at most B shingles a text is
cut into windows of 2B shingles that overlap by B, so that every passage of B
lies in one of them. Items and windows are sketched by one-permutation MinHash
(the least hash in each of BINS ranges of hashes); a window that shares a value
with an item makes a candidate, and candidates are verified with the exact
shingle sets. Items of at most SMALL shingles are their own sketch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import arrow_map, distinct, filtered, narrow, pieces, shingle_hashes, word_hashes, word_hashes_of

BINS_LOG2, SMALL = 6, 16
CONTAINMENT = 80
#: Characters of items that one pass over the texts looks for; more items take more passes.
BLOCK_CHARS = 16_000_000
NONE = np.uint64(2**64 - 1)
TABLE_BITS = 18


class Partition(NamedTuple):
    """Items of one size class: B, sorted sketch values, the item of each, and a table of their low bits."""

    width: int
    values: np.ndarray
    items: np.ndarray
    table: np.ndarray


class Block(NamedTuple):
    ids: list[int]
    sets: list[np.ndarray]
    partitions: list[Partition]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Least hash of each range of hashes that has one."""
    hashes = np.sort(hashes)
    return hashes[np.unique(hashes >> np.uint64(64 - BINS_LOG2), return_index=True)[1]]


def block_of(items: list[tuple[int, str]]) -> Block:
    ids = [i for i, _ in items]
    sets = [distinct(shingle_hashes(word_hashes(t))) for _, t in items]
    by_width: dict[int, list[int]] = {}
    for k, s in enumerate(sets):
        if len(s):
            by_width.setdefault(max(SMALL, 1 << (len(s) - 1).bit_length()), []).append(k)
    partitions = []
    for width, members in sorted(by_width.items()):
        keys = [sets[k] if width == SMALL else sketch(sets[k]) for k in members]
        values, owner = np.concatenate(keys), np.repeat(members, [len(x) for x in keys])
        order = np.argsort(values, kind="stable")
        table = np.zeros(1 << TABLE_BITS, bool)
        table[values & np.uint64(len(table) - 1)] = True
        partitions.append(Partition(width, values[order], owner[order], table))
    return Block(ids, sets, partitions)


def window_values(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sketch values of all windows of 2 * width shingles that begin at multiples of width."""
    if width == SMALL:
        return hashes
    of_block = (np.arange(len(hashes), dtype=np.int64) // width) << BINS_LOG2
    cells = of_block + (hashes >> np.uint64(64 - BINS_LOG2)).astype(np.int64)
    least = np.full(int(of_block[-1]) + (1 << BINS_LOG2), NONE)
    np.minimum.at(least, cells, hashes)
    least = least.reshape(-1, 1 << BINS_LOG2)
    return (np.minimum(least[:-1], least[1:]) if len(least) > 1 else least).ravel()


def matches(words: np.ndarray, block: Block, containment: int) -> list[tuple[int, int, int]]:
    """(position of item, shared shingles, shingles of the item) of the items inside a text of hashed words."""
    hashes = shingle_hashes(words)
    if len(hashes) == 0:
        return []
    found: set[int] = set()
    for p in block.partitions:
        values = window_values(hashes, p.width)
        values = values[p.table[values & np.uint64(len(p.table) - 1)]]
        if len(values):
            values = np.unique(values)
            first, last = np.searchsorted(p.values, values, "left"), np.searchsorted(p.values, values, "right")
            for i, j in zip(first[last > first], last[last > first], strict=True):
                found.update(p.items[i:j].tolist())
    if not found:
        return []
    own, out = distinct(hashes), []
    for k in sorted(found):
        s = block.sets[k]
        at = np.minimum(np.searchsorted(own, s), len(own) - 1)
        shared = int((own[at] == s).sum())
        if 100 * shared >= containment * len(s):
            out.append((k, shared, len(s)))
    return out


def contaminated(docs: DataFrame, items: DataFrame, containment: int = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): items of which a text holds at least ``containment`` percent of the distinct 5-word shingles.

    ``items`` has (item_id, text). Texts and items with fewer than five words are one
    shingle; those without words match nothing, as null texts do. Equal items and equal
    texts each have rows of their own. Items are read in blocks of bounded size, each a pass over the texts.
    An empty table on either side gives no rows.
    """
    texts, out = narrow(docs, id_col, text_col), None
    for block in blocks_of(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def of_chunk(ids: list, batch: list[str], sent=sent) -> dict:
            found = [(i, sent.value.ids[k], shared, size) for i, t in zip(ids, word_hashes_of(batch), strict=True) for k, shared, size in matches(t, sent.value, containment)]
            return {name: [f[c] for f in found] for c, name in enumerate(("doc_id", "item_id", "n_shared", "n_item"))}

        part = arrow_map(texts, of_chunk, "doc_id long, item_id long, n_shared long, n_item long")
        out = part if out is None else out.unionAll(part)
    return out


def blocks_of(items: DataFrame) -> Iterator[Block]:
    """The items (item_id, text) in blocks of about BLOCK_CHARS characters; one block, empty, for an empty table."""
    queries = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    chars = queries.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    blocks = chars // BLOCK_CHARS + 1
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield block_of(sorted((r.item_id, r.text) for r in rows))


def clean(docs: DataFrame, items: DataFrame, containment: int = CONTAINMENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold none of the items (item_id, text)."""
    for block in blocks_of(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        docs = filtered(docs, lambda texts, sent=sent: [not matches(w, sent.value, containment) for part in pieces(texts) for w in word_hashes_of(part)], ["text"])
    return docs


def shingles_sql(table: str, key: str, name: str) -> str:
    """CTEs for the distinct shingles of a table: ``name``(key, g)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""{name}_w AS (SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM {table}),
{name} AS (SELECT DISTINCT {key}, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM {name}_w WHERE len(w) > 0))"""


def contaminated_ctes(docs: str, containment: int = CONTAINMENT) -> str:
    return f"""{shingles_sql(docs, "doc_id", "cd")}, {shingles_sql("benchmark", "item_id", "ci")},
cn AS (SELECT item_id, count(*) AS n_item FROM ci GROUP BY item_id),
leaks AS (SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n_item)::BIGINT AS n_item
  FROM cd JOIN ci USING (g) JOIN cn USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= {containment} * any_value(n_item))"""
