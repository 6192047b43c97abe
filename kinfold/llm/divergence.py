"""Audit of how far the sources of a language lie apart in their terms.

The terms that enough documents of a language have are found by iceberg refinement: the documents that
have a term beginning with some bytes number at least those that have any one such term, so a prefix in
too few documents is dropped with all that begins with it. Prefixes grow level by level
until every term that is left is complete; the long tail of rare terms is sent as short prefixes only.

What survives a level travels as a bitmap of hashes of bounded size. A hash met by chance lets
a prefix through that the exact counts of the next level drop again, so results do not depend on it.

Counts, shares and divergences are integers throughout.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.common import cut_lineage, distinct
from kinfold.session import ship

LEAST_DOCUMENTS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
#: Bytes of the prefixes of the first level; each level doubles them.
FIRST = 6
#: Bits of the bitmap for each surviving prefix, and of the bitmap at least and at most.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 30
#: Prefixes left for each kept term at which the last level begins.
LAST = 0.1
#: Characters of text whose words are counted together.
RUN = 2_000_000
#: Keys that a task holds before it sends their counts, and hashes that it remembers.
HELD = 200_000
#: Rows of (language, source) that are broadcast at most; more are shuffled.
BROADCAST_ROWS = 200_000
#: Cells of a matrix of terms by sources, and of sums that a task holds at most.
CELLS = 2_000_000

#: Letters of a term as they are, A-Z lower-cased, spaces for what parts terms.
TERM = bytes(c + 32 if chr(c) in string.ascii_uppercase else c if c >= 128 or chr(c) in string.ascii_lowercase else 32 for c in range(256))
SEED = 42


@dataclass
class Alive:
    """Hashes of the terms or prefixes that survived. ``xxhash64`` of Spark is this hash with seed 42."""

    size: int
    bitmap: bytes

    def __contains__(self, key: bytes) -> bool:
        import xxhash

        at = xxhash.xxh64_intdigest(key, SEED) & (len(self.bitmap) * 8 - 1)
        return bool(self.bitmap[at >> 3] >> (at & 7) & 1)


class Known(dict):
    """Whether a language's terms or prefixes are alive, remembered."""

    def __init__(self, lang: str, alive: Alive):
        super().__init__()
        self.head, self.alive = lang.encode() + b"\0", alive

    def __missing__(self, key: bytes) -> bool:
        if len(self) > HELD:
            self.clear()
        found = self[key] = self.head + key in self.alive
        return found


def bitmap_of(prefixes: DataFrame, size: int, n: int) -> Alive:
    """The surviving (lang, term), n of them, as a bitmap."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n - 1).bit_length()))
    at = F.xxhash64(F.concat(F.encode("lang", "UTF-8"), F.lit(b"\0"), F.col("term"))).bitwiseAND(F.lit(bits - 1))
    rows = prefixes.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
    out = bytearray(bits // 8)
    for r in rows.toLocalIterator():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["bits"]
    return Alive(size, bytes(out))


def _in_runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, list[str]]]:
    """(keys, texts) of the documents that have these keys in common, about RUN characters at a time."""
    of = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
    texts, held, size = batch.column("text"), [], 0
    order = sorted(range(len(of)), key=of.__getitem__)
    for k, i in enumerate(order):
        held.append(texts[i].as_py())
        size += len(held[-1])
        if k + 1 == len(order) or size > RUN or of[order[k + 1]] != of[i]:
            yield of[i], held
            held, size = [], 0


def bytes_of(column: pa.Array) -> list[bytes]:
    """Values of a binary column without nulls, cut out of its data; a scalar for each would cost ten times as much."""
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else []
    data = data.to_pybytes() if data is not None else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def coded(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct terms, term of each word, text of each word) of some texts."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer((b" ".join([b"", *raw]) + b" ").translate(TERM), np.uint8)
    word = data != 32
    starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    if not len(starts):
        return [], starts, starts
    # the words' bytes side by side are an Arrow column, whose dictionary is made there
    offsets = np.append(0, np.cumsum(ends - starts))
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]).dictionary_encode()
    first = np.searchsorted(starts, 1 + np.cumsum([0, *(len(r) + 1 for r in raw)]))
    return bytes_of(column.dictionary), column.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(first))


def in_texts(code: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, text) of the distinct pairs of them, codes under n."""
    pairs = distinct(text * n + code)
    return pairs % n, pairs // n


def _summed(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    # tasks send sums already, so rows are dealt out before they are added, all sources of a term to one place
    return rows.repartition("lang", "term").groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))


def level(docs: DataFrame, size: int, alive: Alive | None) -> DataFrame:
    """(lang, complete, term, docs) of the terms complete within ``size`` bytes, and of the prefixes of longer ones.

    Only what begins with a prefix alive at the level before is counted, and what was complete there is left out.
    A task sends its counts on when it holds HELD of them.
    """
    sent = docs.sparkSession.sparkContext.broadcast(alive)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Known] = {}
        counters: dict[tuple[str, bool], Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, complete), c in counters.items():
                columns = [pa.repeat(pa.scalar(lang, pa.string()), len(c)), pa.repeat(pa.scalar(complete, pa.bool_()), len(c)), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "complete", "term", "docs"])
            counters.clear()

        for batch in batches:
            for (lang,), texts in _in_runs(batch, ["lang"]):
                terms, code, text = coded(texts)
                if sent.value and terms:
                    before, live = sent.value.size, known.setdefault(lang, Known(lang, sent.value))
                    alive = np.array([len(t) > before and live[t[:before]] for t in terms])
                    code, text = code[alive[code]], text[alive[code]]
                if not len(code):
                    continue
                code, text = in_texts(code, text, len(terms))
                long = np.array([len(t) > size for t in terms])[code]
                prefixes = pa.array([t[:size] for t in terms], pa.binary()).dictionary_encode()
                heads, names = prefixes.indices.to_numpy().astype(np.int64), bytes_of(prefixes.dictionary)
                head, _ = in_texts(heads[code[long]], text[long], len(names))
                for complete, found, of in ((True, code[~long], terms), (False, head, names)):
                    numbers = np.bincount(found)
                    counter = counters.setdefault((lang, complete), Counter())
                    for k in np.flatnonzero(numbers).tolist():
                        counter[of[k]] += int(numbers[k])
                if sum(map(len, counters.values())) > HELD:
                    yield from flush()
        yield from flush()

    sums = docs.select("text", "lang", "source").mapInArrow(counted, "lang string, complete boolean, term binary, docs long")
    return _summed(sums, ["lang", "complete", "term"], ["docs"])


def occurrences(docs: DataFrame, kept: Alive, rest: Alive) -> DataFrame:
    """(lang, source, term, docs, n): how often a source has each kept term, and whole terms that go on from the prefixes of ``rest``.

    ``docs`` is the number of documents of the latter, 0 for kept terms.
    """
    sent = docs.sparkSession.sparkContext.broadcast((kept, rest))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rest = sent.value
        known: dict[str, tuple[Known, Known]] = {}
        for batch in batches:
            for (lang, source), texts in _in_runs(batch, ["lang", "source"]):
                terms, code, text = coded(texts)
                if not terms:
                    continue
                live, longer = known.setdefault(lang, (Known(lang, kept), Known(lang, rest)))
                long = np.array([len(t) > rest.size for t in terms])
                alive = np.array([longer[t[: rest.size]] if z else live[t] for t, z in zip(terms, long.tolist(), strict=True)])
                at = np.flatnonzero(alive)
                of_rest = (alive & long)[code]
                in_docs = np.bincount(in_texts(code[of_rest], text[of_rest], len(terms))[0], minlength=len(terms))
                columns = [pa.repeat(pa.scalar(x, pa.string()), len(at)) for x in (lang, source)]
                columns += [pa.array([terms[k] for k in at.tolist()], pa.binary()), pa.array(in_docs[at]), pa.array(np.bincount(code, minlength=len(terms))[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "docs", "n"])

    sums = docs.select("text", "lang", "source").mapInArrow(counted, "lang string, source string, term binary, docs long, n long")
    return _summed(sums, ["lang", "source", "term"], ["docs", "n"])


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term, by) of the terms in ``least`` documents of a language or more; ``by`` has (source, n) of its occurrences.

    When few prefixes are left beside the kept terms, their last level takes whole terms, in the pass that counts occurrences.
    """
    size, alive, found, kept = FIRST, None, None, 0
    while True:
        rows = cut_lineage(level(docs, size, alive).where(F.col("docs") >= least))
        complete = rows.where("complete").select("lang", "term")
        found = complete if found is None else found.unionAll(complete)
        longer = rows.where("NOT complete")
        n, kept = longer.count(), kept + complete.count()
        alive = bitmap_of(longer, size, n)
        if n <= LAST * kept:
            break
        size *= 2
    counts = occurrences(docs, bitmap_of(found, 0, kept), alive)
    by = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by"))
    # exact terms and counts decide; a hash met by chance ends here
    held = by.join(found.withColumn("kept", F.lit(True)), ["lang", "term"], "left").where((F.col("docs") >= least) | F.col("kept"))
    return held.select("lang", F.decode("term", "UTF-8").alias("term"), "by")


def share(count: Column, total: Column, kept: Column) -> Column:
    """Smoothed share in units of 1 / SCALE: 1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact for counts of any size."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.call_function("div", whole(count + 2, 22) * whole(F.lit(SCALE), 10), whole(total + 2 * kept, 22)) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of shares, which are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def pair_sums(terms: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, a, b, value): the gaps of two sources, a < b by number, summed over all terms.

    ``terms`` has (lang, at, p): the numbers and shares of the sources that have the term. ``langs`` has (lang,
    base): each source's share of a term it does not have. A task adds up a matrix of sources; no pair is made for a term.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def sent(lang: str, first: int, sums: np.ndarray) -> pa.RecordBatch:
            a, b = np.nonzero(np.arange(sums.shape[1])[None, :] > first + np.arange(len(sums))[:, None])
            columns = [pa.array([lang] * len(a), pa.string()), pa.array((a + first).astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(sums[a, b])]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            for name in dict.fromkeys(lang.tolist()):
                part = batch.filter(pa.array(lang == name))
                base = part.column("base")[0].values.to_numpy()
                n = len(base)
                for start in range(0, part.num_rows, max(1, CELLS // n)):
                    some = part.slice(start, max(1, CELLS // n))
                    shares = np.tile(base, (some.num_rows, 1))
                    row = np.repeat(np.arange(some.num_rows), [len(x) for x in some.column("at")])
                    shares[row, some.column("at").flatten().to_numpy()] = some.column("p").flatten().to_numpy()
                    rows = max(1, CELLS // n)
                    if name not in held and sum(x.size for x in held.values()) + n * n <= 4 * CELLS:
                        held[name] = np.zeros((n, n), np.int64)
                    for first in range(0, n, rows):
                        sums = held[name][first : first + rows] if name in held else np.zeros((min(rows, n - first), n), np.int64)
                        for a in range(first, min(first + rows, n)):
                            d = shares - shares[:, a : a + 1]
                            sums[a - first] += (d * d // (shares + shares[:, a : a + 1])).sum(0)
                        if name not in held:
                            yield sent(name, first, sums)
        for name, sums in held.items():
            yield sent(name, 0, sums)

    rows = terms.join(_few(langs), "lang").select("lang", "at", "p", "base")
    return rows.mapInArrow(summed, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and its ``top`` terms against the language.

    Terms are runs of ASCII letters, lower-cased, and of all characters beyond ASCII. A language keeps those in
    ``least`` of its documents; each row is a document, whatever its id. Null text, language and
    source are empty. Part ``pair`` has every other source of the language, also those without terms; part ``term`` the terms that
    a source has and has relatively more of. Ties go by the bytes of the item. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    of = lambda c: F.coalesce(F.col(c), F.lit("")).alias({text_col: "text", lang_col: "lang", source_col: "source"}[c])
    docs = docs.select(of(text_col), of(lang_col), of(source_col))
    terms = cut_lineage(kept_terms(docs, least))
    counts = terms.select("lang", "term", F.explode("by").alias("x")).select("lang", "term", "x.source", "x.n")
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("by", F.lit(0).cast("long"), lambda s, x: s + x["n"])).alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    none = F.lit(0).cast("long")
    groups = cut_lineage(
        docs.groupBy("lang", "source").count().drop("count").join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("total", "v", "lang_total"))).withColumn("number", number)
    )
    langs = groups.where("v > 0").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("number", share(none, F.col("total"), F.col("v")).alias("p")))).alias("base")).select("lang", F.col("base.p").alias("base"))

    in_lang = terms.select("lang", "term", F.explode("by").alias("x"), F.aggregate("by", none, lambda s, x: s + x["n"]).alias("lang_n"))
    shares = in_lang.select("lang", "term", "x.source", "x.n", "lang_n").join(_few(groups), ["lang", "source"]).select(
        "lang", "source", "number", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"),
    )
    shares = cut_lineage(shares)
    best = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    typical = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", best).where(F.col("rank") <= top)

    by_term = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("number", "p")).alias("x")).select("lang", F.col("x.number").alias("at"), F.col("x.p").alias("p"))
    sums = pair_sums(by_term, langs)
    both = sums.unionAll(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("lang", "source", "number")
    others = names.join(names.select("lang", F.col("source").alias("item"), F.col("number").alias("other")), "lang").where("number <> other")
    valued = others.join(both, (others.lang == both.lang) & (F.col("number") == F.col("a")) & (F.col("other") == F.col("b")), "left")
    pairs = valued.select(others.lang, "source", "item", F.coalesce("value", none).alias("value")).withColumn("rank", best)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionAll(columns(typical, "term"))


def divergence_sql(docs: str, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> str:
    """DuckDB SQL for the rows of ``divergence``."""
    p = lambda n, total: f"1 + ({SCALE}::HUGEINT * ({n} + 2)) // ({total} + 2 * v)"
    f = "((p - q) * (p - q)) // (p + q)"
    rank = "row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank"
    return f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM {docs}),
w AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT doc_id) >= {least}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL),
ln AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL), lt AS (SELECT lang, sum(n) AS total FROM n GROUP BY ALL),
s AS (SELECT lang, source, term, coalesce(n, 0) AS n, {p("coalesce(n, 0)", "coalesce(total, 0)")} AS p FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN n USING (lang, source, term)),
q AS (SELECT lang, term, {p("n", "total")} AS q FROM ln JOIN lt USING (lang) JOIN v USING (lang)),
pv AS (SELECT lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM s a JOIN s b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pr AS (SELECT lang, g.source, h.source AS item, coalesce(value, 0)::BIGINT AS value FROM g JOIN g h USING (lang) LEFT JOIN pv ON pv.lang = g.lang AND pv.source = g.source AND pv.item = h.source WHERE g.source <> h.source),
tr AS (SELECT lang, source, term AS item, ({f})::BIGINT AS value FROM s JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, {rank} FROM pr
UNION ALL SELECT lang, source, 'term', item, value, {rank} FROM tr QUALIFY rank <= {top}"""
