"""N-gram Jaccard join by token-combination prefixes.

Sets of 5-word shingles link at a Jaccard similarity of 0.8 or more. A set of n
tokens may miss t = floor(n / 5) of them. Tokens have one global order: rare ones
first, then frequent ones, each by hash. A rare token of a prefix is a signature by
itself. Frequent tokens fall into classes by hash, and each pair of one class is
a signature. A prefix is extended until its rare tokens, plus each class's tokens
less one, number t + 1: then two sets that link share a signature, for if
they shared none, every rare token and all but one of each class would be missing.

Groups of copies never become pairs: equal sets are one representative, rounds
of links to single members merge most of a group, and only pairs from different
components are compared after that, all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import arrow_map, chunks, cut_lineage, distinct, mixed, narrow, release, shingle_hashes, word_hashes_of
from kinfold.llm.components import components

#: Bits that tell frequent tokens by hash, and the number of sets in whose prefix a rare token is at most.
FLAGS, RARE = 1 << 25, 8
#: Signatures of one bucket, about.
BUCKET = 100_000
#: Rounds that link each set to one or two members of its signatures' groups.
ROUNDS = 2
#: Bits of the least sketch that bounds the overlap of two sets, and of the largest that goes along with signatures.
SKETCH_BITS, SMALL_BITS = 256, 2048
#: Ids of a join's side that are broadcast at most; more are shuffled.
BROADCAST_ROWS = 500_000
#: Sets compared with one set in one task, and partners in one list.
GROUP, PARTNERS = 500, 1000


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    return [distinct(shingle_hashes(w)) for w in word_hashes_of(texts)]


def allowed(n: np.ndarray | int):
    """Tokens that a set of n may have besides the shared ones."""
    return n // 5


def flag_of(tokens: np.ndarray) -> np.ndarray:
    return (mixed(tokens) & np.uint64(FLAGS - 1)).astype(np.int64)


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Signatures of a sorted set. ``frequent``: packed bits by ``flag_of``. Sets of up to three tokens link only with equal sets and have none."""
    n = len(tokens)
    if n < 4:
        return tokens[:0]
    flags = flag_of(tokens)
    often = (frequent[flags >> 3] >> (7 - (flags & 7)).astype(np.uint8) & 1).astype(bool)
    need = allowed(n) + 1
    rare = tokens[~often][:need]
    if len(rare) == need:
        return rare
    common, out = tokens[often], [rare]
    with np.errstate(over="ignore"):
        spread = mixed(common)
        for level in sorted({n.bit_length(), (n * 5 // 4).bit_length()}):
            classes = max(1, (1 << level) // 16)
            of = (spread % np.uint64(classes)).astype(np.int64)
            new = np.zeros(len(of), np.int64)
            new[np.unique(of, return_index=True)[1]] = 1
            size = int(np.searchsorted(np.cumsum(1 - new), need - len(rare))) + 1
            order = np.argsort(of[:size], kind="stable")
            kind, token = of[order], common[order]
            for step in range(1, size):
                same = kind[step:] == kind[:-step]
                if not same.any():
                    break
                x, y = token[step:][same], token[:-step][same]
                out.append(mixed(np.minimum(x, y) * np.uint64(2 * level + 1) + mixed(np.maximum(x, y))))
    return np.unique(np.concatenate(out))


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the tokens that hash to each bit: sets differ in at least as many tokens as their sketches in bits.

    There are at least as many bits as tokens, a power of two, so that a sketch folds to half its size.
    """
    bits = max(SKETCH_BITS, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount(((tokens >> np.uint64(21)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def small(sketched: bytes) -> bytes:
    """The sketch folded to SMALL_BITS if it has more: of a fixed size however long the text is."""
    words = np.frombuffer(sketched, np.uint64)
    return sketched if len(words) <= SMALL_BITS // 64 else np.bitwise_xor.reduce(words.reshape(-1, SMALL_BITS // 64), axis=0).tobytes()


def apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Bits in which each two sketches differ, the larger folded to the size of the smaller."""
    sizes = np.array([(len(a), len(b)) for a, b in zip(x, y, strict=True)]).reshape(-1, 2)
    out = np.zeros(len(x), np.int64)
    for size in {tuple(z) for z in sizes.tolist()}:
        at = np.flatnonzero((sizes == size).all(1))
        least = min(size)
        folded = [np.bitwise_xor.reduce(np.frombuffer(b"".join(s[i] for i in at), np.uint64).reshape(len(at), -1, least // 8), axis=1) for s in (x, y)]
        out[at] = np.bitwise_count(folded[0] ^ folded[1]).sum(1, dtype=np.int64)
    return out


def _digests(texts: DataFrame) -> DataFrame:
    """(doc_id, n, digest): size and digest of each text's set."""

    def of_chunk(ids: list, batch: list[str]) -> dict:
        import xxhash

        sets = shingle_sets(batch)
        return {"doc_id": ids, "n": [len(s) for s in sets], "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]}

    return arrow_map(texts, of_chunk, "doc_id long, n long, digest binary")


def _frequent(texts: DataFrame, buckets: int) -> np.ndarray:
    """Packed bits that flag tokens met in more than RARE prefixes by hash alone: FLAGS bits whatever the input."""
    nothing = np.zeros(FLAGS // 8, np.uint8)
    slices = min(1 << (buckets - 1).bit_length(), FLAGS // 64)
    width = FLAGS // slices

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            part = flag_of(tokens) // width
            order = np.argsort(part, kind="stable")
            keys, first = np.unique(part[order], return_index=True)
            return pa.RecordBatch.from_pydict({"slice": keys, "blob": [x.tobytes() for x in np.split(tokens[order], first[1:])]})

        for _, batch in chunks(batches):
            held += [s[: allowed(len(s)) + 1] for s in shingle_sets(batch) if len(s) > 3]
            if sum(map(len, held)) > 1_000_000:
                yield flush()
                held = []
        if held:
            yield flush()

    def flagged(table: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.frombuffer(b.as_py(), np.uint64) for b in table.column("blob")])
        values, counts = np.unique(tokens, return_counts=True)
        bits = np.zeros(width, np.uint8)
        bits[flag_of(values[counts > RARE]) % width] = 1
        return pa.table({"slice": table.column("slice").slice(0, 1), "bits": [np.packbits(bits).tobytes()]})

    sent = texts.mapInArrow(emit, "slice long, blob binary").groupBy("slice").applyInArrow(flagged, "slice long, bits binary")
    for r in sent.collect():
        nothing[r.slice * width // 8 : (r.slice + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
    return nothing


def _few(rows: DataFrame) -> DataFrame:
    """The rows, marked for a broadcast if a count shows them to be few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _signed(texts: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, sig, doc, n, pivot) of signatures that two sets share, the pivot the least of them; and with a null sig (doc, n, sketch, small) of each set."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            s, d = np.concatenate(sigs), np.concatenate(docs)
            where = (mixed(s) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(where, kind="stable")
            s, d, where = s[order], d[order], where[order]
            keys, first = np.unique(where, return_index=True)
            ends = np.append(first[1:], len(where))
            for k in range(0, len(keys), 64):
                part = slice(k, k + 64)
                blobs = [np.concatenate([s[i:j], d[i:j].view(np.uint64)]).tobytes() for i, j in zip(first[part], ends[part], strict=True)]
                m = len(blobs)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part], pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names=["bucket", "blob", "doc", "n", "sketch", "small"])

        for ids, batch in chunks(batches):
            sets = shingle_sets(batch)
            for i, tokens in zip(ids, sets, strict=True):
                s = signatures(tokens, sent.value)
                if len(s):
                    sigs.append(s)
                    docs.append(np.full(len(s), i, np.int64))
                    held += len(s)
            at = [(i, len(s), sketch(s)) for i, s in zip(ids, sets, strict=True) if len(s)]
            m = len(at)
            yield pa.RecordBatch.from_arrays([
                pa.array([int(x[0]) % buckets for x in at], pa.int32()), pa.nulls(m, pa.binary()), pa.array([x[0] for x in at], pa.int64()),
                pa.array([x[1] for x in at], pa.int64()), pa.array([x[2] for x in at], pa.binary()), pa.array([small(x[2]) for x in at], pa.binary())], names=["bucket", "blob", "doc", "n", "sketch", "small"])
            if held > 2_000_000:
                yield from flush()
                sigs, docs, held = [], [], 0
        if held:
            yield from flush()

    def shared(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        own = table.filter(pc.is_valid(table.column("doc")))
        parts = [np.frombuffer(b.as_py(), np.uint64).reshape(2, -1) for b in table.column("blob") if b.is_valid]
        sig, doc = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.uint64)
        order = np.lexsort((doc.view(np.int64), sig))
        sig, doc = sig[order], doc[order].view(np.int64)
        new = np.append(True, sig[1:] != sig[:-1])[: len(sig)]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(sig)))
        run = np.repeat(np.arange(len(first)), size)
        live = size[run] > 1
        m, k = int(live.sum()), own.num_rows
        return pa.table({
            "bucket": pa.array(np.full(m + k, bucket, np.int32)),
            "sig": pa.concat_arrays([pa.array(sig.view(np.int64)[live]), pa.nulls(k, pa.int64())]),
            "doc": pa.concat_arrays([pa.array(doc[live]), own.column("doc").combine_chunks()]),
            "pivot": pa.concat_arrays([pa.array(doc[first][run][live]), pa.nulls(k, pa.int64())]),
            "n": pa.concat_arrays([pa.nulls(m, pa.int64()), own.column("n").combine_chunks()]),
            "sketch": pa.concat_arrays([pa.nulls(m, pa.binary()), own.column("sketch").combine_chunks()]),
            "small": pa.concat_arrays([pa.nulls(m, pa.binary()), own.column("small").combine_chunks()]),
        })

    sent_out = texts.mapInArrow(emit, "bucket int, blob binary, doc long, n long, sketch binary, small binary")
    return sent_out.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(shared, "bucket int, sig long, doc long, pivot long, n long, sketch binary, small binary")


def _salted(rows: DataFrame, key: str, other: str, size: int) -> DataFrame:
    """Adds ``salt``: about ``size`` rows for each key and salt."""
    counts = rows.groupBy(key).agg(F.ceil(F.count("*") / size).alias("salts"))
    return rows.join(counts, key).withColumn("salt", F.pmod(F.xxhash64(other), F.col("salts")))


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by sketches first and then by the sets themselves."""
    of = lambda c: sets.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b").where(
        (100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    )

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                differing = apart(t.column("s_a").to_pylist(), t.column("s_b").to_pylist())
                total = t.column("n_a").to_numpy() + t.column("n_b").to_numpy()
                # shared = (total - differing) / 2 at most, and the union is total less shared
                most = (total - differing) // 2
                yield t.select(["a", "b"]).filter(pa.array(100 * most >= threshold * (total - most)))

    left = cut_lineage(sized.mapInArrow(bounded, "a long, b long"))
    placed = cut_lineage(_salted(left, "b", "a", GROUP).select("a", "b", "salt"))
    sent = placed.select(F.col("a").alias("doc"), "b", "salt").unionAll(placed.select(F.col("b").alias("doc"), "b", "salt").distinct())
    # a set with many partners goes out in parts
    parted = _salted(sent.withColumnRenamed("salt", "to_salt"), "doc", "b", PARTNERS)
    lists = parted.groupBy("doc", "salt").agg(F.collect_list(F.struct("b", F.col("to_salt").alias("salt"))).alias("to")).drop("salt")
    involved = texts.join(_few(cut_lineage(lists)), texts.doc_id == F.col("doc")).select("doc_id", "text", F.col("to.b").alias("b"), F.col("to.salt").alias("salt"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i, text, b, salt in zip(*(t.column(c) for c in range(4)), strict=True):
                blob, b, salt, i = shingle_sets([text.as_py()])[0].tobytes(), b.as_py(), salt.as_py(), i.as_py()
                for k in range(0, len(b), 100):
                    m = len(b[k : k + 100])
                    yield pa.RecordBatch.from_arrays([pa.array(b[k : k + 100], pa.int64()), pa.array(salt[k : k + 100], pa.int64()), pa.array([i] * m, pa.int64()), pa.array([blob] * m, pa.binary())], names=["b", "salt", "doc", "tokens"])

    def compared(table: pa.Table) -> pa.Table:
        b = table.column("b")[0].as_py()
        docs = table.column("doc").to_pylist()
        sets_ = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("tokens")]
        own, out = sets_[docs.index(b)], []
        for a, s in zip(docs, sets_, strict=True):
            if a != b:
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                both = int((own[at] == s).sum())
                if 100 * both >= threshold * (len(s) + len(own) - both):
                    out.append(a)
        return pa.table({"a": pa.array(out, pa.int64()), "b": pa.array([b] * len(out), pa.int64())})

    return involved.mapInArrow(spread, "b long, salt long, doc long, tokens binary").groupBy("b", "salt").applyInArrow(compared, "a long, b long")


class Sketches:
    """Sketches of the sets of one bucket, each at its own size and folded to half of it, in one matrix for each size."""

    def __init__(self, ids: list[int], sketches: list[bytes]):
        self.ids = np.array(ids, np.int64)
        self.size = np.array([len(s) for s in sketches], np.int64)
        self.place: dict[int, np.ndarray] = {}
        self.rows: dict[int, np.ndarray] = {}
        for size in {int(x) for x in self.size} | {int(x) // 2 for x in self.size}:
            own, double = np.flatnonzero(self.size == size), np.flatnonzero(self.size == 2 * size)
            words = [np.frombuffer(b"".join(sketches[i] for i in own), np.uint64).reshape(-1, size // 8)]
            twice = np.frombuffer(b"".join(sketches[i] for i in double), np.uint64).reshape(len(double), 2, size // 8)
            self.rows[size] = np.concatenate([*words, twice[:, 0] ^ twice[:, 1]])
            self.place[size] = np.full(len(self.ids), -1, np.int64)
            self.place[size][np.concatenate([own, double])] = np.arange(len(own) + len(double))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Differing bits of the sketches at two lists of places; sizes within a factor of two."""
        out = np.zeros(len(a), np.int64)
        least = np.minimum(self.size[a], self.size[b])
        for size in np.unique(least):
            at, place, rows = np.flatnonzero(least == size), self.place[int(size)], self.rows[int(size)]
            for k in range(0, len(at), 100_000):
                some = at[k : k + 100_000]
                out[some] = np.bitwise_count(rows[place[a[some]]] ^ rows[place[b[some]]]).sum(1, dtype=np.int64)
        return out


#: Pairs of a bucket that are held before they are compared.
PAIRS_HELD = 500_000


def _cross_pairs(table: pa.Table, threshold: int) -> pa.Table:
    """All pairs of one bucket that share a signature, may link by size and sketch, and lie in different components."""
    own = table.filter(pc.is_valid(table.column("small")))
    table = table.filter(pc.is_valid(table.column("sig")))
    order = np.argsort(own.column("doc").to_numpy(), kind="stable")
    ids, sizes = (own.column(c).to_numpy()[order] for c in ("doc", "n"))
    sketches = Sketches(ids, [own.column("small")[int(i)].as_py() for i in order])
    sig, doc, comp = (table.column(c).to_numpy() for c in ("sig", "doc", "component"))
    doc = np.searchsorted(ids, doc)
    n = sizes[doc]
    order = np.lexsort((n, sig))
    sig, doc, n, comp = sig[order], doc[order], n[order], comp[order]
    ends = np.searchsorted(sig, sig, "right")
    found, held, size = [], [], 0

    def compared() -> np.ndarray:
        pairs = distinct(np.concatenate(held))
        a, b = pairs // len(ids), pairs % len(ids)
        total = sizes[a] + sizes[b]
        most = (total - sketches.apart(a, b)) // 2
        return pairs[100 * most >= threshold * (total - most)]

    for i in range(len(sig)):
        j = i + 1 + int(np.searchsorted(n[i + 1 : ends[i]], n[i] * 100 // threshold, "right"))
        other = doc[i + 1 : j][comp[i + 1 : j] != comp[i]]
        if len(other):
            held.append(np.maximum(other, doc[i]) * len(ids) + np.minimum(other, doc[i]))
            size += len(other)
        if size > PAIRS_HELD:
            found.append(compared())
            held, size = [], 0
    if held:
        found.append(compared())
    pairs = distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pa.table({"a": ids[pairs // len(ids)], "b": ids[pairs % len(ids)]})


def jaccard_components(docs: DataFrame, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Whole texts are read. Texts with fewer than five words are one shingle; null and
    empty texts and texts without words have none and link with nothing. Equal sets
    link. Rows with one id count as one document; those without an id link with nothing and have
    no component. An empty table gives no rows. ``threshold``
    is the least similarity in percent, 80 or more.
    """
    if threshold < 80:
        raise ValueError("prefixes are made for a similarity of 80 percent or more")
    texts = narrow(docs, id_col, text_col)
    base = cut_lineage(_digests(texts))
    tokens = base.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    known = base.where("n > 0 AND doc_id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    placed = cut_lineage(known.join(first, "digest").select("doc_id", "rep"))
    copies = placed.where("doc_id <> rep").select("doc_id").distinct()
    texts_of_sets = texts.where("doc_id IS NOT NULL").join(_few(copies), "doc_id", "left_anti")
    buckets = int(max(16, tokens // 5 // BUCKET))
    signed = release(cut_lineage(_signed(texts_of_sets, _frequent(texts_of_sets, buckets), buckets)))
    sets = signed.where("sig IS NULL").groupBy("doc").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.max("small").alias("small"))
    live = signed.where("sig IS NOT NULL").select("bucket", "sig", "doc", "pivot")

    def chosen(edges: DataFrame) -> DataFrame:
        """Of the pivots of each set, the least and the one met most often."""
        met = edges.where("doc <> pivot").groupBy("doc", "pivot").count()
        best = met.groupBy("doc").agg(F.min("pivot").alias("p"), F.max(F.struct("count", F.negate("pivot").alias("q")))["q"].alias("q"))
        pairs = best.select("doc", F.explode(F.array(F.col("p"), -F.col("q"))).alias("pivot"))
        return pairs.select(F.greatest("doc", "pivot").alias("a"), F.least("doc", "pivot").alias("b")).distinct()

    links = release(cut_lineage(_verified(chosen(live), sets, texts, threshold)))
    for turn in range(1, ROUNDS + 1):
        parts = components(links)
        parts = cut_lineage(live.select("doc").distinct().join(parts, F.col("doc") == F.col("id"), "left").select("doc", F.coalesce("component", "doc").alias("component")))
        open_sigs = live.join(parts, "doc")
        mixed_sigs = open_sigs.groupBy("bucket", "sig").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct(F.xxhash64("doc", F.lit(turn)).alias("h"), "doc", "component")).alias("p")
        ).where("low <> high")
        live = cut_lineage(open_sigs.join(mixed_sigs.select("sig", F.col("p.doc").alias("new"), F.col("p.component").alias("at")), "sig").select(
            "bucket", "sig", "doc", F.col("new").alias("pivot"), "component", "at"
        ))
        del parts, open_sigs, mixed_sigs
        release(live)
        if turn < ROUNDS:
            more = _verified(chosen(live.where("component <> at")), sets, texts, threshold)
            links = release(cut_lineage(links.unionAll(more)))
            live = live.select("bucket", "sig", "doc", "pivot")
    # a sketch goes to a bucket once for each set, not for each of its signatures
    own = live.select("bucket", "doc").distinct().join(sets.select("doc", "n", "small"), "doc")
    none = lambda kind: F.lit(None).cast(kind)
    rest = live.select("bucket", "sig", "doc", "component", none("long").alias("n"), none("binary").alias("small")).unionAll(
        own.select("bucket", none("long").alias("sig"), "doc", none("long").alias("component"), "n", "small")
    )
    pairs = rest.groupBy("bucket").applyInArrow(lambda t: _cross_pairs(t, threshold), "a long, b long").distinct()
    links = release(cut_lineage(links.unionAll(_verified(pairs, sets, texts, threshold))))
    final = components(links)
    placed = placed.join(final, F.col("rep") == F.col("id"), "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    placed = placed.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return base.join(placed, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is the least of its component; of rows with one id, one."""
    found = cut_lineage(jaccard_components(docs, threshold))
    others = cut_lineage(found.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(_few(others), "doc_id", "left_anti")
    repeated = cut_lineage(found.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    return kept.join(_few(repeated), "doc_id", "left_anti").unionByName(kept.join(_few(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def components_ctes(docs: str, threshold: int = 80) -> str:
    """DuckDB CTEs (recursive) for the rows of ``jaccard_components``: ``js`` shingles by id, ``jc`` components."""
    from kinfold.llm.decontaminate import shingles_sql

    return f"""{shingles_sql(docs, "doc_id", "js")},
jn AS (SELECT doc_id, count(*) AS n FROM js GROUP BY doc_id),
jp AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM js a JOIN js b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
jl AS (SELECT a, b FROM jp JOIN jn x ON x.doc_id = a JOIN jn y ON y.doc_id = b WHERE 100 * o >= {threshold} * (x.n + y.n - o)),
jr AS (SELECT doc_id AS id, doc_id AS c FROM {docs} UNION SELECT l.b, r.c FROM jr r JOIN jl l ON l.a = r.id AND r.c < l.b),
jc AS (SELECT id AS doc_id, min(c) AS component_id FROM jr GROUP BY id)"""
