"""Secret scans: fixed patterns, and guess costs of values in credential contexts.

The guess cost of a value is the least sum over its segmentations into words,
dates, repeats, keyboard walks and brute-force spans (dynamic programming over
end positions). A value whose cost reaches a threshold is no placeholder. Words
are those of the corpus, ranked by the number of texts that have them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import arrow_map, chunks, cut_lineage, narrow, parts
from kinfold.session import ship

KINDS = ("assign", "access", "hex", "cost")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A quoted value ends at its quote, so it may hold any symbol; a bare one ends at white space, quotes, brackets, commas and semicolons.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|auth(?:orization)?|(?:api|private|access|client)[_-]?key)"""
    r"""["']?[\x20\t]*(?:[:=]|=>|\bis\b)[\x20\t]*"""
    r"""(?:"([^"\s]{8,})"|'([^'\s]{8,})'|`([^`\s]{8,})`|["'`]?([^\s"'`<>,;(){}\[\]]{8,}))""",
    re.ASCII | re.IGNORECASE,
)
#: One of these, in any case, is in every match of ASSIGN or CONTEXT.
HINTS = (b"pass", b"secret", b"token", b"api", b"pwd", b"credential", b"bearer", b"auth", b"key")
#: Common words and passwords, most common first. Fixed values.
COMMON = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login princess sunshine shadow football baseball superman batman trustno "
    "iloveyou starwars hello freedom whatever secret summer winter spring autumn changeme default example test guest root user pass access "
    "love god money king server system database account private public token key value string name your here placeholder sample demo dummy none null true false"
).split()
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "1qaz2wsx3edc4rfv5tgb6yhn7ujm", "abcdefghijklmnopqrstuvwxyz")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
#: log10 of guesses: of a join between two segments, and of the least cost of a secret.
JOIN, THRESHOLD = 0.3, 10.0
LEET = str.maketrans("@4310$57!", "aaeiosstl")


def _class_size(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


RANKS = {w: i + 1 for i, w in enumerate(COMMON)}
#: Words of the corpus in the dictionary, at most; their letters; the texts that must have one. With these a word
#: costs log10(DICTIONARY + 1) + 0.9 = 5.9 at most and 7.7 with a sign at its end, which is below THRESHOLD.
DICTIONARY, LETTERS, LEAST_TEXTS = 100_000, (3, 24), 2
WORD = re.compile(r"[^\W\d_]+")


def dictionary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of a corpus by the number of texts that have them, to be stored and given to ``scan`` and ``redact``.

    All texts are counted. Values of credential contexts are not, so that a secret is no word because copies repeat it.
    Words as frequent as each other, within a 16th of a doubling, are in the dictionary together or not at all; it has
    at most DICTIONARY words. An empty table gives an empty dictionary; copies of a text and repeated ids count each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            n: Counter = Counter()
            for t in texts:
                low = t.encode().lower()
                if any(h in low for h in HINTS):
                    t = ASSIGN.sub(" ", CONTEXT.sub(" ", t))
                n.update({w for w in WORD.findall(t.lower()) if LETTERS[0] <= len(w) <= LETTERS[1]})
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    words = narrow(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    words = cut_lineage(words.withColumn("step", F.floor(F.log2("n") * 16)))
    least, total = None, 0
    for r in sorted(words.groupBy("step").count().collect(), reverse=True):
        total += r["count"]
        if total > DICTIONARY:
            break
        least = r.step
    return words.where(F.col("step") >= least if least is not None else F.lit(False)).select("word", "n")


def ranked(words: DataFrame) -> dict[str, int]:
    """Ranks of a dictionary's words, most frequent first, and of COMMON; the lesser where a word has both.

    Null words and counts are left out; of a word with several rows the most frequent counts. More than DICTIONARY words are refused.
    """
    kept = words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.max("n").alias("n")).limit(DICTIONARY + 1).collect()
    if len(kept) > DICTIONARY:
        raise ValueError(f"a dictionary has at most {DICTIONARY} words")
    ranks = {r.word: k + 1 for k, r in enumerate(sorted(kept, key=lambda r: (-r.n, r.word)))}
    return ranks | {w: min(k, ranks.get(w, k)) for w, k in RANKS.items()}


def ranks_of(docs: DataFrame) -> dict[str, int]:
    """Ranks of the words of a corpus."""
    return ranked(dictionary(docs))


def _segments(value: str, ranks: dict[str, int] = RANKS) -> dict[int, list[tuple[int, float]]]:
    """Starts and costs of the segments that end at each position, brute force apart."""
    low, out = value.lower(), {}
    add = lambda i, j, cost: out.setdefault(j, []).append((i, cost))
    plain = low.translate(LEET)
    for i in range(len(value)):
        for j in range(i + LETTERS[0], min(len(value), i + LETTERS[1]) + 1):
            rank = ranks.get(low[i:j]) or ranks.get(plain[i:j])
            if rank:
                add(i, j, log10(rank + 1) + (0.3 if value[i:j] != low[i:j] else 0) + (0.6 if low[i:j] != plain[i:j] else 0))
    for m in re.finditer(r"(?=(%s))" % DATE.pattern, value):
        add(m.start(1), m.end(1), log10(366 * 120))
    for m in re.finditer(r"(.{1,4}?)\1{2,}", value, re.DOTALL):
        add(m.start(), m.end(), sum(log10(_class_size(c)) for c in m[1]) + log10(len(m[0]) / len(m[1])))
    for walk in WALKS:
        for row in (walk, walk[::-1]):
            i = 0
            while i < len(low):
                j, at = i + 1, row.find(low[i])
                while at >= 0 and j < len(low) and at + j - i < len(row) and row[at + j - i] == low[j]:
                    j += 1
                if at >= 0 and j - i >= 3:
                    add(i, j, log10(len(WALKS) * 2 * len(row) * (j - i)))
                    i = j
                else:
                    i += 1
    return out


def guess_cost(value: str, ranks: dict[str, int] = RANKS) -> float:
    """log10 of the guesses that the cheapest segmentation needs; 0 for an empty value."""
    best = [0.0] + [float("inf")] * len(value)
    open_run = [float("inf")] * (len(value) + 1)  # the cheapest whose last span is brute force
    ends = _segments(value, ranks)
    for j in range(1, len(value) + 1):
        step = log10(_class_size(value[j - 1]))
        join = JOIN if j > 1 else 0.0
        open_run[j] = min(open_run[j - 1], best[j - 1] + join) + step
        best[j] = min([open_run[j], *(best[i] + cost + (JOIN if i else 0.0) for i, cost in ends.get(j, ()))])
    return best[-1]


def context_values(text: str, ranks: dict[str, int] = RANKS) -> list[tuple[int, int, float]]:
    """(start, end, guess cost) of every value of a credential context, of any length, whole."""
    low = text.encode().lower()
    if not any(h in low for h in HINTS):
        return []
    return [(*m.span(m.lastindex), guess_cost(m[m.lastindex], ranks)) for m in CONTEXT.finditer(text)]


def find_spans(text: str, values: list[tuple[int, int, float]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of a text in order: the three fixed kinds, then values of credential contexts that are costly to guess.

    A costly value is left out where a fixed span already covers it. ``values`` are the text's context values, if known.
    """
    found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    low = text.encode().lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        base = sorted(found)
        for i, j, cost in context_values(text) if values is None else values:
            if cost >= THRESHOLD and not any(s <= i and j <= e for s, _, e in base):
                found.append((i, 3, j))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_cost, base_sha256, spans, guess_costs) of every row.

    ``guess_costs`` has start:end:cost of each value of a credential context, also of those in a fixed span. Whole texts are read; null counts as empty. A text without a secret has an empty
    list of spans. Copies are scanned each. An empty table gives no rows; only two columns are read.

    ``words`` is a stored ``dictionary``; with the same one a text has the same spans in every table. Without it the
    dictionary is learned from ``docs`` in one more pass, so guess costs and cost spans depend on the other texts there.
    """
    texts = narrow(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(ranks_of(texts) if words is None else ranked(words))

    def of_chunk(ids: list, texts: list[str]) -> dict:
        values = [context_values(t, sent.value) for t in texts]
        all_spans = list(map(find_spans, texts, values))
        counts = {f"n_{KINDS[k]}": [sum(x[1] == k for x in s) for s in all_spans] for k in range(4)}
        digests = [hashlib.sha256(joined([x for x in s if x[1] < 3]).encode()).hexdigest() for s in all_spans]
        return {"doc_id": ids, **counts, "base_sha256": digests, "spans": list(map(joined, all_spans)), "guess_costs": [",".join(f"{i}:{j}:{c:.2f}" for i, j, c in v) for v in values]}

    return arrow_map(texts, of_chunk, "doc_id long, n_assign long, n_access long, n_hex long, n_cost long, base_sha256 string, spans string, guess_costs string")


def redacted(text: str, ranks: dict[str, int] = RANKS) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at, spans = [], 0, find_spans(text, context_values(text, ranks))
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by its kind, and ``n_chars`` of the changed texts counted anew.

    Null and empty texts stay as they are, repeated rows are redacted each, an empty table gives no rows, other columns are
    kept whatever their names. ``words`` as in ``scan``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in parts(batch)):
            at, n = b.schema.get_field_index("text"), b.schema.get_field_index("n_chars")
            old = b.column(at).to_pylist()
            new = [t and redacted(t, sent.value) for t in old]
            b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            if n >= 0:
                counts = [len(y) if x != y else c for x, y, c in zip(old, new, b.column(n).to_pylist(), strict=True)]
                b = b.set_column(n, b.schema.field(n), pa.array(counts, b.schema.field(n).type))
            yield b

    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ranks_of(docs) if words is None else ranked(words))
    return docs.mapInArrow(run, docs.schema)
