"""Divergence of sources against a version with full counts."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from kinfold.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=10, top=10):
    docs = [(lang or "", source or "", Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in d[2])
        kept = [t for t, n in df.items() if n >= least]
        v = len(kept)
        counts = defaultdict(Counter)
        for _, source, c in mine:
            counts[source].update({t: n for t, n in c.items() if df[t] >= least})
        whole = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 1000000000 * (c[t] + 2) // (sum(c.values()) + 2 * v)

        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in counts.items():
            pairs = [(sum(f(share(c, t), share(o, t)) for t in kept), x) for x, o in counts.items() if x != s]
            terms = [(f(share(c, t), share(whole, t)), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, found, n in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:n]
                out += [(lang, s, part, x, value, k + 1) for k, (value, x) in enumerate(ordered)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "x", "y", 0) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, docs string, n int").repartition(4)


def corpus(seed, n=300, langs=("en", "de", None, "zz")):
    rng = random.Random(seed)
    words = ["a", "Abc", "abcd", "abcde", "abcdefgh", "abcdefghi", "x" * 40, "x" * 41, "x" * 300, "é", "漢字", "éclair", "rare", "un-do", "3x"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(langs), rng.choice(["s1", "s2", "ß", None, "s10"])) for _ in range(n)]
    return rows + [(None, "en", "lonely"), ("", "qq", None), ("once only", "qq", "two"), (None, None, None)] + [("the same text again", "en", "s1")] * 12


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = sorted(map(tuple, dv.divergence(table(spark, rows)).collect()))
    assert got == brute(rows)
    assert {r[2] for r in got} == {"pair", "term"}


def test_last_level_at_once(spark, monkeypatch):
    rows = corpus(5, 200)
    monkeypatch.setattr(dv, "LAST", 1e9)
    assert sorted(map(tuple, dv.divergence(table(spark, rows)).collect())) == brute(rows)


def test_small_bounds_change_nothing(spark, monkeypatch):
    rows = corpus(3, 150)
    want = brute(rows, least=3, top=4)
    for name, value in (("HELD", 5), ("CELLS", 7), ("BROADCAST_ROWS", 0), ("LEAST_BITS", 1 << 15), ("MOST_BITS", 1 << 15), ("FIRST", 1), ("LAST", 0), ("RUN", 50)):
        monkeypatch.setattr(dv, name, value)
    assert sorted(map(tuple, dv.divergence(table(spark, rows), least=3, top=4).collect())) == want


def test_only_survivors_are_extended(spark):
    """Prefixes in too few documents are not sent again."""
    rows = [(f"common prefixed{chr(97 + k % 26)} lone{chr(97 + k)}longer", "en", "s") for k in range(20)]
    docs = table(spark, rows).select("text", "lang", "source")
    first = dv.level(docs, 4, None)
    alive = dv.bitmap_of(first.where("docs >= 10 AND NOT complete"), 4, first.count())
    assert b"en\0comm" in alive and b"en\0pref" in alive and b"en\0lone" in alive and b"en\0othe" not in alive
    second = {bytes(r.term) for r in dv.level(docs, 8, alive).collect()}
    assert {b"common", b"prefixed"} <= second
    third = dv.bitmap_of(dv.level(docs, 8, alive).where("docs >= 10"), 8, 3)
    assert b"en\0lonealon" not in third


def test_shares_beyond_long(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(dv.share(F.lit(9 * 10**17), F.lit(10**18), F.lit(5)).alias("p")).first()
    assert row.p == 1 + 1000000000 * (9 * 10**17 + 2) // (10**18 + 10)


def test_empty_and_all_terms_rare(spark):
    assert dv.divergence(table(spark, corpus(1, 0)).where("doc_id < 0")).collect() == []
    rows = [("one two", "en", "a"), ("three", "en", "b")]
    assert sorted(map(tuple, dv.divergence(table(spark, rows)).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_very_long_term(spark):
    rows = [("y" * 3_000_000 + " z", "en", f"s{k % 2}") for k in range(3)]
    got = {r[3] for r in dv.divergence(table(spark, rows), least=3).collect() if r[2] == "term"}
    assert got <= {"y" * 3_000_000, "z"}


def test_terms_are_cut_out_of_their_column():
    values = [b"", "é".encode(), b"abc", b"\x00", b"z" * 300]
    for kind in (pa.binary(), pa.large_binary()):
        column = pa.array(values, kind)
        assert dv.bytes_of(column) == values
        assert dv.bytes_of(column[1:4]) == values[1:4]
        assert dv.bytes_of(column[:0]) == dv.bytes_of(pa.array([], kind)) == []
    terms, code, text = dv.coded(["b A b", "", "a"])
    assert ([terms[k] for k in code], text.tolist()) == ([b"b", b"a", b"b", b"a"], [0, 0, 0, 2])
