"""Removal of long repeats against brute force."""

import collections
import hashlib
import random

import pytest

from kinfold.llm import suffixes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def check(make, texts, length, gram):
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(make(texts), length, gram).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


@pytest.mark.parametrize("seed", range(3))
def test_random_repeats(make, seed):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("abé \n") for _ in range(n))
    shared = [piece(rng.randint(30, 200)) for _ in range(6)]
    texts = ["".join(rng.choice(shared)[rng.randint(0, 20) :] if rng.random() < 0.5 else piece(rng.randint(1, 80)) for _ in range(rng.randint(1, 8))) for _ in range(50)]
    texts += ["ab" * 150, "x" * 200, texts[0], "", texts[1][:39], texts[2] + "tail"]
    check(make, texts, 40, 12)
    check(make, texts, 41, 9)


def test_length_of_the_query(make):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(90))
    texts = [" ".join(word() for _ in range(100)) + passage[k : k + 400 + k % 3 - 1] + word() for k in range(20)]
    check(make, [*texts, passage, "Der " * 300, passage[:399], passage[:400]], suffixes.LENGTH, suffixes.GRAM)


def test_awkward_rows(awkward, empty):
    rows = suffixes.remove_repeats(awkward, 100, 20, with_text=True).collect()
    assert len(rows) == awkward.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].n_removed == by_id[0].n_bytes > 0 and by_id[0].n_spans == 1 and by_id[0].kept == b""
    assert by_id[1].n_bytes == by_id[2].n_bytes == 0
    assert by_id[8].n_removed >= by_id[8].n_bytes - 4
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in rows)
    assert suffixes.remove_repeats(empty).count() == 0


def test_one_id_with_two_texts(make):
    rng = random.Random(5)
    piece = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    twice, shared = piece(60), piece(60)
    texts = [(3, piece(90)), (5, twice + piece(30) + twice + shared), (8, shared + piece(50))]
    rows = [*texts, (5, texts[0][1])]
    got = sorted(tuple(r) for r in suffixes.remove_repeats(make(rows), 40, 12).collect())
    assert got == sorted((i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], 40)))
