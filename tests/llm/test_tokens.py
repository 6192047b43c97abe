"""Token counts against the library."""

import random
import unicodedata

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinfold.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def counted(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_short_way_is_proved_for_every_character(library):
    pattern = tokens.pre_token_pattern()
    import re

    for c in map(chr, range(0x20AD)):
        if re.match(f"[{tokens.SAFE}]", c):
            normal = library.normalizer.normalize_str(f"a{c}b")
            assert normal.replace(" ", "_") == re.sub(r"\s", "_", unicodedata.normalize("NFC", f"a{c}b").lower())
            pieces = [f"a{c}b".lower()[i:j] for _, (i, j) in library.pre_tokenizer.pre_tokenize_str(f"a{c}b".lower())]
            assert pieces == pattern.findall(f"a{c}b".lower()), hex(ord(c))


def test_whole_tokens_are_one_token(library):
    whole = tokens.whole_tokens(library, tokens.pre_token_pattern())
    assert len(whole) > 20_000
    assert all(counted(library, w) == 1 for w in random.Random(1).sample(whole, 500))


def test_counts_equal_the_library(spark, make, library):
    rng = random.Random(2)
    alphabet = "aAbBzZéÉßñŒ0123½²'’s. \n\t\x0b-_,!?<|>€“”…İΣς漢字😀́ ­\x85\x1c|endoftext|"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["<|endoftext|> a <|startoftext|>b", "they're I'd WE'LL don't", "<|endoftext", "the " * 3000, None, ""]
    got = {r.doc_id: r for r in tokens.count_tokens(make(texts), PATH).collect()}
    for i, t in enumerate(texts):
        n = counted(library, t)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 2048)


def test_awkward_rows(awkward, empty):
    assert tokens.count_tokens(awkward, PATH).count() == awkward.count()
    assert tokens.count_tokens(empty, PATH).count() == 0
