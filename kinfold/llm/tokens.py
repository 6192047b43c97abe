"""Token counts with a whole-token shortcut.

A pre-token that is one whole token by itself needs no merges. Which strings
of the vocabulary are such is proved once, with the library. Texts of
characters on which this module and the library provably agree are cut here and
looked up; the library merges the pre-tokens that are left, and encodes whole
texts with any other character or with a special string.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import arrow_map, narrow

#: Characters of the short way: white space, printable ASCII, Latin letters and common punctuation. The library lower-cases,
#: composes and classifies each of them as Python does, one by one (tests/llm/test_tokens.py).
SAFE = "\t-\r -~\xa0-įı-ɏ‐-‧‰-⁞€"
LIMIT = 2048
#: Merged pre-tokens remembered by a worker.
KEPT = 300_000


def _class(kind: str) -> str:
    """The safe characters of a class, and what they become in lower case."""
    safe = [chr(c) for c in range(0x20AD) if re.match(f"[{SAFE}]", chr(c))]
    found = {c for c in (*safe, *map(str.lower, safe)) if unicodedata.category(c)[0] == kind}
    return "".join(map(re.escape, sorted(found)))


def pre_token_pattern() -> re.Pattern:
    letters, numbers = _class("L"), _class("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else the next unused from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def whole_tokens(tokenizer, pattern: re.Pattern) -> list[str]:
    """Strings that are one pre-token and that the library encodes as one token."""
    back = {letter: b for b, letter in byte_letters().items()}
    suffix = "</w>"
    texts = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if token.endswith(suffix) and all(c in back for c in token[: -len(suffix)]):
            try:
                text = bytes(back[c] for c in token[: -len(suffix)]).decode()
            except UnicodeDecodeError:
                continue
            if pattern.findall(text) == [text] and text == text.lower() and re.fullmatch(f"[{SAFE}]+", text):
                texts.append(text)
    encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return [t for t, e in zip(texts, encoded, strict=True) if len(e.ids) == 1]


class Counter(dict):
    """Tokens of a pre-token: 1 for whole tokens, else what the library's merges leave."""

    def __init__(self, spec: str, whole: list[str]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = dict.fromkeys(whole, 1)
        super().__init__(self.whole)
        self.pattern = pre_token_pattern()
        special = [re.escape(t["content"]) for t in json.loads(spec)["added_tokens"]]
        self.other = re.compile("|".join([f"[^{SAFE}]", *special]))
        self.letters = byte_letters()

    def __missing__(self, pre_token: str) -> int:
        if len(self) > len(self.whole) + KEPT:
            self.clear()
            self.update(self.whole)
        mapped = pre_token if pre_token.isascii() else "".join(map(self.letters.__getitem__, pre_token.encode()))
        n = self[pre_token] = len(self.tokenizer.model.tokenize(mapped))
        return n

    def count(self, text: str) -> int:
        if self.other.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, self.pattern.findall(text.lower())))


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, as the library counts with the file at ``tokenizer_path``.

    The driver reads the file and sends it with the proved strings, so its size is
    that of one vocabulary. Null texts count as empty, with 0 tokens; copies are
    counted each; an empty table gives no rows. Only two columns are read, so others may have any name.
    """
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    whole = whole_tokens(Tokenizer.from_str(spec), pre_token_pattern())
    sent = docs.sparkSession.sparkContext.broadcast((spec, whole))
    key = hashlib.sha256(spec.encode()).hexdigest()

    def of_chunk(ids: list, texts: list[str]) -> dict:
        counter = _counters.get(key) or _counters.setdefault(key, Counter(*sent.value))
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": np.fromiter(map(counter.count, texts), np.int64, len(texts))}

    counted = arrow_map(narrow(docs, id_col, text_col), of_chunk, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
