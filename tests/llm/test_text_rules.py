"""Secret scans, quality rules, the classifier, licences, mixing and WARC."""

import gzip
import hashlib
import re

import pytest
from conftest_llm import BREAK
from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import licenses, mixing, quality_fm, rules, secrets, warc
from kinfold.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def plain_base(text):
    found = [("assign", m) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = {"assign": 0, "access": 1, "hex": 2}
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in sorted(found, key=lambda x: (x[1].start(), order[x[0]])))


SECRETS = [
    'é token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" x', "PASSWORD:hunter2hunter2 api_key='abcd' apikey=abcdefgh", "AKIAABCDEFGHIJKL AKIAAKIA AKIA", "ſecret=abcdefghi toKen=abcdefghi",
    "password: token=abcdefgh12", "deadbeef" * 4 + " " + "deadbeef" * 3, "pwd: xK9#vQ2!mZ7pL0", "passphrase is correct-horse", "pwd=password123", None, "", "secret" * 5000 + "=abcdefgh",
]


def test_secrets_equal_plain_patterns(spark, make):
    got = {r.doc_id: r for r in secrets.scan(make(SECRETS)).collect()}
    for i, t in enumerate(SECRETS):
        want = plain_base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("cost")] == [s for s in want.split(",") if s]
        assert got[i].n_assign == want.count("assign") and got[i].n_access == want.count("access") and got[i].n_hex == want.count("hex")
    assert got[6].n_cost == 1 and got[8].n_cost == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = secrets.scan(docs).collect()
    assert all(r.base_sha256 == hashlib.sha256(plain_base(texts[r.doc_id]).encode()).hexdigest() for r in rows)
    assert sum(r.n_assign for r in rows) > 0


def least_cost(value, ends, at=0, open_run=False):
    """The cheapest segmentation by trying all."""
    if at == len(value):
        return 0.0
    from math import log10

    step = log10(secrets._class_size(value[at]))
    best = step + (0 if open_run or at == 0 else secrets.JOIN) + least_cost(value, ends, at + 1, True)
    for j, starts in ends.items():
        for i, cost in starts:
            if i == at:
                best = min(best, cost + (secrets.JOIN if at else 0) + least_cost(value, ends, j, False))
    return best


@pytest.mark.parametrize("value", ["", "a", "password", "qwerty12", "20240131x", "aaaaaaa", "P@ssw0rd1", "zx81!kQ", "abcabcabc", "summer2021"])
def test_guess_cost_is_the_least(value):
    assert secrets.guess_cost(value) == pytest.approx(least_cost(value, secrets._segments(value)))


def test_long_values_are_spans_whole():
    value = "xK9#vQ2!mZ7pL0" * 40
    text = f"login credentials: {value} and more"
    assert secrets.find_spans(text) == [(19, 3, 19 + len(value))]
    assert value[-14:] not in secrets.redacted(text)


KEYWORDS = "password passwd passphrase passcode pwd secret token api_key apikey credential credentials bearer auth authorization private_key access-key client_key".split()


@pytest.mark.parametrize("word", KEYWORDS)
def test_values_with_symbols_are_found_after_each_keyword(word):
    for value in ("Zx!9$kQ2@mP7w", "q7$Lm#9zT!x2", "aB3(x,Y;9[z]{Q}k"):
        for text in (f'{word}: "{value}" x', f"{word.upper()} = '{value}'"):
            at = text.index(value)
            assert secrets.find_spans(text) == [(at, 3, at + len(value))], text
            assert secrets.redacted(text) == text.replace(value, "<cost>")


def test_every_context_value_has_a_guess_cost(make):
    texts = ['token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"', "api_key=abcdefgh12 pwd: password123", "no value here"]
    got = {r.doc_id: r for r in secrets.scan(make(texts)).collect()}
    for i, values in enumerate((["2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"], ["abcdefgh12", "password123"], [])):
        found = [x.split(":") for x in got[i].guess_costs.split(",") if x]
        assert [texts[i][int(s) : int(e)] for s, e, _ in found] == values and all(float(c) > 0 for *_, c in found)
        assert got[i].base_sha256 == hashlib.sha256(plain_base(texts[i]).encode()).hexdigest()
    assert got[0].n_cost == 0 and got[0].n_assign == 1


def test_prose_is_no_secret(make):
    claims = ["The secret is consistency", "What they pass is considered final", "Our secret is patience.", "The token is Authentic, they say", "Le secret is préparation!"]
    other = ["consistency and patience are considered", "authentic préparation", "of patience, consistency: préparation considered authentic"]
    hidden = ["secret is qzxvkjwpt", "my secret is qzxvkjwpt", "pwd: xK9#vQ2!mZ7pL0"]
    docs = make(claims + other + hidden)
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    left = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    for i, t in enumerate(claims + other):
        assert got[i].n_cost == 0 and got[i].spans == "" and left[i] == t
        assert i >= len(claims) or got[i].guess_costs
    for i in range(len(claims + other), docs.count()):
        assert got[i].n_cost == 1 and "<cost>" in left[i]


def test_dictionary_is_bounded_and_ranked(make, monkeypatch, empty):
    from math import log10

    texts = ["alpha beta gamma"] * 4 + ["alpha beta"] * 2 + ["alpha delta"] * 3 + ["once token: hiddenvalue"] + ["x token: hiddenvalue"]
    ranks = secrets.ranks_of(make(texts))
    assert [ranks[w] for w in ("alpha", "beta", "gamma", "delta")] == [1, 2, 3, 4] and "once" not in ranks and "hiddenvalue" not in ranks
    monkeypatch.setattr(secrets, "DICTIONARY", 2)
    assert {"alpha", "beta"} == set(secrets.ranks_of(make(texts))) - set(secrets.RANKS)
    monkeypatch.undo()
    assert secrets.ranks_of(empty) == secrets.RANKS
    assert log10(secrets.DICTIONARY + 1) + 0.9 + secrets.JOIN + log10(33) < secrets.THRESHOLD


def test_a_stored_dictionary_gives_a_text_the_same_spans_everywhere(spark, make, empty):
    value = "our secret is paragliding now"
    alone, among = make([value]), make([value, "paragliding here", "paragliding there", "then paragliding"])
    spans = lambda docs, words=None: {r.doc_id: (r.spans, r.guess_costs) for r in secrets.scan(docs, words=words).collect()}[0]
    assert spans(alone) != spans(among)
    words = secrets.dictionary(among)
    assert words.columns == ["word", "n"]
    stored = spark.createDataFrame([*words.collect(), (None, 3), ("paragliding", 1)], words.schema)
    assert spans(alone, stored) == spans(among, stored) == spans(among)
    assert secrets.redact(alone, stored).first().text == value and secrets.redact(alone).first().text != value
    assert secrets.ranked(secrets.dictionary(empty)) == secrets.RANKS


def test_license_sample_is_the_least_by_hash(make, monkeypatch):
    texts = make([(i, "\n".join(f"line {i} {j}" for j in range(40))) for i in range(60)]).select("doc_id", "text")
    lines = texts.selectExpr("doc_id", "posexplode(split(text, '\n'))").selectExpr("xxhash64(doc_id, pos) AS h", "col").collect()
    monkeypatch.setattr(licenses, "SAMPLE_LINES", 50)
    assert licenses.sample_lines(texts) == [r.col for r in sorted(lines)[:50]]


def test_guess_costs_are_ordered():
    assert secrets.guess_cost("password123456") < secrets.guess_cost("summer20210131") < secrets.THRESHOLD < secrets.guess_cost("xK9#vQ2!mZ7pL0")


def test_redaction_leaves_no_secret(make, awkward, empty):
    rows = secrets.redact(make(SECRETS)).collect()
    assert all(r.text is None or (not plain_base(r.text) and r.n_chars in (None, len(r.text))) for r in rows)
    assert secrets.redact(awkward).columns == awkward.columns and secrets.redact(awkward).count() == awkward.count()
    assert secrets.redact(empty).count() == 0 and secrets.scan(empty).count() == 0
    assert secrets.scan(awkward).where("spans = ''").count() == awkward.count()


def plain_measures(text):
    words = [w for w in BREAK.split(text or "") if w]
    lines = [x for x in (text or "").split("\n") if BREAK.sub("", x)]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in rules.SYMBOLS), len(lines) - len(set(lines)), len(marked)


def test_rules_equal_plain_measures(make, awkward, empty):
    texts = ["a b c a b c", "x x x x", "a b a b a b", "one", "a\nb\na\n\n a\n", "#$ <a>|\n#$ <a>|", "the of and to " * 40, None, "", " a\x0bb\x0cc\r\n", "a b c d e a b c f d e a"]
    for r in rules.quality_rules(make(texts)).collect():
        n, *rest = plain_measures(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [n, *rest], texts[r.doc_id]
        assert r.base_failed == (n < 50 or 100 * r.n_repeat_words > 50 * n) and not (r.base_failed and r.kept)
    assert rules.quality_rules(awkward).count() == awkward.count()
    assert rules.quality_rules(empty).count() == 0


def test_rules_keep_good_documents(spark):
    joined = QUERIES["op9_quality_rules"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("n_words >= 50")
    good, bad = joined.where("quality = 1"), joined.where("quality = 0")
    assert good.where("kept").count() >= 0.98 * good.count() and bad.where("kept").count() <= 0.1 * bad.count()


def test_rules_use_no_python(spark):
    plan = QUERIES["op9_quality_rules"](spark, SF)._jdf.queryExecution().toString() + QUERIES["op6_source_mix"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_classifier_on_held_out_rows(spark):
    joined = QUERIES["op7_quality_classifier"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(joined) > 50 and (joined.predicted == joined.quality).mean() > 0.93
    assert joined.score.between(0, 1).all()


def test_sum_of_squares_identity(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    width = quality_fm.META_AT + quality_fm.META_CLASSES
    model = quality_fm.Model(0.3, rng.normal(size=width).astype(np.float32), rng.normal(size=(width, quality_fm.FACTORS)).astype(np.float32), np.zeros(quality_fm.N_STATS), np.ones(quality_fm.N_STATS))
    rows = quality_fm.scaled(quality_fm.features(["some words and some more", ""], [[5, None]]), model)
    got, _ = quality_fm.raw_scores(rows, model)
    ends = [rows.start[1], len(rows.index)]
    for k in range(2):
        i, x = rows.index[rows.start[k] : ends[k]], rows.value[rows.start[k] : ends[k]].astype(float)
        pairs = sum(model.v[i[a]].astype(float) @ model.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert got[k] == pytest.approx(0.3 + model.w[i] @ x + pairs, rel=1e-3, abs=1e-3)


def test_classifier_on_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(9, None, None), (None, 1, 0), (0, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality_fm.train(awkward, labels)
    assert quality_fm.score(awkward, model).where("score BETWEEN 0 AND 1").count() == awkward.count()
    kept = quality_fm.accepted(awkward, model)
    assert kept.columns == awkward.columns
    assert quality_fm.score(awkward, model).where("predicted = 1").count() == kept.count()
    assert quality_fm.score(empty, quality_fm.train(empty, labels)).count() == 0
    assert [r.score for r in quality_fm.score(awkward, quality_fm.train(awkward, labels.where("doc_id > 99"))).collect()] == [0.5] * awkward.count()


def test_licences_are_found_and_confirmed(spark, make, awkward, empty):
    prose = "and then the river ran on for many miles through the green valley to the sea"
    texts = [f"{prose}\n{t}\n{prose}" for ts in licenses.TEMPLATES.values() for t in ts]
    families = [f for f, ts in licenses.TEMPLATES.items() for _ in ts]
    negatives = [*licenses.NO_LICENCE, prose, "", None]
    got = licenses.scan(make(texts + negatives)).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.paragraph, r.family))
    hit = sum((1, f) in found.get(i, []) for i, f in enumerate(families))
    assert hit >= 0.9 * len(families), [(texts[i], found.get(i)) for i, f in enumerate(families) if (1, f) not in found.get(i, [])]
    assert not [i for i in found if i >= len(texts)]
    assert licenses.scan(awkward).count() == 0 and licenses.scan(empty).count() == 0


WRAPPED = {
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy", 'of this software and associated documentation files (the "Software"), to deal', "in the Software without restriction, including without limitation the rights"],
    "bsd": ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions are met:"],
    "lgpl": ["This library is free software; you can redistribute it and/or", "modify it under the terms of the GNU Lesser General Public", "License as published by the Free Software Foundation; either"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any", "purpose with or without fee is hereby granted, provided that the above"],
}


@pytest.mark.parametrize("mark", ["", " * ", "# ", "//"])
def test_wrapped_licences_are_found(make, mark):
    prose = ["the river ran on for many miles", "through the green valley to the sea"]
    texts = ["\n".join([*prose, "", *(mark + x for x in lines), mark.rstrip(), *prose]) for lines in WRAPPED.values()]
    got = licenses.scan(make([*texts, "\n".join(prose * 9)])).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in got) == [(i, 3, f) for i, f in enumerate(WRAPPED)]


def test_licences_of_the_documents(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    want = set(texts[texts.text.str.contains("License|CC BY|All rights reserved", regex=True)].doc_id)
    got = {r.doc_id for r in QUERIES["op1_license_scan"](spark, SF).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(texts)


def test_mixture_meets_targets(spark):
    rows = [(i, "web" if i < 900 else "books", "en" if i % 3 else "de", f"s{i % 4}", 1 + i % 50) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, tokens long")
    got = mixing.mix(docs).toPandas()
    total = got.tokens.sum()
    spent = (got.tokens * got.copies).groupby(got.domain).sum()
    # books can give four epochs of its tokens at most; web takes what is left
    books = min(0.3 / 0.7 * total // 2, 4 * got[got.domain == "books"].tokens.sum())
    assert abs(spent["books"] - books) <= 50 * 16 and abs(spent.sum() - total // 2) <= 50 * 16
    assert got.copies.max() <= 4


def test_rows_of_a_hot_leaf_stay_where_they_are(spark, make):
    """No exchange between the stored rows and the copies: the plan of the leaves is broadcast."""
    docs = make([(i, "a b c " * (i % 7)) for i in range(300)])
    plan = mixing.mix_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_mixture_of_awkward_rows(awkward, empty):
    got = mixing.mix_documents(awkward, 1.0).collect()
    assert len(got) == awkward.count() and all(r.copies >= 0 for r in got)
    kept = mixing.mixed_documents(awkward)
    assert sorted(kept.columns) == sorted(awkward.columns)
    assert mixing.mix_documents(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


PAGES = [
    (1, "http://a/", "<html><head><title>A &amp; B</title><style>p{}</style></head><body><p>One&nbsp;two<br>three &#233;&#x41; &#xD800; &amp;lt;</p><script>var t='</p>';</script><!-- x --><a href='b'>link</a></body></html>"),
    (2, None, None), (3, "", ""), (3, "", ""), (4, "u", "no tags < here"), (None, "u", "<p>" * 30_000 + "deep"),
]


def test_warc_records_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    records = warc.derivatives(warc.responses_of(pages), keep=("page_id",))
    rows = records.collect()
    assert len(rows) == 2 * len(PAGES)
    one = {r.record_type: r for r in rows if r.page_id == 1}
    assert one["conversion"].block == "One two\nthree éA &#xD800; &lt;\nlink" and one["conversion"].refers_to == one["metadata"].refers_to
    assert "title: A & B\r\n" in one["metadata"].block and "outlinks: 1\r\n" in one["metadata"].block and "source-header-Content-Type: text/html" in one["metadata"].block
    assert all(len(r.block.encode()) == r.content_length and r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() for r in rows)
    warc.write_warc(records, str(tmp_path / "out"))
    seen = []
    for path in (tmp_path / "out").glob("*.gz"):
        data = gzip.decompress(path.read_bytes())
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1") and data[size : size + 4] == b"\r\n\r\n"
            seen.append((fields["WARC-Type"], fields["WARC-Record-ID"][1:-1], fields["WARC-Refers-To"][1:-1], data[:size].decode()))
            data = data[size + 4 :]
    assert sorted(seen) == sorted((r.record_type, r.record_id, r.refers_to, r.block) for r in rows)
    assert warc.derivatives(warc.responses_of(pages.where("page_id > 9"))).count() == 0


def test_every_named_entity_is_decoded(spark):
    import html

    names = sorted(html.entities.html5)
    texts = [f"a &{n} b" for n in names] + [f"&{n}x;&{n}" for n in names if n[-1] != ";"]
    texts += ["&copy; 2024 &middot; caf&eacute; &uuml;&mdash;&NotEqualTilde;", "&copy2024", "&notit; &notin; &am &amp &", "&amp;eacute; &amp;#65; &#38;lt;", "&unknown; &Copy; R&D a&b=1", "no entity", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", warc.decoded(F.col("t")).alias("t")).collect()
    assert {r.i: r.t for r in rows} == {i: html.unescape(t).replace("\xa0", " ") for i, t in enumerate(texts)}


def test_warc_query_has_the_decoded_blocks(spark):
    rows = QUERIES["op10_warc_derivatives"](spark, SF).where("record_type = 'conversion'").collect()
    assert rows and all("©" in r.block and "&copy;" not in r.block and "&middot;" not in r.block for r in rows)
    assert all(r.content_length == len(r.block.encode()) and r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() for r in rows)


def test_pipeline_stages(spark, awkward, empty, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    left = docs.collect()
    assert 0.6 * len(start) < len(left) < len(start)
    assert all(not plain_base(r.text) for r in left)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert final.columns == [*docs.columns, "copies"] and 0 < final.count() <= len(left)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, final.collect()))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        assert stage(spark, awkward, SF).count() <= awkward.count()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_metadata_that_is_no_number(spark):
    """NaN, infinite and null metadata are one class; rows of one id give the same model each time."""
    from kinfold.llm import quality_fm as fm

    assert {fm.order_of(x) for x in (None, float("nan"), float("inf"), float("-inf"))} == {fm.META_CLASSES - 1}
    rows = [(i % 40, f"{'good words here' if i % 2 else 'BAD !!! ###'} {i}", [float("nan"), float("inf"), None, 7.0][i % 4]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    first, second = (fm.train(docs.repartition(n), labels) for n in (2, 7))
    assert (first.v == second.v).all() and (first.w == second.w).all()
    scores = fm.score(docs, first).collect()
    assert len(scores) == 80 and all(0 <= r.score <= 1 for r in scores)
    assert fm.accepted(docs, first).count() == sum(r.predicted for r in scores)


def test_parts_of_batches(monkeypatch):
    import pyarrow as pa

    from kinfold.llm import common

    monkeypatch.setattr(common, "CHUNK_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"a": [1, 2, 3, 4, 5], "t": ["x" * 25, None, "yy", "z" * 9, ""]})
    got = list(common.parts(batch))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch])) and len(got) == 2
    assert list(common.parts(batch.slice(0, 0))) == []
