"""Quality rules: a table of thresholds compiled into one projection.

Native: only Spark's own functions. Words are runs of anything but space and
the controls 9 to 13.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import WHITE, WORD_BREAK, text_of

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish. Fixed values.
STOP_WORDS = (
    "the of and to in is that for it was on with as be by this are from or an at "
    "der die das und in den von zu mit ist auf im nicht ein eine für sich auch "
    "le la les de des et un une du en que qui dans pour est sur au "
    "el los las y del se por con para una su al lo como"
).split()
STOP_WORDS = sorted(set(STOP_WORDS))


class Rule(NamedTuple):
    """A ratio of two measures that must lie between two bounds; None leaves a side open."""

    name: str
    over: str
    under: str
    least: float | None
    most: float | None


#: Measures are the columns of ``measured``. An empty denominator passes: word counts are judged by the base rule.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("shouted_per_word", "n_shouts", "n_words", None, 0.3),
    Rule("capitals_per_character", "n_capitals", "word_chars", None, 0.4),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.02, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.3),
    Rule("words_in_repeated_windows", "n_repeat_words", "n_words", None, 0.4),
)
MIN_WORDS = 50


def _removed(text: Column, characters: str) -> Column:
    """How many of the characters the text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _covered(starts: Column) -> Column:
    """Words covered by windows of three that begin at the sorted starts; after the last, least() gives 3."""
    gaps = F.zip_with(F.slice(starts, 2, F.size(starts)), starts, lambda b, a: F.least(b - a, F.lit(3)))
    return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of each row: (doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, ...).

    A null text counts as empty. Rows are independent, so copies, ties and
    clashing columns of the input do not matter; only the two named columns are read.
    Windows of three words are compared by 64-bit hashes.
    """
    text = F.col("text")
    pages = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    split = pages.select(
        "doc_id",
        F.filter(F.split(text, WORD_BREAK), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "").alias("lines"),
        F.length(F.translate(text, WHITE, "")).alias("word_chars"),
        _removed(text, SYMBOLS).alias("n_symbols"),
        _removed(text, "!").alias("n_shouts"),
        _removed(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
    )
    n = F.size("words")
    at = lambda i: F.get("words", i)
    hashed = split.withColumn(
        "windows",
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))))
        .otherwise(F.array().cast("array<bigint>")),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = hashed.withColumn(
        "ordered",
        F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    beside = lambda j: F.get("ordered", j)["h"]
    marked = F.transform(
        "ordered",
        lambda e, j: F.when(e["h"].eqNullSafe(beside(j - 1)) | e["h"].eqNullSafe(beside(j + 1)), e["i"]),
    )
    starts = ordered.withColumn("starts", F.sort_array(F.filter(marked, lambda i: i.isNotNull())))
    big = lambda c, name: c.cast("bigint").alias(name)
    # made by a generator, below which no filter on a measure moves: it would be computed from the text again and again
    return starts.select("doc_id", F.inline(F.array(F.struct(
        big(n, "n_words"),
        big(F.col("word_chars"), "word_chars"),
        big(F.col("n_symbols"), "n_symbols"),
        big(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        big(F.when(F.size("starts") > 0, _covered(F.col("starts"))).otherwise(0), "n_repeat_words"),
        big(F.size("lines"), "n_lines"),
        big(F.col("n_shouts"), "n_shouts"),
        big(F.col("n_capitals"), "n_capitals"),
        big(F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))), "n_stop_words"),
    ))))


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The rules as one condition on the measures."""
    tests = []
    for r in rules:
        ratio = F.col(r.over) / F.col(r.under)
        bounds = [ratio >= r.least] * (r.least is not None) + [ratio <= r.most] * (r.most is not None)
        tests.append(F.when(F.col(r.under) == 0, True).otherwise(reduce(lambda a, b: a & b, bounds, F.lit(True))))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of every row.

    ``base_failed``: under 50 words, or more than half of the words in repeated
    windows. ``kept``: the base rule and every rule of the table hold. Empty and
    null texts fail by their word count; an empty table gives no rows.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured(docs, id_col, text_col).select("*", failed.alias("base_failed"), (~failed & compiled(rules)).alias("kept"))


def rules_sql() -> str:
    """DuckDB SQL for the query's rows."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = []
    for r in RULES:
        parts = [f"{r.over} / {r.under} >= {r.least}"] * (r.least is not None) + [f"{r.over} / {r.under} <= {r.most}"] * (r.most is not None)
        tests.append(f"({r.under} = 0 OR ({' AND '.join(parts)}))")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
  length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals FROM t),
w AS (SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS g FROM (
  SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM a WHERE len(words) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM w) WHERE c >= 2),
c AS (SELECT doc_id, count(*) AS n_repeat_words FROM (
  SELECT DISTINCT doc_id, i + k AS p FROM r, (VALUES (0), (1), (2)) o(k)) GROUP BY doc_id),
m AS (SELECT a.doc_id, len(words)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  len(lines)::BIGINT AS n_lines, n_shouts::BIGINT AS n_shouts, n_capitals::BIGINT AS n_capitals,
  len(list_filter(words, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words
  FROM a LEFT JOIN c ON a.doc_id = c.doc_id)
SELECT *, base_failed = false AND {' AND '.join(tests)} AS kept
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
"""
