"""Mixing sources to target weights: hierarchical budgeting with seeded epochs.

Native: only Spark's own functions. A budget of tokens flows down a tree of
levels. At each node it is shared among the children by weight; what a child
cannot take, even with all its epochs, goes to its siblings first, and reaches
the node's own siblings only when every child is full. A leaf repeats its rows
for whole epochs and takes a prefix of the last one, in seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import WORD_BREAK, cut_lineage, text_of

#: Target weights of the query: shares of domains and languages; sources of one language share evenly. Fixed values.
DOMAIN_WEIGHTS = {"web": 0.4, "books": 0.3, "news": 0.2, "forums": 0.1}
LANG_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
OTHER_WEIGHT = 0.05
LEVELS = ("domain", "lang", "source")
MAX_EPOCHS = 4
SEED = "mix-1"
#: Leaves that are broadcast at most.
BROADCAST_LEAVES = 100_000
#: Hex digits of the seeded order that each step of the search for a leaf's cut adds.
DIGITS = (2, 4)


def weight_table(weights: dict[str, float], column: str) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for key, w in weights.items():
        out = F.when(F.col(column) == key, w).otherwise(out)
    return out


def default_weights() -> dict[str, Column]:
    return {"domain": weight_table(DOMAIN_WEIGHTS, "domain"), "lang": weight_table(LANG_WEIGHTS, "lang"), "source": F.lit(1.0)}


def domain_of(source: Column) -> Column:
    """Domain of a source by the number in its name; without one, the first."""
    number = F.coalesce(F.regexp_extract(source, "[0-9]{1,6}", 0).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAIN_WEIGHTS)), number % len(DOMAIN_WEIGHTS) + 1)


def n_words(text: str = "text") -> Column:
    return F.size(F.filter(F.split(text_of(text), WORD_BREAK), lambda w: w != "")).cast("bigint")


def filled(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Share each parent's ``budget`` among its rows by ``weight``, none beyond its ``cap``: adds ``share``.

    The rows are nodes of the tree, not documents. Weights of 0 or less get nothing.
    """
    key = parents or [F.lit(0)]
    rows = nodes.withColumn("weight", F.greatest("weight", F.lit(0.0))).withColumn(
        "full_at", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))
    )
    order = Window.partitionBy(*key).orderBy(F.col("full_at").asc_nulls_last(), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("full", F.coalesce(before + F.col("full_at") * left <= F.col("budget"), F.lit(False)))
    whole = Window.partitionBy(*key)
    spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(whole)
    share = F.when(F.col("full"), F.col("cap")).when(
        F.col("weight") > 0, F.least("cap", F.col("weight") * (F.col("budget") - spent) / open_weight)
    ).otherwise(0.0)
    return rows.withColumn("share", share).drop("full", "full_at")


def leaf_targets(rows: DataFrame, levels: list[str], weights: dict[str, Column], fraction: float, max_epochs: int) -> DataFrame:
    """(levels, available, target): whole tokens that each leaf is to give."""
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("available"))
    leaves = cut_lineage(leaves)
    budget = leaves.agg(F.floor(F.coalesce(F.sum("available"), F.lit(0)) * F.lit(fraction)).cast("double").alias("share"))
    for depth, level in enumerate(levels):
        parents, path = levels[:depth], levels[: depth + 1]
        nodes = leaves.groupBy(*path).agg((F.sum("available") * F.lit(max_epochs)).cast("double").alias("cap"))
        above = budget.select(*parents, F.col("share").alias("budget"))
        nodes = nodes.join(above, parents) if parents else nodes.crossJoin(F.broadcast(above))
        budget = filled(nodes.withColumn("weight", weights[level].cast("double")), parents, level)
    return leaves.join(budget.select(*levels, F.floor(F.col("share") + F.lit(1e-6)).cast("bigint").alias("target")), levels)


def leaf_plan(
    rows: DataFrame, levels: list[str], weights: dict[str, Column], fraction: float, max_epochs: int, seed: str
) -> DataFrame:
    """(levels, epochs, end): whole epochs of each leaf, and the last place in the seeded order that its last epoch reaches.

    ``rows`` (doc_id, levels, tokens) are read several times and should be stored. The
    cut is found from sums by digits of the order, then among the rows of one such range, so no leaf's rows meet in one task.
    """
    targets = leaf_targets(rows, levels, weights, fraction, max_epochs)
    some = F.col("available") > 0
    targets = cut_lineage(targets.select(
        *levels,
        F.when(some, F.expr("target div available")).otherwise(0).alias("epochs"),
        F.when(some, F.col("target") % F.col("available")).otherwise(0).alias("rest"),
    ))
    inside = rows.join(sized(targets.drop("rest")), levels).withColumn("place", place_of(seed, F.col("epochs"), F.col("doc_id")))
    cut = targets.select(*levels, F.col("rest"), F.lit("").alias("prefix"))
    for digits in DIGITS:
        sums = inside.join(sized(cut), levels).where(F.col("place").startswith(F.col("prefix"))).groupBy(
            *levels, "rest", F.substring("place", 1, digits).alias("range")
        ).agg(F.sum("tokens").alias("tokens"))
        upto = Window.partitionBy(*levels).orderBy("range")
        running = sums.withColumn("sum", F.sum("tokens").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        first = running.where(F.col("sum") > F.col("rest")).groupBy(*levels).agg(
            F.min(F.struct("range", (F.col("rest") - F.col("sum") + F.col("tokens")).alias("rest"))).alias("at")
        )
        cut = cut_lineage(first.select(*levels, F.col("at.rest").alias("rest"), F.col("at.range").alias("prefix")))
    last = inside.join(sized(cut), levels).where(F.col("place").startswith(F.col("prefix")))
    upto = Window.partitionBy(*levels).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = last.withColumn("sum", F.sum("tokens").over(upto)).where(F.col("sum") <= F.col("rest"))
    fits = fits.groupBy(*levels).agg(F.max("place").alias("reach"))
    # a leaf without a cut has room for all its rows; every place is below "g"
    end = F.when(F.col("prefix").isNull(), "g").otherwise(F.coalesce("reach", "prefix"))
    return cut_lineage(targets.drop("rest").join(cut.select(*levels, "prefix"), levels, "left").join(fits, levels, "left").select(*levels, "epochs", end.alias("end")))


def sized(leaves: DataFrame) -> DataFrame:
    """One row for each leaf, broadcast if there are few, so that the rows of a hot leaf stay where they are."""
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def place_of(seed: str, epoch: Column, key: Column) -> Column:
    """Place of a row in the order of an epoch: hexadecimal text."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def copies_of(seed: str, key: Column) -> Column:
    taken = F.when(place_of(seed, F.col("epochs"), key) <= F.col("end"), 1).otherwise(0)
    return (F.col("epochs") + taken).cast("bigint")


def rows_of(docs: DataFrame, levels: list[str]) -> DataFrame:
    named = [F.coalesce(F.col(x), F.lit("")).alias(x) for x in levels]
    return cut_lineage(docs.select("doc_id", *named, F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint").alias("tokens")))


def mix(
    docs: DataFrame,
    levels: tuple[str, ...] = LEVELS,
    weights: dict[str, Column] | None = None,
    fraction: float = 0.5,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """(doc_id, levels, tokens, copies): how often each row of (doc_id, levels, tokens) is taken.

    ``fraction`` of all tokens is the budget. Null names of levels are a name of
    their own, "". Null tokens count as 0. Equal ids share their place in the
    seeded order, so they are taken together or not at all. In the last epoch a
    leaf gives the longest prefix that fits into the rest of its target. An empty
    table gives no rows.
    """
    levels = list(levels)
    rows = rows_of(docs, levels)
    plan = leaf_plan(rows, levels, weights or default_weights(), fraction, max_epochs, seed)
    return rows.join(sized(plan), levels).select("doc_id", *levels, "tokens", copies_of(seed, F.col("doc_id")).alias("copies"))


def mix_documents(docs: DataFrame, fraction: float = 0.5) -> DataFrame:
    """``mix`` of a table of documents: domain by source, tokens by words of the whole text."""
    return mix(levelled(docs), fraction=fraction)


def levelled(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", n_words().alias("tokens"))


def mixed_documents(docs: DataFrame, fraction: float = 0.5) -> DataFrame:
    """The rows of a table of documents that ``mix_documents`` takes, with their ``copies`` (in place of a column of that name). Texts are not shuffled unless there are very many leaves."""
    levels = list(LEVELS)
    plan = leaf_plan(rows_of(levelled(docs), levels), levels, default_weights(), fraction, MAX_EPOCHS, SEED)
    plan = sized(plan.select(*[F.col(x).alias(f"leaf_{x}") for x in levels], F.col("epochs"), F.col("end")))
    own = docs.select(F.struct(*docs.columns).alias("doc"))
    of = {"domain": domain_of(F.col("doc.source")), "lang": F.col("doc.lang"), "source": F.col("doc.source")}
    leaf = [F.coalesce(of[x], F.lit("")) == F.col(f"leaf_{x}") for x in levels]
    taken = own.join(plan, leaf).withColumn("copies", copies_of(SEED, F.col("doc.doc_id"))).where("copies > 0")
    return taken.select(*[f"doc.`{c}`" for c in docs.columns if c != "copies"], "copies")


def mix_ctes(table: str, fraction: float) -> str:
    """The rows of ``mix_documents(table)`` as DuckDB common table expressions; the last is ``mixed``."""
    case = lambda w, c: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in w.items()) + f" ELSE {OTHER_WEIGHT} END"
    names = ", ".join(f"'{x}'" for x in DOMAIN_WEIGHTS)
    weights = [case(DOMAIN_WEIGHTS, "domain"), case(LANG_WEIGHTS, "lang"), "1.0"]
    out = f"""mx_rows AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  [{names}][coalesce(TRY_CAST(regexp_extract(source, '[0-9]{{1,6}}') AS INT), 0) % {len(DOMAIN_WEIGHTS)} + 1] AS domain,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS tokens FROM {table}),
mx_leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS available FROM mx_rows GROUP BY ALL),
mx_b0 AS (SELECT floor(coalesce(sum(available), 0) * {fraction})::DOUBLE AS share FROM mx_leaves),
"""
    for d, level in enumerate(LEVELS):
        path, parents = ", ".join(LEVELS[: d + 1]), ", ".join(LEVELS[:d])
        part = f"PARTITION BY {parents}" if parents else ""
        join = f"JOIN mx_b{d} b USING ({parents})" if parents else f", mx_b{d} b"
        out += f"""mx_n{d} AS (SELECT n.*, b.share AS budget, ({weights[d]})::DOUBLE AS weight FROM
  (SELECT {path}, (sum(available) * {MAX_EPOCHS})::DOUBLE AS cap FROM mx_leaves GROUP BY ALL) n {join}),
mx_f{d} AS (SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + cap / weight * sum(weight) OVER ({part} ORDER BY cap / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= budget AS is_full FROM mx_n{d}),
mx_b{d + 1} AS (SELECT {path}, CASE WHEN is_full THEN cap ELSE least(cap, weight * (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}))
  / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part})) END AS share FROM mx_f{d}),
"""
    return out + f"""mx_t AS (SELECT l.*, CASE WHEN available > 0 THEN floor(share + 1e-6)::BIGINT // available ELSE 0 END AS epochs,
  CASE WHEN available > 0 THEN floor(share + 1e-6)::BIGINT % available ELSE 0 END AS rest
  FROM mx_leaves l JOIN mx_b{len(LEVELS)} USING (domain, lang, source)),
mx_p AS (SELECT r.*, epochs, rest, md5('{SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM mx_rows r JOIN mx_t USING (domain, lang, source)),
mixed AS (SELECT doc_id, domain, lang, source, tokens, (epochs + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source
  ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM mx_p)"""
