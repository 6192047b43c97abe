"""Study effects, assay results and points of departure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.numbers import normalised_dose
from kinfold.operators.distribution import null_safe

STUDY = ["chem_id", "study_id", "study_type", "species"]

#: Parts into which the rows of one guideline are dealt.
PARTS = 16


def select_effects(
    effects: DataFrame,
    study_type: str | None = None,
    target: str | None = None,
    critical: int | None = None,
    trt_related: int | None = None,
    species: str | None = None,
    pod: str | None = None,
) -> DataFrame:
    """Effects with a guideline that meet every given condition; ``pod`` names a boolean column."""
    wanted = {
        "study_type": study_type, "effect_target": target, "effect_critical": critical,
        "effect_trt_related": trt_related, "species": species,
    }
    out = effects.where(F.col("study_guideline_id").isNotNull())
    for column, value in wanted.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.where(F.col(pod)) if pod else out


def hits_with_catalogue(results: DataFrame, assays: DataFrame) -> DataFrame:
    """Assay results with a model, with the catalogue's columns."""
    return results.where(F.col("modl").isNotNull()).join(assays, "aeid")


def join_chain(start: DataFrame, steps: list[tuple[DataFrame, list[str]]], columns: list[str]) -> DataFrame:
    """Inner equi-join of a chain of tables on their shared keys, distinct rows of some columns.

    Rows are dealt out before equal ones meet: a task of the join would hold nearly as many distinct rows as it
    makes, while a task of one share holds no more than its share of all distinct ones, however long the input is.
    """
    for table, keys in steps:
        start = start.join(table, keys)
    return start.select(*columns).repartition(*columns).distinct()


def assay_catalogue(assays: DataFrame, components: DataFrame, endpoints: DataFrame, genes: DataFrame) -> DataFrame:
    """Assays with components and endpoints: rows with a gene, and rows of endpoints that have none."""
    # the rows without a gene are those a left join adds; genes meet the few components first, so the assays are joined once
    return assays.join(components.join(genes, "aeid", "left"), "aid").join(endpoints, "acid")


def assay_results(fits: DataFrame, samples: DataFrame, entities: DataFrame, hits: DataFrame, drop_constant: bool = False) -> DataFrame:
    """Fits joined to hit calls, samples and entities; optionally without constant fits."""
    out = fits.join(hits, "fit_id").join(samples, "sample_id").join(entities, "id")
    return out.where(F.col("modl") != "cnst") if drop_constant else out


def unreported(required: DataFrame, reported: DataFrame, keys: list[str]) -> DataFrame:
    """Required combinations that no report holds; nulls match nulls."""
    r = reported.select(*keys).distinct()
    return required.join(r, null_safe(required, r, keys), "left_anti")


def split_required(required: DataFrame, reported: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(positives, negatives): what was reported, and what was required but not reported."""
    return reported, unreported(required, reported, keys)


def classified_effects(positive: DataFrame, unrelated: DataFrame, missing: DataFrame, context: list[str]) -> DataFrame:
    """Positive effects as class 1; as class 0 unrelated effects and unreported requirements.

    Requirements take the study context of the positives on the guideline; a
    guideline on one side only keeps its row.
    """
    effect = [c for c in missing.columns if c != "study_guideline_id"]
    studies = positive.select("study_guideline_id", *context).distinct()
    # guidelines are few: requirements are dealt out by a hash as well, and each study meets every part of its guideline
    key = "study_guideline_id"
    parts = missing.withColumn("_part", F.pmod(F.xxhash64(*missing.columns), F.lit(PARTS)))
    met = studies.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))).join(parts, [key, "_part"]).drop("_part")
    negative = met.unionByName(studies.join(missing.select(key).distinct(), key, "left_anti"), allowMissingColumns=True).unionByName(
        missing.join(studies.select(key).distinct(), key, "left_anti"), allowMissingColumns=True
    )
    columns = ["study_guideline_id", *context, *effect]
    return (
        positive.select(*columns).withColumn("effect_class", F.lit(1))
        .unionByName(unrelated.select(*columns).unionByName(negative.select(*columns)).withColumn("effect_class", F.lit(0)))
    )


def first_match(rows: DataFrame, lookup: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Left join to the first lookup row of each key; the row's own columns win."""
    added = [c for c in lookup.columns if c != key and c not in rows.columns]
    ranked = [*order, *(c for c in added if c not in order)]
    first = lookup.groupBy(key).agg(F.min(F.struct(*ranked)).alias("m"))
    return rows.join(first.select(key, *(F.col(f"m.{c}").alias(c) for c in added)), key, "left")


def points_of_departure(effects: DataFrame, compat: bool = False) -> DataFrame:
    """Effects with lel, nel, loael, noael of their study and one flag per row for each.

    LEL is the smallest dose with a treatment-related effect, NEL the dose one
    level below the smallest such level; LOAEL and NOAEL the same for critical
    effects. ``compat`` keeps a rule of older results: the LEL flag then marks
    rows that are not treatment-related.
    """
    e = effects.withColumn("dose", normalised_dose(F.col("dose"), F.col("unit"))).withColumn("unit", F.lit("mg/kg/day"))
    trt, crit = F.col("effect_trt_related") == 1, F.col("effect_critical") == 1
    # one exchange by study for all of it: a join of the rows with their own minima would move and make them several times
    e = e.dropna(subset=STUDY)
    study = W.partitionBy(*STUDY)
    e = e.withColumns(
        {
            "lel": F.min(F.when(trt, F.col("dose"))).over(study), "dl_lel": F.min(F.when(trt, F.col("level"))).over(study),
            "loael": F.min(F.when(crit, F.col("dose"))).over(study), "dl_loael": F.min(F.when(crit, F.col("level"))).over(study),
        }
    )
    below = lambda level: (F.col("level") == F.col(level) - 1) & (F.col(level) > 1)
    e = e.withColumns({n: F.min(F.when(below(f"dl_{of}"), F.col("dose"))).over(study) for n, of in (("nel", "lel"), ("noael", "loael"))})
    related, dosed = F.col("effect_trt_related"), F.col("level") > 0
    flag = lambda name, rule: F.coalesce((F.col("dose") == F.col(name)) & rule & dosed, F.lit(False))
    return e.withColumns(
        {
            "is_nel": flag("nel", related == 0),
            "is_lel": flag("lel", related == (0 if compat else 1)),
            "is_noael": flag("noael", F.col("effect_critical") == 0),
            "is_loael": flag("loael", crit),
        }
    )


def prefix_ranges(cells: DataFrame, label: str, value: str, keys: list[str]) -> DataFrame:
    """Smallest and largest value per label text before ``:``; equal ends are widened by 0.5."""
    prefix = F.get(F.split(label, ":"), 0)
    span = cells.where(F.col(value).isNotNull()).groupBy(*keys, prefix.alias("prefix")).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    pad = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    return span.select(*keys, "prefix", (F.col("lo") - pad).alias("range_min"), (F.col("hi") + pad).alias("range_max"))


def result_documents(fits: DataFrame, points: DataFrame, flags: DataFrame, models: list[str]) -> DataFrame:
    """One row per (sample, assay): a struct per fitted model, the best model, points and flags.

    ``fits`` has a column ``<model>_<parameter>`` per model and parameter, with
    the quality of a fit under ``aic`` (smallest is best). Points and flags are
    distinct and bounded by the plates of one sample in one assay.
    """
    key = ["sample_id", "aeid"]
    fields = lambda m: [c for c in fits.columns if c.startswith(m + "_")]
    nested = F.array_compact(
        F.array(
            *(
                F.when(F.col(f"{m}_aic").isNotNull(), F.struct(F.lit(m).alias("model"), F.map_from_arrays(
                    F.array(*(F.lit(c[len(m) + 1 :]) for c in fields(m))), F.array(*(F.col(c).cast("double") for c in fields(m)))
                ).alias("params")))
                for m in models
            )
        )
    )
    best = F.array_min(F.transform("fits", lambda f: F.struct(f["params"]["aic"].alias("aic"), f["model"].alias("model"))))
    docs = fits.select(*key, nested.alias("fits")).withColumn("best", best["model"])
    p = points.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("conc", "resp"))).alias("points"))
    q = flags.groupBy(*key).agg(F.sort_array(F.collect_set("flag")).alias("flags"))
    return docs.join(p, key, "left").join(q, key, "left")
