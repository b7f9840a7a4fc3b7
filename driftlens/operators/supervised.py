"""Supervised studies: splits, fits, intervals and metrics of all assays, seeds and models in common passes."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.codes import draw
from driftlens.operators import boosting, features, linear, sparse, splits
from driftlens.operators.contracts import linspace_sample
from driftlens.operators.metrics import conformal_radius, finite, regression
from driftlens.operators.storage import stored
from driftlens.operators.tables import group_folds

MODELS = ("mean", "biophysical_ridge", "additive_ridge")


def with_calibration(df: DataFrame, by: list[str], item: str, share: float = 0.2, seed: str = "seed") -> DataFrame:
    """df with ceil(share * n) of each group's train rows, by a draw, in role calibration."""
    own = Window.partitionBy(*by, "role")
    order = own.orderBy(draw("calibration", F.col(seed), F.col(item)), item)
    rows = df.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(own))
    return rows.withColumn("role", F.when((F.col("role") == "train") & (F.col("_i") <= F.ceil(F.col("_n") * F.lit(share))), "calibration").otherwise(F.col("role"))).drop("_i", "_n")


def predictions(df: DataFrame, by: list[str], models: tuple[str, ...] = MODELS, code: str = "code", observed: str = "observed") -> DataFrame:
    """df's rows not of role train, once a model, with `model` and `predicted` of the fit on their group's train rows. df: a stored table."""
    train, rest = df.filter("role = 'train'"), df.filter("role <> 'train'")
    made = []
    for model in models:
        if model == "mean":
            one = rest.join(train.groupBy(*by).agg(F.avg(observed).alias("predicted")), by, "left")
        elif model == "biophysical_ridge":
            full = features.by_code(df, code, lambda codes: features.biophysical(codes, code))
            one = linear.predict(full.filter("role <> 'train'"), linear.ridge(full.filter("role = 'train'"), by, features.NAMES, observed), by, features.NAMES)
        elif model == "additive_ridge":
            turned = df.withColumn("_part", F.col("role")).withColumn("role", F.when(F.col("role") == "train", "train").otherwise("test"))
            one = sparse.additive_ridge(turned, by, code, target=observed).withColumn("role", F.col("_part"))
        else:
            raise ValueError(f"no model {model}")
        made.append(one.select(*df.columns, "predicted", F.lit(model).alias("model")))
    return reduce(DataFrame.unionByName, made)


def evaluated(predicted: DataFrame, scale: DataFrame, by: list[str], item: str, coverage: float = 0.8, observed: str = "observed") -> DataFrame:
    """(by, model, metrics, normalized_rmse, radius, observed_coverage, normalized_width, row counts): the radius comes from the
    calibration rows, everything else from the test rows; scale(by, target_sd, fit_rows) from the train rows."""
    one = [*by, "model"]
    test = predicted.filter("role = 'test'")
    radius = conformal_radius(predicted.filter("role = 'calibration'"), one, item, coverage, observed)
    covered = test.join(radius, one).groupBy(*one).agg(F.avg((F.abs(F.col(observed) - F.col("predicted")) <= F.col("radius")).cast("double")).alias("observed_coverage"), F.max("radius").alias("radius"))
    sizes = predicted.groupBy(*one).agg(F.count_if(F.col("role") == "calibration").alias("calibration_rows"), F.count_if(F.col("role") == "test").alias("test_rows"))
    made = regression(test, one, observed, "predicted").join(covered, one, "left").join(sizes, one).join(scale, by)
    over = lambda v: F.when(F.col("target_sd") > 1e-12, v / F.col("target_sd"))
    return made.withColumns({"normalized_rmse": over(F.col("rmse")), "normalized_width": over(2 * F.col("radius"))})


def assays(df: DataFrame, by: list[str], seeds: list[int], models: tuple[str, ...] = MODELS, share: float = 0.2, calibration: float = 0.2, coverage: float = 0.8, code: str = "code", position: str = "position", observed: str = "observed") -> DataFrame:
    """One row an assay, seed, split (random items or positions left out) and model; every fit runs over all of them."""
    # all splits stand beside each other before rows are repeated: df is worked out and dealt by its groups once
    own = [c for c in df.columns if c not in ("role", "seed", "split")]
    rows, made = df.select(*own), []
    for seed in seeds:
        for name, split, unit in (("random", splits.random_item, code), ("position", splits.position, position)):
            rows = split(rows, by, unit, share, seed).withColumnRenamed("role", f"_role{len(made)}")
            made.append(F.struct(F.col(f"_role{len(made)}").alias("role"), F.lit(seed).alias("seed"), F.lit(name).alias("split")))
    rows = rows.select(*own, F.explode(F.array(*made)).alias("_s")).select(*own, "_s.*")
    group = [*by, "seed", "split"]
    full = stored(with_calibration(rows, group, code, calibration))
    scale = full.filter("role = 'train'").groupBy(*group).agg(F.stddev_pop(observed).alias("target_sd"), F.count(F.lit(1)).alias("fit_rows"))
    return evaluated(stored(predictions(full, group, models, code, observed)), scale, group, code, coverage, observed)


def repeated(df: DataFrame, by: list[str], start: int, repeats: int, **more: object) -> DataFrame:
    """`assays` over the seeds start, start + 1, ...; fewer than two raise."""
    if repeats < 2:
        raise ValueError("at least two repeats are needed")
    return assays(df, by, list(range(start, start + repeats)), **more)


def cross_features(df: DataFrame, assay: list[str], code: str, ref: str, alt: str, position: str, length: str, observed: str, scores: list[str], letters: str, most: int = 1000) -> tuple[DataFrame, list[str]]:
    """(rows, feature names): of each assay at most `most` rows, evenly in order of codes, with indicators of both residues, the
    place over the length, log of length, the biophysical features and the scores; target: percentile rank within the assay."""
    one = lambda c, kind: {f"{kind}_{a}": (F.col(c) == a).cast("double") for a in letters}
    taken = linspace_sample(df, assay, code, most)
    own = Window.partitionBy(*assay)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*assay, observed))
    target = (F.rank().over(own.orderBy(observed)) + (ties - 1) / 2) / F.count(F.lit(1)).over(own)
    # what made the rows runs once, however often folds and fits read them
    rows = stored(taken.withColumn("target", target))
    made = features.by_code(rows, code, lambda codes: features.biophysical(codes, code)).withColumns(one(ref, "reference") | one(alt, "alternate") | {"normalized_position": F.col(position) / F.col(length), "log_protein_length": F.log1p(F.col(length).cast("double"))})
    return made, [*one(ref, "reference"), *one(alt, "alternate"), "normalized_position", "log_protein_length", *features.NAMES, *scores]


#: Rows of features that keys tell, up to which the driver holds them as a lookup.
PROFILES = 4096


def profiles(df: DataFrame, keys: list[str], told: list[str]) -> tuple[DataFrame, linear.Lookup | None]:
    """(df with _profile, the number of its keys' row; the rows' features `told`), or (df, None) where there are too many of them."""
    own = df.select(*keys, *(F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(told))).groupBy(*keys).agg(F.array(*(F.first(f"_f{i}") for i in range(len(told)))).alias("_f"))
    found = own.limit(PROFILES + 1).collect()
    if len(found) > PROFILES:
        return df, None
    found.sort(key=lambda r: [(r[k] is not None, r[k]) for k in keys])
    schema = ", ".join(f"_k{i} {t}" for i, (_, t) in enumerate(df.select(*keys).dtypes)) + ", _profile int"
    numbers = df.sparkSession.createDataFrame([(*(r[k] for k in keys), i) for i, r in enumerate(found)], schema)
    same = reduce(lambda a, b: a & b, (df[k].eqNullSafe(numbers[f"_k{i}"]) for i, k in enumerate(keys)))
    values = np.array([[np.nan if v is None else v for v in r["_f"]] for r in found], float).reshape(len(found), len(told))
    return df.join(F.broadcast(numbers), same, "left").select(*df.columns, "_profile"), linear.Lookup("_profile", told, values)


def pooled(df: DataFrame, names: list[str], scores: list[str], group: str, assay: str, folds: int = 5, settings: dict | None = None, ablation: bool = True, target: str = "target", keys: list[str] | None = None, varying: list[str] | None = None) -> DataFrame:
    """Every row, predicted by models pooled over assays whose group was left out: ridge and boosted trees, each also
    without the scores (`_mutation_only`). Each assay weighs as much as another; one job fits all folds.

    keys: columns that tell all features but the `varying` ones. Where they take few values, rows carry a number in
    place of these features. Where an assay is of one fold, so that it weighs the same in all others, rows of equal
    features are added up before they are copied for each fold; fits need no more of them."""
    lookup, columns = None, df.columns
    if keys is not None:
        df, lookup = profiles(df, keys, [n for n in names if n not in (varying or [])])
    placed = group_folds(df, [], group, folds).select(group, F.col("fold").alias("_own"))
    # an assay's train rows in each fold
    sizes = df.groupBy(assay, group).agg(F.count(F.lit(1)).alias("_n")).join(placed, group).groupBy(F.col(assay).alias("_assay"))
    sizes = stored(sizes.agg(F.array(*(F.sum(F.when(F.col("_own") != k, F.col("_n"))) for k in range(folds))).alias("_sizes"), F.sum("_n").alias("_all"), F.count_distinct("_own").alias("_folds")))
    rows = df.join(F.broadcast(placed), group)
    carried = [n for n in names if n not in lookup.features] + ["_profile"] if lookup else names
    # every row once, with what fits need
    narrow = rows.select(*carried, target, "_own", F.col(assay).alias("_a"))
    narrow = narrow.join(sizes, narrow["_a"].eqNullSafe(sizes["_assay"])).drop("_a", "_assay")
    crossed = lambda df: df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter("fold <> _own")
    train, count = None, None
    if lookup is not None and sizes.filter("_folds > 1").isEmpty():
        own = narrow.filter(finite(target)).withColumn("_weight", 1 / F.col("_all"))
        cells = stored(own.groupBy("_own", *carried).agg(F.count(F.lit(1)).alias("_count"), F.sum("_weight").alias("_weight"), (F.sum(F.col("_weight") * F.col(target)) / F.sum("_weight")).alias(target)))
        # where hardly any rows are equal, adding them up saves nothing
        if 2 * cells.count() <= (cells.agg(F.sum("_count")).first()[0] or 0):
            train, count = crossed(cells), "_count"
    if train is None:
        train = crossed(stored(narrow)).withColumn("_weight", 1 / F.get("_sizes", F.col("fold"))).drop("_own", "_sizes")
    test = rows.withColumnRenamed("_own", "fold")
    made = []
    for suffix, used in (("", names), *((("_mutation_only", [n for n in names if n not in scores]),) if ablation else ())):
        fitted = stored(linear.ridge(train, ["fold"], used, target, 10.0, "_weight", lookup=lookup, count=count))
        made.append(linear.predict(test, fitted, ["fold"], used, lookup=lookup).withColumn("model", F.lit(f"ridge{suffix}")))
        model = boosting.fit(train, ["fold"], used, target, "_weight", lookup=lookup, count=count, **(settings or {}))
        made.append(boosting.predict(test, model, ["fold"]).withColumn("model", F.lit(f"boosted{suffix}")))
    return reduce(DataFrame.unionByName, (one.select(*columns, "fold", "predicted", "model") for one in made))


def winner(df: DataFrame, names: list[str], group: str, label: str = "label", folds: int = 5, c: float = 1.0, settings: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with fold, model and probability of label 1, once for each of logistic regression and boosted trees, from folds
    without the row's group; standardised coefficients of the logistic fit on all rows). Features must be imputed."""
    placed = group_folds(df, [], group, folds).select(group, F.col("fold").alias("_own"))
    rows = df.join(placed, group).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    rows = stored(rows.withColumn("role", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train")))
    train, test = rows.filter("role = 'train'"), rows.filter("role = 'test'").drop("_own", "role")
    fitted = linear.logistic(train, ["fold"], names, label, c).drop("_scaled")
    one = linear.predict(test, fitted, ["fold"], names).withColumn("probability", linear.probability(F.col("predicted"))).drop("predicted").withColumn("model", F.lit("logistic"))
    model = boosting.fit(train, ["fold"], names, label, loss="logistic", **(settings or {"rate": 0.05, "rounds": 150, "leaves": 15, "least": 20}))
    two = boosting.predict(test, model, ["fold"], "probability").withColumn("model", F.lit("boosted"))
    whole = linear.logistic(df, [], names, label, c).select(F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.col("_scaled").alias("coefficient"))).alias("_c")).select("_c.feature", "_c.coefficient")
    return one.unionByName(two), whole


def win_summary(predicted: DataFrame, group: str, label: str = "label", probability: str = "probability") -> DataFrame:
    """(model, n, prevalence, roc_auc, brier, accuracy, balanced_accuracy, mean_group_accuracy, majority_accuracy)."""
    right = (F.col(label) == (F.col(probability) >= 0.5).cast("int")).cast("double")
    # the area is the rank sum of label 1; ranks come from counts of equal probabilities, so that no task sorts the rows
    cells = predicted.groupBy("model", probability).agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_one"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy("model").orderBy(probability).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = cells.withColumn("_rank", below + (F.col("_n") + 1) / 2).groupBy("model").agg(F.sum(F.col("_rank") * F.col("_one")).alias("_ranks"), F.sum("_one").alias("_p"), (F.sum("_n") - F.sum("_one")).alias("_q"))
    auc = sums.select("model", ((F.col("_ranks") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * F.col("_q"))).alias("roc_auc"))
    share = F.avg(F.col(label).cast("double"))
    each = lambda v: F.avg(F.when(F.col(label) == v, right))
    made = predicted.groupBy("model").agg(F.count(F.lit(1)).alias("n"), share.alias("prevalence"), F.avg((F.col(probability) - F.col(label)) ** 2).alias("brier"), F.avg(right).alias("accuracy"), ((each(0) + each(1)) / 2).alias("balanced_accuracy"), F.greatest(share, 1 - share).alias("majority_accuracy"))
    groups = predicted.groupBy("model", group).agg(F.avg(right).alias("_a")).groupBy("model").agg(F.avg("_a").alias("mean_group_accuracy"))
    return made.join(auc, "model").join(groups, "model")
