"""Resampling within levels, and what abstaining by a confidence improves.

Groups of null keys have no draws. Draws depend on the replicate and the place among sorted units alone, so
that every value, model and cluster shares them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.codes import draw
from driftlens.operators import positions
from driftlens.operators.metrics import average_rank, finite
from driftlens.operators.storage import stored


def drawn(units: DataFrame, by: list[str], unit: str, repeats: int = 200, seed: int = 1) -> DataFrame:
    """units, a row each, as often as each of the draws with replacement takes them; _rep is the draw."""
    own = Window.partitionBy(*by)
    numbered = units.withColumn("_i", F.row_number().over(own.orderBy(unit)) - 1).withColumn("_n", F.count(F.lit(1)).over(own))
    slots = numbered.select(*by, "_n", F.col("_i").alias("_slot")).withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    picks = slots.select(*by, "_rep", F.pmod(draw(seed, F.col("_rep"), F.col("_slot")), F.col("_n")).cast("int").alias("_i"))
    return picks.join(numbered.drop("_n"), [*by, "_i"]).drop("_i")


def within(leaves: DataFrame, by: list[str], levels: list[str], repeats: int = 200, seed: int = 1, path: bool = False) -> DataFrame:
    """leaves, a row for each key of all levels, as often as draws take them; a draw at each level, within
    what was drawn above it, anew for each copy. path: with _path, which tells copies apart.

    Copies are dealt evenly before a level multiplies them, into a number of tasks that is not lowered for their
    small size: a level's draws of a few large groups do not meet in few tasks."""
    state = leaves.select(*by).distinct().withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_path", F.col("_rep").cast("string"))
    tasks = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for k, level in enumerate(levels):
        above, last = [*by, *levels[:k]], k == len(levels) - 1
        own = Window.partitionBy(*above)
        units = leaves if last else leaves.select(*above, level).distinct()
        # the last level's units carry their rows, which copies would otherwise be joined with once more
        units = units.withColumn("_i", F.dense_rank().over(own.orderBy(level)) - 1)
        sizes = units.groupBy(*above).agg((F.max("_i") + 1).alias("_n"))
        copies = state.join(sizes, above).repartition(tasks, "_rep", "_path", *above)
        slots = copies.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        own_path = F.concat_ws("|", "_path", F.col("_slot").cast("string"))
        picks = slots.select(*above, "_rep", own_path.alias("_path"), F.pmod(draw(seed, own_path), F.col("_n")).cast("int").alias("_i"))
        state = (picks.drop("_path") if last and not path else picks).join(units.filter(F.col(level).isNotNull()), [*above, "_i"]).drop("_i")
    return state


def limits(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """lower and upper 2.5 % of the replicates, and p, one-sided: (1 + replicates of 0 or less) / (1 + replicates)."""
    edge = lambda q: F.percentile(value, F.lit(q))
    return df.groupBy(*by).agg(edge(0.025).alias("lower"), edge(0.975).alias("upper"), ((F.count_if(F.col(value) <= 0) + 1) / (F.count(value) + 1)).alias("p"))


def nested_mean(df: DataFrame, by: list[str], levels: list[str], value: str, repeats: int = 200, seed: int = 1) -> DataFrame:
    """Limits of the mean over leaves (the last level's means), drawn level by level.

    df is read once. Leaves stand in the row of the group they are drawn from, and a copy of that group draws and adds
    them up within its own row: the rows that meet are as many as copies of groups, however many leaves they have."""
    *upper, last = levels
    above, tasks = [*by, *upper], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df.groupBy(*by, *levels).agg(F.avg(value).alias("_v"))
    unit = F.struct(F.col(last).alias("u"), F.col("_v").cast("double").alias("v"))
    # in order of the level; a leaf without a key has a place, but draws of it count for nothing
    held = leaves.groupBy(*above).agg(F.sort_array(F.collect_list(unit)).alias("_u"))
    held = stored(held.select(*above, F.transform("_u", lambda x: F.when(x["u"].isNotNull(), x["v"])).alias("_held"), F.transform("_u", lambda x: x["u"].isNotNull()).alias("_there")))
    copies = within(held.select(*above), by, upper, repeats, seed, path=True)
    # a stated number of tasks is not lowered for the small size of what draws multiply
    rows = copies.repartition(tasks, *above).join(held.repartition(tasks, *above), above) if above else copies.crossJoin(held)

    drawn_at = F.transform(F.sequence(F.lit(0), F.size("_held") - 1), lambda slot: F.pmod(draw(seed, F.concat_ws("|", F.col("_path"), slot.cast("string"))), F.size("_held")).cast("int"))
    rows = rows.withColumn("_at", drawn_at)
    total = F.aggregate("_at", F.lit(0.0), lambda s, i: s + F.coalesce(F.get("_held", i), F.lit(0.0)))
    count = lambda ok: F.aggregate("_at", F.lit(0), lambda s, i: s + ok(i).cast("int"))
    sums = rows.select(*by, "_rep", total.alias("_s"), count(lambda i: F.get("_held", i).isNotNull()).alias("_c"), count(lambda i: F.get("_there", i)).alias("_d"))
    made = sums.groupBy(*by, "_rep").agg(F.try_divide(F.sum("_s"), F.sum("_c")).alias("_v"), F.sum("_d").alias("_d")).filter("_d > 0")
    return limits(made, by, "_v")


def pooled(df: DataFrame, by: list[str], unit: str, values: list[str], repeats: int = 200, seed: int = 1) -> DataFrame:
    """(by, _rep, values): units are drawn and all their rows pooled, so that a unit weighs what it holds."""
    sums = df.groupBy(*by, unit).agg(*(f(v).alias(f"_{n}{i}") for i, v in enumerate(values) for n, f in (("s", F.sum), ("c", F.count))))
    return drawn(sums, by, unit, repeats, seed).groupBy(*by, "_rep").agg(*(F.try_divide(F.sum(f"_s{i}"), F.sum(f"_c{i}")).alias(v) for i, v in enumerate(values)))


def position_rank(df: DataFrame, by: list[str], position: str = "position", observed: str = "observed", predicted: str = "predicted", repeats: int = 200, seed: int = 1) -> DataFrame:
    """Limits of the rank correlation when positions are drawn; ranks are those of the whole group, and 0
    stands where a draw has no variance. A group meets in one task, as do its draws."""
    rows = df.filter(finite(observed) & finite(predicted)).select(*by, position, average_rank(observed, by).alias("_x"), average_rank(predicted, by).alias("_y"))
    made = positions.replicates(positions.gathered(rows.dropna(subset=by), by, position, {"rho": F.lit(True)}), by, ["rho"], repeats, str(seed), named=False)
    return positions.limits(made, by, "rho")


def improvements(df: DataFrame, by: list[str], order: list[Column | str], gain: str = "gain", regret: str = "regret", steps: int = 10) -> DataFrame:
    """What taking the surest tasks first improves over taking tasks at random, as areas over coverages
    1 / steps ... 1 and at a half: mean regret, share without gain, mean gain. Positive is better.

    df: a row a task; order: surest first, ties named. A group's tasks meet in one window."""
    own = Window.partitionBy(*by)
    upto = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    values = {"regret": F.col(regret), "risk": (F.col(gain) <= 0).cast("double"), "utility": F.col(gain)}
    rows = df.withColumn("_i", F.row_number().over(own.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(own))
    rows = rows.withColumns({f"_{k}": F.avg(v).over(upto) for k, v in values.items()})
    at = lambda k, i: F.max(F.when(F.col("_i") == F.ceil(F.col("_n") * F.lit(i / steps)), F.col(f"_{k}")))
    points = rows.groupBy(*by).agg(*(at(k, i).alias(f"{k}{i}") for k in values for i in range(1, steps + 1)))
    half, width = round(steps / 2), 1 - 1 / steps

    def better(k: str, first: Column, last: Column) -> Column:
        return last - first if k != "utility" else first - last

    out = []
    for k in values:
        total = F.col(f"{k}{steps}")
        area = sum((F.col(f"{k}{i}") + F.col(f"{k}{i + 1}")) / (2 * steps) for i in range(1, steps))
        out += [better(k, area, total * width).alias(f"{k}_auc"), better(k, F.col(f"{k}{half}"), total).alias(f"{k}_half")]
    return points.select(*by, *out)


IMPROVEMENTS = [f"{k}_{w}" for k in ("regret", "risk", "utility") for w in ("auc", "half")]


def bootstrap_improvements(df: DataFrame, by: list[str], levels: list[str], order: list[Column | str], repeats: int = 200, seed: int = 1) -> DataFrame:
    """(by, name, lower, upper, p) of each improvement, tasks drawn level by level."""
    made = improvements(within(df, by, levels, repeats, seed), [*by, "_rep"], order)
    return limits(made.unpivot([*by, "_rep"], IMPROVEMENTS, "name", "value"), [*by, "name"], "value")


def development_gates(limit: DataFrame, points: DataFrame, panels: DataFrame, by: list[str]) -> DataFrame:
    """(by, family_gate, panel_gate, ready): limits of the areas clear of 0 and no gain lost at a half; and no
    panel made worse."""
    of = lambda n, c: F.max(F.when(F.col("name") == n, F.col(c)))
    family = limit.groupBy(*by).agg(of("regret_auc", "lower").alias("_a"), of("risk_auc", "lower").alias("_b")).join(points.select(*by, "utility_half"), by)
    family = family.select(*by, ((F.col("_a") > 0) & (F.col("_b") >= 0) & (F.col("utility_half") >= 0)).alias("family_gate"))
    panel = panels.groupBy(*by).agg(F.bool_and((F.col("regret_auc") >= 0) & (F.col("risk_auc") >= 0) & (F.col("utility_half") >= 0)).alias("panel_gate"))
    return family.join(panel, by, "left").withColumn("ready", F.col("family_gate") & F.coalesce("panel_gate", F.lit(False)))
