"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document gets a rate r = min(cap, exp(lambda_s * z)), z being its size over the mean size of its
source s. These are the rates of least relative entropy to one copy each under the token constraint
sum(size * r) = target_s with at most `cap` copies; lambda_s is the root of the derivative of the convex
dual, found by Newton steps kept inside a bracket, all in one job. Rates depend on (source, size) alone, so that every
step works on counts of documents by source and size. Rates become whole copies by systematic rounding:
documents of a source are passed in order of size, and a copy is taken whenever the running sum of
fractions crosses a whole number; the words taken stay within about one document of the target.

Null sizes do not occur (a null text has size 0 and is never taken); a null source is a source of its
own, last in order; repeated rows are documents of their own (the copies they get may be exchanged among
equal rows); an empty table gives an empty result; other columns are kept whatever their names, and the
names in ADDED replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import cut, words

ADDED = ("size", "source_size", "target", "rate", "copies", "taken")
#: Parts into which the documents of one source and size are dealt for ranking.
SALTS = 32


def targets(by_source: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """by_source(missing, name, source_size): the target of each source.

    Sources in order weigh 1, 2, ..., cycle, repeating, and share all sizes by weight; none gets more
    than cap times its size. The level of the uncapped is found from sources sorted by size over weight:
    a source is capped if the level left by those before it would lift it above its cap."""
    order = Window.partitionBy().orderBy("missing", "name")
    filled = Window.partitionBy().orderBy(F.col("limit") / F.col("weight"), "missing", "name")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = by_source.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("double")).withColumn("limit", cap * F.col("source_size"))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = F.when(F.col("weight") * level <= F.col("limit"), level)
    leveled = ranked.withColumn("own_level", level)
    # the first level that fits holds for it and all after it
    leveled = leveled.withColumn("level", F.first("own_level", ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, 0)))
    return leveled.select("missing", "name", "source_size", "weight", F.coalesce(F.col("weight") * F.col("level"), F.col("limit")).alias("target"))


def _rate(lam: Column, z: Column, cap: float) -> Column:
    """min(cap, exp(lam * z)); the cap itself where it binds, free of rounding."""
    free = lam * z
    return F.when(free >= F.log(F.lit(cap)), F.lit(float(cap))).otherwise(F.exp(free))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once."""
    return F.transform(F.array(value), use)[0]


def balance(cells: DataFrame, goals: DataFrame, cap: float = 3.0, steps: int = 40, within: float = 1e-9) -> DataFrame:
    """Newton's iteration: goals with `lam`, the multiplier of each source.

    cells(missing, name, size, z, n). lam starts at 0; a step that leaves the bracket halves it
    instead. A target at the limit of cap times the size has all rates at the cap. A source's distinct
    sizes, in order, are folded in its own row, so that all steps are one job and sums do not hang on
    partitions; d distinct sizes take d * (d + 1) / 2 words at least, which bounds the row."""
    size, target = F.col("source_size"), F.col("target")
    full = target >= cap * size * (1 - 1e-12)
    start = F.struct(F.when(full, F.lit(1e9)).when(target <= 0, F.lit(-1e9)).otherwise(F.lit(0.0)).alias("lam"), F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"), (full | (target <= 0)).alias("done"))

    def moved(now: Column, sums: Column) -> Column:
        lam, gap = now["lam"], sums["got"] - target
        low, high = F.when(gap < 0, lam).otherwise(now["low"]), F.when(gap > 0, lam).otherwise(now["high"])
        newton = lam - F.try_divide(gap, sums["slope"])
        inside = newton.isNotNull() & (newton > low) & (newton < high)
        middle = F.when((low < -5e3) | (high > 5e3), lam + F.when(gap < 0, 1.0).otherwise(-1.0) * F.greatest(F.lit(1.0), F.abs(lam))).otherwise((low + high) / 2)
        settled = F.abs(gap) <= within * F.greatest(F.lit(1.0), target)
        return F.struct(F.when(settled, lam).when(inside, newton).otherwise(middle).alias("lam"), F.when(settled, now["low"]).otherwise(low).alias("low"), F.when(settled, now["high"]).otherwise(high).alias("high"), settled.alias("done"))

    def step(now: Column, _: Column) -> Column:
        def add(sums: Column, cell: Column) -> Column:
            words, free = cell["n"] * cell["size"], now["lam"] * cell["z"] < F.log(F.lit(cap))
            return _with(words * _rate(now["lam"], cell["z"], cap), lambda x: F.struct((sums["got"] + x).alias("got"), (sums["slope"] + F.when(free, x * cell["z"]).otherwise(0.0)).alias("slope")))

        sums = F.aggregate("sizes", F.struct(F.lit(0.0).alias("got"), F.lit(0.0).alias("slope")), add)
        return F.when(now["done"], now).otherwise(_with(sums, lambda x: moved(now, x)))

    sizes = cells.groupBy("missing", "name").agg(F.sort_array(F.collect_list(F.struct("size", "z", "n"))).alias("sizes"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["lam"]
    return goals.join(sizes, ["missing", "name"], "left").select("missing", "name", "source_size", "target", found.alias("lam"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cap: float = 3.0) -> DataFrame:
    """docs with size, source_size, target, rate, copies (whole) and taken = copies * size."""
    kept = [c for c in docs.columns if c not in ADDED]
    # the rows travel as one column, so that no name of theirs meets a name used here
    own = [F.col(f"`{c}`") for c in kept]
    sized = docs.select(
        F.struct(*own).alias("row"), words(F.col(f"`{text}`")).alias("size"), F.col(f"`{source}`").isNull().alias("missing"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("name"),
        F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(SALTS)).cast("int").alias("salt"), F.struct(F.xxhash64(F.lit(7), F.col(f"`{key}`")).alias("h"), F.col(f"`{key}`").alias("k")).alias("order"),
    )
    by = ["missing", "name", "size", "salt"]
    cells = cut(sized.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
    by_source = cells.groupBy("missing", "name").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    goals = cut(targets(by_source.select("missing", "name", "source_size"), cap).join(by_source.select("missing", "name", "docs"), ["missing", "name"]))
    mean = F.col("source_size") / F.col("docs")
    scaled = cells.join(goals.select("missing", "name", "source_size", "docs"), ["missing", "name"]).withColumn("z", F.when(F.col("source_size") > 0, F.col("size") / mean).otherwise(0.0))
    solved = cut(balance(scaled.filter("size > 0").groupBy("missing", "name", "size", "z").agg(F.sum("n").alias("n")), goals, cap))
    # sums over a source's distinct sizes first, then over the salts within one size: no task holds a source's documents
    rated = scaled.filter("size > 0").join(solved.select("missing", "name", "target", "lam"), ["missing", "name"]).withColumn("rate", _rate(F.col("lam"), F.col("z"), cap)).withColumn("part", F.col("rate") - F.floor("rate"))
    before = lambda w: F.coalesce(F.sum("sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sizes = rated.groupBy(*by[:3]).agg(F.sum(F.col("part") * F.col("n")).alias("sum"))
    starts = sizes.select(*by[:3], before(Window.partitionBy("missing", "name").orderBy("size")).alias("start"))
    within = rated.withColumn("sum", F.col("part") * F.col("n")).select(*by, "rate", "part", before(Window.partitionBy(*by[:3]).orderBy("salt")).alias("inner"))
    # written, so that the plan over the documents stays small
    rated = cut(within.join(starts, by[:3]).select(*by, "rate", "part", (F.col("start") + F.col("inner") + 0.5).alias("offset")))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("order"))
    place = F.col("offset") + F.col("part") * F.col("rank")
    copies = F.floor("rate") + F.floor(place) - F.floor(place - F.col("part"))
    return (
        sized.join(rated, by, "left")
        .join(goals.select("missing", "name", "source_size", "target"), ["missing", "name"])
        .withColumn("rank", F.when(F.col("rate").isNotNull(), rank))
        .withColumn("copies", F.coalesce(F.least(copies, F.lit(int(cap))), F.lit(0)).cast("int"))
        .select(*(F.col("row").getField(c).alias(c) for c in kept), "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as its copies say."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy")
