"""Mixing sources to target weights by nested hash thresholds. Native: no Python in the plan.

Each document has a hash of its id. Sizes are summed by source and the hash's leading bits; running sums over
those few buckets show where a source's budget ends; only the bucket at the boundary is summed again by its next
bits, until its last level. A document is taken if its hash is below its source's threshold, so nothing is
sorted, thresholds of smaller budgets lie below those of larger ones, and reruns agree.

Cases: a null text has size 0; null sources are one source, listed last; repeated rows have the same
hash and are taken together; null ids share a hash; an empty table gives an empty result; a very long text counts whole, and a source
whose texts are few and long is met as near as its texts allow; mix() keeps all columns, whatever their names, mix_report() returns its own.
Plan: sizes are written once (a few numbers a document, no text); each level reads them and
shuffles partial sums of 2**BITS buckets a source; thresholds go to all executors if there are few sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, cut, lookup

WEIGHTS = (3, 1, 2)
SHARE, MOST_REPEATS = 1.5, 2
#: A hash has BITS * LEVELS bits.
BITS, LEVELS = 11, 4


def size_of(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(id: str = "doc_id") -> F.Column:
    """The first BITS * LEVELS bits of the md5 of an id's text."""
    digits = F.substring(F.md5(F.coalesce(F.col(id).cast("string"), F.lit("null")).cast("binary")), 1, 15)
    return F.shiftright(F.conv(digits, 16, 10).cast("long"), 60 - BITS * LEVELS)


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """Add target to (source, source_size): budget share * sum(source_size) by weight, none above most times
    its size and the excess reshared by weight. That is min(level * weight, most * size) with the
    level that spends the budget; in the order of most * size / weight the stopped sources come first."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = by_source.withColumn("k", F.row_number().over(order) - 1).withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int")))
    w = w.withColumn("stop", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("stop") / F.col("weight"))
    before, whole = Window.orderBy("ratio", "k").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(whole))
    w = w.withColumn("left", F.col("budget") - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
    w = w.withColumn("level", F.col("left") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # from the first source that isn't stopped on, each next one's level is no higher
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    level = F.coalesce(level, F.lit(float("inf")))  # only if the budget exceeds all stops
    return w.select("source", "source_size", F.least(level * F.col("weight"), F.col("stop")).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> tuple[DataFrame, int]:
    """(source, source_size, target, repeats, threshold) and the number of sources: a source's documents are
    taken repeats times, and once more those whose hash is below the threshold. sized: source, size, hash."""
    state = budgets.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    state = state.withColumn("left", F.col("target") - F.col("repeats") * F.col("source_size")).withColumn("threshold", F.lit(0).cast("long"))
    state = cut(state)
    n = state.count()
    for level in range(LEVELS):
        low = BITS * (LEVELS - 1 - level)
        rows = lookup(sized, state.select("source", F.col("threshold").alias("__at")), "source", n)
        if level:  # only the bucket at the boundary
            rows = rows.where(F.shiftright("hash", low + BITS) == F.shiftright("__at", low + BITS))
        sums = rows.groupBy("source", F.shiftright("hash", low).alias("bucket")).agg(F.sum("size").alias("size"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("through", F.sum("size").over(run))
        ahead = lookup(sums, state.select("source", F.col("left").alias("__left")), "source", n)
        # whole buckets within what is left; at the last level also the next one, if that comes nearer
        fits = F.col("through") <= F.col("__left")
        if level == LEVELS - 1:
            fits = fits | ((F.col("through") - F.col("size") <= F.col("__left")) & (F.col("through") - F.col("__left") < F.col("__left") - (F.col("through") - F.col("size"))))
        ends = ahead.groupBy("source").agg(F.max(F.when(fits, F.col("bucket"))).alias("fit"), F.max(F.when(fits, F.col("through"))).alias("spent"), F.min(F.when(~fits, F.col("bucket"))).alias("next"))
        state = lookup(state, ends, "source", n)
        after = F.shiftleft(F.col("fit") + 1, low)
        state = state.withColumn("threshold", F.coalesce(F.shiftleft(F.col("next"), low) if level < LEVELS - 1 else F.lit(None), after, F.col("threshold"))).withColumn("left", F.col("left") - F.coalesce("spent", F.lit(0))).drop("fit", "spent", "next")
        state = cut(state)
    return state.drop("left"), n


def sizes(df: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    return df.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size_of(f"`{text}`").alias("size"), hash_of(f"`{id}`").alias("hash"))


def plan_mix(df: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS):
    """(sized documents, thresholds by source, number of sources)."""
    sized = cut(sizes(df, id, source, text))
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    found, n = thresholds(sized, targets(by, weights, share, most))
    return sized, found, n


def copies() -> F.Column:
    return (F.col("repeats") + (F.col("hash") < F.col("threshold")).cast("int")).cast("int")


def mix_report(df: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words) of every document."""
    sized, found, n = plan_mix(df, **how)
    return lookup(sized, found, "source", n).withColumn("copies", copies()).withColumn("taken", F.col("size") * F.col("copies"))


def mix(df: DataFrame, id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it. No text is shuffled while sources are few."""
    _, found, n = plan_mix(df, id=id, source=source, **how)
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    rows = df.select(whole, F.col(f"`{source}`").alias("__source"), hash_of(f"`{id}`").alias("hash__"))
    found = found.select(F.col("source").alias("__source"), F.col("repeats").alias("__r"), F.col("threshold").alias("__t"))
    rows = lookup(rows, found, "__source", n).withColumn("__copies", (F.col("__r") + (F.col("hash__") < F.col("__t")).cast("int")).cast("int"))
    return rows.where("__copies > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies")))).select("__row.*")
