"""Duplicates, splits and isolation of a manifest: rows with an id, a content key, a label, a group and a split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.hashing import hash32
from quillon.operators import written
from quillon.operators.ranking import global_rank

#: The split that wins when copies disagree comes first.
PRIORITY = ("test", "train", "val", "calib", "bench")


def priority(split: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in PRIORITY]), split), F.lit(len(PRIORITY) + 1)).cast("int")


def exact_duplicates(df: DataFrame, key: str, order: list, label: str | None = None) -> DataFrame:
    """Add kept_id's place: keep_rank (1 for the row that stays) and conflict (copies with different labels)."""
    w = Window.partitionBy(key)
    out = df.withColumn("keep_rank", F.row_number().over(w.orderBy(*order)))
    return out.withColumn("conflict", F.min(label).over(w) != F.max(label).over(w)) if label else out


def group_quota_split(df: DataFrame, group: str, seed, quotas: list[tuple[str, float]], rest: str) -> DataFrame:
    """A split for each group: groups in an order by hash, the first round(share * n) of them to the first split, and so on."""
    groups = df.select(group).distinct().withColumn("h", hash32(seed, F.col(group)))
    ranked = global_rank(groups, F.shiftright("h", 22), [F.col("h"), F.col(group)])
    n = groups.agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked.join(F.broadcast(n))
    split, through = F.lit(rest), F.lit(0)
    chain = None
    for name, share in quotas:
        through = through + F.bround(F.lit(share) * F.col("n")).cast("int")
        chain = (F.when if chain is None else chain.when)(F.col("rank") <= through, name)
    split = chain.otherwise(rest) if chain is not None else split
    return ranked.select(group, split.alias("split"))


def per_key_split(df: DataFrame, key: list[str], id: str, seed, share: float, names: tuple[str, str]) -> DataFrame:
    """Within each key the first ceil(share * n) rows, in an order by hash, get the first name."""
    w = Window.partitionBy(*key)
    rank = F.row_number().over(w.orderBy(hash32(seed, F.col(id)), id))
    return df.withColumn("split", F.when(rank <= F.ceil(F.lit(share) * F.count(F.lit(1)).over(w)), names[0]).otherwise(names[1]))


def with_best(df: DataFrame, key: str, **aggs: Column) -> DataFrame:
    """Add aggregates over each key's rows. They are summed up in the tasks that read the rows and joined back, so that the rows of a hot key needn't meet
    (Spark splits it in the join); df is read twice. Rows with a null key are a key of their own."""
    best = df.groupBy(F.col(key).alias("__key")).agg(*[a.alias(n) for n, a in aggs.items()])
    return df.join(best, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def isolate(df: DataFrame, key: str, reason: str) -> DataFrame:
    """Rows that aren't dropped yet and whose split isn't their key's winning split are dropped."""
    live = F.col("drop_reason").isNull() & F.col(key).isNotNull()
    out = with_best(df, key, __best=F.min(F.when(live, priority(F.col("split")))))
    return out.withColumn("drop_reason", F.when(live & (priority(F.col("split")) > F.col("__best")), reason).otherwise(F.col("drop_reason"))).drop("__best")


def resolve(df: DataFrame, id: str = "id", key: str = "md5", label: str = "label") -> DataFrame:
    """Add drop_reason: conflicting copies, later copies, conflicting clusters, then isolation by group and by cluster, in this order.

    df is a manifest: an id names one row. Each step's result is written, as the next one reads it twice."""
    since = written.marked()
    rows = written.kept(df)
    order = F.struct(priority(F.col("split")).alias("p"), F.col(id).alias("id"))
    rows = with_best(rows, key, __low=F.min(label), __high=F.max(label), __first=F.min(order))
    reason = F.when(F.col("__low") != F.col("__high"), "exact_conflict").when(order != F.col("__first"), "exact_dup")
    rows = written.kept(rows.withColumn("drop_reason", reason).drop("__low", "__high", "__first"))
    live = F.col("drop_reason").isNull() & F.col("dup_cluster").isNotNull()
    own = F.when(live, F.col(label))
    rows = with_best(rows, "dup_cluster", __low=F.min(own), __high=F.max(own))
    rows = rows.withColumn("drop_reason", F.when(live & (F.col("__low") != F.col("__high")), "cluster_conflict").otherwise(F.col("drop_reason"))).drop("__low", "__high")
    rows = written.kept(isolate(written.kept(rows), "group", "group_split"))
    written.drop(since, 1)
    return isolate(rows, "dup_cluster", "cluster_split")


def check_invariants(df: DataFrame) -> DataFrame:
    """check, violations: groups and clusters in one split, contents once."""
    parts = []
    for name, key, what in (("group_one_split", "group", "split"), ("cluster_one_split", "dup_cluster", "split")):
        parts.append(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(what).alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations")).select(F.lit(name).alias("check"), "violations"))
    parts.append(df.groupBy("md5").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations")).select(F.lit("md5_once").alias("check"), "violations"))
    return parts[0].union(parts[1]).union(parts[2])


class TestSplitAccess(PermissionError):
    """The test split was asked for without leave."""


def select_split(df: DataFrame, split: str, allow_test: bool = False) -> DataFrame:
    if split == "test" and not allow_test:
        raise TestSplitAccess("the test split is read only with allow_test=True")
    return df.where(F.col("split") == split)
