"""Deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnforge.functions.keys import hash_bucket


def entity_sample(df: DataFrame, key: str, positive: Column, share: float, seed: str = "0") -> DataFrame:
    """Complete histories of every entity with a positive row and of a share of the others, by a hash
    of the entity. Adds ``weight``: how many entities a kept one stands for. The flag is aggregated
    by entity and joined back; rows of an entity never go through one window partition."""
    e = df.groupBy(key).agg(F.max(F.when(positive, 1).otherwise(0)).alias("_pos"))
    chosen = e.where((F.col("_pos") == 1) | (hash_bucket(F.col(key), 10_000, seed) < int(round(share * 10_000))))
    weight = F.when(F.col("_pos") == 1, 1.0).otherwise(1.0 / share if share > 0 else 0.0)
    return df.join(chosen.select(key, weight.alias("weight")), key)


def quota_sample(df: DataFrame, key: Column, target: str, part: str, train: str, negative_share: float, per_class: dict[int, int], per_part: int, seed: str = "0") -> DataFrame:
    """All positives and evaluation rows, a hash share of training negatives; then quotas by class in
    training and by evaluation part, in hash order. The hash filter comes before the rankings."""
    order = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")).cast("binary"))
    is_train = F.col(part) == train
    kept = df.where(F.col(part).isNotNull() & (~is_train | (F.col(target) == 1) | (hash_bucket(key, 10_000, seed) < int(round(negative_share * 10_000)))))
    w = Window.partitionBy(part, F.when(is_train, F.col(target)))
    cap = F.lit(per_part)
    for c, n in per_class.items():
        cap = F.when(is_train & (F.col(target) == c), F.lit(n)).otherwise(cap)
    # The literal bound lets Spark limit each group before the shuffle.
    return kept.withColumn("_rank", F.row_number().over(w.orderBy(order))).where(F.col("_rank") <= max([per_part, *per_class.values()])).where(F.col("_rank") <= cap).drop("_rank")


def stable_sample(df: DataFrame, key: Column, n: int, seed: str = "") -> DataFrame:
    """The n rows of least SHA-256; the same whatever the order of the input."""
    return df.orderBy(F.sha2(F.concat(key.cast("string"), F.lit(seed)), 256), key).limit(n)


def sample_per_group(df: DataFrame, groups: list[str], key: Column, n: int, seed: str = "0") -> DataFrame:
    """n rows of each group in a random order that the seed fixes: by a hash of the key."""
    order = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")).cast("binary"))
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*groups).orderBy(order))).where(F.col("_rank") <= n).drop("_rank")


def cap_rows(df: DataFrame, key: str, positive: Column, most: int | None, seed: str = "0") -> DataFrame:
    """About ``most`` rows: all of a smaller input, else an entity sample of that share, with weights."""
    rows = df.count() if most is not None else 0
    return entity_sample(df, key, positive, most / rows, seed) if most is not None and rows > most else df.withColumn("weight", F.lit(1.0))


def bernoulli(df: DataFrame, percent: float, seed: int) -> DataFrame:
    return df.sample(withReplacement=False, fraction=percent / 100.0, seed=seed)


def class_ratio(df: DataFrame, target: str) -> DataFrame:
    """Negatives by positive, for class weights."""
    g = df.agg(F.count_if(F.col(target) == 1).alias("positives"), F.count_if(F.col(target) == 0).alias("negatives"))
    return g.withColumn("ratio", F.round(F.col("negatives") / F.nullif(F.col("positives"), F.lit(0)), 6))


def stratified_subsample(df: DataFrame, target: str, key: Column, most: int, seed: str = "0") -> DataFrame:
    """At most ``most`` rows with the class shares of the input, in hash order."""
    n = {r[target]: r["count"] for r in df.groupBy(target).count().collect()}
    total = sum(n.values())
    order = Window.partitionBy(target).orderBy(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")).cast("binary")))
    quota = F.lit(0)
    for c, k in n.items():
        quota = F.when(F.col(target).eqNullSafe(F.lit(c)), F.lit(k if total <= most else max(1, most * k // total))).otherwise(quota)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).where(F.col("_rank") <= quota).drop("_rank")
