"""Mode with a fixed tie-break, and hierarchical imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.constants import MIN_DONORS
from tarnforge.functions.lineage import cut

#: Groups whose modes are broadcast at most.
FEW = 200_000


def mode_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """By key: the most frequent value (the smallest of equals), its count and the group's donors.
    Only reported rows are donors. Counts first, then one value a key: no sort of raw rows."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.max_by(value, F.struct("n", (-F.col(value)).alias("v")))
    return n.groupBy(*keys).agg(best.alias("mode_value"), F.max("n").alias("mode_rows"), F.sum("n").alias("donors"))


def impute_hierarchical(df: DataFrame, value: str, levels: list[tuple[str, list[str], int | None]], name: str | None = None) -> DataFrame:
    """Fills ``value`` from the first level whose peer group has enough donors.

    ``levels``: (method, keys, least donors; None: any). Imputed rows never donate. Adds
    <name>_imputed, <name>_method and <name>_was_missing; what no level fills is unresolved. The modes
    of a level of at most ``FEW`` groups are broadcast, so that no row moves; those of more are joined.
    """
    name = name or value
    out = df
    filled, method = F.col(value), F.when(F.col(value).isNotNull(), F.lit("reported"))
    extra = []
    for i, (label, keys, least) in enumerate(levels):
        m = cut(mode_by(df, keys, value).select(*[F.col(k).alias(f"_l{i}_{k}") for k in keys], F.col("mode_value").alias(f"_m{i}"), F.col("donors").alias(f"_d{i}")))
        on = [F.col(k).eqNullSafe(F.col(f"_l{i}_{k}")) for k in keys]
        small = F.broadcast(m) if m.count() <= FEW else m
        out = out.join(small, on, "left") if keys else out.crossJoin(F.broadcast(m))
        ok = F.col(f"_m{i}").isNotNull() & (F.lit(True) if least is None else F.col(f"_d{i}") >= least)
        filled, method = F.coalesce(filled, F.when(ok, F.col(f"_m{i}"))), method.when(ok, F.lit(label))
        extra += [f"_l{i}_{k}" for k in keys] + [f"_m{i}", f"_d{i}"]
    out = out.withColumns({f"{name}_imputed": filled, f"{name}_method": method.otherwise(F.lit("unresolved")), f"{name}_was_missing": F.col(value).isNull()})
    return out.drop(*extra)


def fine_coarse_month(fine: list[str], coarse: list[str], month: str) -> list[tuple[str, list[str], int | None]]:
    """The preset of three levels."""
    return [("fine_mode", fine, MIN_DONORS), ("coarse_mode", coarse, MIN_DONORS), ("month_mode", [month], None)]
