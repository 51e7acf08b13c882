"""The one-big-table: identity, rolling features of every attribute, label; validated and published.

At the preset (22 attributes, raw and normalised, three windows) it has 847 columns, and 429 in each
single-representation projection. Identity, attributes and labels are a narrow frame; all windows of
all attributes are made of it in one vectorised pass: one exchange, one sort. The stage is written
once, and everything after it (validation, projections, publication) reads what was written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnforge.constants import HORIZON_DAYS, MODEL_IDS, WINDOW_DAYS
from tarnforge.functions.keys import epoch_day
from tarnforge.functions.scalar import any_of
from tarnforge.operators import clean, labels, profile, sets, wide_windows
from tarnforge.sources import publish

# Identity and label columns, in order.
IDENTITY = ("SMART_DAILY_KEY", "SSD_KEY", "DISK_ID", "MODEL_CODE", "OBSERVATION_DATE_KEY", "OBSERVATION_DATE")
LABEL = ("FIRST_FAILURE_DATE", "LAST_SEEN_DATE", "DAYS_TO_FAILURE", "LABEL_STATUS", "TARGET_30D")
# The parts of a feature family after the base column, each for all windows.
FAMILY = ("MEAN", "COUNT", "PREV_COUNT", "MEAN_VALID", "MEAN_SHIFT", "MEAN_SHIFT_VALID")


class ValidationError(ValueError):
    """A stage breaks its contract; nothing is published."""


@dataclass(frozen=True)
class Spec:
    ids: tuple[int, ...] = MODEL_IDS
    representations: tuple[str, ...] = ("R", "N")
    windows: tuple[int, ...] = WINDOW_DAYS
    horizon: int = HORIZON_DAYS

    def bases(self, representations: tuple[str, ...] | None = None) -> list[str]:
        return [f"{r}_{i}" for r in (representations or self.representations) for i in self.ids]

    def columns(self, representations: tuple[str, ...] | None = None) -> list[str]:
        """Exact names and order of a projection."""
        family = [c for b in self.bases(representations) for c in (b, *(f"{b}_{part}_{n}D" for part in FAMILY for n in self.windows))]
        return [*IDENTITY, *family, *LABEL]


def check_registry(columns: list[str], spec: Spec) -> None:
    """Exactly the registered attribute columns, whatever their case."""
    found = {c.upper() for c in columns if c[:2].upper() in ("R_", "N_") and c[2:].isdigit()}
    if found != {b.upper() for b in spec.bases()}:
        raise ValidationError(f"attribute columns differ: {sorted(found ^ set(spec.bases()))[:10]}")


def build(facts: DataFrame, failures: DataFrame, spec: Spec = Spec(), start: str | None = None, end: str | None = None, entities: int | None = None) -> DataFrame:
    """``facts``: IDENTITY and attributes; ``failures``: SSD_KEY, FAILURE_DATE.

    Features and labels are computed on the widened context and cut to the output dates at the end.
    """
    check_registry(facts.columns, spec)
    facts = clean.require_columns(facts, [*IDENTITY, *spec.bases()])
    context = clean.context_scope(facts, "OBSERVATION_DATE", start, end, spec.windows, spec.horizon)
    if entities is not None:
        context = clean.first_entities(context, "SSD_KEY", entities)
    out = context.select(*IDENTITY, *spec.bases(), epoch_day(F.col("OBSERVATION_DATE")).alias("_day"))
    seen = labels.last_seen(context, "SSD_KEY", "OBSERVATION_DATE")
    failed = labels.failure_summary(failures, "SSD_KEY", "FAILURE_DATE")
    out = out.join(failed, "SSD_KEY", "left").join(seen, "SSD_KEY", "left")
    status = labels.status("OBSERVATION_DATE", spec.horizon)
    out = out.select(
        "_day", *IDENTITY, *spec.bases(), F.col("first_failure_date").alias("FIRST_FAILURE_DATE"), F.col("last_seen_date").alias("LAST_SEEN_DATE"),
        F.datediff("first_failure_date", "OBSERVATION_DATE").alias("DAYS_TO_FAILURE"), status.alias("LABEL_STATUS"),
    )
    out = out.withColumn("TARGET_30D", labels.target("LABEL_STATUS"))
    out = wide_windows.with_families(out, "SSD_KEY", "_day", spec.bases(), spec.windows, spec.columns())
    return clean.output_scope(out, "OBSERVATION_DATE", start, end)


def count_errors(spec: Spec) -> Column:
    """A window count outside 0 to the window's days."""
    return any_of([~F.coalesce(F.col(f"{b}_{p}_{n}D").between(0, n), F.lit(False)) for b in spec.bases() for n in spec.windows for p in ("COUNT", "PREV_COUNT")])


def mean_errors(spec: Spec) -> Column:
    """A mean that exists without values, or its flag differs."""
    return any_of([(F.col(f"{b}_MEAN_{n}D").isNotNull() != (F.col(f"{b}_COUNT_{n}D") > 0)) | ~F.col(f"{b}_MEAN_VALID_{n}D").eqNullSafe((F.col(f"{b}_COUNT_{n}D") > 0).cast("int")) for b in spec.bases() for n in spec.windows])


def shift_errors(spec: Spec) -> Column:
    bad = []
    for b in spec.bases():
        for n in spec.windows:
            due = (F.col(f"{b}_COUNT_{n}D") > 0) & (F.col(f"{b}_PREV_COUNT_{n}D") > 0)
            bad.append((F.col(f"{b}_MEAN_SHIFT_{n}D").isNotNull() != due) | ~F.col(f"{b}_MEAN_SHIFT_VALID_{n}D").eqNullSafe(due.cast("int")))
    return any_of(bad)


def parity_warnings(spec: Spec) -> Column:
    """Raw and normalised counts of an attribute differ."""
    if len(spec.representations) < 2:
        return F.lit(False)
    a, b = spec.representations
    return any_of([F.col(f"{a}_{i}_{p}_{n}D") != F.col(f"{b}_{i}_{p}_{n}D") for i in spec.ids for n in spec.windows for p in ("COUNT", "PREV_COUNT")])


def label_errors(spec: Spec) -> Column:
    """The stored label differs from a recomputation."""
    days = F.datediff("FIRST_FAILURE_DATE", "OBSERVATION_DATE")
    again = labels.status("OBSERVATION_DATE", spec.horizon)
    return ~F.col("DAYS_TO_FAILURE").eqNullSafe(days) | ~F.col("LABEL_STATUS").eqNullSafe(again) | ~F.col("TARGET_30D").eqNullSafe(labels.target("LABEL_STATUS"))


def validate(stage: DataFrame, spec: Spec, expected_rows: int | None = None) -> dict:
    """All blocking counters and the warning in one aggregate over the stored stage."""
    clean.exact_schema(stage, spec.columns())
    n = lambda c: F.count_if(F.coalesce(c, F.lit(True)))  # noqa: E731  null is ambiguous and counts
    status = F.col("LABEL_STATUS")
    got = profile.scalar(stage, {
        "output_rows": F.count("*"), "entities": F.count_distinct("SSD_KEY"), "keys": F.count_distinct("SMART_DAILY_KEY"), "entity_days": F.count_distinct("SSD_KEY", "OBSERVATION_DATE"),
        "null_identity": F.count_if(any_of([F.col(c).isNull() for c in IDENTITY])), "count_errors": n(count_errors(spec)), "mean_errors": n(mean_errors(spec)), "shift_errors": n(shift_errors(spec)),
        "label_errors": n(label_errors(spec)), "warnings": F.count_if(parity_warnings(spec)), **{f"{k.lower()}_rows": F.count_if(status == k) for k in ("POSITIVE", "NEGATIVE", "CENSORED", "SAME_DAY_FAILURE", "POST_FAILURE")},
    })
    blocking = {k: got[k] for k in ("NULL_IDENTITY", "COUNT_ERRORS", "MEAN_ERRORS", "SHIFT_ERRORS", "LABEL_ERRORS")}
    blocking |= {"repeated_keys": got["OUTPUT_ROWS"] - got["KEYS"], "repeated_grain": got["OUTPUT_ROWS"] - got["ENTITY_DAYS"]}
    blocking |= {"empty": int(got["OUTPUT_ROWS"] == 0), "lost_rows": 0 if expected_rows is None else got["OUTPUT_ROWS"] - expected_rows}
    if bad := {k: v for k, v in blocking.items() if v}:
        raise ValidationError(f"stage fails {bad}")
    return got


def variant(stage: DataFrame, spec: Spec, representation: str) -> DataFrame:
    """One representation's projection; no column of the other may be left."""
    out = stage.select(*spec.columns((representation,)))
    clean.forbid_columns(out, {c for r in spec.representations if r != representation for c in spec.columns((r,)) if c.startswith(f"{r}_")})
    return out


def years_by_label(stage: DataFrame) -> DataFrame:
    return stage.groupBy(F.year("OBSERVATION_DATE").alias("year"), "LABEL_STATUS").agg(F.count("*").alias("row_count"))


def run(spark: SparkSession, facts: DataFrame, failures: DataFrame, root: str, nonce: str, spec: Spec = Spec(), start: str | None = None, end: str | None = None, entities: int | None = None) -> dict:
    """Build, store, validate, project, publish, audit. A bounded run is validated but not published;
    a failed one leaves its stages and an audit row."""
    run_id = publish.run_id(nonce)
    names = {"RN": "obt_rn", **{r: f"obt_{r.lower()}" for r in spec.representations}}
    paths = {k: publish.stage_path(root, v, run_id) for k, v in names.items()}
    bounded = any(x is not None for x in (start, end, entities))
    try:
        stage = publish.write_stage(build(facts, failures, spec, start, end, entities), paths["RN"])
        got = validate(stage, spec)
        for r in spec.representations:
            part = publish.write_stage(variant(stage, spec, r), paths[r])
            if not sets.same_rows(part, stage.select(*part.columns)):
                raise ValidationError(f"projection {r} differs from the stage")
        if not bounded:
            for k in (*spec.representations, "RN"):
                publish.promote(spark, paths[k], names[k], root, names[k])
    except Exception as e:
        publish.audit(spark, f"{root}/_audit", run_id, "failed", {}, str(e))
        raise
    publish.audit(spark, f"{root}/_audit", run_id, "validated" if bounded else "published", {k.lower(): v for k, v in got.items()})
    return got
