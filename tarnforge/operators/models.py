"""Model families on pyspark.ml behind one interface, fold evaluation, search and a run log."""

from __future__ import annotations

import hashlib
import json
import statistics
from collections.abc import Callable
from pathlib import Path

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.operators.preprocess import Preprocessor

FORBIDDEN = {"target", "label_status", "days_to_failure", "first_failure_date", "failure_event_count", "last_seen_date"}


def guard_features(cols: list[str]) -> list[str]:
    """Columns that know the future never enter a model."""
    bad = {c.lower() for c in cols} & FORBIDDEN
    if bad:
        raise ValueError(f"leaking features {sorted(bad)}")
    return cols


def balanced_weight(df: DataFrame, target: str) -> DataFrame:
    """Adds class_weight: both classes weigh alike. One aggregate."""
    row = df.agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("n")).first()
    total = row.p + row.n
    return df.withColumn("class_weight", F.when(F.col(target) == 1, total / (2.0 * max(row.p, 1))).otherwise(total / (2.0 * max(row.n, 1))))


class Prior:
    """Predicts the training rate (or 0 and 1 by ``most_frequent``)."""

    def __init__(self, most_frequent: bool = False):
        self.most_frequent = most_frequent

    def fit(self, df: DataFrame, cols: list[str], target: str) -> Prior:
        p = df.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
        self.value = float(p > 0.5) if self.most_frequent else p
        return self

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", F.lit(self.value))


class SparkModel:
    """A pyspark.ml classifier after the shared preprocessing; ``make`` gets the number of features."""

    def __init__(self, make: Callable[[int], object], weighted: bool = True, exact: bool = False):
        self.make, self.weighted, self.exact = make, weighted, exact

    def fit(self, df: DataFrame, cols: list[str], target: str) -> SparkModel:
        guard_features(cols)
        self.cols = cols
        self.prep = Preprocessor(exact=self.exact).fit(df, cols)
        rows = balanced_weight(df.where(F.col(target).isNotNull()), target) if self.weighted else df.where(F.col(target).isNotNull())
        x = self.prep.transform(rows.withColumn("_y", F.col(target).cast("double")), ["_y", *(["class_weight"] if self.weighted else [])])
        self.inputs = [c for c in x.columns if c not in ("_y", "class_weight")]
        model = self.make(len(self.inputs)).setLabelCol("_y").setFeaturesCol("_x")
        if self.weighted:
            model = model.setWeightCol("class_weight")
        self.model = Pipeline(stages=[VectorAssembler(inputCols=self.inputs, outputCol="_x"), model]).fit(x)
        return self

    def score(self, df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c not in self.prep.stats]
        out = self.model.transform(self.prep.transform(df, others))
        return out.select(*others, vector_to_array("probability")[1].alias("score"))


FAMILIES: dict[str, Callable[..., object]] = {
    "prior": lambda **k: Prior(**k),
    "logistic": lambda l2=0.01, **k: SparkModel(lambda n: LogisticRegression(regParam=l2, elasticNetParam=0.0, maxIter=k.get("max_iter", 50))),
    "forest": lambda trees=20, depth=6, seed=7: SparkModel(lambda n: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)),
    "boosting": lambda rounds=20, depth=4, seed=7: SparkModel(lambda n: GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed)),
    "mlp": lambda hidden=16, seed=7, max_iter=50: SparkModel(lambda n: MultilayerPerceptronClassifier(layers=[n, hidden, 2], seed=seed, maxIter=max_iter), weighted=False),
}


def evaluate_folds(df: DataFrame, date: str, folds: list, make: Callable[[], object], cols: list[str], target: str, metric: Callable[[DataFrame], float], prune: Callable[[int, float], bool] | None = None) -> dict:
    """Fits on each fold's training rows, scores its validation rows: values, mean, sample deviation,
    training value and gap. ``prune`` may stop after a fold. The loop is over folds, never rows."""
    values, train_values, oof = [], [], None
    for i, fold in enumerate(folds):
        model = make().fit(fold.train(df, date).where(F.col(target).isNotNull()), cols, target)
        scored = model.score(fold.validation(df, date)).withColumn("fold", F.lit(i))
        values.append(metric(scored))
        train_values.append(metric(model.score(fold.train(df, date))))
        oof = scored if oof is None else oof.unionByName(scored)
        if prune and prune(i, statistics.fmean(values)):
            break
    mean = statistics.fmean(values)
    return {"values": values, "mean": mean, "std": statistics.stdev(values) if len(values) > 1 else 0.0, "train_mean": statistics.fmean(train_values), "gap": statistics.fmean(train_values) - mean, "oof": oof}


def prompt_cases(df: DataFrame, age: str, attributes: list[str], parts: dict[str, str]) -> DataFrame:
    """What a language model would be shown of a row: a JSON object of its age and, for each attribute, of
    the values named by ``parts`` (name to column suffix), rounded; null where unknown. Neither labels
    nor identifiers are in it."""
    guard_features([age, *[f"{a}{x}" for a in attributes for x in parts.values()]])
    number = lambda c: F.round(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), 3)
    body = F.struct(number(age).alias("age_days"), *[F.struct(*[number(f"{a}{x}").alias(n) for n, x in parts.items()]).alias(a) for a in attributes])
    return df.withColumn("prompt_case", F.to_json(body, {"ignoreNullFields": "false"}))


class KeyedCache:
    """Answers by the SHA-256 of model, instructions and batch, each asked for once. An answer is written
    under another name first, so that a broken run leaves none that is cut. The folder is the driver's."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    @staticmethod
    def key(model: str, instructions: str, batch: list[dict]) -> str:
        return hashlib.sha256(json.dumps([model, instructions, batch], sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    def answer(self, model: str, instructions: str, batch: list[dict], ask: Callable[[list[dict]], object]) -> object:
        path = self.folder / f"{self.key(model, instructions, batch)}.json"
        if not path.exists():
            part = path.with_suffix(".part")
            part.write_text(json.dumps(ask(batch)))
            part.rename(path)
        return json.loads(path.read_text())


class RunLog:
    """Append-only JSON run log with aliases and an idempotent result cache, in a folder of the driver:
    what is logged is small, and no executor reads it."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def cached(self, name: str, compute: Callable[[], dict], refresh: bool = False) -> dict:
        """The stored result of this name, computed once."""
        path = self.folder / f"{name}.json"
        if refresh or not path.exists():
            path.write_text(json.dumps(compute(), sort_keys=True, default=str))
        return json.loads(path.read_text())

    def log(self, params: dict, metrics: dict) -> str:
        body = json.dumps({"params": params, "metrics": metrics}, sort_keys=True, default=str)
        run = hashlib.sha256(body.encode()).hexdigest()[:16]
        (self.folder / f"run-{run}.json").write_text(body)
        return run

    def alias(self, name: str, run: str) -> None:
        (self.folder / f"alias-{name}.json").write_text(json.dumps({"run": run}))

    def load(self, alias: str) -> dict:
        run = json.loads((self.folder / f"alias-{alias}.json").read_text())["run"]
        return json.loads((self.folder / f"run-{run}.json").read_text())

    def reproduces(self, alias: str, metric: str, value: float, tolerance: float = 1e-6) -> bool:
        known = self.load(alias)["metrics"][metric]
        return abs(known - value) <= tolerance * max(abs(known), 1e-12)


def search(space: list[dict], evaluate: Callable[[dict, Callable[[int, float], bool]], dict], log: RunLog, name: str) -> dict:
    """Tries each point once (finished ones are read from the log), pruning those whose running mean is
    below the median of what others had at the same fold."""
    seen: dict[int, list[float]] = {}
    best = None
    for point in space:
        key = f"{name}-{hashlib.sha256(json.dumps(point, sort_keys=True).encode()).hexdigest()[:12]}"

        def prune(fold: int, mean: float) -> bool:
            earlier = seen.setdefault(fold, [])
            stop = len(earlier) >= 3 and mean < statistics.median(earlier)
            earlier.append(mean)
            return stop

        result = log.cached(key, lambda point=point: {"point": point, **{k: v for k, v in evaluate(point, prune).items() if k != "oof"}})
        if best is None or result["mean"] > best["mean"]:
            best = result
    return best
