"""Queries of the model families: their scores have no SQL form, so their rows are checked by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnforge.catalog.base import query, read
from tarnforge.functions.keys import hash_bucket
from tarnforge.operators import metrics, models


def _rows(spark, d):
    """Labelled documents with a few counts."""
    count = lambda p, n: F.regexp_count("text", F.lit(p)).cast("double").alias(n)
    docs = read(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), count("[A-Z]", "n_upper"), count("[#*$%&|<>!]", "n_marks"), count("\\n", "n_breaks"))
    y = read(spark, d, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").alias("y"))
    return docs.join(y, "doc_id").withColumn("bucket", hash_bucket(F.col("doc_id"), 4))


@query("ml1_prior", "SELECT round(avg(quality), 6) AS score FROM labels JOIN documents USING (doc_id)")
def ml1(spark, d):
    r = _rows(spark, d)
    return models.Prior().fit(r, [], "y").score(r).select(F.round("score", 6).alias("score")).distinct()


def _family(name, **options):
    def run(spark, d):
        r = _rows(spark, d)
        model = models.FAMILIES[name](**options).fit(r.where("bucket > 0"), ["n_chars", "n_upper", "n_marks", "n_breaks"], "y")
        return metrics.roc_auc(model.score(r.where("bucket = 0")), "score", "y")

    return run


query("ml2_logistic")(_family("logistic"))
query("ml3_forest")(_family("forest", trees=10, depth=4))
query("ml4_boosting")(_family("boosting", rounds=5, depth=3))
query("ml5_mlp")(_family("mlp", hidden=6, max_iter=30))


def _returned(spark, d):
    l = read(spark, d, "lineitem")
    return l.select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10).alias("discount"))


#: Newton's steps for a constant and two features; the 3 x 3 system is solved by cofactors.
_NEWTON = """WITH RECURSIVE x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, CAST(l_quantity AS DOUBLE) / 50 AS u, CAST(l_discount AS DOUBLE) * 10 AS v FROM lineitem),
n AS (SELECT count(*) / 2.0 / sum(y) AS w1, count(*) / 2.0 / sum(1 - y) AS w0 FROM x), r AS (SELECT y, u, v, CASE WHEN y = 1 THEN w1 ELSE w0 END::DOUBLE AS w FROM x, n),
steps AS (
  SELECT 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2
  UNION ALL
  SELECT k + 1, b0 + ((e * i - h * h) * g0 + (c * h - b * i) * g1 + (b * h - c * e) * g2) / det, b1 + ((h * c - b * i) * g0 + (a * i - c * c) * g1 + (c * b - a * h) * g2) / det, b2 + ((b * h - e * c) * g0 + (b * c - a * h) * g1 + (a * e - b * b) * g2) / det
  FROM (SELECT *, a * (e * i - h * h) - b * (b * i - h * c) + c * (b * h - e * c) AS det FROM (
    SELECT k, b0, b1, b2, sum(s) AS a, sum(s * u) AS b, sum(s * v) AS c, sum(s * u * u) + 1 AS e, sum(s * u * v) AS h, sum(s * v * v) + 1 AS i, sum(w * (y - p)) AS g0, sum(w * (y - p) * u) - b1 AS g1, sum(w * (y - p) * v) - b2 AS g2
    FROM (SELECT *, w * p * (1 - p) AS s FROM (SELECT steps.*, r.*, 1 / (1 + exp(-(b0 + b1 * u + b2 * v))) AS p FROM steps, r WHERE k < 8)) GROUP BY k, b0, b1, b2))
)"""


@query("ml2_newton", _NEWTON + """
SELECT term, round(value, 5) AS value FROM (SELECT unnest(['constant', 'quantity', 'discount']) AS term, unnest([b0, b1, b2]) AS value FROM steps WHERE k = 8)""")
def ml2_newton(spark, d):
    """Coefficients of a balanced, penalised logistic regression."""
    from tarnforge.operators.newton import Logistic

    m = Logistic(l2=1.0).fit(_returned(spark, d), ["quantity", "discount"], "y")
    return spark.createDataFrame([(t, round(v, 5)) for t, v in m.coefficients().items()], "term string, value double")


@query("ml2_newton_scores", _NEWTON + """
SELECT l_linenumber, count(*) AS n, round(avg(1 / (1 + exp(-(b0 + b1 * l_quantity / 50 + b2 * l_discount * 10)))), 5) AS score FROM lineitem, steps WHERE k = 8 GROUP BY 1""")
def ml2_newton_scores(spark, d):
    from tarnforge.operators.newton import Logistic

    m = Logistic(l2=1.0).fit(_returned(spark, d), ["quantity", "discount"], "y")
    l = read(spark, d, "lineitem").select("l_linenumber", (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10).alias("discount"))
    return m.score(l).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("score"))


def _explained(name, **options):
    """Each row's contributions, which with the base add up to what the fitted model gives."""
    def run(spark, d):
        from pyspark.ml.functions import vector_to_array

        from tarnforge.operators import contributions

        r = _rows(spark, d)
        m = models.FAMILIES[name](**options).fit(r.where("bucket > 0"), ["n_chars", "n_upper", "n_marks", "n_breaks"], "y")
        fitted = m.model.stages[-1]
        x = m.model.transform(m.prep.transform(r, ["doc_id"]))
        value = F.get(vector_to_array("probability"), F.lit(1)) if name == "forest" else F.get(vector_to_array("rawPrediction"), F.lit(1))
        rows = x.select("doc_id", vector_to_array("_x").alias("x"), value.alias("value"))
        out = contributions.contributions(rows, "x", contributions.ensemble(fitted), len(m.inputs))
        total = F.aggregate("contributions", F.col("base"), lambda a, b: a + b)
        return out.select("doc_id", F.size("contributions").alias("n_features"), (F.abs(total - F.col("value")) < 1e-6).alias("adds_up"))

    return run


_ADDS_UP = "SELECT DISTINCT doc_id, 4 AS n_features, true AS adds_up FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL"
query("ml12_forest_contributions", _ADDS_UP)(_explained("forest", trees=8, depth=4))
query("ml12_boosting_contributions", _ADDS_UP)(_explained("boosting", rounds=4, depth=3))
