"""Clusters of entity weeks: standard scaling, k-means with k by silhouette, a plane to draw them in, and noise."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evaluation import knee
from ..operators.neighbours import density_clusters, k_distances
from ..operators.vectors import within_distance
from ..sources.shared import remove, written_once


def scaled(columns: list[str]) -> Pipeline:
    """Missing values as means, then one vector of standard deviations from the mean: column `x`."""
    filled = [f"_{c}" for c in columns]
    return Pipeline(stages=[Imputer(inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="x", withMean=True)])


def fit(weeks: DataFrame, columns: list[str], ks: tuple[int, ...] = (3, 4, 5), seed: int = 42):
    """(scaler, k-means of the best silhouette, plane, {k: silhouette})."""
    scaler = scaled(columns).fit(weeks)
    rows = scaler.transform(weeks).select("x").persist()
    score = ClusteringEvaluator(featuresCol="x", metricName="silhouette")
    models = {k: KMeans(featuresCol="x", predictionCol="prediction", k=k, seed=seed).fit(rows) for k in ks}
    found = {k: score.evaluate(m.transform(rows)) for k, m in models.items()}
    plane = PCA(k=2, inputCol="x", outputCol="plane").fit(rows)
    rows.unpersist()
    return scaler, models[max(found, key=found.get)], plane, found


def assign(weeks: DataFrame, scaler, kmeans, plane) -> DataFrame:
    """Weeks with cluster_id and their place in the plane."""
    out = plane.transform(kmeans.transform(scaler.transform(weeks)))
    xy = vector_to_array("plane")
    return out.withColumns({"cluster_id": F.col("prediction"), "plane_x": xy[0], "plane_y": xy[1], "x": vector_to_array("x")}).drop("prediction", "plane", "_v", *(c for c in out.columns if c.startswith("_")))


#: Names of clusters by the feature that sets them apart, above and below the mean.
TRAITS = {
    "fuel_per_productive_hour": ("high fuel use", "fuel-saving"),
    "idle_pct": ("idle-heavy", "low idle"),
    "productivity_per_hour": ("high output", "low output"),
    "time_ratio": ("slow pace", "fast pace"),
    "anomaly_per_10h": ("anomaly-prone", "few anomalies"),
    "safety_per_10h": ("needs safety coaching", "few safety events"),
}
#: Fixed value: a centroid this far from the mean in a feature may be named after it.
TRAIT_LEAST = 0.5


#: Names that go first, in this order: what must be strong (columns added up with their signs) and how much at least.
FIRST = (
    ("needs safety coaching", {"safety_per_10h": 1}, TRAIT_LEAST),
    ("idle-heavy", {"idle_pct": 1}, TRAIT_LEAST),
    ("efficient", {"time_ratio": -1, "fuel_per_productive_hour": -1}, 1e-9),
)


def cluster_names(centroids: dict[int, dict[str, float]]) -> dict[int, str]:
    """A name for each cluster (as many as k) from its centroid in standard deviations.

    Every name that would suit a cluster is a claim. Claims are heard in one order: the names that go first by strength, then each
    cluster's traits by strength. A claim holds if cluster and name are both free. Who is left is average, and numbered if there are several.
    """
    claims = [(place, -sum(sign * z[f] for f, sign in of.items()), i, name) for place, (name, of, least) in enumerate(FIRST) for i, z in centroids.items() if sum(sign * z[f] for f, sign in of.items()) >= least]
    claims += [(len(FIRST) + i, -abs(z), i, TRAITS[f][z < 0]) for i, row in centroids.items() for f, z in row.items() if f in TRAITS and abs(z) >= TRAIT_LEAST]
    owner: dict[str, int] = {}
    for *_, i, name in sorted(claims):
        if name not in owner and i not in owner.values():
            owner[name] = i
    left = sorted(centroids.keys() - set(owner.values()))
    return {i: name for name, i in owner.items()} | {i: "average" if n == 1 else f"average {n}" for n, i in enumerate(left, 1)}


def dense(weeks: DataFrame, key: str, vector: str = "x", least: int = 5) -> tuple[float | None, DataFrame]:
    """The radius at the knee of the k-distances, and weeks with core and cluster by density; rows without a cluster are noise."""
    far = written_once(k_distances(weeks, key, vector, least), "k-distances")
    eps = knee(far, "k_distance").first()["eps"]
    remove(far)
    found = density_clusters(weeks, key, vector, eps if eps is not None else 0.0, least)
    return eps, weeks.join(found.withColumnRenamed("id", key), key, "left")


def noise(column: str, core: list[list[float]], radius: float, df: DataFrame) -> Column:
    """Whether no core point is within the radius."""
    return ~within_distance(df, column, core, radius)


def outlier_reason(z_columns: list[str], limit: float = 2.5) -> Column:
    """The feature furthest from the mean, if beyond the limit: name and side."""
    items = F.array(*(F.struct(F.abs(c).alias("size"), F.lit(c.removeprefix("z_")).alias("name"), F.when(F.col(c) > 0, "high").otherwise("low").alias("side")) for c in z_columns))
    top = F.array_max(F.filter(items, lambda x: x["size"].isNotNull()))
    return F.when(top["size"] >= limit, F.concat(top["side"], F.lit(" "), top["name"]))
