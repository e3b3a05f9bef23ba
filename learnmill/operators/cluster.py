"""One interface to the clustering algorithms that give rows a cluster: train, then predict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clique, medoids, neighbors


class Cluster:
    """``Cluster("dbscan", min_points=5, radius=0.75).train(points)`` gives (id, cluster); predict does so for other points.

    dbscan and clarans take points (id, x, y), or arrays where the algorithm does; clique takes ``id_col`` and ``columns`` of any number. Clusters are named
    by numbers, of clarans by the medoid's id; -1 is noise."""

    def __init__(self, algorithm: str, **how):
        if algorithm not in ("dbscan", "clarans", "clique"):
            raise ValueError("the algorithms are dbscan, clarans and clique")
        self.algorithm, self.how = algorithm, how

    def train(self, points: DataFrame) -> DataFrame:
        if self.algorithm == "dbscan":
            neighbors._checkpoints(points.sparkSession)
            self._fitted = points, neighbors.dbscan(points, **self.how).checkpoint()
            return self._fitted[1].select("id", "cluster")
        if self.algorithm == "clarans":
            chosen = medoids.clarans(points, **self.how)
            self._fitted = points.where(F.col("id").isin(chosen))
            return self.predict(points)
        found, self._fitted = clique.fit_rows(points, **self.how)
        return found

    def predict(self, new: DataFrame) -> DataFrame:
        if self.algorithm == "dbscan":
            points, labels = self._fitted
            extra = {"metric": self.how["metric"]} if "metric" in self.how else {}
            return neighbors.predict_dbscan(new, points, labels, self.how["radius"], **extra)
        if self.algorithm == "clarans":
            return medoids.assign(new, self._fitted).select("id", F.col("medoid").alias("cluster"))
        return clique.predict_rows(new, self.how["id_col"], self._fitted)
