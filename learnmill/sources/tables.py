"""Readers and the feature views that the catalog's queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def z_scored(df: DataFrame, columns: list[str], digits: int = 9) -> DataFrame:
    stats = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"_s_{c}") for c in columns))
    return df.crossJoin(F.broadcast(stats)).select(*(c for c in df.columns if c not in columns), *(F.round((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"), digits).alias(c) for c in columns))


def user_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y): users by the mean and spread of their events' values, standardised."""
    users = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("x"), F.stddev_samp("value").alias("y"))
    return z_scored(users, ["x", "y"])


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, x1, x2): y = +1 for quality 1 and -1 for 0; x1 = 1, x2 = n_chars / 1000."""
    return (
        table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
        .select(F.col("doc_id").alias("id"), (2.0 * F.col("quality") - 1.0).alias("y"), F.lit(1.0).alias("x1"), (F.col("n_chars") / 1000.0).alias("x2"))
    )


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x1, x2): y = +1 for returned lines and -1 for others; x1 = quantity / 50, x2 = discount x 10 - 0.5."""
    return table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("y"), (F.col("l_quantity") / 50.0).alias("x1"), (F.col("l_discount") * 10.0 - 0.5).alias("x2"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, ts, obs): each user's event values over time."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("seq_id"), "ts", F.col("value").alias("obs"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, v): embeddings as arrays of double."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))


#: The same views in DuckDB's SQL, as the heads of WITH clauses.
SQL_USERS = """u0 AS (SELECT user_id AS id, avg(value) AS a, stddev_samp(value) AS s FROM events GROUP BY 1),
s0 AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(s) AS ms, stddev_samp(s) AS ss FROM u0),
p AS (SELECT id, round((a - ma) / sa, 9) AS x, round((s - ms) / ss, 9) AS y FROM u0, s0)"""
SQL_DOCS = "d AS (SELECT doc_id AS id, 2.0::DOUBLE * quality - 1.0 AS y, 1.0::DOUBLE AS x1, n_chars::DOUBLE / 1000.0::DOUBLE AS x2 FROM documents JOIN labels USING (doc_id))"
SQL_LINES = "d AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y, l_quantity / 50.0::DOUBLE AS x1, l_discount * 10.0::DOUBLE - 0.5::DOUBLE AS x2 FROM lineitem)"
SQL_SEQ = "q AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS t, value AS obs FROM events)"
SQL_VEC = "v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings)"
