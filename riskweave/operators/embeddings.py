"""Entity vectors from co-occurrence counts by a truncated SVD that stays distributed.

The sparse log-count matrix is a (row, column, weight) table. Randomised subspace iteration
needs only products with it, each a join and a group-by; vectors are array columns. What
reaches the driver is k x k numbers (k at most 42), never a row of the matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hash_unit
from ..session import cut_lineage
from .entities import cooccurrence

# fixed values: vector lengths and the least number of events of an entity
USER_DIM, MERCHANT_DIM, DEVICE_DIM, MIN_FREQUENCY = 32, 16, 16, 5
OVERSAMPLE, ROUNDS, SEED = 10, 5, 42


def _product(pairs: DataFrame, vectors: DataFrame, out: str, over: str, k: int) -> DataFrame:
    """(out, v): the weighted sum of the vectors of ``over``, for each ``out``."""
    joined = pairs.join(vectors, over)
    sums = joined.groupBy(out).agg(*[F.expr(f"sum(weight * v[{i}]) AS _{i}") for i in range(k)])
    return sums.select(out, F.expr(f"array({', '.join(f'_{i}' for i in range(k))}) AS v"))


def _gram(vectors: DataFrame, k: int) -> np.ndarray:
    """vT v: k x k sums, added up per partition first."""

    def partial(batches):
        total = np.zeros((k, k))
        for pdf in batches:
            if len(pdf):
                block = np.vstack(pdf["v"].to_numpy())
                total += block.T @ block
        yield pd.DataFrame({"i": np.arange(k * k), "s": total.ravel()})

    cells = vectors.select("v").mapInPandas(partial, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(k * k)
    for r in cells:
        out[r["i"]] = r["s"]
    return out.reshape(k, k)


def _times(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Multiply every vector by a small matrix."""

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.vstack(v.to_numpy()) @ matrix)) if len(v) else pd.Series([], dtype=object)

    return vectors.withColumn("v", apply("v"))


def _orthonormal(vectors: DataFrame, k: int) -> DataFrame:
    """Vectors with orthonormal columns. The product is written once, then measured and turned."""
    stored = cut_lineage(vectors)
    values, basis = np.linalg.eigh(_gram(stored, k))
    keep = values > values.max() * 1e-14 if values.max() > 0 else np.zeros(k, bool)
    scale = np.where(keep, 1 / np.sqrt(np.where(keep, values, 1.0)), 0.0)
    return _times(stored, basis * scale)


@dataclass
class Factors:
    """Row vectors U*S and column vectors V*S of a matrix, with the singular values."""

    rows: DataFrame
    columns: DataFrame
    singular: list[float]


def truncated_svd(pairs: DataFrame, row: str, column: str, rank: int, *, rounds: int = ROUNDS, seed: int = SEED) -> Factors:
    """The leading ``rank`` factors of a (row, column, weight) table.

    Signs are fixed so that each component's largest column entry is positive.
    """
    pairs = cut_lineage(pairs.select(row, column, "weight"))
    sizes = pairs.agg(F.count_distinct(row).alias("r"), F.count_distinct(column).alias("c")).first()
    k = min(rank + OVERSAMPLE, sizes["r"], sizes["c"])
    rank = min(rank, k)
    unit = lambda i, part: hash_unit(F.col(column), seed, i, part)
    start = pairs.select(column).distinct().select(
        column,
        F.array(*[F.sqrt(-2 * F.log(unit(i, "u"))) * F.cos(2 * np.pi * unit(i, "v")) for i in range(k)]).alias("v"),
    )
    left = _orthonormal(_product(pairs, start, row, column, k), k)
    for _ in range(rounds):
        right = _orthonormal(_product(pairs, left, column, row, k), k)
        left = _orthonormal(_product(pairs, right, row, column, k), k)
    image = cut_lineage(_product(pairs, left, column, row, k))
    values, basis = np.linalg.eigh(_gram(image, k))
    order = np.argsort(values)[::-1][:rank]
    singular = np.sqrt(np.maximum(values[order], 0.0))
    turn = basis[:, order]
    columns = _times(image, turn)
    peaks = columns.agg(*[F.max_by(F.col("v")[i], F.abs(F.col("v")[i])).alias(f"_{i}") for i in range(rank)]).first()
    signs = np.where(np.array([p or 0.0 for p in peaks]) < 0, -1.0, 1.0)
    return Factors(
        rows=_times(left, turn * singular * signs), columns=_times(image, turn * signs), singular=singular.tolist()
    )


@dataclass
class EntityEmbeddings:
    """``vectors``: (entity_type, entity_id, vector); ``defaults``: mean vector per type."""

    vectors: DataFrame
    defaults: dict[str, list[float]]

    def save(self, path: str) -> None:
        spark = self.vectors.sparkSession
        self.vectors.write.mode("overwrite").partitionBy("entity_type").parquet(f"{path}/vectors")
        rows = [(k, v) for k, v in self.defaults.items()]
        spark.createDataFrame(rows, "entity_type string, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/defaults")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "EntityEmbeddings":
        defaults = {r["entity_type"]: list(r["vector"]) for r in spark.read.parquet(f"{path}/defaults").collect()}
        return cls(spark.read.parquet(f"{path}/vectors").select("entity_type", "entity_id", "vector"), defaults)

    def lookup(self, df: DataFrame, kinds=("user", "merchant", "device")) -> DataFrame:
        """Add ``user_embedding`` etc.; an unknown id, or a missing column, gets the mean vector."""
        out = df
        for kind in kinds:
            default = F.array(*[F.lit(float(x)) for x in self.defaults[kind]]).cast("array<double>")
            name, key = f"{kind}_embedding", f"{kind}_id"
            if key not in df.columns:
                out = out.withColumn(name, default)
                continue
            mine = self.vectors.filter(F.col("entity_type") == kind).select(
                F.col("entity_id").alias("_e"), F.col("vector").alias("_vec")
            )
            out = out.join(mine, F.col(key).cast("string") == F.col("_e"), "left").drop("_e")
            out = out.withColumn(name, F.coalesce("_vec", default)).drop("_vec")
        return out

    def features(self, df: DataFrame, kinds=("user", "merchant", "device")) -> DataFrame:
        """The vectors as flat columns user_emb_0, user_emb_1, ..."""
        found = self.lookup(df, kinds)
        flat = [F.col(f"{k}_embedding")[i].alias(f"{k}_emb_{i}") for k in kinds for i in range(len(self.defaults[k]))]
        return found.select(*df.columns, *flat)


def _mean_vector(vectors: DataFrame, dim: int) -> list[float]:
    if dim == 0:
        return []
    row = vectors.agg(*[F.avg(F.col("vector")[i]).alias(f"_{i}") for i in range(dim)]).first()
    return [float(x or 0.0) for x in row]


def fit_embeddings(
    df: DataFrame, *, user_dim: int = USER_DIM, merchant_dim: int = MERCHANT_DIM, device_dim: int = DEVICE_DIM,
    min_frequency: int = MIN_FREQUENCY, rounds: int = ROUNDS, seed: int = SEED,
) -> EntityEmbeddings:
    """Vectors of frequent users and merchants from user x merchant counts, and of devices from
    device x user counts."""
    um = cooccurrence(df, "user_id", "merchant_id", min_frequency)
    sizes = um.agg(F.count_distinct("user_id").alias("u"), F.count_distinct("merchant_id").alias("m")).first()
    user_dim, merchant_dim = min(user_dim, max(sizes["m"] - 1, 0)), min(merchant_dim, max(sizes["u"] - 1, 0))
    both = truncated_svd(um, "user_id", "merchant_id", max(user_dim, merchant_dim), rounds=rounds, seed=seed)
    du = cooccurrence(df, "device_id", "user_id", min_frequency)
    device_dim = min(device_dim, max(sizes["u"] - 1, 0))
    dev = truncated_svd(du, "device_id", "user_id", device_dim, rounds=rounds, seed=seed)

    def table(kind: str, vectors: DataFrame, ident: str, dim: int) -> tuple[DataFrame, int]:
        dim = min(dim, len(dev.singular if kind == "device" else both.singular))
        return vectors.select(
            F.lit(kind).alias("entity_type"), F.col(ident).cast("string").alias("entity_id"), F.slice("v", 1, dim).alias("vector")
        ), dim

    parts = [
        ("user", *table("user", both.rows, "user_id", user_dim)),
        ("merchant", *table("merchant", both.columns, "merchant_id", merchant_dim)),
        ("device", *table("device", dev.rows, "device_id", device_dim)),
    ]
    stored = {kind: cut_lineage(vectors) for kind, vectors, _ in parts}
    defaults = {kind: _mean_vector(stored[kind], dim) for kind, _, dim in parts}
    everything = stored["user"].unionByName(stored["merchant"]).unionByName(stored["device"])
    return EntityEmbeddings(everything, defaults)
