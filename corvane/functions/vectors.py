"""Vector expressions and the exact search of a stated set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in the JVM; null for null, all-zero or other-length vectors."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def depth_multiplier(depth: Column, rate: float, floor: float) -> Column:
    return F.greatest(1 - depth * rate, F.lit(floor))


def rows_of(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``dim`` finite numbers that aren't all zero, and these as vectors of length 1."""
    ok = np.array(pc.fill_null(pc.equal(pc.list_value_length(col), dim), False).to_numpy(zero_copy_only=False), bool)
    x = col.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(norm) & (norm > 0)
    ok[np.flatnonzero(ok)[~good]] = False
    return ok, x[good] / norm[good, None]


def search(rows: DataFrame, queries: DataFrame, k: int, floor: float, id_col: str = "chunk_id", vec_col: str = "embedding", most_queries: int = 4096) -> DataFrame:
    """(query_id, id, similarity): the ``k`` most similar rows of each query, similarities strictly above ``floor``.

    ``queries`` (query_id, vector) is a stated set of at most ``most_queries``;
    its matrix goes to the executors, which compare it with one Arrow batch of
    rows after the other and keep the best ``k`` of a batch, so what is
    shuffled is a small part of the rows. Vectors that are null, of another
    length, all zero or not finite have no rows. Equal similarities: smaller id
    first. A row delivered twice counts once.
    """
    asked = queries.where("query_id is not null and vector is not null").limit(most_queries + 1).collect()
    if len(asked) > most_queries:
        raise ValueError(f"at most {most_queries} queries in a batch")
    names = [r["query_id"] for r in asked]
    kind_q, kind_i = queries.schema["query_id"].dataType.simpleString(), rows.schema[id_col].dataType.simpleString()
    schema = f"query_id {kind_q}, id {kind_i}, similarity double"
    spark = rows.sparkSession
    dim = max((len(r["vector"]) for r in asked), default=0)
    if not dim:
        return spark.createDataFrame([], schema)
    ok, unit = rows_of(pa.array([list(r["vector"]) for r in asked], pa.list_(pa.float64())), dim)
    held = spark.sparkContext.broadcast((unit, [n for n, o in zip(names, ok) if o]))
    label = to_arrow_type(queries.schema["query_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, name = held.value
        labels = pa.array(name, label)
        for b in batches:
            good, x = rows_of(b.column(1), dim)
            ids = b.column(0).filter(pa.array(good))
            for lo in range(0, len(q), 256):
                s = q[lo : lo + 256] @ x.T
                if s.shape[1] > k:  # what is below the batch's k-th can't be among the first k
                    cut = np.maximum(np.partition(s, -k, axis=1)[:, -k], np.nextafter(floor, 2))[:, None]
                    i, j = np.nonzero(s >= cut)
                else:
                    i, j = np.nonzero(s > floor)
                if len(i):
                    yield pa.RecordBatch.from_arrays([labels.take(pa.array(lo + i)), ids.take(pa.array(j)), pa.array(s[i, j])], ["query_id", "id", "similarity"])

    hits = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null").mapInArrow(run, schema)
    hits = hits.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
