"""Sources and sinks: Parquet with vector metadata, CSV and TSV pairs, embedding archives, workloads, results."""

from __future__ import annotations

import json
import os
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.topk import TopKQuery


def parquet(spark: SparkSession, path: str, bits: dict[str, int] | None = None) -> DataFrame:
    """A Parquet table. Columns in `bits` are fixed-size binary bit strings of the given length, highest bit first."""
    df = spark.read.parquet(path)
    for c, n in (bits or {}).items():
        df = df.withColumn(c, bytes_to_bits(F.col(c), n))
    return df


def bytes_to_bits(col, nbits: int):  # noqa: ANN001, ANN201
    """Binary of ceil(nbits / 8) bytes -> struct<nbits, words>."""
    hexed = F.rpad(F.hex(col), -(-nbits // 64) * 16, "0")
    word = lambda i: F.conv(F.substr(hexed, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint")
    return F.when(col.isNotNull(), F.struct(F.lit(nbits).alias("nbits"), F.transform(F.sequence(F.lit(0), F.lit(-(-nbits // 64) - 1)), word).alias("words")))


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep, header=header)


def pair_tsv(spark: SparkSession, path: str) -> DataFrame:
    """query_id, neighbor_id, dist -> (l_id, r_id, dis)."""
    return csv(spark, path, "l_id bigint, r_id bigint, dis double", "\t")


def npz(spark: SparkSession, path: str, name: str, ids: str | None = None) -> DataFrame:
    """An array of an .npz archive as (id, embedding). The archive is one file read by the driver: convert large ones to Parquet once."""
    with np.load(path) as z:
        m = z[name]
        i = z[ids] if ids else np.arange(len(m))
    return spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(i, m, strict=True)], "id bigint, embedding array<float>")


def media(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Images, audio and other files: (path, modificationTime, length, content)."""
    r = spark.read.format("binaryFile")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def workload(path: str) -> list[TopKQuery]:
    """The queries of a JSON workload file."""
    with open(path) as f:
        doc = json.load(f)
    return [TopKQuery.from_json(q) for q in (doc["queries"] if isinstance(doc, dict) else doc)]


def views(spark: SparkSession, folder: str) -> list[str]:
    """Register every Parquet table of a local folder as a view."""
    names = sorted(n[: -len(".parquet")] for n in os.listdir(folder) if n.endswith(".parquet"))
    for n in names:
        spark.read.parquet(os.path.join(folder, n + ".parquet")).createOrReplaceTempView(n)
    return names


def vector_columns(df: DataFrame) -> list[str]:
    """Columns of float or double arrays."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType))]


def light(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Without vector columns, or only the kept ones."""
    return df.select(*keep) if keep else df.drop(*vector_columns(df))


def write_results(path: str, query_id: Any, rows: DataFrame, elapsed: float, profile: dict[str, Any] | None = None, setting: dict[str, Any] | None = None) -> None:
    """A bounded result (top k) with its time, profile and settings as one JSON file."""
    with open(path, "w") as f:
        json.dump({"query_id": query_id, "rows": [r.asDict(True) for r in rows.collect()], "elapsed": elapsed, "qps": 1 / elapsed if elapsed else None, "profile": profile or {}, "setting": setting or {}}, f, default=str)


def write_summary(df: DataFrame, path: str, keys: list[str], sums: list[str]) -> None:
    """Rolled up per key, as CSV."""
    df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).write.mode("overwrite").csv(path, header=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """A candidate set kept for several uses, as a view."""
    df = df.persist()
    df.createOrReplaceTempView(name)
    return df


def embed(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, embedding): hashed bag of words, of unit length. A stand-in for an embedding model, without network."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    slots = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    counts = df.select(key, slots.alias("s")).withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter("s", lambda x: x == i)).cast("double")))
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return counts.select(key, F.transform("v", lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)).cast("float")).alias("embedding"))
