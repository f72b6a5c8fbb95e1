"""Attribute predicates as Columns. A null attribute fails every operator, != included."""

from __future__ import annotations

import operator
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt, "=": operator.eq, "==": operator.eq, "!=": operator.ne}
#: Literals of an `in` list up to which it is an expression; longer lists become a semi-join.
LITERALS = 1000


@dataclass(frozen=True)
class Predicate:
    table: str
    attribute: str
    operator: str
    value: Any

    def column(self, prefix: str = "") -> Column:
        c = F.col(prefix + self.attribute)
        if self.operator in _COMPARE:
            return c.isNotNull() & _COMPARE[self.operator](c, F.lit(self.value))
        if self.operator == "in":
            return c.isin(list(self.value))
        if self.operator == "@>":
            return c.isNotNull() & (F.size(F.array_except(F.array(*[F.lit(v) for v in self.value]), c)) == 0)
        raise ValueError(f"unsupported operator {self.operator}")


def table_name(name: str) -> str:
    """Tables are matched regardless of case and of an index suffix."""
    n = name.lower()
    return n[: -len("_hnsw")] if n.endswith("_hnsw") else n


def of_table(preds: Iterable[Predicate], table: str) -> list[Predicate]:
    return [p for p in preds if table_name(p.table) == table_name(table)]


def conjunction(preds: Iterable[Predicate], prefix: str = "") -> Column:
    """All of them; none is true."""
    return reduce(operator.and_, (p.column(prefix) for p in preds), F.lit(True))


def apply(df: DataFrame, preds: Iterable[Predicate], prefix: str = "") -> DataFrame:
    """Filter by all predicates; a long `in` list becomes a semi-join with the list as a table."""
    for p in preds:
        if p.operator == "in" and len(p.value) > LITERALS:
            ids = df.sparkSession.createDataFrame([(v,) for v in p.value], f"`{prefix + p.attribute}` {df.schema[prefix + p.attribute].dataType.simpleString()}")
            df = df.join(ids, prefix + p.attribute, "left_semi")
        else:
            df = df.filter(p.column(prefix))
    return df


def selectivity(df: DataFrame, preds: Iterable[Predicate]) -> DataFrame:
    """(rows, passing, share): what a conjunction lets through."""
    c = conjunction(list(preds))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(c).alias("passing")).withColumn("share", F.try_divide("passing", "rows"))


def within_ids(df: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose key is in a table of ids (a filter, also without any index)."""
    return df.join(ids.select(F.col(id_col).alias(key)).distinct(), key, "left_semi")


def id_bitmap(ids: DataFrame, id_col: str) -> DataFrame:
    """(bucket, bitmap): ids as bitmaps by bucket, to be tested with bitmap functions or merged."""
    return ids.groupBy(F.bitmap_bucket_number(id_col).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(id_col)).alias("bitmap"))


def in_bitmap(df: DataFrame, key: str, bitmaps: DataFrame) -> DataFrame:
    """Rows whose key is set in the bitmaps."""
    x = df.withColumn("__b", F.bitmap_bucket_number(key)).withColumn("__p", F.bitmap_bit_position(key))
    j = x.join(bitmaps, x["__b"] == bitmaps["bucket"])
    bit = F.expr("(shiftright(cast(conv(hex(substring(bitmap, cast(__p div 8 as int) + 1, 1)), 16, 10) as int), cast(__p % 8 as int)) & 1) = 1")
    return j.filter(bit).drop("__b", "__p", "bucket", "bitmap")


def bloom(ids: DataFrame, id_col: str, bits: int = 1 << 20, hashes: int = 5) -> DataFrame:
    """(bucket, bitmap): a Bloom filter of a fixed number of bits, in bitmaps of 32768 bits each, built map-side."""
    at = ids.filter(F.col(id_col).isNotNull()).select(F.explode(_bloom_bits(F.col(id_col), bits, hashes)).alias("b"))
    return id_bitmap(at, "b")


def _bloom_bits(c: Column, bits: int, hashes: int) -> Column:
    one, two = F.xxhash64(c, F.lit(1)), F.xxhash64(c, F.lit(2)).bitwiseOR(F.lit(1))
    return F.array(*[F.pmod(F.shiftright(one, 8) + F.shiftright(two, 8) * F.lit(i), F.lit(bits)) for i in range(hashes)])


def maybe_in(df: DataFrame, key: str, filter_: DataFrame, bits: int = 1 << 20, hashes: int = 5) -> DataFrame:
    """Rows whose key may be in a `bloom` of the same size: all that are, and a few that are not. Null keys are not."""
    keys = df.select(F.col(key).alias("__k")).filter(F.col(key).isNotNull()).distinct().withColumn("__i", F.explode(_bloom_bits(F.col("__k"), bits, hashes)))
    hit = in_bitmap(keys, "__i", filter_).groupBy("__k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == hashes)
    return df.join(hit.select(F.col("__k").alias(key)), key, "left_semi")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first by `order` (ties by the whole row), chosen map-side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("__f")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"__f.{c}").alias(c) for c in (*order, *rest)]).select(*df.columns)
