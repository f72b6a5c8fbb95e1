"""Encoding a corpus with a public byte-level BPE vocabulary, in Spark expressions.

Texts are cut into words by the vocabulary's pattern. A word that is a piece of the vocabulary is
its id; of all other words the distinct ones are encoded by a fold: a higher-order function keeps
the word's byte pieces and the ranks of their neighbours, and merges the best-ranked neighbours
until none can be merged. The ranks are a literal in the plan: a hashed list of small maps, built
once by constant folding, so a lookup costs one hash and a scan of a dozen keys. The encoded words
are joined back to their places.

Bytes are written as hexadecimal text inside the fold. A word of more than `LONG_WORD` bytes would
make the fold quadratic; such words are merged with a heap in Python, with the same result.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

#: Fixed value: the public pattern that cuts text into words before merging, with Unicode classes.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lists of the literal rank map; bytes from which a word is merged with a heap.
LISTS, LONG_WORD = 8192, 400
#: Salts of a word that many texts hold.
SALTS = 8
#: Characters of a plan description.
PLAN_STRING = 50_000
_NONE = 2**31 - 1


@dataclass(frozen=True)
class Vocabulary:
    """A rank file: base64 of the bytes of a piece, a space, its rank, which is its id."""

    path: str
    pattern: str = PATTERN

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        with open(self.path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}

    @cached_property
    def _lists(self) -> str:
        lists: list[dict[str, int]] = [{} for _ in range(LISTS)]
        for piece, rank in self.ranks.items():
            h = piece.hex().upper()
            lists[zlib.crc32(h.encode()) % LISTS][h] = rank
        return json.dumps(lists, separators=(",", ":"))

    def with_ranks(self, f: Callable[[Callable[[Column], Column]], Column]) -> Column:
        """f(rank): an expression that looks up ranks, with the literal map in it once.

        rank(piece) is the id of a piece given as upper-case hexadecimal text, or null.
        """
        literal = F.from_json(F.lit(self._lists), "array<map<string,int>>")
        return _let(literal, lambda lists: f(lambda piece: F.try_element_at(F.get(lists, F.pmod(F.crc32(piece.cast("binary")), F.lit(LISTS)).cast("int")), piece)))

    @cached_property
    def _pieces(self) -> str:
        out = [""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            out[rank] = piece.hex().upper()
        return json.dumps(out, separators=(",", ":"))

    def piece(self, i: Column) -> Column:
        """The piece of an id as hexadecimal text; null for an id that does not exist."""
        return F.get(F.from_json(F.lit(self._pieces), "array<string>"), i)


def words(text: Column, vocabulary: Vocabulary) -> Column:
    """The words of a text in order; none for null and empty texts."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(vocabulary.pattern), F.lit(0)), F.array().cast("array<string>"))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _fold(hexed: Column, rank: Callable[[Column], Column]) -> Column:
    """Ids of a word of at least two bytes, given as hexadecimal text."""
    score = lambda p: F.coalesce(rank(p), F.lit(_NONE))
    n = (F.length(hexed) / 2).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(hexed, i * 2 + 1, F.lit(2)))
    start = _let(parts, lambda p: F.struct(p.alias("parts"), F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: score(F.concat(a, b))).alias("ranks")))

    def merge(acc: Column, i: Column) -> Column:
        """Join parts i and i + 1 (from 1); only the ranks beside the new part change."""
        parts, ranks = acc["parts"], acc["ranks"]
        size = F.size(parts)
        new = F.concat(F.get(parts, i - 1), F.get(parts, i))
        left = F.when(i > 1, F.array(score(F.concat(F.get(parts, i - 2), new)))).otherwise(F.array().cast("array<int>"))
        right = F.when(i + 1 < size, F.array(score(F.concat(new, F.get(parts, i + 1))))).otherwise(F.array().cast("array<int>"))
        rest = F.greatest(size - i - 1, F.lit(0))
        return F.struct(
            F.concat(F.slice(parts, 1, i - 1), F.array(new), F.slice(parts, i + 2, rest)).alias("parts"),
            F.concat(F.slice(ranks, 1, F.greatest(i - 2, F.lit(0))), left, right, F.slice(ranks, i + 2, F.greatest(rest - 1, F.lit(0)))).alias("ranks"),
        )

    def step(acc: Column, _: Column) -> Column:
        best = F.coalesce(F.array_min(acc["ranks"]), F.lit(_NONE))
        return _let(best, lambda m: F.when(m == _NONE, acc).otherwise(_let(F.array_position(acc["ranks"], m).cast("int"), lambda i: merge(acc, i))))

    end = F.aggregate(F.sequence(F.lit(1), n - 1), start, step)
    return F.transform(end["parts"], rank)


def merge_with_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word, in n log n steps: the reference for the fold, and the way for long words."""
    n = len(word)
    if word in ranks:
        return [ranks[word]]
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    live = [True] * n
    while heap:
        _, i, m, e = heapq.heappop(heap)
        if not (live[i] and end[i] == m and m < n and live[m] and end[m] == e):
            continue
        live[m], end[i], after[i] = False, e, after[m]
        if after[m] < n:
            before[after[m]] = i
            x = end[after[m]]
            if (r := ranks.get(word[i:x])) is not None:
                heapq.heappush(heap, (r, i, e, x))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : e])) is not None:
            heapq.heappush(heap, (r, before[i], i, e))
    return [ranks[word[i : end[i]]] for i in range(n) if live[i]]


def _long(ranks: dict[bytes, int]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([merge_with_heap(bytes.fromhex(w), ranks) for w in b.column(0).to_pylist()], pa.list_(pa.int32()))], ["word", "ids"])

    return run


def encode_words(distinct: DataFrame, v: Vocabulary) -> DataFrame:
    """(word, ids) of distinct words given as hexadecimal text in `word`."""
    short = distinct.filter(F.length("word") <= 2 * LONG_WORD).select("word", v.with_ranks(lambda rank: F.when(F.length("word") > 2, _fold(F.col("word"), rank)).otherwise(F.array(rank(F.col("word"))))).alias("ids"))
    return short.unionByName(distinct.filter(F.length("word") > 2 * LONG_WORD).select("word").mapInArrow(_long(v.ranks), "word string, ids array<int>"))


@contextmanager
def _short_plans(spark: SparkSession) -> Iterator[None]:
    """Plan descriptions are shortened while jobs run that carry the rank map: each would repeat it in the driver's memory."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    if before.startswith("21474836"):  # the default, no limit
        spark.conf.set(name, f"{PLAN_STRING}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _cut_words(df: DataFrame, key: str, text: str, v: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """(key, __h, __k, __r) of every row: the ids of its words that are pieces (null for others) and the
    others with their places; and (word, ids) of all distinct others. The rank map is in neither plan.

    Texts are read and cut into words once; both tables are in the checkpoint folder.
    """
    with _short_plans(df.sparkSession):
        src = df.select(F.col(key), F.xxhash64(text).alias("__h"), F.transform(words(F.col(text), v), lambda w: F.hex(F.encode(w, "utf-8"))).alias("__w"))
        src = src.select(key, "__h", "__w", v.with_ranks(lambda rank: F.transform("__w", rank)).alias("__k"))
        rare = F.filter(F.transform("__w", lambda w, i: F.when(F.isnull(F.get(F.col("__k"), i)), F.struct(i.alias("i"), w.alias("word")))), lambda x: x.isNotNull())
        src = cut(src.select(key, "__h", "__k", rare.alias("__r")))
        distinct = src.select(F.explode(F.transform("__r", lambda x: x["word"])).alias("word")).distinct()  # counted map-side, so that a frequent word costs a row a task
        return src, cut(encode_words(distinct, v))


def _rare(src: DataFrame, done: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, __h, i, value): what `value` makes of the ids of each word that is no piece. Words are met with
    their salted ids, so that no task gets all places of a frequent one."""
    places = src.select(key, "__h", F.explode("__r").alias("p")).select(key, "__h", "p.i", "p.word").distinct().withColumn("salt", F.pmod(F.col("__h"), F.lit(SALTS)))
    met = done.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return places.join(met, ["word", "salt"]).select(key, "__h", "i", value.alias("value"))


def encode(df: DataFrame, key: str, text: str, v: Vocabulary) -> DataFrame:
    """(key, ids): every text as its list of token ids, without special tokens.

    An empty and a null text both give an empty list. Rows keep their number and their key, null or
    repeated keys included; texts may be of any length and are read whole. An empty table gives an
    empty result; other columns are not read.
    """
    src, done = _cut_words(df, key, text, v)
    back = _rare(src, done, key, F.col("ids")).groupBy(key, "__h").agg(F.collect_list(F.struct("i", F.col("value").alias("ids"))).alias("__rare"))
    known = F.filter(F.transform("x.__k", lambda r, i: F.when(r.isNotNull(), F.struct(i.alias("i"), F.array(r).alias("ids")))), lambda s: s.isNotNull())
    every = F.array_sort(F.concat(known, F.coalesce("y.__rare", F.array().cast("array<struct<i:int,ids:array<int>>>"))))
    return _with(src, back, key).select(F.col(f"x.{key}").alias(key), F.flatten(F.transform(every, lambda s: s["ids"])).alias("ids"))


def _with(src: DataFrame, back: DataFrame, key: str) -> DataFrame:
    return src.alias("x").join(back.alias("y"), F.col(f"x.{key}").eqNullSafe(F.col(f"y.{key}")) & (F.col("x.__h") == F.col("y.__h")), "left")


def decode(ids: Column, v: Vocabulary) -> Column:
    """The text of a list of ids: their binary pieces in a row, read as UTF-8. Null for null and for unknown ids."""
    hexed = F.transform(ids, lambda i: v.piece(i))
    return F.when(ids.isNotNull() & ~F.exists(hexed, lambda p: p.isNull()), F.unhex(F.array_join(hexed, "")).cast("string"))


def token_counts(df: DataFrame, key: str, text: str, v: Vocabulary) -> DataFrame:
    """(key, tokens): the number of tokens of every text; see `encode`. No list of ids is formed."""
    src, done = _cut_words(df, key, text, v)
    more = _rare(src, done.select("word", F.size("ids").alias("n")), key, F.col("n")).groupBy(key, "__h").agg(F.sum("value").alias("more"))
    known = F.size(F.filter("x.__k", lambda r: r.isNotNull()))
    return _with(src, more, key).select(F.col(f"x.{key}").alias(key), (known + F.coalesce("y.more", F.lit(0))).cast("int").alias("tokens"))
