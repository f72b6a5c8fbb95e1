"""Vector algebra as Column expressions, and as SQL functions by `register`.

Vectors are array<float>; half vectors are array<float> whose values are rounded through 16-bit
floats; sparse vectors are struct<dim:int, indices:array<int>, values:array<float>> with 0-based
ascending indices; bit strings are struct<nbits:int, words:array<bigint>>, bit 0 the highest of the
first word. Sums run in double. A null vector gives null, two lengths raise an error, a zero norm
gives a NaN cosine distance. For one query vector against many rows use `score`, which works on
Arrow batches with matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_DIMS, MOST_SPARSE_DIMS, MOST_NONZERO = 16000, 1_000_000_000, 16000


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) != F.size(b), F.raise_error(F.concat(F.lit("different vector dimensions "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))).otherwise(value)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _let(value: Column, f) -> Column:  # noqa: ANN001
    """f(value) with the value computed once: lambdas would compute it again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _pairs(a: Column, b: Column, f) -> Column:  # noqa: ANN001
    return _total(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))


def l2_squared(a: Column, b: Column) -> Column:
    return _same(a, b, _pairs(a, b, lambda x, y: (x - y) * (x - y)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def inner_product(a: Column, b: Column) -> Column:
    return _same(a, b, _pairs(a, b, lambda x, y: x * y))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def l1_distance(a: Column, b: Column) -> Column:
    return _same(a, b, _pairs(a, b, lambda x, y: F.abs(x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(F.lit(1.0) - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(inner_product(a, b), n))))


def spherical_distance(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product(a, b)))) / F.lit(float(np.pi))


def dims(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))


def l2_normalize(a: Column) -> Column:
    """A zero vector stays zero."""
    return _let(F.struct(a.alias("a"), norm(a).alias("n")), lambda s: F.when(s["n"] == 0, s["a"]).otherwise(F.transform(s["a"], lambda x: F.try_divide(x.cast("double"), s["n"]).cast("float"))))


def subvector(a: Column, start: int | Column, count: int | Column) -> Column:
    """`count` values from the 1-based `start`; what lies outside is left out, nothing left is an error."""
    s, n = (F.lit(x) if isinstance(x, int) else x for x in (start, count))
    lo, hi = F.greatest(s, F.lit(1)), F.least(s + n - 1, F.size(a))
    return F.when(a.isNull(), None).when(hi < lo, F.raise_error(F.lit("vector must have at least 1 dimension"))).otherwise(F.slice(a, lo, F.greatest(hi - lo + 1, F.lit(0))))


def _checked(a: Column, b: Column, f, underflow: bool = False) -> Column:  # noqa: ANN001
    def one(x: Column, y: Column) -> Column:
        v = f(x.cast("float"), y.cast("float")).cast("float")
        out = F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit("value out of range: overflow")).cast("float"))
        if underflow:
            out = out.when((v == 0) & (x != 0) & (y != 0), F.raise_error(F.lit("value out of range: underflow")).cast("float"))
        return out.otherwise(v)

    return _same(a, b, F.zip_with(a, b, one))


def add(a: Column, b: Column) -> Column:
    return _checked(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _checked(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return _checked(a, b, lambda x, y: x * y, underflow=True)


def concat(a: Column, b: Column) -> Column:
    return F.when(F.size(a) + F.size(b) > MOST_DIMS, F.raise_error(F.lit(f"vector cannot have more than {MOST_DIMS} dimensions"))).otherwise(F.concat(a, b))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: by values first, then by length."""
    return F.when(a.isNull() | b.isNull(), None).when(a < b, -1).when(a > b, 1).otherwise(0)


# bits


def binary_quantize(a: Column) -> Column:
    """One bit a value: 1 where it is positive."""
    return _let(a, _quantize)


def _quantize(a: Column) -> Column:
    n = F.size(a)
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda s, i: F.shiftleft(s, 1).bitwiseOR(F.when(F.get(a, w * 64 + i) > 0, 1).otherwise(0).cast("bigint")))
    words = F.transform(F.sequence(F.lit(0), F.ceil(n / 64).cast("int") - 1), word)
    return F.when(a.isNotNull(), F.struct(n.alias("nbits"), words.alias("words")))


def _bit_pairs(a: Column, b: Column, f) -> Column:  # noqa: ANN001
    bad = F.raise_error(F.lit("different bit lengths")).cast("bigint")
    return F.when(a.isNull() | b.isNull(), None).when(a["nbits"] != b["nbits"], bad).otherwise(F.aggregate(F.zip_with(a["words"], b["words"], f), F.lit(0).cast("bigint"), lambda s, x: s + x))


def hamming_distance(a: Column, b: Column) -> Column:
    return _bit_pairs(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint"))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 where no bit is shared, two empty strings included."""
    both, either = _bit_pairs(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("bigint")), _bit_pairs(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y)).cast("bigint"))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.try_divide(both.cast("double"), either))


def bits_from_text(s: Column) -> Column:
    """'0101' -> bit string."""
    padded = F.concat(s, F.repeat(F.lit("0"), F.pmod(-F.length(s), F.lit(64)).cast("int")))
    words = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(s) / 64).cast("int") - 1, F.lit(0))), lambda w: F.conv(F.substr(padded, w * 64 + 1, F.lit(64)), 2, -10).cast("bigint"))
    return F.when(s.rlike("^[01]*$"), F.struct(F.length(s).alias("nbits"), words.alias("words"))).when(s.isNotNull(), F.raise_error(F.lit("a bit string holds 0 and 1 only")))


# text and other carriers

_NUMBER = r"[+-]?(?:\d++(?:\.\d*+)?|\.\d++)(?:[eE][+-]?\d++)?"


def parse_vector(s: Column, dim: int | None = None) -> Column:
    """'[1, 2.5]' -> vector. Malformed texts, NaN, infinities, values beyond float, no or too many dimensions raise an error."""
    shape = s.rlike(rf"^\s*\[\s*(?:{_NUMBER}\s*(?:,\s*{_NUMBER}\s*)*)?\]\s*$")
    parts = F.split(F.regexp_replace(s, r"[\[\]\s]", ""), ",")
    v = F.transform(parts, lambda x: x.cast("double").cast("float"))
    empty = F.regexp_replace(s, r"\s", "") == "[]"
    out = F.when(s.isNull(), None).when(~shape, F.raise_error(F.lit("invalid input syntax for type vector"))).when(empty, F.raise_error(F.lit("vector must have at least 1 dimension")))
    out = out.when(F.size(parts) > MOST_DIMS, F.raise_error(F.lit(f"vector cannot have more than {MOST_DIMS} dimensions")))
    if dim is not None:
        out = out.when(F.size(parts) != dim, F.raise_error(F.lit(f"expected {dim} dimensions")))
    return out.when(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), F.raise_error(F.lit("value is out of range for type vector"))).otherwise(v)


def format_vector(a: Column) -> Column:
    """Vector -> '[1,2.5]': shortest decimals that read back alike."""
    one = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    return F.when(a.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(a, one), ","), F.lit("]")))


def to_vector(a: Column, dim: int | None = None) -> Column:
    """Any numeric array -> vector; null elements, NaN, infinities and wrong lengths raise an error."""
    v = F.transform(a, lambda x: x.cast("float"))
    out = F.when(a.isNull(), None).when(F.size(a) == 0, F.raise_error(F.lit("vector must have at least 1 dimension"))).when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.raise_error(F.lit("value not allowed in vector")))
    if dim is not None:
        out = out.when(F.size(a) != dim, F.raise_error(F.lit(f"expected {dim} dimensions")))
    return out.otherwise(v)


def to_half(a: Column) -> Column:
    """Round every value to the nearest 16-bit float; beyond 65504 is an error."""

    @F.arrow_udf("array<float>")
    def run(col: pa.Array) -> pa.Array:
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        v = col.values.to_numpy(zero_copy_only=False).astype(np.float32)
        with np.errstate(over="ignore"):
            h = v.astype(np.float16).astype(np.float32)
        if np.isinf(h).any() or np.isnan(h).any():
            raise ValueError("value is out of range for type halfvec")
        return pa.ListArray.from_arrays(col.offsets, pa.array(h), mask=col.is_null()) if col.null_count else pa.ListArray.from_arrays(col.offsets, pa.array(h))

    return run(a)


def to_sparse(a: Column) -> Column:
    return _let(a, _to_sparse)


def _to_sparse(a: Column) -> Column:
    idx = F.filter(F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.when(F.get(a, i) != 0, i)), lambda i: i.isNotNull())
    return F.when(a.isNotNull(), F.struct(F.size(a).alias("dim"), idx.alias("indices"), F.filter(a, lambda x: x != 0).alias("values")))


def to_dense(s: Column) -> Column:
    return _let(s, _to_dense)


def _to_dense(s: Column) -> Column:
    at = lambda i: F.array_position(s["indices"], i).cast("int")
    return F.when(s.isNotNull(), F.transform(F.sequence(F.lit(0), s["dim"] - 1), lambda i: F.coalesce(F.get(s["values"], at(i) - 1), F.lit(0.0)).cast("float")))


def format_sparse(s: Column) -> Column:
    """'{1:2.5,3:1}/4': indices from 1."""
    return _let(s, _format_sparse)


def _format_sparse(s: Column) -> Column:
    one = F.zip_with(s["indices"], s["values"], lambda i, x: F.concat((i + 1).cast("string"), F.lit(":"), F.regexp_replace(x.cast("string"), r"\.0$", "")))
    return F.when(s.isNotNull(), F.concat(F.lit("{"), F.array_join(one, ","), F.lit("}/"), s["dim"].cast("string")))


def parse_sparse(s: Column) -> Column:
    """'{1:2.5,3:1}/4' -> sparse vector; zeros are dropped, indices sorted; repeated or outlying indices raise an error."""
    return _let(s, _parse_sparse)


def _parse_sparse(s: Column) -> Column:
    shape = s.rlike(rf"^\s*\{{\s*(?:\d+\s*:\s*{_NUMBER}\s*(?:,\s*\d+\s*:\s*{_NUMBER}\s*)*)?\}}\s*/\s*\d+\s*$")
    flat = F.regexp_replace(s, r"\s", "")
    body, dim = F.regexp_extract(flat, r"\{(.*)\}", 1), F.regexp_extract(flat, r"/(\d+)$", 1).cast("int")
    pairs = F.array_sort(F.filter(F.transform(F.filter(F.split(body, ","), lambda x: x != ""), lambda x: F.struct((F.split_part(x, F.lit(":"), F.lit(1)).cast("int") - 1).alias("i"), F.split_part(x, F.lit(":"), F.lit(2)).cast("float").alias("v"))), lambda p: p["v"] != 0))
    i = F.transform(pairs, lambda p: p["i"])
    bad = (F.size(i) != F.size(F.array_distinct(i))) | F.exists(i, lambda x: (x < 0) | (x >= dim)) | (dim < 1) | (dim > MOST_SPARSE_DIMS) | (F.size(i) > MOST_NONZERO)
    return F.when(s.isNull(), None).when(~shape, F.raise_error(F.lit("invalid input syntax for type sparsevec"))).when(bad, F.raise_error(F.lit("sparsevec index out of bounds or repeated"))).otherwise(
        F.struct(dim.alias("dim"), i.alias("indices"), F.transform(pairs, lambda p: p["v"]).alias("values"))
    )


def sparse_inner_product(a: Column, b: Column) -> Column:
    """Over the shared indices only."""
    bad = F.raise_error(F.lit("different sparsevec dimensions")).cast("double")
    at = lambda s, i: F.get(s["values"], F.array_position(s["indices"], i).cast("int") - 1).cast("double")
    inner = lambda p: F.when(p["a"].isNull() | p["b"].isNull(), None).when(p["a"]["dim"] != p["b"]["dim"], bad).otherwise(_total(F.transform(F.array_intersect(p["a"]["indices"], p["b"]["indices"]), lambda i: at(p["a"], i) * at(p["b"], i))))
    return _let(F.struct(a.alias("a"), b.alias("b")), inner)


def sparse_l2_distance(a: Column, b: Column) -> Column:
    sq = lambda s: _total(F.transform(s["values"], lambda x: x.cast("double") * x.cast("double")))
    return F.sqrt(F.greatest(F.lit(0.0), sq(a) + sq(b) - 2 * sparse_inner_product(a, b)))


# one query vector against many rows

METRICS = ("l2", "l2sq", "ip", "cos", "l1")


def score(vec: Column, query: list[float], metric: str = "l2") -> Column:
    """Distance of every row's vector to one query vector, in Arrow batches; lower is nearer ("ip" is negated).

    Null vectors and vectors of another length give null.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    q = np.asarray(query, np.float64)

    @F.arrow_udf("double")
    def run(col: pa.Array) -> pa.Array:
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        out = np.full(len(col), np.nan)
        offs = col.offsets.to_numpy()
        ok = col.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offs) == len(q))
        idx = np.flatnonzero(ok)
        vals = col.values.to_numpy(zero_copy_only=False)
        for lo in range(0, len(idx), 4096):
            i = idx[lo : lo + 4096]
            m = vals[offs[i][:, None] + np.arange(len(q))].astype(np.float64)
            if metric in ("l2", "l2sq"):
                d = ((m - q) ** 2).sum(1)
                out[i] = np.sqrt(d) if metric == "l2" else d
            elif metric == "ip":
                out[i] = -(m @ q)
            elif metric == "l1":
                out[i] = np.abs(m - q).sum(1)
            else:
                n = np.sqrt((m * m).sum(1)) * np.sqrt((q * q).sum())
                with np.errstate(invalid="ignore", divide="ignore"):
                    out[i] = 1 - np.clip((m @ q) / n, -1, 1)
        return pa.array(out, mask=~ok)

    return run(vec)


# aggregates


#: Groups whose running sums a task holds; beyond that they are handed on.
HELD_GROUPS, SALTS = 2048, 16


def vec_aggregate(df: DataFrame, keys: list[str], vec: str, out: str, how: str = "avg", half: bool = False) -> DataFrame:
    """Element-wise average ("avg") or sum ("sum") of the vectors of each group, in double, as array<float>.

    Sums are taken from Arrow batches in each task, merged over salts, then over groups, so that no
    element becomes a row and no group is held by one task. Null vectors are skipped, a group without
    vectors gives null, vectors of several lengths in a group raise an error. With `half` the result
    is rounded to 16-bit floats; beyond 65504 is an error.
    """
    if how not in ("avg", "sum"):
        raise ValueError("how must be avg or sum")
    groups = df.select(*keys, F.col(vec).alias("__v")).withColumn("__k", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))
    kind = groups.schema["__k"].dataType.simpleString()
    part = groups.select("__k", "__v").mapInArrow(_partial_sums, f"__k {kind}, __s int, __n bigint, __t array<double>")
    part = part.groupBy("__k", "__s").applyInArrow(_merge_sums, f"__k {kind}, __n bigint, __t array<double>")
    done = part.groupBy("__k").applyInArrow(_merge_sums, f"__k {kind}, __n bigint, __t array<double>")
    value = F.transform("__t", lambda x: (F.try_divide(x, F.col("__n").cast("double")) if how == "avg" else x).cast("float"))
    value = F.when(F.col("__n") > 0, value)
    return done.select(*[F.col(f"__k.{k}").alias(k) for k in keys], (to_half(value) if half else value).alias(out))


def _partial_sums(batches):  # noqa: ANN001, ANN202
    held: dict[str, list] = {}

    def flush(salt: int) -> pa.RecordBatch:
        rows = list(held.values())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.concat_arrays([r[0] for r in rows]), pa.array([salt] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["__k", "__s", "__n", "__t"])

    salt = 0
    for b in batches:
        k = b.column(0)
        names = [str(x) for x in k.to_pylist()]
        order: dict[str, list[int]] = {}
        for i, n in enumerate(names):
            order.setdefault(n, []).append(i)
        vecs = b.column(1)
        lengths = vecs.value_lengths().to_pylist()
        for n, rows in order.items():
            at = held.setdefault(n, [k.slice(rows[0], 1), 0, None])
            live = [i for i in rows if lengths[i] is not None]
            if not live:
                continue
            dims = {lengths[i] for i in live} | ({len(at[2])} if at[2] is not None else set())
            if len(dims) > 1:
                raise ValueError("different vector dimensions in a group")
            m = vecs.take(pa.array(live)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(live), -1)
            at[1], at[2] = at[1] + len(live), m.sum(0) if at[2] is None else at[2] + m.sum(0)
        if len(held) > HELD_GROUPS:
            yield flush(salt % SALTS)
            salt += 1
    if held:
        yield flush(int.from_bytes(np.random.default_rng(len(held)).bytes(1), "little") % SALTS)


def _merge_sums(parts: pa.Table) -> pa.Table:
    sums = [np.asarray(t, np.float64) for t in parts["__t"].to_pylist() if t is not None]
    if len({len(t) for t in sums}) > 1:
        raise ValueError("different vector dimensions in a group")
    total = np.sum(sums, axis=0).tolist() if sums else None
    return pa.table({"__k": parts["__k"].combine_chunks().slice(0, 1), "__n": pa.array([sum(parts["__n"].to_pylist())], pa.int64()), "__t": pa.array([total], pa.list_(pa.float64()))})


_V, _S, _B, _D = "array<float>", "struct<dim:int,indices:array<int>,values:array<float>>", "struct<nbits:int,words:array<bigint>>", "double"
_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)"
_SAME = "if(size(a) = size(b), {body}, raise_error('different vector dimensions'))"
#: Name -> (arguments, result, body): every scalar function of the module that SQL can state.
_SQL = {
    "l2_squared_distance": ("a V, b V", "D", _SAME.format(body="aggregate(zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, x) -> s + x)")),
    "l2_distance": ("a V, b V", "D", "sqrt(l2_squared_distance(a, b))"),
    "inner_product": ("a V, b V", "D", _SAME.format(body=_DOT.format(a="a", b="b"))),
    "negative_inner_product": ("a V, b V", "D", "-inner_product(a, b)"),
    "l1_distance": ("a V, b V", "D", _SAME.format(body="aggregate(zip_with(a, b, (x, y) -> abs(double(x) - double(y))), 0D, (s, x) -> s + x)")),
    "vector_norm": ("a V", "D", f"sqrt({_DOT.format(a='a', b='a')})"),
    "vector_dims": ("a V", "int", "size(a)"),
    "cosine_distance": ("a V, b V", "D", "1D - greatest(-1D, least(1D, coalesce(try_divide(inner_product(a, b), vector_norm(a) * vector_norm(b)), double('NaN'))))"),
    "spherical_distance": ("a V, b V", "D", "acos(greatest(-1D, least(1D, inner_product(a, b)))) / pi()"),
    "l2_normalize": ("a V", "V", "if(vector_norm(a) = 0D, a, transform(a, x -> float(double(x) / vector_norm(a))))"),
    "subvector": ("a V, first int, n int", "V", "if(least(first + n - 1, size(a)) < greatest(first, 1), raise_error('vector must have at least 1 dimension'), slice(a, greatest(first, 1), greatest(least(first + n - 1, size(a)) - greatest(first, 1) + 1, 0)))"),
    "vector_add": ("a V, b V", "V", _SAME.format(body="zip_with(a, b, (x, y) -> x + y)")),
    "vector_sub": ("a V, b V", "V", _SAME.format(body="zip_with(a, b, (x, y) -> x - y)")),
    "vector_mul": ("a V, b V", "V", _SAME.format(body="zip_with(a, b, (x, y) -> x * y)")),
    "vector_concat": ("a V, b V", "V", "concat(a, b)"),
    "vector_cmp": ("a V, b V", "int", "case when a < b then -1 when a > b then 1 when a = b then 0 end"),
    "vector_lt": ("a V, b V", "boolean", "a < b"),
    "vector_le": ("a V, b V", "boolean", "a <= b"),
    "vector_eq": ("a V, b V", "boolean", "a = b"),
    "vector_ne": ("a V, b V", "boolean", "a <> b"),
    "vector_ge": ("a V, b V", "boolean", "a >= b"),
    "vector_gt": ("a V, b V", "boolean", "a > b"),
    "binary_quantize": ("a V", "B", "named_struct('nbits', size(a), 'words', transform(sequence(0, int(ceil(size(a) / 64)) - 1), w -> aggregate(sequence(0, 63), 0L, (s, i) -> shiftleft(s, 1) | bigint(coalesce(get(a, w * 64 + i) > 0, false)))))"),
    "hamming_distance": ("a B, b B", "bigint", "if(a.nbits = b.nbits, aggregate(zip_with(a.words, b.words, (x, y) -> bigint(bit_count(x ^ y))), 0L, (s, x) -> s + x), raise_error('different bit lengths'))"),
    "jaccard_distance": ("a B, b B", "D", "if(a.nbits = b.nbits, 1D - coalesce(try_divide(double(aggregate(zip_with(a.words, b.words, (x, y) -> bigint(bit_count(x & y))), 0L, (s, x) -> s + x)), double(aggregate(zip_with(a.words, b.words, (x, y) -> bigint(bit_count(x | y))), 0L, (s, x) -> s + x))), 0D), raise_error('different bit lengths'))"),
    "to_sparsevec": ("a V", "S", "named_struct('dim', size(a), 'indices', filter(transform(sequence(0, size(a) - 1), i -> if(get(a, i) <> 0, i, null)), i -> i is not null), 'values', filter(a, x -> x <> 0))"),
    "to_vector": ("s S", "V", "transform(sequence(0, s.dim - 1), i -> float(coalesce(try_element_at(s.values, int(nullif(array_position(s.indices, i), 0))), 0)))"),
    "sparsevec_inner_product": ("a S, b S", "D", "if(a.dim = b.dim, aggregate(array_intersect(a.indices, b.indices), 0D, (s, i) -> s + double(element_at(a.values, int(array_position(a.indices, i)))) * double(element_at(b.values, int(array_position(b.indices, i))))), raise_error('different sparsevec dimensions'))"),
    "sparsevec_l2_distance": ("a S, b S", "D", "sqrt(greatest(0D, aggregate(a.values, 0D, (s, x) -> s + double(x) * double(x)) + aggregate(b.values, 0D, (s, x) -> s + double(x) * double(x)) - 2 * sparsevec_inner_product(a, b)))"),
    "vector_out": ("a V", "string", "concat('[', array_join(transform(a, x -> regexp_replace(string(x), '[.]0$', '')), ','), ']')"),
    "vector_in": ("t string", "V", "transform(split(regexp_replace(t, '[\\\\[\\\\]\\\\s]', ''), ','), x -> float(x))"),
}


def register(spark: SparkSession) -> None:
    """Install the scalar functions of _SQL for this session, and the aggregates vector_sum and vector_avg.

    Project a result to a column before ORDER BY. The aggregates see a group at a time (Arrow, no map-side
    sums): for large groups use `vec_aggregate`.
    """
    for name, (arguments, result, body) in _SQL.items():
        names = {"V": _V, "S": _S, "B": _B, "D": _D}
        args = ", ".join(f"{n} {names.get(t, t)}" for n, t in (a.split() for a in arguments.split(", ")))
        spark.sql(f"create or replace temporary function {name}({args}) returns {names.get(result, result)} return {body}")

    from pyspark.sql.functions import pandas_udf

    def aggregate(how: str):  # noqa: ANN202
        def run(v):  # noqa: ANN001, ANN202
            rows = [np.asarray(x, np.float64) for x in v if x is not None]
            if not rows:
                return None
            if len({len(x) for x in rows}) > 1:
                raise ValueError("different vector dimensions in a group")
            total = np.sum(rows, axis=0)
            return (total / len(rows) if how == "avg" else total).astype(np.float32).tolist()

        import pandas as pd

        run.__annotations__ = {"v": pd.Series, "return": list}
        return run

    from pyspark.sql.pandas.functions import PandasUDFType

    for how in ("sum", "avg"):
        spark.udf.register(f"vector_{how}", pandas_udf(aggregate(how), _V, PandasUDFType.GROUPED_AGG))
