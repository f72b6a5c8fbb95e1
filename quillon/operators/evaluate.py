"""Quality of results against a ground truth; each measure is a one-row DataFrame unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boundary_recall(found: DataFrame, truth: DataFrame, query: str = "query_id", slack: float = 1e-6) -> DataFrame:
    """Share of found scores no worse than the worst true score of their query, over the number of true rows."""
    edge = truth.groupBy(query).agg(F.max("score").alias("edge"), F.count(F.lit(1)).alias("n"))
    hits = found.join(edge, query).filter(F.col("score") <= F.col("edge") + slack).groupBy(query).agg(F.count(F.lit(1)).alias("hit"))
    per = edge.join(hits, query, "left").select("n", F.least("n", F.coalesce("hit", F.lit(0))).alias("hit"))
    return per.agg((F.sum("hit") / F.sum("n")).alias("recall"))


def set_scores(found: DataFrame, truth: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """(precision, recall, f1) of distinct keys. Both empty is 1; recall counts at most `limit` true rows."""
    f, t = found.select(*keys).distinct(), truth.select(*keys).distinct()
    tp = f.join(t, keys, "left_semi").agg(F.count(F.lit(1)).alias("tp"))
    n = tp.join(f.agg(F.count(F.lit(1)).alias("f"))).join(t.agg(F.count(F.lit(1)).alias("t")))  # three one-row frames
    want = F.col("t") if limit is None else F.least(F.col("t"), F.lit(limit))
    empty = (F.col("f") == 0) & (F.col("t") == 0)
    p = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide("tp", "f"), F.lit(0.0)))
    r = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(F.col("tp"), want), F.lit(0.0)))
    return n.select(p.alias("precision"), r.alias("recall")).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def canonical_pair(a: str, b: str) -> Column:
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def canonical_tuple(cols: list[str]) -> Column:
    return F.array_sort(F.array(*[F.col(c) for c in cols]))


def relative_error(found: float | None, truth: float) -> float:
    """|found - truth| / |truth|; a missing value is 1, a zero truth gives the absolute error."""
    if found is None:
        return 1.0
    return abs(found - truth) / abs(truth) if truth else abs(found)


def closeness(found: float | None, truth: float) -> float:
    return 1 / (1 + relative_error(found, truth))


def mean_label_error(found: DataFrame, truth: DataFrame, label: str, value: str) -> DataFrame:
    """Mean relative error over the labels of either side; a missing label is 0."""
    f, t = found.select(label, F.col(value).alias("f")), truth.select(label, F.col(value).alias("t"))
    x = f.join(t, label, "full").fillna(0, ["f", "t"])
    return x.agg(F.avg(F.when(F.col("t") == 0, F.when(F.col("f") == 0, 0.0).otherwise(1.0)).otherwise(F.abs(F.col("f") - F.col("t")) / F.abs("t"))).alias("error"))


def mape(found: DataFrame, truth: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(mape): mean of |found - truth| / |truth| over the true rows; a missing row counts as 1, a true 0 by the absolute error."""
    f, t = found.select(*keys, F.col(value).cast("double").alias("f")), truth.select(*keys, F.col(value).cast("double").alias("t"))
    error = F.when(F.col("f").isNull(), 1.0).when(F.col("t") == 0, F.abs("f")).otherwise(F.abs(F.col("f") - F.col("t")) / F.abs("t"))
    return t.join(f, keys, "left").agg(F.avg(error).alias("mape"))


def value_scores(found: DataFrame, truth: DataFrame, value: str) -> DataFrame:
    """(precision, recall, f1) of the distinct values of a column, texts without outer space and regardless of case; nulls do not count."""
    plain = lambda d: d.select(F.lower(F.trim(F.col(value).cast("string"))).alias("value")).filter("value is not null")
    return set_scores(plain(found), plain(truth), ["value"])


def _average_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """Ranks from counts of distinct values; ties share their mean rank."""
    from .ranks import count_better

    v = df.groupBy(F.col(col).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    r = count_better(df, [], F.col(col), "__b", higher_is_better=False)
    return df.join(v.join(r, "__v").select("__v", (F.col("__b") + (F.col("__c") + 1) / 2).alias(out)), F.col(col).cast("double") == F.col("__v")).drop("__v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(spearman): correlation of average ranks."""
    return _average_ranks(_average_ranks(df.select(x, y), x, "rx"), y, "ry").agg(F.corr("rx", "ry").alias("spearman"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """(kendall): tau-b over all pairs of distinct value pairs; meant for ranked result lists."""
    v = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    a, b = v.toDF("ax", "ay", "an"), v.toDF("bx", "by", "bn")
    w = F.col("an") * F.col("bn")
    sign = F.signum(F.col("ax") - F.col("bx")) * F.signum(F.col("ay") - F.col("by"))
    j = a.join(b, (F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))
    s = j.agg(F.sum(sign * w).alias("s"), F.sum(F.when(F.col("ax") != F.col("bx"), w)).alias("nx"), F.sum(F.when(F.col("ay") != F.col("by"), w)).alias("ny"))
    return s.select(F.try_divide(F.col("s"), F.sqrt(F.col("nx").cast("double") * F.col("ny"))).alias("kendall"))


def macro_f1(df: DataFrame, found: str, truth: str) -> DataFrame:
    """(macro_f1): mean F1 over the labels of either column."""
    c = df.groupBy(F.col(found).alias("f"), F.col(truth).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    parts = c.select(F.explode(F.array(F.struct(F.col("f").alias("label"), F.col("n").alias("pf"), F.lit(0).cast("bigint").alias("pt")), F.struct(F.col("t").alias("label"), F.lit(0).cast("bigint").alias("pf"), F.col("n").alias("pt")))).alias("s"), F.when(F.col("f") == F.col("t"), F.col("n")).otherwise(0).alias("tp"))
    g = parts.groupBy("s.label").agg(F.sum("s.pf").alias("pf"), F.sum("s.pt").alias("pt"), (F.sum("tp") / 2).alias("tp"))
    return g.agg(F.avg(2 * F.col("tp") / (F.col("pf") + F.col("pt"))).alias("macro_f1"))


def _choose2(c: Column) -> Column:
    return c * (c - 1) / 2


def adjusted_rand(df: DataFrame, found: str, truth: str) -> DataFrame:
    """(ari) from the contingency table."""
    c = df.groupBy(found, truth).agg(F.count(F.lit(1)).alias("n"))
    a = c.groupBy(found).agg(F.sum("n").alias("n")).agg(F.sum(_choose2(F.col("n"))).alias("a"), F.sum("n").alias("n"))
    b = c.groupBy(truth).agg(F.sum("n").alias("n")).agg(F.sum(_choose2(F.col("n"))).alias("b"))
    x = c.agg(F.sum(_choose2(F.col("n"))).alias("i")).join(a).join(b)  # one-row frames
    want = F.try_divide(F.col("a") * F.col("b"), _choose2(F.col("n")))
    most = (F.col("a") + F.col("b")) / 2
    return x.select(F.coalesce(F.try_divide(F.col("i") - want, most - want), F.lit(1.0)).alias("ari"))


def omega_index(found: DataFrame, truth: DataFrame, item: str, cluster: str) -> DataFrame:
    """(omega): agreement of two overlapping clusterings on how often each pair of items shares a cluster; for evaluation sets."""

    def together(d: DataFrame, out: str) -> DataFrame:
        a, b = d.select(F.col(item).alias("a"), cluster), d.select(F.col(item).alias("b"), cluster)
        return a.join(b, cluster).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias(out))

    n = found.select(item).union(truth.select(item)).distinct().agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("pairs"))
    j = together(found, "f").join(together(truth, "t"), ["a", "b"], "full").fillna(0)
    levels = j.groupBy("f", "t").agg(F.count(F.lit(1)).alias("c"))
    seen = levels.agg(F.sum("c").alias("seen"))
    grid = levels.join(seen).join(n)
    zero = F.col("pairs") - F.col("seen")
    same = grid.agg(F.sum(F.when(F.col("f") == F.col("t"), F.col("c")).otherwise(0)).alias("s"), F.max(zero).alias("z"), F.max("pairs").alias("p"))
    fl, tl = levels.groupBy(F.col("f").alias("k")).agg(F.sum("c").alias("cf")), levels.groupBy(F.col("t").alias("k")).agg(F.sum("c").alias("ct"))
    exp = fl.join(tl, "k", "full").fillna(0).join(seen).join(n).agg(F.sum(F.when(F.col("k") == 0, (F.col("cf") + zero) * (F.col("ct") + zero)).otherwise(F.col("cf") * F.col("ct"))).alias("e"), F.max(F.when(F.col("k") == 0, 1).otherwise(0)).alias("has0"), F.max(zero).alias("zz"))
    e = (F.col("e") + F.when(F.col("has0") == 0, F.col("zz") * F.col("zz")).otherwise(0)) / (F.col("p") * F.col("p"))
    o = (F.col("s") + F.col("z")) / F.col("p")
    return same.join(exp).select(F.coalesce(F.try_divide(o - e, 1 - e), F.lit(1.0)).alias("omega"))


def matched_rows(found: DataFrame, truth: DataFrame, cols: list[str]) -> DataFrame:
    """Found rows that equal a true row on the given columns, nulls being equal."""
    f, t = found.alias("f"), truth.select(*cols).distinct().alias("t")
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"f.{c}").eqNullSafe(F.col(f"t.{c}"))
    return f.join(t, cond, "left_semi")


METRICS = {"boundary_recall": boundary_recall, "set": set_scores, "label_error": mean_label_error, "mape": mape, "values": value_scores, "spearman": spearman, "kendall": kendall, "macro_f1": macro_f1, "ari": adjusted_rand, "omega": omega_index}


def metric(name: str):  # noqa: ANN201
    if name not in METRICS:
        raise ValueError(f"unknown metric {name}")
    return METRICS[name]


