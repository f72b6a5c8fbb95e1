"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Each source's budget is its share of the wanted size in tokens. Complete passes over the source
come first, as many as fit and as the cap allows; what is left is filled by a weighted sample
without replacement: every document draws a key -ln(u) / weight (u from a hash of seed, plan and
document, so runs repeat), documents are taken in the order of their keys, and a running total of
tokens tells where the budget is reached. The total comes from sums per bucket of keys, so a source
of any size is cut without one task sorting it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running_total
from ..session import cut


def quality(text: Column) -> Column:
    """A weight between 0.05 and 1: the share of letters and spaces in a text."""
    n = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L} ]", ""))
    return F.when(n > 0, F.greatest(F.lit(0.05), letters / n)).otherwise(0.05)


def source_name(col: Column) -> Column:
    """Sources are compared without outer space and regardless of case."""
    return F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))


def budgets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_id, source, target_share, max_repeats, target_tokens, source_tokens, documents, epochs, rest) for each plan and source.

    `docs` (doc_id, source, tokens) are sums over all documents. `epochs` complete passes fit the budget
    and the cap, `rest` tokens remain to be sampled (0 once the cap is reached). Sources without
    documents get 0. Of repeated rows of a plan and source the greatest share counts.
    """
    per = docs.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.sum(F.when(F.col("tokens") > 0, 1).otherwise(0)).alias("documents"))
    total = per.agg(F.sum("source_tokens")).head()[0] or 0
    t = targets.select("plan_id", source_name(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"), F.col("size_ratio").cast("double"))
    t = t.filter(F.col("plan_id").isNotNull() & F.col("source").isNotNull() & (F.col("target_share") > 0) & ~F.isnan("target_share") & (F.col("size_ratio") > 0))
    t = t.groupBy("plan_id", "source").agg(F.max_by(F.struct("target_share", "max_repeats", "size_ratio"), "target_share").alias("t")).select("plan_id", "source", "t.*")
    b = t.join(per, "source", "left").fillna(0, ["source_tokens", "documents"])
    b = b.withColumn("target_tokens", F.col("target_share") * F.col("size_ratio") * F.lit(float(total)))
    b = b.withColumn("epochs", F.when(F.col("source_tokens") > 0, F.least(F.floor(F.col("target_tokens") / F.col("source_tokens")), F.col("max_repeats"))).otherwise(0).cast("int"))
    rest = F.col("target_tokens") - F.col("epochs") * F.col("source_tokens")
    return b.withColumn("rest", F.when((F.col("epochs") < F.col("max_repeats")) & (F.col("source_tokens") > 0), rest).otherwise(0.0)).drop("size_ratio")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """(plan_id, source, doc_id, tokens, copies): how often each document is used in each plan.

    `docs` (doc_id, source, tokens, weight). Documents without tokens, with a null source or a null
    id are not used (their tokens still count towards the size of the whole). A document whose
    middle lies within the remaining budget is taken, so a source ends within half a document of its
    target, unless its cap comes first. Null or non-positive weights count as the least weight.
    Repeated ids are documents of their own with equal keys. Empty tables give an empty result.
    """
    named = docs.select("doc_id", source_name(F.col("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens"), F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(1e-6)).alias("weight"))
    b = cut(budgets(named, targets))  # a row a plan and source
    usable = named.filter((F.col("tokens") > 0) & F.col("source").isNotNull() & F.col("doc_id").isNotNull())
    x = usable.join(b.filter("epochs > 0 or rest > 0").select("plan_id", "source", "epochs", "rest"), "source")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "plan_id", F.lit(seed)), 11) + F.lit(1)) / F.lit(float(2**53 + 1))
    x = x.withColumn("key", -F.log(u) / F.col("weight"))
    full = x.filter("epochs > 0").select("plan_id", "source", "doc_id", "tokens", F.col("epochs").alias("copies"))
    drawn = x.filter("rest > 0")
    ties = drawn.groupBy("plan_id", "source", "key").agg(F.sum("tokens").alias("tokens"))
    before = running_total(ties, ["plan_id", "source"], "key", "tokens", "before")
    taken = drawn.join(before.select("plan_id", "source", "key", "before"), ["plan_id", "source", "key"]).filter(F.col("before") + F.col("tokens") / 2 <= F.col("rest"))
    part = taken.select("plan_id", "source", "doc_id", "tokens", F.lit(1).alias("copies"))
    return full.unionByName(part).groupBy("plan_id", "source", "doc_id", "tokens").agg(F.sum("copies").cast("int").alias("copies"))


def report(docs: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """For each plan and source: the target and reached tokens and shares, passes, and what the cap left open.

    `reached_share` is of the tokens the whole plan reached; `share_of_wanted` of those it wanted.
    """
    named = docs.select("doc_id", source_name(F.col("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens"))
    b = budgets(named, targets)
    used = mix(docs, targets, seed).groupBy("plan_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"), F.max("copies").alias("most_copies"), F.count(F.lit(1)).alias("used_documents"))
    x = b.join(used, ["plan_id", "source"], "left").fillna(0, ["reached_tokens", "most_copies", "used_documents"])
    whole = x.groupBy("plan_id").agg(F.sum("reached_tokens").alias("all_reached"), F.sum("target_tokens").alias("all_wanted"))
    x = x.join(whole, "plan_id")
    return x.select(
        "plan_id", "source", "target_share", F.try_divide("reached_tokens", "all_reached").alias("reached_share"), (F.col("reached_tokens") / F.col("all_wanted")).alias("share_of_wanted"),
        F.round("target_tokens", 3).alias("target_tokens"), "reached_tokens", "source_tokens", "documents", "used_documents", "max_repeats", "most_copies",
        F.greatest(F.lit(0.0), F.round(F.col("target_tokens") - F.col("reached_tokens"), 3)).alias("open_tokens"),
    )


def weighted_documents(df: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, weight) of a documents table and its token counts (doc_id, tokens)."""
    return df.select("doc_id", "source", quality(F.col("text")).alias("weight")).join(counts, "doc_id")
