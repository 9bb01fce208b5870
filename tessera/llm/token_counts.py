"""Token counts: the exact histogram of encoded lengths answers every context limit.

Documents are aggregated by encoded length. With suffix sums over the lengths, a limit's truncated total is
the tokens of the documents up to it and the limit times the documents above it, and a quantile is the first
length that enough documents reach. The sums run over blocks of BLOCK lengths, and then over the blocks.
The histogram is a table before its sums: it has a row for each length at most, and no text is encoded twice.

Defined results: a null or empty text has length 0. Repeated rows count each. An empty table gives an empty
histogram, totals of 0 and null quantiles. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import materialize

#: Lengths that are summed in one task.
BLOCK = 128


def histogram(docs: DataFrame, tokenizer: str, *, text_col: str = "text") -> DataFrame:
    """n_tokens and n_docs, one row for each length that occurs."""
    counted = bpe.lengths(docs.select(F.col(text_col).alias("text")), tokenizer)
    return materialize(counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "histogram")


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """For each length: n_docs and its tokens, docs_at_least and tokens_at_least (suffix sums), the whole
    table's total_docs and total_tokens, truncated_total (tokens left by the limit n_tokens) and
    quantile (share of documents that are no longer)."""
    h = lengths.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("_block", F.floor(F.col("n_tokens") / BLOCK))
    sums = h.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("tokens").alias("_t"))
    #: One row for each block of lengths: as many as the longest document has tokens, divided by BLOCK.
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = sums.select(
        "_block",
        *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_above") for c in ("_d", "_t")],
        F.sum("_d").over(every).alias("total_docs"),
        F.sum("_t").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    s = h.withColumn("_di", F.sum("n_docs").over(inside)).withColumn("_ti", F.sum("tokens").over(inside)).join(above, "_block")
    at_least, tokens_at_least = F.col("_di") + F.col("_d_above"), F.col("_ti") + F.col("_t_above")
    return s.select(
        "n_tokens", "n_docs", "tokens", at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"), "total_docs", "total_tokens",
        (F.col("total_tokens") - tokens_at_least + F.col("n_tokens") * at_least).alias("truncated_total"),
        ((F.col("total_docs") - at_least + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
    )


def limits(sums: DataFrame, context: list[int]) -> DataFrame:
    """For each context limit: limit, docs_over, truncated_total and tokens_lost."""
    picks = []
    for k, n in enumerate(context):
        over, held = F.col("n_tokens") > n, F.lit(n) * F.col("n_docs")
        parts = {"docs_over": F.when(over, F.col("n_docs")), "truncated_total": F.when(over, held).otherwise(F.col("tokens")), "tokens_lost": F.when(over, F.col("tokens") - held)}
        picks += [F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(f"{name}{k}") for name, x in parts.items()]
    if not picks:
        return sums.sparkSession.createDataFrame([], "limit long, docs_over long, truncated_total long, tokens_lost long")
    rows = [F.struct(F.lit(n).cast("long").alias("limit"), *[F.col(f"{c}{k}").alias(c) for c in ("docs_over", "truncated_total", "tokens_lost")]) for k, n in enumerate(context)]
    return sums.agg(*picks).select(F.inline(F.array(*rows)))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the first length that this share of the documents doesn't exceed."""
    picks = [F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias(f"q{k}") for k, q in enumerate(shares)]
    row = sums.agg(*picks)
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{k}").alias("n_tokens")) for k, q in enumerate(shares)])).alias("x")).select("x.*")
