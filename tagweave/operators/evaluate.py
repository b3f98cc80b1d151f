"""Masked losses, perplexity and comparisons, over a table of token scores.

scores: (example_id, split, side, pos, loss, attention, tags), a row a token; loss is that of the
token given those before it, so the first token of an example has none to count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.sources import rank_in_groups

KEYS = ("split", "side", "example_id")
LARGEST = 3.4028234663852886e38


def finite(loss: str = "loss") -> F.Column:
    """Not-a-number is 0, infinities the largest single-precision number with their sign."""
    c = F.nanvl(F.col(loss), F.lit(0.0))
    return F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c))


def first_region(scores: DataFrame) -> DataFrame:
    """scores with `first_region`: up to the second token that isn't tags, from the first."""
    seen = F.sum(1 - F.col("tags")).over(Window.partitionBy(*KEYS).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return scores.withColumn("first_region", seen == 1)


def masked_mean_loss(scores: DataFrame, drop_first: bool = True) -> DataFrame:
    """(split, side, example_id, loss, tokens): mean over attended tokens that aren't tags.

    drop_first leaves out the first such token and the tags up to the next (evaluation); without it
    (training) only the first token of the example is out. An example without tokens has a null loss.
    """
    first = F.min("pos").over(Window.partitionBy(*KEYS))
    rows = first_region(scores).withColumn("_first", first)
    use = (F.col("attention") == 1) & (F.col("tags") == 0) & (F.col("pos") > F.col("_first"))
    use = use & ~F.col("first_region") if drop_first else use
    total = F.sum(F.when(use, finite()))
    n = F.count_if(use)
    return rows.groupBy(*KEYS).agg((total / F.when(n > 0, n)).alias("loss"), n.alias("tokens"))


def perplexity(losses: DataFrame, most: int | None = None) -> DataFrame:
    """(split, side, perplexity, examples): exp of the mean of losses weighted by tokens; the first `most` examples."""
    rows = losses.where("loss is not null and not isnan(loss)")
    if most is not None:
        rows = rank_in_groups(rows, ("split", "side"), "example_id").where(F.col("_rn") < most)
    ratio = F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens")
    return rows.groupBy("split", "side").agg(F.exp(ratio).alias("perplexity"), F.count("*").alias("examples"))


def mean_perplexity(losses: DataFrame) -> DataFrame:
    """exp of the plain mean loss, by split and side."""
    return losses.where("loss is not null and not isnan(loss)").groupBy("split", "side").agg(F.exp(F.avg("loss")).alias("perplexity"))


def preference(pairs: DataFrame, correct: str, incorrect: str) -> DataFrame:
    """One row: the share of pairs whose correct side is the less perplexing, and their number."""
    won = F.avg((F.col(correct) < F.col(incorrect)).cast("int"))
    return pairs.agg(won.alias("accuracy"), F.count("*").alias("pairs"))


def mask_runs(scores: DataFrame, mask: str = "tags") -> DataFrame:
    """(split, side, example_id, run, mask, first, last, tokens): runs of neighbours with equal mask."""
    w = Window.partitionBy(*KEYS).orderBy("pos")
    new = F.coalesce((F.col(mask) != F.lag(mask).over(w)).cast("int"), F.lit(1))
    runs = scores.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*KEYS, "run").agg(F.first(mask).alias("mask"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("tokens"))


def error_counts(df: DataFrame) -> DataFrame:
    """One row: the sum of every *_error column."""
    return df.agg(*(F.sum(c).alias(c) for c in df.columns if c.endswith("_error")))


def any_nodes(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Per group, whether any row has nodes in any of the columns."""
    some = F.lit(False)
    for c in columns:
        some = some | F.coalesce(F.size(c) > 0, F.lit(False))
    return df.groupBy(by).agg(F.bool_or(some).alias("has_tags"), F.count("*").alias("rows"))


def longest_row(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    return df.agg(F.max(F.size(ids)).alias("longest"))
