"""A cleaning pipeline over `documents`, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import finished, fresh, shared_dir
from tagweave.llm.decontaminate import remove_contaminated
from tagweave.llm.jaccard_join import near_duplicates
from tagweave.llm.line_dedup import dedup_lines
from tagweave.llm.packing import pack
from tagweave.llm.toxicity import score, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; null and empty texts have the score of no evidence."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh(docs, "toxicity")
    return score(docs, model, name).where(F.col(name) < 0.5).drop(name).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the smallest doc_id only; n_chars follows the text, and all documents stay.

    Columns that are called like the operator's own keep their values.
    """
    renamed = docs
    own = {c: fresh(docs, f"{c}_") for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    for c, held in own.items():
        renamed = renamed.withColumnRenamed(c, held)
    out = dedup_lines(renamed).drop("n_lines", "n_dropped")
    for c, held in own.items():
        out = out.withColumnRenamed(held, c)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in docs.schema.fields])


def _without_repeats(docs: DataFrame, compared: DataFrame) -> DataFrame:
    """docs without the doc_ids that are near duplicates of a smaller one in `compared`."""
    found = finished(lambda: near_duplicates(compared).where("doc_id <> class_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return docs.join(found.hint("shuffle_hash"), docs["doc_id"] == found["gone"], "left_anti").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays; rows without doc_id stay.

    Taking lines out makes copies unlike each other, so documents are compared as they are now, and what is
    left is compared once more as it came.
    """
    left = _without_repeats(docs, docs)
    came = spark.read.parquet(f"{sf_dir}/documents.parquet").join(left.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    return _without_repeats(left, came)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go; null and empty texts hold none, repeated rows go alike."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences; every row is a document, and null and empty texts are the end id."""
    # earlier stages leave executors more workers than cores, which take turns and hold what those stages left
    return pack(docs, keep=50_000, piece_bytes=1 << 20, forget=True)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("jaccard_join", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The first and the last stage are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of what all stages leave of `documents`; each stage's rows are a table in the shared folder.

    Null and empty texts pass every stage and are packed as the end id. Rows that share a doc_id go or stay
    together as near duplicates, so repeated rows stay repeated; rows without doc_id are no one's duplicates.
    Without labels no document is toxic, without benchmark none is contaminated, and
    an empty table gives no pieces; labels that conflict are `toxicity.train`'s to settle. Columns that are
    called like an operator's own keep their values.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
