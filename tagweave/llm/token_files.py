"""Token ids in Parquet files that can be read selectively.

Files hold documents in ascending doc_id order, a row each: doc_id, n_tokens, the file's number, the
place of the first id in the file, and the ids as a list column. Ids are dictionary-encoded (their
vocabulary is small and fixed); the other columns, which mostly rise, are delta-encoded. Row groups and
pages are small and pages carry an index, so a reader of a few documents, or of tags only, skips
the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.llm.common import documents, pieces, shared_dir, ship
from tagweave.llm.tokens import encoder, public_path

END_ID = 1
NO_DOC = -(1 << 63)
TOKENIZER = "word_bpe_49k.json"
SCHEMA = "doc_id long, n_tokens long, part int, first long, ids array<int>"
META = ("doc_id", "n_tokens", "part", "first")
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",  # delta encoding where there's no dictionary
    "parquet.enable.dictionary": "true",
    **{f"parquet.enable.dictionary#{c}": "false" for c in META},
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "500",
}


def _encode(path: str, end_id: int, bounds: np.ndarray):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, ends = enc.encode(piece.column("text"), end)
                begins = np.r_[0, ends[:-1]]
                tie = np.array([zlib.crc32(ids[b:e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)], np.int64)
                doc = piece.column("doc_id").fill_null(NO_DOC).to_numpy(zero_copy_only=False)
                # an id that fills several ranges is dealt to them by its rows' ids
                low, high = np.searchsorted(bounds, doc, "left"), np.searchsorted(bounds, doc, "right")
                part = low + tie % (high - low + 1)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(part.astype(np.int32)), pa.array(tie), lists], ["doc_id", "part", "tie", "ids"])

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = 0
    for batch in batches:
        counts = np.diff(batch.column("ids").offsets.to_numpy()).astype(np.int64)
        ends = np.cumsum(counts)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), batch.column("part"), pa.array(first + ends - counts), batch.column("ids")], [*META, "ids"])
        first += int(ends[-1]) if len(ends) else 0


def range_bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """parts - 1 doc_ids that cut docs into ranges of like sizes, from a sample of at most some 100 ids a range."""
    total = docs.count()
    ids = docs.select(F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc_id"))
    share = min(1.0, 100 * parts / max(1, total))
    drawn = np.sort(np.array([r["doc_id"] for r in (ids if share == 1 else ids.sample(share, seed=1)).collect()], np.int64))
    return drawn[(np.arange(1, parts) * len(drawn)) // parts] if len(drawn) else np.empty(0, np.int64)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Encode docs and write them to path in ascending doc_id order; null doc_ids come first.

    Null and empty texts are the end id alone. Rows of one doc_id follow each other, in no order of theirs.
    Only doc_id and text are read. Texts are encoded where they are read, and only ids travel: each row goes
    straight to the part of its range of doc_ids (as many as shuffle partitions).
    """
    spark = ship(docs.sparkSession)
    src = documents(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    encode = _encode(tokenizer or public_path(TOKENIZER), end_id, range_bounds(src, parts))
    encoded = src.mapInArrow(encode, "doc_id long, part int, tie long, ids array<int>")
    ranged = encoded.repartitionById(parts, "part").sortWithinPartitions(F.asc("doc_id"), F.asc("tie")).select("doc_id", "part", "ids")
    ranged.mapInArrow(_number, SCHEMA).write.options(**LAYOUT).parquet(path)
    return path


def read_tokens(
    spark: SparkSession, path: str, columns: tuple[str, ...] = (*META, "ids"), lowest: int | None = None, highest: int | None = None
) -> DataFrame:
    """The files' rows, or only some columns or doc_ids; both reach the scan. `start` counts all ids before a document."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if lowest is not None:
        rows = rows.where(F.col("doc_id") >= lowest)
    if highest is not None:
        rows = rows.where(F.col("doc_id") <= highest)
    return rows.select(*columns)


def with_starts(rows: DataFrame, path: str) -> DataFrame:
    """rows with `start`: one number a file, added up over the files, plus the place in the file."""
    totals = read_tokens(rows.sparkSession, path, ("part", "n_tokens")).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("first"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = np.ascontiguousarray(lists.values.to_numpy(), "<i4")
        ends = lists.offsets.to_numpy()
        sums = [zlib.crc32(values[b:e]) for b, e in zip(ends[:-1], ends[1:], strict=True)]
        cols = [batch.column(c) for c in META]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], [*META, "n_ids", "ids_crc32"])


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/tokens")
    read = read_tokens(spark, path).mapInArrow(_digest, "doc_id long, n_tokens long, part int, first long, n_ids long, ids_crc32 long")
    return with_starts(read, path).select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")
