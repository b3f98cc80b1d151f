"""Packing of token pieces by first-fit decreasing in randomised groups.

A document of n tokens is cut into full pieces of the sequence length and one rest. Documents are dealt at
random, a document whole, to groups of about `group_pieces`; in each group pieces are placed, longest first, into the first
bin that still has room, which a tournament tree over the bins' capacities finds in log(bins) steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import PIECE_BYTES, documents, pieces, ship, written
from tagweave.llm.tokens import KEEP, encoder, public_path

LENGTH = 2048
END_ID = 1
GROUP_PIECES = 4096
TOKENIZER = "byte_bpe_50k.json"

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, all at most `capacity`: a maximum tree over the capacities left."""
    n = len(sizes)
    leaves = 1
    while leaves < max(1, n):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins = np.empty(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, at = int(sizes[i]), 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[i] = at - leaves
        tree[at] -= size
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
    return bins


def _cut(path: str, length: int, end_id: int, with_ids: bool, keep: int, piece_bytes: int, forget: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number = encoder(path, keep), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in pieces(batch, "text", piece_bytes):
                ids, ends = enc.encode(part.column("text"), end)
                begins = np.r_[0, ends[:-1]]
                tokens = ends - begins
                many = -(-tokens // length)
                which = np.repeat(np.arange(len(many)), many)
                start = (np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)) * length
                sizes = np.minimum(tokens[which] - start, length)
                at = begins[which] + start
                sums = [zlib.crc32(ids[b : b + n]) for b, n in zip(at.tolist(), sizes.tolist(), strict=True)]
                cols = [part.column("doc_id").take(pa.array(which)), *map(pa.array, (start, sizes)), pa.array(sums, pa.int64()), pa.array(tokens[which])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids.view("<i4"))))
                    names.append("ids")
                cols.append(pa.array(which + number))
                number += len(many)
                yield pa.RecordBatch.from_arrays(cols, [*names, "document"])
        if forget:
            enc.forget()

    return run


def _place(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["document", "start"], ignore_index=True)
        sizes = pdf["length"].to_numpy(np.int64)
        bins = first_fit_decreasing(sizes, length)
        order = np.lexsort((np.arange(len(bins)), -sizes, bins))
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        offset = np.empty(len(bins), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        pdf["sequence_id"] = (pdf["in_group"].to_numpy(np.int64) << 32) + bins
        pdf["offset"] = offset
        return pdf.drop(columns=["document", "in_group"])

    return run


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    length: int = LENGTH,
    end_id: int = END_ID,
    group_pieces: int = GROUP_PIECES,
    seed: int = 0,
    with_ids: bool = False,
    keep: int = KEEP,
    piece_bytes: int = PIECE_BYTES,
    forget: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset.

    Every row of docs is a document of its own, also one whose doc_id is null or occurs again; null and
    empty texts are the end id alone. Pieces of a sequence follow each other without gaps; sequences
    are meant to be padded to `length`. Ties in length go by the order of the pieces. sequence_id begins
    with the number of the partition in which a group was packed, so other partitions give other ids, and
    other groups; pieces and their contents are the same. Only doc_id and
    text are read. A worker takes about `piece_bytes` of text at once, and keeps at most 2 * `keep` encoded
    pre-tokens and those of two such pieces; with `forget` it drops them at the end of each task, so that workers
    which wait for one hold none. Neither changes a row. Documents are dealt by hash of their
    number in the scan, so equal rows scatter and a document's pieces share a group.
    """
    ship(docs.sparkSession)
    path = tokenizer or public_path(TOKENIZER)
    schema = PIECE + (", ids array<int>" if with_ids else "")
    cut = written(documents(docs).mapInArrow(_cut(path, length, end_id, with_ids, keep, piece_bytes, forget), schema + ", document long"), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("in_group", F.pmod(F.xxhash64("document", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("in_group").applyInPandas(_place(length), schema + ", sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
