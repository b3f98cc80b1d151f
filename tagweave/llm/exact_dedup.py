"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of `block` bytes. Distinct blocks are sorted and numbered; then
adjacent pairs of names are sorted and numbered in turn, until every document has a single name. Two
texts have the same (level, name) if and only if they are equal: names are ranks of distinct keys,
never hashes.

Blocks are sorted by (hash, content). Where a hash has one content only, which is counted, the rank
of the hash is the rank of the block and rows find their name by the hash; blocks whose hashes have
several contents are told apart by the contents themselves. So contents are shuffled once, after the
copies within each task have been merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.llm.common import LOWER, documents, ship, utf8, written

BLOCK = 4096


def block_hash(block: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(block), "big", signed=True)


def _cut(text: str | None, block: int) -> tuple[bytes, list[bytes]]:
    data = utf8(text).translate(LOWER)
    return data, [data[i : i + block] for i in range(0, max(1, len(data)), block)]


def _identify(block: int, hasher: Callable[[bytes], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, hashes = [], []
            for text in batch.column("text").to_pylist():
                data, blocks = _cut(text, block)
                shas.append(hashlib.sha256(data).hexdigest())
                hashes.append([hasher(b) for b in blocks])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(shas, pa.string()), pa.array(hashes, pa.list_(pa.int64()))],
                ["doc_id", "row", "text_sha256", "hashes"],
            )

    return run


#: Bytes of blocks that a task remembers, so that one that many of its batches hold is sent once.
REMEMBERED = 32 << 20


def _contents(block: int, hasher: Callable[[bytes], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        held = 0
        for batch in batches:
            blocks = {b for text in batch.column("text").to_pylist() for b in _cut(text, block)[1]} - sent
            keys = [hasher(b) for b in blocks]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(list(blocks), pa.binary())], ["h", "content"])
            if held > REMEMBERED:
                sent, held = set(), 0
            sent |= blocks
            held += sum(map(len, blocks))

    return run


def _ranked(keys: DataFrame, *by: str) -> DataFrame:
    """Distinct keys with `name`, their rank: sorted in ranges, each range counting on from those before."""
    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    local = keys.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    local = written(local.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)), "names")
    sizes = local.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("part", F.coalesce("before", F.lit(0)).alias("before"))
    return local.join(F.broadcast(before), "part").withColumn("name", F.col("before") + F.col("at")).drop("part", "before", "at")


def identities(
    docs: DataFrame, block: int = BLOCK, hasher: Callable[[bytes], int] = block_hash, row: str = "row"
) -> tuple[DataFrame, DataFrame]:
    """(rows, names): doc_id, row, text_sha256 of every row of docs, and row, level, name: its identity."""
    spark = ship(docs.sparkSession)
    src = documents(docs, F.monotonically_increasing_id().alias("row"))
    base = written(src.mapInArrow(_identify(block, hasher), "doc_id long, row long, text_sha256 string, hashes array<long>"), "rows")
    # each batch has merged its copies; one exchange by the hash serves the distinct and the ranks
    distinct = documents(docs).mapInArrow(_contents(block, hasher), "h long, content binary").repartition("h").distinct()
    each = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("content"))).withColumn(
        "of", F.count("*").over(Window.partitionBy("h"))
    )
    # contents go on only where a hash has several of them
    keys = each.select("h", "rank", "of", F.when(F.col("of") > 1, F.col("content")).alias("content"))
    named = written(_ranked(keys, "h", "rank"), "blocks")
    rows = base.select("row", F.size("hashes").alias("left"), F.posexplode("hashes").alias("i", "h"))
    part = rows.join(named.where("of = 1").select("h", "name"), "h").select("row", "left", "i", "name")
    clashes = named.where("of > 1").select("h", "content", "name")
    if not clashes.isEmpty():
        hit = rows.join(clashes.select("h").distinct(), "h", "left_semi").select("row").distinct()
        again = base.join(hit, "row", "left_semi").select("row", "text_sha256")
        wanted = again.select("text_sha256").distinct()
        found = documents(docs).mapInArrow(_explode(block, hasher), _BLOCKS).join(wanted, "text_sha256", "left_semi").distinct()
        named_blocks = found.join(clashes, ["h", "content"]).select("text_sha256", "left", "i", "name")
        part = part.union(again.join(named_blocks, "text_sha256").select("row", "left", "i", "name"))
    done, level = [], 0
    while True:
        part = written(part, f"level{level}")
        done.append(part.where("left = 1").select("row", F.lit(level).alias("level"), "name"))
        part = part.where("left > 1")
        if part.isEmpty():
            break
        level += 1
        slot = lambda k: F.max(F.when(F.col("i") % 2 == k, F.col("name")))
        pairs = part.groupBy("row", (F.col("i") / 2).cast("int").alias("i")).agg(
            F.first("left").alias("left"), F.coalesce(slot(0), F.lit(-1)).alias("a"), F.coalesce(slot(1), F.lit(-1)).alias("b")
        )
        pairs = written(pairs, f"pairs{level}")
        names = _ranked(pairs.select("a", "b").distinct(), "a", "b")
        part = pairs.join(names, ["a", "b"]).select("row", F.ceil(F.col("left") / 2).cast("int").alias("left"), "i", "name")
    names = done[0]
    for d in done[1:]:
        names = names.union(d)
    return base.drop("hashes"), names


_BLOCKS = "text_sha256 string, left int, i int, h long, content binary"


def _explode(block: int, hasher: Callable[[bytes], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                data, blocks = _cut(text, block)
                sha = hashlib.sha256(data).hexdigest()
                out += [(sha, len(blocks), i, hasher(b), b) for i, b in enumerate(blocks)]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["text_sha256", "left", "i", "h", "content"])

    return run


def exact_groups(docs: DataFrame, block: int = BLOCK, hasher: Callable[[bytes], int] = block_hash) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the
    largest doc_id of a group stays; a null doc_id counts as the smallest. Of several rows with that
    doc_id one stays, the last as Spark reads them. Columns but doc_id and text are not read.
    """
    rows, names = identities(docs, block, hasher)
    full = written(rows.join(names, "row"), "named")
    best = full.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size"))
    # only groups of several rows have anything to look up
    many = written(best.where("group_size > 1"), "groups")
    out = full.join(many, ["level", "name"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
