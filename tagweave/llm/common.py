"""What the operators of this subpackage share: the shared folder, written tables, text helpers."""

from __future__ import annotations

import ctypes
import gc
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "spark.tagweave.shipped"

#: bytes -> bytes tables: A-Z to a-z; and also every ASCII byte that is neither letter nor digit to a space.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else (c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


#: What operators keep in a Python worker from task to task, by operator.
CACHES: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    return CACHES.setdefault(name, {})


_LATEST: list[str] = []


def only(name: str) -> None:
    """Empty all other operators' caches: a worker that goes on to another stage doesn't keep the last one's memory."""
    if _LATEST == [name]:
        return
    _LATEST[:] = [name]
    for other, cache in CACHES.items():
        if other != name:
            cache.clear()
    release()


def release() -> None:
    """Give the memory that this worker no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:  # the allocator keeps freed pages otherwise
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors, once a session."""
    if spark.conf.get(_SHIPPED, "") != spark.sparkContext.applicationId:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(os.path.join(root, "tagweave")):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, root))
        path = os.path.join(tempfile.mkdtemp(prefix="tagweave-"), "tagweave_src.zip")
        with open(path, "wb") as f:
            f.write(buffer.getvalue())
        spark.sparkContext.addPyFile(path)
        spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which the cluster shares; where that is unset, a local one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tagweave-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tagweave/{uuid.uuid4().hex}"


#: Tables that written() made in this session and that nothing has dropped yet.
_WRITTEN: list[str] = []


#: Rows that a part of a written table stands for, where the number of its rows is known about.
PART_ROWS = 1 << 14


def written(df: DataFrame, name: str = "t", rows: int | None = None, **options: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and outlives any executor.

    Where `rows`, about the number of df's rows, is given, small tables have few parts, also in a session that
    leaves them in all its shuffle partitions: each part costs files, and a local file system starts a process
    for each of them. It is for what a shuffle or join returns; work on Python's side keeps its tasks.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // PART_ROWS)))
    path = f"{shared_dir(spark)}/{name}"
    df.write.options(**options).parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(work: Callable[[], DataFrame], name: str = "result") -> DataFrame:
    """What work() returns as a table; the tables that it wrote on its way are dropped."""
    mark = len(_WRITTEN)
    out = written(work(), name)
    spark = out.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    for path in _WRITTEN[mark:-1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(conf).delete(folder, True)
    _WRITTEN[mark:] = _WRITTEN[-1:]
    return out


def fresh(df: DataFrame, name: str) -> str:
    """name, or the first of name_, name__, ... that df has no column of."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id as long and text as string, whatever else df has; rows keep their order in a partition."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


#: Bytes of text that are worked on at once.
PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch with about `most` bytes of the string column each; one row at least."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n) + 1
    if begin < batch.num_rows:
        yield batch.slice(begin)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups from batches sorted by a long column, and the groups' bounds in them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if last is not None and keys[0] != last:
            new = np.r_[0, new]
        if len(new):  # all before the last change is complete
            at = int(new[-1])
            table = pa.Table.from_batches([*held, batch.slice(0, at)] if at or not held else held, batch.schema)
            if table.num_rows:
                yield _bounded(table, key)
            held = [batch.slice(at)]
        else:
            held.append(batch)
        last = keys[-1]
    if held:
        yield _bounded(pa.Table.from_batches(held), key)


def _bounded(table: pa.Table, key: str) -> tuple[pa.Table, np.ndarray]:
    table = table.combine_chunks()
    keys = table.column(key).to_numpy()
    return table, np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


def array_of(table: pa.Table, name: str) -> pa.Array:
    col = table.column(name)
    return col.chunk(0) if col.num_chunks == 1 else pa.concat_arrays(col.chunks)


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node reachable from it.

    Large stars and small stars in turn: every node hangs its larger neighbours, then all others, on the
    smallest neighbour, until the edges form stars. Each round is a table in the shared folder.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = written(pairs, "edges")
    before, rows = None, 2 * pairs.count()  # both directions
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "large", rows)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large_star", rows)
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "small", rows)
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        pairs = written(small.distinct(), "small_star", rows)
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before, rows = state, 2 * state[0]
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
