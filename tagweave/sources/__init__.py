"""Reading and writing corpora."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave import schemas
from tagweave.functions.exprs import no_nodes


def with_annotations(df: DataFrame) -> DataFrame:
    """df with every annotation column, missing or null ones empty."""
    out = {}
    for name, node in schemas.ANNOTATIONS.items():
        out[name] = F.coalesce(F.col(name), no_nodes(node)) if name in df.columns else no_nodes(node)
    return df.withColumns(out)


def read_annotated(spark: SparkSession, *paths: str, prefix: str = "tags_") -> DataFrame:
    """JSON lines, plain or gzipped, under the explicit annotated schema; prefix: what the files' annotations begin with."""
    df = spark.read.schema(schemas.V2.replace("tags_", prefix)).json(list(paths))
    return with_annotations(df.withColumnsRenamed({prefix + c.removeprefix("tags_"): c for c in schemas.ANNOTATIONS}))


def read_v1(spark: SparkSession, *paths: str, ext: str = "jsonl", tags: bool = True) -> DataFrame:
    """Training files: json or jsonl, and txt (a text a line) only without tags."""
    if ext in ("json", "jsonl"):
        return spark.read.schema(schemas.V1 if tags else "id string, text string").json(list(paths))
    if ext == "txt" and not tags:
        return spark.read.text(list(paths)).withColumnRenamed("value", "text")
    raise ValueError(f"files with extension {ext!r} can't be read " + ("with tags" if tags else "here"))


def read_named(spark: SparkSession, name: str, config: str | None = None, revision: str | None = None) -> DataFrame:
    """A table by catalogue name, or a directory <name>[/<config>][/<revision>] of Parquet files."""
    if "/" not in name and spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.read.parquet("/".join(x for x in (name.rstrip("/"), config, revision) if x))


def read_columnar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_lines(spark: SparkSession, *paths: str, schema: str) -> DataFrame:
    """One JSON record a line; lines that aren't keep their text in _corrupt_record."""
    return parse_lines(spark.read.text(list(paths)), "value", schema).drop("value")


def parse_lines(df: DataFrame, column: str, schema: str) -> DataFrame:
    parsed = F.from_json(F.col(column), schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return df.withColumn("_parsed", parsed).select("*", "_parsed.*").drop("_parsed")


def file_name() -> F.Column:
    """The name of the file that a row was read from, without its folders."""
    return F.substring_index(F.input_file_name(), "/", -1)


def select_files(
    files: DataFrame,
    name: str = "name",
    pattern: str | None = None,
    prefix: str | None = None,
    serial_range: tuple[str, int, int] | None = None,
    task: tuple[int, int] | None = None,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """Rows of a table of file names: by regex, by prefix and extension, by serial number, by task slice.

    serial_range (pattern with one group, low, high) keeps serials in [low, high); task (t, n) keeps the
    sorted names [t*n, t*n + n); exclude holds names to leave out.
    """
    if prefix is not None:
        files = files.where(F.col(name).startswith(prefix) & F.col(name).rlike(r"\.jsonl(\.gz)?$"))
    if pattern is not None:
        files = files.where(F.col(name).rlike(pattern))
    if serial_range is not None:
        serial = F.regexp_extract(name, serial_range[0], 1).try_cast("int")
        files = files.where((serial >= serial_range[1]) & (serial < serial_range[2]))
    if exclude is not None:
        files = files.join(exclude.select(F.col(name).alias("_x")).distinct(), F.col(name) == F.col("_x"), "left_anti")
    if task is not None:
        t, n = task
        files = files.withColumn("_rn", F.row_number().over(Window.orderBy(name)) - 1)  # file names: a short list
        files = files.where((F.col("_rn") >= t * n) & (F.col("_rn") < t * n + n)).drop("_rn")
    return files


def union_sparse(*dfs: DataFrame) -> DataFrame:
    """Union by name; columns that a side lacks are empty lists if they are lists, else null."""
    both = dfs[0]
    for d in dfs[1:]:
        both = both.unionByName(d, allowMissingColumns=True)
    lists = {f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in both.schema if f.dataType.typeName() == "array"}
    return both.withColumns(lists)


def read_site_tables(spark: SparkSession, redirects: str, paragraphs: str) -> tuple[DataFrame, DataFrame]:
    """(alias, title) and (title, seq, text) tables, as Parquet."""
    return spark.read.parquet(redirects), spark.read.parquet(paragraphs)


def shard(df: DataFrame, n: int, order_by: str, mode: str = "round_robin") -> DataFrame:
    """df with `shard` 0..n-1: every n-th row in turn, or n contiguous runs, in the order of a unique column."""
    rn = row_index(df, order_by)
    if mode == "round_robin":
        return rn.withColumn("shard", F.pmod("_rn", F.lit(n)).cast("int")).drop("_rn")
    if mode != "contiguous":
        raise ValueError(mode)
    total = rn.count()
    big, size = total % n, total // n
    edge = big * (size + 1)
    at = F.when(F.col("_rn") < edge, F.floor(F.col("_rn") / (size + 1))).otherwise(big + F.floor((F.col("_rn") - edge) / max(1, size)))
    return rn.withColumn("shard", at.cast("int")).drop("_rn")


def row_index(df: DataFrame, *order_by: str, name: str = "_rn") -> DataFrame:
    """df with the rank of each row from 0: sorted in ranges, each counting on from the ones before.

    The sorted rows are written to the shared folder, so that both readers see the same numbers. Only one
    number a range meets in a single task.
    """
    sort = [F.col(c) for c in order_by]
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    ranged = settled(ranged.withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("_part", before.alias("_base"))
    return ranged.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_base")


def rank_in_groups(df: DataFrame, groups: tuple[str, ...], order_by: str, name: str = "_rn") -> DataFrame:
    """df with each row's rank from 0 in its group, in the order of a column that is unique there.

    Rows are ranked in ranges of (group, order), and a group's ranges, of which each is one number, are summed
    after that, so a group of any size is ranked by many tasks.
    """
    ranged = settled(df.repartitionByRange(*groups, order_by).withColumn("_range", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(order_by)) - 1
    sizes = ranged.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*(F.col(g).alias(f"_of_{g}") for g in groups), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    same = F.col("_range") == F.col("_r")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    ranked = ranged.withColumn("_own", own).join(bases, same)
    return ranked.select(*df.columns, (F.col("_base") + F.col("_own")).alias(name))


def concat_shards(spark: SparkSession, path: str, expect: int | None = None) -> DataFrame:
    """The table written with partitionBy("shard"), after a check of the number of shards."""
    df = spark.read.parquet(path)
    if expect is not None and (found := df.select("shard").distinct().count()) != expect:
        raise ValueError(f"{path} holds {found} shards, not {expect}")
    return df


def write_columnar(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet; mode "ignore" skips what is there, "overwrite" replaces it. Files appear when the job commits."""
    df.write.mode(mode).parquet(path)


def write_jsonl_gz(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "gzip").json(path)


#: Manifests of a published table are named by version; the last line tells that one is whole.
MANIFESTS = "_manifests"
COMPLETE = "complete"


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop
    at = hadoop.fs.Path(path)
    return hadoop, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Data files below path; names that begin with _ or . are none."""
    _, at, files = _files(spark, path)
    base, found, walk = str(files.makeQualified(at).toString()).rstrip("/"), [], files.listFiles(at, True)
    while walk.hasNext():
        name = str(walk.next().getPath().toString())
        if not any(part[:1] in "_." for part in name[len(base) + 1 :].split("/")):
            found.append(name[len(base) + 1 :])
    return sorted(found)


def versions(spark: SparkSession, path: str, folder: str = MANIFESTS) -> dict[int, list[str]]:
    """The files of each published version of a table, relative to path; what has no whole manifest isn't published."""
    hadoop, at, files = _files(spark, f"{path.rstrip('/')}/{folder}")
    out: dict[int, list[str]] = {}
    if files.exists(at):
        for status in files.listStatus(at):
            name = str(status.getPath().getName())
            if name.isdigit():
                stream = files.open(status.getPath())
                try:
                    lines = str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).split("\n")
                finally:
                    stream.close()
                if lines[-1] == f"{COMPLETE} {len(lines) - 1}":
                    out[int(name)] = lines[:-1]
    return out


def _add_version(write: Callable[[DataFrame, str], None], df: DataFrame, path: str, folder: str, version: int) -> None:
    spark = df.sparkSession
    beside = f"part-{uuid.uuid4().hex}"
    write(df, f"{path}/{beside}")
    names = [f"{beside}/{name}" for name in _listed(spark, f"{path}/{beside}")]
    hadoop, at, files = _files(spark, f"{path}/{folder}/{version}")
    broken = files.exists(at) and version not in versions(spark, path, folder)  # its writer was lost
    stream = files.create(at, broken)
    try:
        stream.write(bytearray("\n".join([*names, f"{COMPLETE} {len(names)}"]).encode()))
    finally:
        stream.close()


def publish(write: Callable[[DataFrame, str], None], df: DataFrame, path: str, replace: bool = False) -> bool:
    """Write df to files of its own below path, then a manifest that names them; False where a version is there and stays.

    Nothing is renamed or overwritten: files that no manifest names are never read, so a writer that fails
    leaves nothing behind for readers, and one that replaces a version leaves the old one whole meanwhile. Of
    two writers of one version the first to make its manifest wins, and the other is told so by an error.
    """
    path = path.rstrip("/")
    there = versions(df.sparkSession, path)
    if there and not replace:
        return False
    _add_version(write, df, path, MANIFESTS, max(there, default=0) + 1)
    return True


def _read(spark: SparkSession, path: str, names: list[str], schema: str | None, kind: str) -> DataFrame:
    reader = spark.read.format(kind)
    if schema is not None:
        if not names:
            return spark.createDataFrame([], schema)
        reader = reader.schema(schema)
    return reader.load([f"{path.rstrip('/')}/{name}" for name in names])


def read_published(spark: SparkSession, path: str, schema: str | None = None, kind: str = "parquet", version: int | None = None) -> DataFrame:
    """A version of a published table, the last by default, by the files that its manifest names."""
    there = versions(spark, path)
    if not there or (version is not None and version not in there):
        raise FileNotFoundError(f"{path} has no version {'at all' if version is None else version}")
    return _read(spark, path, there[max(there) if version is None else version], schema, kind)


#: The log of a stream's batches that are published.
BATCHES = "_batches"


def publish_batch(df: DataFrame, path: str, batch: int) -> bool:
    """Add a stream's batch to a table of Parquet files; False where the log has the batch already."""
    path = path.rstrip("/")
    if batch in versions(df.sparkSession, path, BATCHES):
        return False
    _add_version(write_columnar, df, path, BATCHES, batch)
    return True


def read_batches(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All batches that the log of a table has."""
    names = [name for _, own in sorted(versions(spark, path, BATCHES).items()) for name in own]
    if not names and schema is None:
        raise FileNotFoundError(f"{path} has no batches")
    return _read(spark, path, names, schema, "parquet")


def write_shards(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy("shard").parquet(path)


def write_schema(df: DataFrame, path: str) -> None:
    """The schema's JSON form, a single line of text, in a directory beside the data."""
    text = json.dumps(json.loads(df.schema.json()), sort_keys=True)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the one that all executors share (spark.checkpoint.dir); a local one where none is set, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tagweave-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tagweave/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: read twice, it holds the same rows, whatever executors are lost."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
