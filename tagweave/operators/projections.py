"""Selecting rows, columns and nodes; set operations and joins on texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tagweave.schemas import ANY

PREFIX = "tags_"
#: Spark limits groups of a window before the exchange up to so many rows.
TOP_BY_WINDOW = 1000


def annotations(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.name.startswith(PREFIX) and isinstance(f.dataType, ArrayType)]


def keep_tags(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop annotation columns but those of keys, which must be there."""
    missing = [k for k in keys if PREFIX + k not in df.columns]
    if missing:
        raise ValueError(f"no column for {missing}")
    return df.drop(*(c for c in annotations(df) if c.removeprefix(PREFIX) not in keys))


def drop_empty_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.length(text) > 0)


def only_with_tags(df: DataFrame, key: str, order_by: str, limit: int | None = None) -> DataFrame:
    """Rows that have nodes of a key, all other annotations emptied; the first `limit` by order_by."""
    empty = {c: F.array().cast(df.schema[c].dataType) for c in annotations(df) if c != PREFIX + key}
    out = df.where(F.size(PREFIX + key) > 0).withColumns(empty)
    return out if limit is None else out.orderBy(order_by).limit(limit)


def validation_by_type(df: DataFrame, order_by: str, limit: int) -> DataFrame:
    """A `split` a type of annotation (rows that have it), `validation` and `validation_no_tags` (all rows).

    Each split takes the first `limit` rows; other types' nodes are emptied, and all of them without tags. Up
    to TOP_BY_WINDOW rows a split, tasks keep their own first rows before they meet, in one pass; beyond it,
    each split is a pass of its own.
    """
    cols = annotations(df)
    names = F.array(*(F.when(F.size(c) > 0, F.lit("validation_" + c.removeprefix(PREFIX))) for c in cols), F.lit("validation"), F.lit("validation_no_tags"))
    rows = df.withColumn("split", F.explode(F.filter(names, lambda n: n.isNotNull())))
    if limit <= TOP_BY_WINDOW:
        place = F.row_number().over(Window.partitionBy("split").orderBy(order_by))
        out = rows.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
    else:
        splits = ["validation", "validation_no_tags", *("validation_" + c.removeprefix(PREFIX) for c in cols)]
        out = reduce(DataFrame.unionByName, (rows.where(F.col("split") == name).orderBy(order_by).limit(limit) for name in splits))
    keep = lambda c: (F.col("split") == "validation") | (F.col("split") == "validation_" + c.removeprefix(PREFIX))
    return out.withColumns({c: F.when(keep(c), F.col(c)).otherwise(F.array().cast(df.schema[c].dataType)) for c in cols})


def _widened(df: DataFrame, column: str) -> Column:
    """A column's nodes with every field of any node type; a missing key is the column's suffix."""
    held = df.schema[column].dataType.elementType.fieldNames()
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(ANY)

    def wide(x: Column) -> Column:
        values = []
        for f in fields:
            v = x[f.name].cast(f.dataType) if f.name in held else F.lit(None).cast(f.dataType)
            if f.name == "key":
                v = F.coalesce(v, F.lit(column.removeprefix(PREFIX)))
            values.append(v.alias(f.name))
        return F.struct(*values)

    return F.coalesce(F.transform(column, wide), F.array().cast(f"array<{ANY}>"))


def to_v1(df: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """One `tags` list of all annotation lists, or those of keys, in column order; a table that has it stays as it is."""
    if "tags" in df.columns:
        return df
    cols = annotations(df)
    df = df.drop(*(c for c in cols if keys is not None and c.removeprefix(PREFIX) not in keys))
    cols = annotations(df)
    nodes = F.concat(*(_widened(df, c) for c in cols)) if cols else F.array().cast(f"array<{ANY}>")
    return df.withColumn("tags", nodes).drop(*cols)


def with_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("labels", F.col("input_ids"))


def evaluation_columns(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c in ("text", "tags") or c.startswith(PREFIX)))


def clean_up(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with text, without error columns; one row of counts: rows, empty_rows)."""
    empty = F.coalesce(F.length("text") == 0, F.lit(True))
    counts = df.agg(F.count("*").alias("rows"), F.count_if(empty).alias("empty_rows"))
    return df.where(~empty).drop(*(c for c in df.columns if "_error" in c)), counts


def dedupe_text(df: DataFrame, order_by: str, text: str = "text") -> DataFrame:
    """One row a text, the first by order_by. Copies meet after each task has kept its first."""
    best = df.groupBy(F.col(text).alias("_t")).agg(F.min(order_by).alias("_first"))
    return df.join(best, F.col(text).eqNullSafe(F.col("_t")) & (F.col(order_by) == F.col("_first")), "left_semi")


def intersect_on_text(dfs: list[DataFrame], order_by: str, lists: list[str], text: str = "text") -> DataFrame:
    """Texts that every table has, each table de-duplicated first; the tables' lists are concatenated in turn."""
    parts = [dedupe_text(d, order_by, text).select(F.col(text).alias("_t"), F.col(c).alias(f"_l{i}")) for i, (d, c) in enumerate(zip(dfs, lists, strict=True))]
    both = reduce(lambda a, b: a.join(b, "_t"), parts)
    return both.select(F.col("_t").alias(text), F.concat(*(F.coalesce(f"_l{i}", F.array().cast(dfs[i].schema[c].dataType)) for i, c in enumerate(lists))).alias("tags"))


def difference(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    return df.join(other.select(on).distinct(), on, "left_anti")


def step_counts(step: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the step's name and the numbers of rows before and after it."""
    return before.select(F.lit(0).alias("_a")).unionAll(after.select(F.lit(1).alias("_a"))).agg(
        F.count_if(F.col("_a") == 0).alias("rows_before"), F.count_if(F.col("_a") == 1).alias("rows_after")
    ).select(F.lit(step).alias("step"), "rows_before", "rows_after")
