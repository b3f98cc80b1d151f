"""Seeded sampling, shuffling, splitting and interleaving. All draws are md5-uniform in seed and row key."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions.exprs import let, uniform
from tagweave.operators.projections import PREFIX, annotations
from tagweave.sources import row_index


def type_counts(df: DataFrame, nodes: str = "tags") -> DataFrame:
    """(key, n): rows that hold nodes of each key."""
    keys = F.array_distinct(F.transform(nodes, lambda x: x["key"]))
    return df.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def column_counts(df: DataFrame) -> DataFrame:
    """(key, n): rows in which each annotation column has nodes."""
    names = F.array(*(F.when(F.size(c) > 0, F.lit(c.removeprefix(PREFIX))) for c in annotations(df)))
    return df.select(F.explode(F.filter(names, lambda x: x.isNotNull())).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def type_weights(counts: DataFrame) -> DataFrame:
    """(key, n, weight): all counts over each, in one pass; a row a node type is all that meets."""
    return counts.withColumn("weight", F.sum("n").over(Window.partitionBy(F.lit(0))) / F.col("n"))


def _kept(keys: Column, weights: dict[str, float], seed: int, id_col: str) -> Column:
    """k of the n keys, k drawn evenly from 1..n, by the smallest -ln(u)/weight."""
    weight = F.create_map(*(F.lit(x) for kw in sorted(weights.items()) for x in (kw[0], float(kw[1]))))
    drawn = F.array_sort(F.transform(keys, lambda k: F.struct((-F.ln(uniform_of(seed, id_col, k)) / F.coalesce(weight[k], F.lit(1.0))).alias("e"), k.alias("k"))))
    n = F.floor(uniform(seed, id_col, tag="count") * F.size(keys)).cast("int") + 1
    return F.transform(F.slice(drawn, 1, n), lambda d: d["k"])


def uniform_of(seed: int, id_col: str, key: Column) -> Column:
    name = F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), key)
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 1) / float((1 << 52) + 1)


def sample_tags(df: DataFrame, weights: dict[str, float], seed: int, id_col: str, nodes: str = "tags") -> DataFrame:
    """Keep all nodes of some of a row's types, drawn without replacement by weight."""
    keys = F.array_sort(F.array_distinct(F.transform(nodes, lambda x: x["key"])))
    kept = let(keys, lambda k: F.when(F.size(k) > 0, _kept(k, weights, seed, id_col)))
    return df.withColumn(nodes, let(kept, lambda k: F.filter(nodes, lambda x: F.array_contains(k, x["key"]))))


def drop_html(df: DataFrame, html_rate: float, seed: int, id_col: str) -> DataFrame:
    """df with all html nodes of a row gone, with probability 1 - html_rate."""
    drop = uniform(seed, id_col, tag="html") < F.lit(1 - html_rate)
    html = F.when(~drop, F.col(PREFIX + "html")).otherwise(F.array().cast(df.schema[PREFIX + "html"].dataType))
    return df.withColumn(PREFIX + "html", html)


def sample_tags_columns(df: DataFrame, weights: dict[str, float], seed: int, id_col: str, html_rate: float = 1.0) -> DataFrame:
    """The same over annotation columns; others' lists become empty, html first with probability 1 - html_rate."""
    cols = [c for c in annotations(df) if c.removeprefix(PREFIX) in weights]
    if PREFIX + "html" in cols and html_rate < 1:
        df = drop_html(df, html_rate, seed, id_col)
    names = F.filter(F.array(*(F.when(F.size(c) > 0, F.lit(c.removeprefix(PREFIX))) for c in sorted(cols))), lambda x: x.isNotNull())
    out = df.withColumn("_kept", F.when(F.size(names) > 0, _kept(names, weights, seed, id_col)))
    return out.withColumns(
        {c: F.when(F.array_contains("_kept", c.removeprefix(PREFIX)), F.col(c)).otherwise(F.array().cast(df.schema[c].dataType)) for c in cols}
    ).drop("_kept")


def sample_rows(df: DataFrame, share: float, seed: int, id_col: str) -> DataFrame:
    """Rows whose number is below share; see sample_with_replacement."""
    return df.where(uniform(seed, id_col) < share)


def sample_with_replacement(df: DataFrame, n: int, seed: int, order_by: str) -> DataFrame:
    """n draws, numbered by `draw`, each of any row of df by its rank in the order of a unique column."""
    ranked, total = row_index(df, order_by), df.count()
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(uniform(seed, "id") * total).cast("long").alias("_rn"))
    return draws.join(ranked, "_rn").drop("_rn")


#: Rows that a buffered shuffle reads through one buffer.
STRETCH = 1 << 20


def drawn_order(n: int, draws: np.ndarray) -> list[int]:
    """n places in the order that n numbers in [0, 1) draw."""
    out = list(range(n))
    for i in range(n):
        j = i + int(draws[i] * (n - i))
        out[i], out[j] = out[j], out[i]
    return out


def _buffered(seed: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the buffer, in the order of its places
        stretch, place, draw = None, 0, None

        def given(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal place
            at = pa.array(np.arange(place, place + rows.num_rows) + stretch * STRETCH, pa.int64())
            place += rows.num_rows
            yield from rows.append_column("place", at).combine_chunks().to_batches()

        def rest() -> Iterator[pa.RecordBatch]:
            if held is not None and held.num_rows:
                yield from given(held.take(pa.array(drawn_order(held.num_rows, first))))

        for batch in batches:
            own = batch.column("_stretch").to_numpy()
            for part in np.split(np.arange(len(own)), np.flatnonzero(own[1:] != own[:-1]) + 1):
                if not len(part):
                    continue
                rows = pa.Table.from_batches([batch.slice(int(part[0]), len(part))]).drop_columns(["_stretch"])
                if int(own[part[0]]) != stretch:
                    yield from rest()
                    stretch, place, held = int(own[part[0]]), 0, None
                    draw = np.random.default_rng([seed, stretch])
                    first = draw.random(size)
                both = rows if held is None else pa.concat_tables([held, rows])
                known = 0 if held is None else held.num_rows
                full = max(0, size - known)  # rows that only fill the buffer
                slots, out = list(range(min(both.num_rows, size))), []
                for i, u in zip(range(known + full, both.num_rows), draw.random(max(0, both.num_rows - known - full)), strict=True):
                    j = int(u * size)
                    out.append(slots[j])
                    slots[j] = i
                yield from given(both.take(pa.array(out, pa.int64())))
                held = both.take(pa.array(slots, pa.int64())).combine_chunks()
        yield from rest()

    return run


def shuffle(df: DataFrame, seed: int, id_col: str, total: bool = True, buffer_size: int | None = None) -> DataFrame:
    """All rows in random order, or (total=False) random order within random partitions.

    buffer_size: as a stream would, through a buffer of so many rows, in stretches of STRETCH rows in the
    order of the unique id_col, each with a buffer of its own; `place` is a row's place in the new order. The
    same seed gives the same places, however the rows are partitioned; a task holds the buffer and a batch.
    """
    if buffer_size is not None:
        if buffer_size < 1:
            raise ValueError(f"buffer_size {buffer_size}")
        ranked = row_index(df, id_col).withColumn("_stretch", F.floor(F.col("_rn") / STRETCH))
        sorted_ = ranked.repartition("_stretch").sortWithinPartitions("_stretch", "_rn").drop("_rn")
        return sorted_.mapInArrow(_buffered(seed, buffer_size), df.withColumn("place", F.lit(0).cast("long")).schema)
    keyed = df.withColumn("_u", uniform(seed, id_col))
    keyed = keyed.orderBy("_u", id_col) if total else keyed.repartition(F.xxhash64("_u")).sortWithinPartitions("_u")
    return keyed.drop("_u")


def interleave(dfs: list[DataFrame], weights: list[float], seed: int, id_col: str, stop_first: bool = False) -> DataFrame:
    """Rows of the sources with `source` and `turn`, their place / weight; drained, or up to the first source's end."""
    parts, ends = [], []
    for i, (d, w) in enumerate(zip(dfs, weights, strict=True)):
        ranked = row_index(d.withColumn("_u", uniform(seed, id_col, tag=str(i))), "_u", id_col)
        part = ranked.withColumns({"source": F.lit(i), "turn": (F.col("_rn") + 1) / float(w)}).drop("_u", "_rn")
        parts.append(part)
        ends.append(part.agg(F.max("turn").alias("t")))
    both = reduce(DataFrame.unionByName, parts)
    if stop_first:
        end = reduce(DataFrame.union, ends).agg(F.min("t")).first()[0]
        both = both.where(F.col("turn") <= F.lit(end))
    return both


def percent_split(df: DataFrame, percent: int, order_by: str) -> DataFrame:
    """df with `split`: the first percent of the rows are "validation", the rest "train"."""
    ranked = row_index(df, order_by)
    bound = int(df.count() * percent / 100 + 0.5)
    return ranked.withColumn("split", F.when(F.col("_rn") < bound, "validation").otherwise("train")).drop("_rn")


def first_n(df: DataFrame, n: int, *order_by: str) -> DataFrame:
    return df.orderBy(*order_by).limit(n)
