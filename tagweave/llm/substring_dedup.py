"""Removal of repeated byte strings by bucket-pointer refinement.

Suffixes fall into initial buckets by a q-gram, and buckets are refined by the bucket identifiers of later
offsets until they stand for strings of `length` bytes; a suffix alone in its bucket is done.

The first buckets are over the cluster and few. Every window of `short` bytes has an anchor, its smallest
`gram`-byte string by hash, so equal windows have equal anchors at equal places: a suffix whose anchor has a
bucket of its own can't begin a repeat and is done at once. Others are refined by the identifier of the whole
run of windows that share the anchor (with the bytes that strings of `length` from there need); a run that
occurs twice repeats throughout. What is left, runs that differ in a bucket of several, is refined byte by
byte: buckets of exact 8-byte strings, then of 16, 32, ... bytes, each named by the pair of a suffix's own
bucket and that of the suffix one length on, until `short` and `length` are reached (`refine`). Buckets of
more than `small` different runs are refined over the cluster, by a pair of halves' identifiers.

No bucket is gathered whole beyond that. Strings are judged on the input, and every byte covered by a
repeated string goes. Exact names need no hashes; anchors, whole runs and halves are named by 64-bit hashes,
always two at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import array_of, documents, ship, utf8, whole_groups, written
from tagweave.llm.jaccard_join import _BYTE, _powers, mix

LENGTH = 400
#: Shorter repeats (passages of some fifty words) are counted too, but not removed.
SHORT = 240
GRAM = 60
SMALL = 4096
#: Longer texts are cut, with windows on either side of a cut kept whole.
PIECE = 1 << 19
#: Suffixes that are refined at once in a task; a bucket is kept whole.
AT_ONCE = 2 << 20
_U = np.uint64


def identifiers(b: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit identifier of every run of n bytes in b."""
    up, down = _powers(len(b) + 1)
    sums = np.r_[_U(0), np.cumsum(_BYTE[b] * up[: len(b)])]
    return mix((sums[n:] - sums[:-n]) * down[: len(b) - n + 1])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` values in a row, by prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, 1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def runs(data: bytes, length: int = LENGTH, gram: int = GRAM, short: int = SHORT) -> list[tuple[int, int, int, int]]:
    """(first window, number of windows, anchor's bucket, identifier of the run) of the windows of data."""
    out = []
    view = memoryview(data)
    for base in range(0, max(0, len(data) - short + 1), PIECE):
        g = identifiers(np.frombuffer(view[base : base + PIECE + short - 1], np.uint8), gram)
        place = np.arange(len(g), dtype=np.uint64)
        first = _least((g & ~_U((1 << 20) - 1)) | place, short - gram + 1) & _U((1 << 20) - 1)
        change = np.r_[0, np.flatnonzero(first[1:] != first[:-1]) + 1, len(first)]
        bucket = g[first[change[:-1]].astype(np.int64)].view(np.int64)
        change += base
        for at, end, key in zip(change[:-1].tolist(), change[1:].tolist(), bucket.tolist(), strict=True):
            out.append((at, end - at, key, xxhash.xxh3_64_intdigest(view[at : end - 1 + length]) - (1 << 63)))
    return out


def _runs(length: int, gram: int, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = runs(utf8(text), length, gram, short)
                out += found
                rows += [row] * len(found)
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["row", "at", "n", "g", "c"])

    return run


_CONTEXT = "row binary, at int, n int, g long, open boolean, hot boolean, bytes binary"


def _contexts(length: int):
    """The bytes of runs that must be compared window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("runs")
            fields = marks.values
            at, n, g, full, compare, hot = (fields.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "g", "full", "compare", "hot"))
            offsets = marks.offsets.to_numpy()
            chosen = np.flatnonzero(compare)
            of = np.searchsorted(offsets, chosen, side="right") - 1
            texts = batch.column("text")
            names, out, last, data = batch.column("row").to_pylist(), [], -1, b""
            for i, r in zip(chosen.tolist(), of.tolist(), strict=True):
                if r != last:
                    last, data = r, utf8(texts[r].as_py())
                out.append(data[at[i] : at[i] + n[i] - 1 + length])
            cols = [pa.array([names[r] for r in of.tolist()], pa.binary()), *(pa.array(x[chosen]) for x in (at, n, g)), pa.array(~full[chosen].astype(bool)), pa.array(hot[chosen].astype(bool)), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "at", "n", "g", "open", "hot", "bytes"])

    return run


def _named(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among those that occur twice; -1 for keys that occur once."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    group = np.cumsum(new) - 1
    several = np.diff(np.r_[np.flatnonzero(new), len(keys)]) > 1
    rank = np.where(several, np.cumsum(several) - 1, -1)
    out = np.empty(len(keys), np.int64)
    out[order] = rank[group]
    return out


def refine(data: np.ndarray, lengths: tuple[int, ...]) -> Iterator[np.ndarray]:
    """For each length in turn, a name for the string of so many bytes at every place of data, -1 where it occurs once.

    Names of short strings are ranks of their bytes; longer ones are ranks of pairs of names, those of the
    place and of the place as far on as is still to cover. A place that is alone once stays so.
    """
    gram = 8
    names = np.full(len(data), -1, np.int64)
    if len(data) >= gram:
        names[: len(data) - gram + 1] = _named(np.ndarray((len(data) - gram + 1,), "<u8", np.ascontiguousarray(data), 0, (1,)).copy())
    for wanted in lengths:
        while gram < wanted:
            step = min(gram, wanted - gram)
            both = np.flatnonzero((names[: len(names) - step] >= 0) & (names[step:] >= 0)) if len(names) > step else np.empty(0, np.int64)
            pairs = names[both] * (len(data) + 1) + names[both + step]
            names = np.full(len(data), -1, np.int64)
            if len(both):
                names[both] = _named(pairs)
            gram += step
        yield names


def _edges(flags: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of runs of true flags that stay in one context."""
    cut = np.r_[True, context[1:] != context[:-1]] if len(context) else np.empty(0, bool)
    begin = flags & (cut | ~np.r_[False, flags[:-1]])
    after = np.r_[cut[1:], True] if len(cut) else cut
    end = flags & (after | ~np.r_[flags[1:], False])
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _in_bucket(length: int, short: int):
    """Windows of open runs that occur in another run of the bucket, as ranges of window starts, for both lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "g"):
            sizes = pc.binary_length(array_of(table, "bytes")).to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            lo = 0
            while lo < table.num_rows:  # whole buckets, about AT_ONCE bytes
                room = np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, side="right")
                hi = int(bounds[max(np.searchsorted(bounds, room, side="right") - 1, np.searchsorted(bounds, lo, side="right"))])
                yield from _refined(table.slice(lo, hi - lo), length, short)
                lo = hi

    return run


def _starts(n: np.ndarray, sizes: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and place in it of every window of so many bytes that starts in a run."""
    many = np.clip(np.minimum(n, sizes - wanted + 1), 0, None)
    context = np.repeat(np.arange(len(n)), many)
    return context, np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


def _may_repeat(part: pa.Table, short: int) -> pa.Table:
    """Contexts without those none of whose windows has another's identifier: all their suffixes are alone."""
    n, held = array_of(part, "n").to_numpy().astype(np.int64), array_of(part, "bytes")
    sizes = pc.binary_length(held).to_numpy().astype(np.int64)
    context, nth = _starts(n, sizes, short)
    if not len(context):
        return part.slice(0, 0)
    ids = identifiers(np.frombuffer(b"".join(held.to_pylist()), np.uint8), short)[(np.cumsum(sizes) - sizes)[context] + nth]
    again = _named(ids) >= 0
    return part.take(pa.array(np.flatnonzero(np.bincount(context[again], minlength=len(n)))))


def _refined(part: pa.Table, length: int, short: int) -> Iterator[pa.RecordBatch]:
    part = _may_repeat(part, short).combine_chunks()
    if not part.num_rows:
        return
    row, at, n, is_open, held = (array_of(part, c) for c in ("row", "at", "n", "open", "bytes"))
    at, n, is_open = at.to_numpy().astype(np.int64), n.to_numpy().astype(np.int64), is_open.to_numpy(zero_copy_only=False)
    sizes = pc.binary_length(held).to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(held.to_pylist()), np.uint8)
    base = np.cumsum(sizes) - sizes
    for wanted, names in zip((short, length), refine(data, (short, length)), strict=True):
        context, nth = _starts(n, sizes, wanted)
        mine = names[base[context] + nth]
        known = mine >= 0
        weight = np.bincount(mine[known], np.where(is_open[context[known]], 1, 2))
        twice = np.zeros(len(mine), bool)
        twice[known] = weight[mine[known]] > 1
        begin, end = _edges(twice & is_open[context], context)
        if len(begin):
            c = context[begin]
            cols = [row.take(pa.array(c)), pa.array(at[c] + nth[begin]), pa.array(at[c] + nth[end - 1] + 1), pa.array(np.full(len(c), wanted, np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "first", "end", "size"])


def _windows(length: int, short: int):
    """A row for every window of both lengths: the identifiers of its halves are its bucket and that of a later offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["bytes"], np.uint8)
                for wanted in (short, length):
                    n = min(r["n"], len(data) - wanted + 1)
                    if n > 0:
                        half = -(-wanted // 2)
                        ids = identifiers(data, half).view(np.int64)
                        cols = [np.arange(r["at"], r["at"] + n, dtype=np.int64), np.full(n, r["g"], np.int64), np.full(n, wanted, np.int32)]
                        cols += [ids[:n], ids[wanted - half : wanted - half + n], np.full(n, 1 if r["open"] else 2, np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array([r["row"]] * n, pa.binary()), *map(pa.array, cols)], ["row", "first", "g", "size", "b", "later", "weight"])

    return run


def _covered(n_bytes: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which bytes the ranges cover."""
    step = np.bincount(begin, minlength=n_bytes + 1) - np.bincount(end, minlength=n_bytes + 1)
    return np.cumsum(step[:-1]) > 0


def _cut(length: int, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, ranges = batch.column("runs"), batch.column("ranges")
            at, n, full = (marks.values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "full"))
            first, end, size = (ranges.values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "end", "size"))
            mark_at, range_at = marks.offsets.to_numpy(), ranges.offsets.to_numpy()
            out = []
            for i, (row, text) in enumerate(zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                data = utf8(text)
                m = slice(mark_at[i], mark_at[i + 1])
                begin, stop = at[m][full[m].astype(bool)], (at[m] + n[m])[full[m].astype(bool)]
                r = slice(range_at[i], range_at[i + 1])
                covered = []
                for wanted in (length, short):
                    last = np.minimum(stop, len(data) - wanted + 1)
                    some, own = last > begin, size[r] == wanted
                    covered.append(_covered(len(data), np.r_[begin[some], first[r][own]].astype(np.int64), np.r_[last[some], end[r][own]].astype(np.int64) - 1 + wanted))
                gone, repeated = covered[0], int(covered[1].sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
                out.append((row, len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), repeated, kept))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["row", "n_removed", "n_spans", "kept_sha256", "n_repeated", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, small: int = SMALL, short: int = SHORT, with_kept: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated[, kept: the bytes left].

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in another row or
    the same. n_repeated counts bytes covered by strings of `short` bytes (gram <= short <= length) that do;
    they stay. Null counts as empty; texts shorter than `length` stay whole; repeated rows are documents of
    their own, so all of a repeated text of `length` bytes or more goes. kept may end inside a character.
    Only doc_id and text are read.
    """
    if not gram <= short <= length:
        raise ValueError("gram <= short <= length")
    ship(docs.sparkSession)
    # a row's name comes from what it holds: numbers given by a scan may differ in the next one
    ends = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("|"), F.col("text").cast("string")), F.lit(""))
    name = F.unhex(F.md5(F.concat(*ends).cast("binary")))  # an id is digits, so the bar after it tells the two apart, and a null from either
    src = documents(docs, name.alias("row"))
    suffixes = written(src.select("row", "text").mapInArrow(_runs(length, gram, short), "row binary, at int, n int, g long, c long"), "runs", compression="zstd")
    # written first, so that Spark can split a large bucket's part of the join
    shared = written(suffixes.groupBy("g").agg(F.count("*").alias("of")).where("of > 1").select("g"), "shared")
    live = written(suffixes.join(shared, "g"), "live", compression="zstd")
    kinds = written(live.groupBy("g", "c").agg(F.count("*").alias("copies"), F.min(F.struct("row", "at")).alias("one")), "kinds")
    several = written(kinds.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
    marks = live.join(kinds, ["g", "c"]).join(several, "g", "left")
    full = F.col("copies") > 1
    chosen = (F.col("one.row") == F.col("row")) & (F.col("one.at") == F.col("at"))
    compare = F.col("kinds").isNotNull() & (~full | chosen)
    mark = F.struct("at", "n", "g", full.alias("full"), compare.alias("compare"), F.coalesce(F.col("kinds") > small, F.lit(False)).alias("hot"))
    marks = marks.groupBy("row").agg(F.collect_list(mark).alias("runs"))
    held = written(src.select("row", "text").join(marks.hint("shuffle_hash"), "row"), "held", compression="zstd")
    contexts = written(held.mapInArrow(_contexts(length), _CONTEXT), "contexts", compression="zstd")
    ranges = contexts.where("not hot").repartition("g").sortWithinPartitions("g").mapInArrow(_in_bucket(length, short), "row binary, first long, end long, size int")
    hot = contexts.where("hot")
    if not hot.isEmpty():
        windows = written(hot.mapInArrow(_windows(length, short), "row binary, first long, g long, size int, b long, later long, weight int"), "windows", compression="zstd")
        twice = written(windows.groupBy("g", "size", "b", "later").agg(F.sum("weight").alias("times")).where("times > 1").drop("times"), "twice")
        more = windows.where("weight = 1").join(twice, ["g", "size", "b", "later"]).select("row", "first", (F.col("first") + 1).alias("end"), "size")
        ranges = ranges.union(more)
    ranges = ranges.groupBy("row").agg(F.collect_list(F.struct("first", "end", "size")).alias("ranges"))
    none = F.expr("cast(array() as array<struct<first:bigint,end:bigint,size:int>>)")
    cut = held.join(ranges.hint("shuffle_hash"), "row", "left").withColumn("ranges", F.coalesce("ranges", none)).mapInArrow(
        _cut(length, short), "row binary, n_removed long, n_spans long, kept_sha256 string, n_repeated long, kept binary"
    )
    cut = written((cut if with_kept else cut.drop("kept")).dropDuplicates(["row"]), "cut")
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    plain = src.select("row", "doc_id", F.octet_length(bytes_).cast("long").alias("n_bytes"), F.sha2(bytes_, 256).alias("sha"), *([bytes_.alias("whole")] if with_kept else []))
    out = plain.join(cut, "row", "left")
    zero = F.lit(0).cast("long")
    cols = ["doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("n_repeated", zero).alias("n_repeated")]
    return out.select(*cols, *([F.coalesce("kept", "whole").alias("kept")] if with_kept else []))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
