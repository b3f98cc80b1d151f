"""Similarity join of documents on word shingles, by chosen paths.

Every document is the set of its runs of five words. Documents with equal sets form a class and are
joined once. Each of several runs chooses for a set the tokens whose hash is below 1/(similarity x size),
one or so a set; classes that chose the same token share a bucket. A bucket of more than `brute` classes
is split again on further sampled tokens (the set's smallest under hashes of its own run and level), level
by level; buckets whose classes are too alike to split, and what is still large after the last level, are
compared in blocks. Runs share no hash, so a pair that one of them parts meets in others with the chance
that it had in the first; they repeat until a pair at the threshold is in one bucket at least with the
target recall, whatever the sizes of its buckets.

In a bucket, sketches tell which classes can be similar, and sets are sent only for these; then all pairs
of the bucket are compared exactly by their shared tokens. A pair in several buckets is counted in the
first of them only, which both sides' lists of buckets tell, so that links are counted without ever being
listed: a bucket returns one row a class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import WORD_BYTES, array_of, documents, only, ship, smallest_reachable, utf8, whole_groups, written

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99999
BRUTE = 2048
LEVELS = 4
SKETCH = 64
SPLITS = 3
#: Chance that sketches drop a pair at the threshold, at most.
DROPPED = 1e-9
#: A bucket's name ends in its run, in so many bits.
RUN_BITS = 12

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)
_POSITION = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | _U(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _UNBASE)):
            p = np.full(max(n, 1 << 17), base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, n: int = WORDS, table: bytes = WORD_BYTES) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of n words; all words if there are fewer, none without words.

    table maps bytes to what is compared, and to spaces what parts words.
    """
    b = np.frombuffer(utf8(text).translate(table), np.uint8)
    word = b != 32
    edge = np.flatnonzero(np.diff(np.r_[False, word, False]))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(len(b) + 1)
    sums = np.r_[_U(0), np.cumsum(_BYTE[b] * up[: len(b)])]
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    k = min(n, len(hashes))
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        out += hashes[i : len(hashes) - k + 1 + i] * _POSITION[i]
    return np.unique(mix(out))


@cache
def _hashes(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of n hash functions on 32 bits; the first ones are the same for every n."""
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03) + _U(seed))
    return (x[::2] | _U(1)).astype(np.uint32)[:, None], x[1::2].astype(np.uint32)[:, None]


def _hashed(low: np.ndarray, n: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first function, functions x tokens) for all n functions, in blocks of bounded size."""
    mul, add = _hashes(n, seed)
    step = max(1, (1 << 18) // len(low))
    for i in range(0, n, step):
        yield i, low[None, :] * mul[i : i + step] + add[i : i + step]


def runs_for(recall: float, similarity: float, levels: int = LEVELS) -> int:
    """Of a pair at the threshold a run chooses a shared token but for a chance of 1/e; all levels but the last may split.

    Every run and level has hashes of its own, so the chances multiply.
    """
    split = 1 - (1 - similarity) ** SPLITS
    runs = math.ceil(math.log(1 - recall) / math.log(1 - (1 - math.exp(-1)) * split ** (levels - 1)))
    if runs > 1 << RUN_BITS:
        raise ValueError(f"recall {recall} at similarity {similarity} takes {runs} runs")
    return runs


def least_equal(similarity: float) -> int:
    """The most sketch values to ask for, where a pair at the threshold has fewer with a chance of DROPPED at most."""
    below = 0.0
    for t in range(SKETCH):
        below += math.comb(SKETCH, t) * similarity**t * (1 - similarity) ** (SKETCH - t)
        if below > DROPPED:
            return t
    return SKETCH


def coordinates(runs: int, levels: int = LEVELS) -> int:
    """Sketch values that a set needs: SPLITS for each run and level that splits, of which the first SKETCH are compared."""
    return max(SKETCH, runs * (levels - 1) * SPLITS)


def paths(tokens: np.ndarray, runs: int, similarity: float) -> np.ndarray:
    """Names of the tokens that each run chooses for a set; the last RUN_BITS of a name are its run."""
    bound = np.uint32(min(2**32 - 1, int(2**32 / (similarity * len(tokens)))))
    out = []
    for first, h in _hashed(tokens.astype(np.uint32), runs, 1):
        run, at = np.nonzero(h <= bound)
        run = (run + first).astype(np.uint64)
        out.append((mix(tokens[at] + run * _U(0xD1B54A32D192ED03)) << _U(RUN_BITS)) | run)
    return np.concatenate(out).astype(np.int64)


def sketch(tokens: np.ndarray, n: int = SKETCH) -> bytes:
    """Low halves of the smallest hashes under each of n functions."""
    low = (tokens >> _U(32)).astype(np.uint32)
    least = np.concatenate([h.min(1) for _, h in _hashed(low, n, 2)]).astype(np.uint64)
    return mix(least).astype("<u2").tobytes()


def digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _describe(runs: int, similarity: float, n: int, values: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard_join")
        for batch in batches:
            sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
            none = np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([digest(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([sketch(s, values) if len(s) else b"" for s in sets], pa.binary()),
                    pa.array([paths(s, runs, similarity) if len(s) else none for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "c", "n", "sketch", "paths"],
            )

    return run


def _chunked(rows: DataFrame, brute: int) -> DataFrame:
    """Rows (b, k, m, ...) with `g`, their group, and the row's side in it: large buckets in pairs of chunks."""
    half = max(1, brute // 2)
    rows = rows.withColumn("chunks", F.when(F.col("m") <= brute, 1).otherwise(F.ceil(F.col("m") / half)).cast("int"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("k"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = F.xxhash64("b", F.least("x", "side"), F.greatest("x", "side"))
    rows = rows.withColumn("g", F.when(F.col("chunks") == 1, F.col("b")).otherwise(pair))
    return rows.withColumn("across", (F.col("x") != F.col("side"))).drop("x", "chunks", "m").withColumn(
        "alone", ~F.col("across")
    )


#: Columns of a matrix of members and what they share, at once.
COLUMNS = 2048


def _owned(b: int, lists: list[np.ndarray], sides: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """m x m: pairs i < j for which b is the first bucket that both are in (and that this group must compare)."""
    m = len(lists)
    ok = np.triu(np.ones((m, m), bool), 1)
    smaller = [x[x < b] for x in lists]
    flat = np.concatenate(smaller) if m else np.empty(0, np.int64)
    if len(flat):
        names, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        keep = np.cumsum(times > 1) - 1
        shared = times[at] > 1
        if shared.any():
            row = np.repeat(np.arange(m), [len(s) for s in smaller])[shared]
            column = keep[at[shared]]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            for base in range(0, int(column[-1]) + 1, COLUMNS):
                lo, hi = np.searchsorted(column, [base, base + COLUMNS])
                if hi > lo:
                    inside = np.zeros((m, COLUMNS), np.float32)
                    inside[row[lo:hi], column[lo:hi] - base] = 1
                    ok &= inside @ inside.T == 0
    if not alone.all():
        ok &= sides[:, None] != sides[None, :]
    return ok


def _near(sketches: np.ndarray, least: int) -> np.ndarray:
    m = len(sketches)
    out = np.zeros((m, m), bool)
    step = max(1, (1 << 22) // (m * SKETCH))
    for i in range(0, m, step):
        out[i : i + step] = (sketches[i : i + step, None, :] == sketches[None, :, :]).sum(2) >= least
    return out


def _candidates(similarity: float):
    least = least_equal(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "g"):
            b = array_of(table, "b").to_numpy()
            n = array_of(table, "n").to_numpy()
            k = array_of(table, "k").to_numpy()
            side = array_of(table, "side").to_numpy()
            alone = array_of(table, "alone").to_numpy(zero_copy_only=False)
            raw = np.frombuffer(b"".join(array_of(table, "sketch").to_pylist()), "<u2").reshape(-1, SKETCH)
            lists = array_of(table, "bs")
            values, offs = lists.values.to_numpy(), lists.offsets.to_numpy()
            keep = np.zeros(len(k), bool)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                if hi - lo == 2:
                    i, j = lo, lo + 1
                    if min(n[i], n[j]) < similarity * max(n[i], n[j]) or (raw[i] == raw[j]).sum() < least:
                        continue
                size = n[lo:hi].astype(np.float32)
                ok = np.minimum(size[:, None], size) >= np.float32(similarity * (1 - 1e-6)) * np.maximum(size[:, None], size)
                ok &= _near(raw[lo:hi], least)
                if not np.triu(ok, 1).any():
                    continue
                ok &= _owned(int(b[lo]), [values[offs[i] : offs[i + 1]] for i in range(lo, hi)], side[lo:hi], alone[lo:hi])
                keep[lo:hi] = ok.any(0) | ok.any(1)
            at = np.flatnonzero(keep)
            cols = [pa.array(k[at]), pa.array(b[at])]
            yield pa.RecordBatch.from_arrays(cols, ["k", "b"])

    return run


def _load(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard_join")
        for batch in batches:
            sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
            same = [digest(s) == c for s, c in zip(sets, batch.column("c").to_pylist(), strict=True)]
            kept = batch.filter(pa.array(same, pa.bool_()))
            data = pa.array([s.tobytes() for s, x in zip(sets, same, strict=True) if x], pa.binary())
            yield pa.RecordBatch.from_arrays([kept.column("k"), data], ["k", "tokens"])

    return run


#: Tokens of so many sets are counted by a matrix product, others pair by pair.
DENSE = 48


#: Tokens that are counted at once; sets are sorted, so that ranges of tokens can be met in turn.
TOKENS = 1 << 20


def shared_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """m x m: numbers of tokens that sets share."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    ranges = max(1, -(-sum(map(len, sets)) // TOKENS))
    edges = [0, *((i << 64) // ranges for i in range(1, ranges))]
    cuts = [np.r_[np.searchsorted(s, np.array(edges, np.uint64)), len(s)] for s in sets]
    for i in range(ranges):
        _add_shared(out, [s[c[i] : c[i + 1]] for s, c in zip(sets, cuts, strict=True)])
    return out


def _add_shared(out: np.ndarray, sets: list[np.ndarray]) -> None:
    m = len(sets)
    flat = np.concatenate(sets)
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    often = times[at] >= DENSE
    if often.any():
        rank = np.cumsum(times >= DENSE) - 1
        r, c = row[often], rank[at[often]]
        order = np.argsort(c, kind="stable")
        r, c = r[order], c[order]
        columns = int(c[-1]) + 1
        for base in range(0, columns, COLUMNS):
            lo, hi = np.searchsorted(c, [base, base + COLUMNS])
            x = np.zeros((m, min(COLUMNS, columns - base)), np.float32)
            x[r[lo:hi], c[lo:hi] - base] = 1
            out += x @ x.T
    some = (times[at] > 1) & ~often
    if some.any():
        order = np.lexsort((row[some], at[some]))
        r, c = row[some][order], at[some][order]
        for apart in range(1, int(times[c].max())):
            same = np.flatnonzero(c[apart:] == c[:-apart])
            if not len(same):
                break
            i, j = r[same], r[same + apart]
            np.add.at(out.ravel(), i * m + j, np.float32(1))
            np.add.at(out.ravel(), j * m + i, np.float32(1))


def _roots(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first member that each of m is connected to by the pairs (i, j)."""
    root = np.arange(m)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard_join")
        for table, bounds in whole_groups(batches, "g"):
            b, k, copies = (array_of(table, c).to_numpy() for c in ("b", "k", "copies"))
            side, alone = array_of(table, "side").to_numpy(), array_of(table, "alone").to_numpy(zero_copy_only=False)
            lists = array_of(table, "bs")
            values, offs = lists.values.to_numpy(), lists.offsets.to_numpy()
            tokens = array_of(table, "tokens")
            out: list[tuple] = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                members = lo + np.unique(k[lo:hi], return_index=True)[1]  # repeated rows load a set twice
                if len(members) < 2:
                    continue
                owned = _owned(int(b[lo]), [values[offs[i] : offs[i + 1]] for i in members.tolist()], side[members], alone[members])
                mine = np.flatnonzero(owned.any(0) | owned.any(1))
                if not len(mine):
                    continue
                members, owned = members[mine], owned[np.ix_(mine, mine)]
                sets = [np.frombuffer(tokens[int(i)].as_buffer(), np.uint64) for i in members]
                size = np.array([len(s) for s in sets], float)
                i, j = np.nonzero(owned)
                both = shared_tokens(sets)[i, j].astype(float)
                hit = both >= similarity * (size[i] + size[j] - both) - 1e-6
                i, j = i[hit], j[hit]
                if not len(i):
                    continue
                kk, cc = k[members], copies[members]
                links = np.zeros((2, len(kk)), np.int64)
                np.add.at(links[0], i, cc[j])
                np.add.at(links[0], j, cc[i])
                links[1] = np.bincount(i, minlength=len(kk)) + np.bincount(j, minlength=len(kk))
                root = _roots(len(kk), i, j)
                some = np.flatnonzero(links[1])
                out += zip(kk[some].tolist(), kk[root[some]].tolist(), links[0][some].tolist(), links[1][some].tolist(), strict=True)
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["k", "root", "links", "class_links"])

    return run


def _buckets(classes: DataFrame, brute: int, levels: int, some: int) -> DataFrame:
    """(b, k, m): buckets of two classes or more, the large ones split level by level. some: about the number of all paths."""
    rows = classes.select("k", F.explode("paths").alias("b"))
    done = None
    for level in range(levels):
        rows = written(rows, f"paths{level}", some) if level else rows
        counts = written(rows.groupBy("b").agg(F.count("*").alias("m")).where("m > 1"), f"counts{level}", some)
        live = rows.join(counts, "b")
        final = level == levels - 1
        ready = live if final else live.where(F.col("m") <= brute)
        done = ready.select("b", "k", "m") if done is None else done.union(ready.select("b", "k", "m"))
        if final or counts.where(F.col("m") > brute).isEmpty():
            break
        # every run splits by sketch values of its own, so that no two runs part a pair by the same ones
        run = F.col("b").bitwiseAND(F.lit((1 << RUN_BITS) - 1))
        first = (run * (levels - 1) + level) * SPLITS
        part = [F.substring("sketch", ((first + i) * 2 + 1).cast("int"), F.lit(2)) for i in range(SPLITS)]
        large = written(live.where(F.col("m") > brute).join(classes.select("k", "sketch"), "k"), f"large{level}", some)
        # where half of a bucket would stay together its classes are similar, and splitting it is of no use
        share = large.groupBy("b", "m", part[0]).agg(F.count("*").alias("c")).groupBy("b", "m").agg(F.max("c").alias("c"))
        dense = written(share.where("2 * c >= m").select("b"), f"dense{level}", some)
        done = done.union(large.join(dense, "b").select("b", "k", "m"))
        names = (F.xxhash64("b", F.lit(level * SPLITS + i), p) for i, p in enumerate(part))
        children = F.array(*(F.shiftleft(name, RUN_BITS).bitwiseOR(run) for name in names))
        rows = large.join(dense, "b", "left_anti").select("k", F.explode(children).alias("b"))
    return done


def link_classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, n: int = WORDS, brute: int = BRUTE, levels: int = LEVELS):
    """(sets, classes, totals, components): documents with their class digest, the classes, their links, their components."""
    spark = ship(docs.sparkSession)
    src = documents(docs).where("doc_id is not null")
    runs = runs_for(recall, similarity, levels)
    sets = src.mapInArrow(_describe(runs, similarity, n, coordinates(runs, levels)), "doc_id long, c binary, n int, sketch binary, paths array<long>")
    sets = written(sets, "sets")
    rows = sets.count()
    some = math.ceil(rows * runs / similarity)  # a run chooses 1/similarity tokens of a set
    classes = sets.where("n > 0").groupBy("c").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")
    )
    classes = written(classes.withColumn("k", F.monotonically_increasing_id()), "classes", rows)
    buckets = written(_buckets(classes, brute, levels, some), "buckets", some)
    lists = buckets.groupBy("k").agg(F.sort_array(F.collect_set("b")).alias("bs"))
    lists = written(classes.select("k", "n", F.substring("sketch", 1, 2 * SKETCH).alias("sketch")).join(lists, "k"), "lists", rows)
    full = buckets.dropDuplicates(["b", "k"]).join(lists, "k")
    grouped = _chunked(full, brute).repartition("g").sortWithinPartitions("g", "k")
    grouped = grouped.select("g", "b", "k", "n", "sketch", "bs", "side", "alone")
    wanted = written(grouped.mapInArrow(_candidates(similarity), "k long, b long").distinct(), "wanted", some)
    need = classes.join(wanted.select("k").distinct(), "k", "left_semi").select("k", "c", F.col("rep").alias("doc_id"))
    loaded = src.join(need.hint("shuffle_hash"), "doc_id").select("k", "c", "text").mapInArrow(_load(n), "k long, tokens binary")
    sent = (
        wanted.join(buckets.groupBy("b").agg(F.first("m").alias("m")), "b")
        .join(lists.select("k", "bs"), "k")
        .join(classes.select("k", "copies"), "k")
        .join(loaded, "k")
    )
    groups = _chunked(sent, brute).repartition("g").sortWithinPartitions("g", "k")
    groups = groups.select("g", "b", "k", "copies", "bs", "side", "alone", "tokens")
    links = written(groups.mapInArrow(_verify(similarity), "k long, root long, links long, class_links long"), "links")
    totals = links.groupBy("k").agg(F.sum("links").alias("links"), F.sum("class_links").alias("class_links"))
    components = smallest_reachable(links.select(F.col("k").alias("a"), F.col("root").alias("b")))
    return sets, classes, totals, components


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, **kw) -> DataFrame:
    """One row per row of docs: doc_id, class_id, set_id, n_links, n_set_links.

    class_id is the smallest doc_id of the documents that chains of links at `similarity` or more lead
    to; set_id the smallest with the same set of shingles; n_links counts the other documents within
    the similarity, copies included, n_set_links those sets among them that differ.

    Texts of fewer than five words are one shingle; null, empty and wordless texts have no set, no
    links and their own doc_id as class. Rows without doc_id have null ids and no links. Repeated rows
    are copies. Columns but doc_id and text are not read.
    """
    sets, classes, totals, components = link_classes(docs, similarity, **kw)
    named = classes.select("k", "c", "rep", "copies").join(totals, "k", "left").join(components.withColumnRenamed("node", "k"), "k", "left")
    rows = classes.count()
    named = written(named.withColumn("root", F.coalesce("root", "k")), "named", rows)
    least = written(named.groupBy("root").agg(F.min("rep").alias("class_id")), "roots", rows)
    named = written(named.join(least, "root").select("c", "rep", "copies", "links", "class_links", "class_id"), "answers", rows)
    out = sets.select("doc_id", "c", "n").join(named, "c", "left")
    has = F.col("n") > 0
    out = out.select(
        "doc_id",
        F.when(has, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(has, F.col("rep")).otherwise(F.col("doc_id")).alias("set_id"),
        F.when(has, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(has, F.coalesce("class_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_set_links"),
    )
    none = F.lit(None).cast("long")
    lost = documents(docs).where("doc_id is null").select(none.alias("doc_id"), none.alias("class_id"), none.alias("set_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_set_links"))
    return out.union(lost)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
