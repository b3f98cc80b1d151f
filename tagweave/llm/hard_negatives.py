"""Hard negatives by threshold joins of vectors, with norm bounds in place of full scores.

Rows are ranged by norm into blocks, and a block meets the queries in chunks. In a block dimensions are
ordered by energy and cut into slabs. A row enters a slab's list unless the norm of what follows, times the
largest such norm of a query, stays under the lowest threshold: the rest of such a row isn't indexed, as no
query reaches its threshold there alone. Partial scores grow slab by slab; what they and the norms of the
remaining dimensions can't lift to a query's threshold is dropped, the rest is scored in full.

A query wants the best k rows in each of its windows of scores. Thresholds start near the window's top and
fall until the window holds k rows or its end is reached. The block of largest norms comes first: what it
finds for a window bounds the k-th score from below, so that in all other blocks a threshold falls no
further, and blocks whose norms can't reach it are not met at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.llm.common import finished, only, ship, written

POSITIVES = 5
NEGATIVES = 10
SCALE = 256
BLOCK = 4096
CHUNK = 1024
SLAB = 8
#: Thresholds are at these parts of the way from a window's top to its end.
STEPS = (0.125, 0.25, 0.5, 1.0)
#: Scores are longs; no score lies beyond.
FAR = 1 << 62
#: Products below this are exact in doubles.
EXACT = float(1 << 53)

QUERY = "q long, q_id long, q_label int, v array<long>, norm double, windows array<struct<p: long, lo: long, hi: long>>"
FOUND = "q long, p long, r long, r_id long, score long"


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows, short ones filled up with zeros."""
    lists = [col.chunk(i) for i in range(col.num_chunks)]
    sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]) if lists else np.empty(0, int)
    flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists]) if lists else np.empty(0, np.int64)
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


class Block:
    """Rows with their norms from each slab on, in the order of falling energy of the dimensions."""

    def __init__(self, rows: np.ndarray, queries: np.ndarray):
        wide = max(rows.shape[1], queries.shape[1], 1)
        rows, queries = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (rows, queries))
        order = np.argsort(-(rows.astype(float) ** 2).sum(0), kind="stable")
        self.rows, self.queries = rows[:, order], queries[:, order]
        self.edges = [*range(0, wide, SLAB), wide]
        self.row_norms, self.query_norms = self._norms(self.rows), self._norms(self.queries)
        self.most = float(self.row_norms[:, 0].max(initial=0))
        if self.most * self.query_norms[:, 0].max(initial=0) < EXACT:
            self.rows, self.queries = self.rows.astype(float), self.queries.astype(float)

    def _norms(self, x: np.ndarray) -> np.ndarray:
        squares = np.add.reduceat(x.astype(float) ** 2, self.edges[:-1], axis=1)
        tails = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
        return np.sqrt(np.c_[tails, np.zeros(len(x))]) * (1 + 1e-9)

    def reaching(self, which: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, query, score) of all scores of `least` or more, for the queries `which`."""
        queries, norms = self.queries[which], self.query_norms[which]
        covered = self.row_norms * norms.max(0) < least.min()
        slabs = (~covered).cumprod(1).sum(1).clip(max=len(self.edges) - 1)  # of the row that are in the index
        at = np.argsort(-slabs, kind="stable")[: int((slabs > 0).sum())]
        partial = np.zeros((len(at), len(which)), self.rows.dtype)
        for s, (lo, hi) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)):
            n = int(np.searchsorted(-slabs[at], -s, "left"))  # rows with more than s slabs come first
            if not n:
                break
            partial[:n] += self.rows[at[:n], lo:hi] @ queries[:, lo:hi].T
            rest = self.row_norms[at[:n], s + 1, None] * norms[:, s + 1]
            alive = np.ones(len(at), bool)
            alive[:n] = (partial[:n] + rest >= least).any(1)
            if not alive.all():
                at, partial = at[alive], partial[alive]
        ends = slabs[at]
        bound = partial + self.row_norms[at, ends][:, None] * norms[:, ends].T
        row, query = np.nonzero(bound >= least)
        score = np.empty(len(row), np.int64)
        for i in range(0, len(row), 1 << 14):  # the dimensions that the index left out
            r, q = at[row[i : i + (1 << 14)]], query[i : i + (1 << 14)]
            score[i : i + (1 << 14)] = np.einsum("ij,ij->i", self.rows[r], queries[q]).astype(np.int64)
        hit = score >= least[query]
        return at[row[hit]], which[query[hit]], score[hit]


def best(block: Block, allowed, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, ids: np.ndarray):
    """(window, row, score): the first k allowed rows of every window (query at, from lo to hi), by score and then id."""
    reach = np.minimum(block.query_norms[:, 0] * block.most, float(FAR))[at]
    top = np.minimum(hi.astype(float), reach)
    end = np.maximum(lo.astype(float), -reach)
    pending = np.flatnonzero(top >= end)
    out = []
    for step in STEPS:
        if not len(pending):
            break
        least = top - step * (top - end) if step < 1 else end
        which, slot = np.unique(at[pending], return_inverse=True)
        lowest = np.full(len(which), np.inf)
        np.minimum.at(lowest, slot, least[pending])
        row, query, score = block.reaching(which, lowest)
        fits = allowed(row, query)
        row, query, score = row[fits], query[fits], score[fits]
        order = np.lexsort((ids[row], -score, query))
        row, query, score = row[order], query[order], score[order]
        begins, ends = np.searchsorted(query, which), np.searchsorted(query, which, "right")
        open_ = []
        for w, s in zip(pending.tolist(), slot.tolist(), strict=True):
            own = -score[begins[s] : ends[s]]
            i = begins[s] + np.searchsorted(own, -hi[w])
            j = min(i + k, begins[s] + np.searchsorted(own, -least[w], "right"))
            if j - i == k or step == 1:
                out.append((np.full(j - i, w), row[i:j], score[i:j]))
            else:
                open_.append(w)
        pending = np.array(open_, int)
    parts = list(zip(*out, strict=True)) if out else [[np.empty(0, int)]] * 3
    return tuple(np.concatenate(p) for p in parts)


def _meet(k: int, same: bool):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        only("hard_negatives")
        names = ["q", "p", "r", "r_id", "score"]
        if not rows.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        block = Block(_matrix(rows.column("v")), _matrix(queries.column("v")))
        uid, ids, label = (rows.column(c).to_numpy() for c in ("r", "r_id", "label"))
        q, q_label = queries.column("q").to_numpy(), queries.column("q_label").to_numpy()
        held = queries.column("windows").to_pylist()
        at = np.repeat(np.arange(len(held)), [len(x) for x in held])
        p, lo, hi = (np.array([w[f] for x in held for w in x], np.int64) for f in ("p", "lo", "hi"))

        def allowed(row: np.ndarray, query: np.ndarray) -> np.ndarray:
            alike = label[row] == q_label[query]
            return alike & (uid[row] != q[query]) if same else ~alike

        w, row, score = best(block, allowed, at, lo, hi, k, ids)
        cols = (q[at[w]], p[w], uid[row], ids[row], score)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, cols, strict=True)})

    return run


def _search(blocks: DataFrame, queries: DataFrame, k: int, same: bool, chunks: int) -> DataFrame:
    """FOUND: of every window of every query the first k rows with the query's label (not the query itself), or with another."""
    stats = blocks.groupBy(F.col("block").alias("own")).agg(F.max("norm").alias("most"))

    def met(rows: DataFrame, sizes: DataFrame, wanted: DataFrame) -> DataFrame:
        lowest = F.array_min(F.col("windows.lo"))
        asked = wanted.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int")).join(
            F.broadcast(sizes), F.col("norm") * F.col("most") * (1 + 1e-9) >= lowest  # 16 bytes for a block of rows
        )
        spread = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        sides = (spread.select("block", "chunk", "r", "r_id", "label", "v"), asked.select(F.col("own").alias("block"), "chunk", "q", "q_label", "v", "windows"))
        pair = [x.groupBy("block", "chunk") for x in sides]
        return pair[0].cogroup(pair[1]).applyInArrow(_meet(k, same), FOUND)

    head = blocks.agg(F.min("block")).first()[0]
    first = written(met(blocks.where(F.col("block") == head), stats.where(F.col("own") == head), queries), "first")
    # what is found already bounds a window's k-th score from below
    floors = first.groupBy("q", "p").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    raised = queries.withColumn("w", F.explode("windows")).select(*(c for c in queries.columns if c != "windows"), "w.*").join(floors, ["q", "p"], "left")
    raised = raised.withColumn("lo", F.greatest("lo", F.coalesce("floor", "lo"))).groupBy("q").agg(
        *(F.first(c).alias(c) for c in ("q_id", "q_label", "v", "norm")), F.collect_list(F.struct("p", "lo", "hi")).alias("windows")
    )
    found = first.union(met(blocks.where(F.col("block") != head), stats.where(F.col("own") != head), written(raised, "raised")))
    order = Window.partitionBy("q", "p").orderBy(F.desc("score"), "r_id", "r")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = 30, highest: int = 90, block: int = BLOCK, chunk: int = CHUNK
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, a subset of the rows' ids.

    rows has vec_id, label and v, a list of whole numbers; anchors has vec_id. An anchor's positives are its
    first `positives` other rows of its label, by inner product, ties by vec_id; of each, the first `negatives`
    rows of other labels whose score is between `lowest` and `highest` per cent of the positive's are returned.
    Where there are fewer, all are. Rows without id, label or list take no part; shorter lists count as
    filled up with zeros; products must fit in a long. Rows that repeat an id are rows of their own, also as
    anchors. Positives of negative score have no window. Other columns are not read.
    """
    spark = ship(rows.sparkSession)
    held = rows.select(F.col("vec_id").cast("long").alias("r_id"), F.col("label").cast("int").alias("label"), F.col("v").cast("array<long>").alias("v"))
    held = held.where("r_id is not null and label is not null and v is not null and not exists(v, x -> x is null)")
    held = held.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
    n = held.count()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    ranged = held.repartitionByRange(-(-n // block), F.desc("norm"), "r_id").select(F.monotonically_increasing_id().alias("r"), F.spark_partition_id().alias("block"), "*")
    blocks = written(ranged, "blocks")
    wanted = anchors.select(F.col("vec_id").cast("long").alias("r_id")).distinct()
    asked = written(blocks.join(wanted, "r_id", "left_semi").select(F.col("r").alias("q"), F.col("r_id").alias("q_id"), F.col("label").alias("q_label"), "v", "norm"), "anchors")
    chunks = max(1, -(-asked.count() // chunk))
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("p"), F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi")))
    good = written(_search(blocks, asked.withColumn("windows", whole), positives, True, chunks).select("q", F.col("r").alias("p"), F.col("r_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    share = "{0} * (positive_score div 100) + ({0} * (positive_score % 100) + {1}) div 100"  # of the score, rounded up or down
    per_cent = F.struct("p", F.expr(share.format(lowest, 99)).alias("lo"), F.expr(share.format(highest, 0)).alias("hi"))
    windows = good.where("positive_score >= 0").groupBy("q").agg(F.collect_list(per_cent).alias("windows"))
    bad = _search(blocks, asked.join(windows, "q"), negatives, False, chunks)
    return (
        bad.join(good, ["q", "p"])
        .join(asked.select("q", "q_id"), "q")
        .select(F.col("q_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("r_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def whole_numbers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v, the components times `scale` rounded down; rows with a null or non-finite component have no v."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.select("vec_id", "label", F.when(~odd, F.transform(x, lambda c: F.floor(c * scale))).alias("v"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return finished(lambda: mine(rows, rows.where("vec_id % 100 = 0")))
