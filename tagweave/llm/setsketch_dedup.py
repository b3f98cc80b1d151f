"""Near duplicates by SetSketch registers: bands of registers, likelihoods of similarity, exact sets.

Every shingle of a document throws points in time, a Poisson process of its own hash, each at a register;
a register holds the time of its first point, as the truncated exponent that it has to the base BASE.
Registers of a union are the larger ones of its parts, so sketches merge. Equal registers in all of a band
put two documents in a bucket.

Documents of equal sets are one class. A bucket isn't compared pair by pair: its most central class, the one
that shares most bands with most others, is the star that the others are held against. What remains of a
bucket in more than one component after that, and only that, is compared across its components: never two
classes that are known to be connected, so that a large group of near copies costs a comparison or so for
each copy. Before sets travel, the likelihood of the registers' orders (greater, less, equal) tells which
pairs can reach the similarity; links are confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import array_of, documents, finished, only, ship, smallest_reachable, whole_groups, written
from tagweave.llm.jaccard_join import digest, mix, shared_tokens, shingles

WORDS = 5
#: Links have 100 x intersection >= PER_CENT x union.
PER_CENT = 85
BAND = 8
BANDS = 36
REGISTERS = BAND * BANDS
BASE = 1.1
#: Exponents of one shingle alone are above 0; those of two thousand million are below 255.
OFFSET = 30
#: Chance that the likelihood drops a pair at the threshold: a normal deviate beyond the root of this.
RATIO = 30.0
#: Classes that one task compares with each other.
BRUTE = 1024
#: A-Z to a-z, and white space to spaces.
WORD_TABLE = bytes(32 if c in (9, 10, 11, 12, 13) else c + 32 if 65 <= c <= 90 else c for c in range(256))

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_POINTS = 1 << 17


def registers(tokens: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The sketch of a set of 64-bit hashes, as bytes; all zero for the empty set."""
    first = np.full(m, np.inf)
    for begin in range(0, len(tokens), _POINTS):
        _throw(first, tokens[begin : begin + _POINTS], len(tokens))
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(OFFSET - np.log(first / m) / math.log(BASE)), 0, 255).astype(np.uint8)


def _throw(first: np.ndarray, active: np.ndarray, size: int) -> None:
    """Points of the shingles `active`, one unit of time apart in the mean, until none can come first at any register."""
    m = len(first)
    time = np.zeros(len(active))
    expected = m * (math.log(m) + 1) / size
    thrown = 0
    while len(active):
        last = float(first.max())
        ahead = (last if last < np.inf else max(expected, time.mean() + 1)) - time.mean()
        n = int(min(max(1, math.ceil(ahead)), max(1, _POINTS // len(active))))
        h = mix(active[:, None] + np.arange(thrown + 1, thrown + n + 1, dtype=np.uint64) * _STEP)
        at = time[:, None] + np.cumsum(-np.log(((h >> _U(11)).astype(float) + 0.5) * 2.0**-53), axis=1)
        which = ((h & _U(0x7FF)) * _U(m)) >> _U(11)
        np.minimum.at(first, which.ravel().astype(np.int64), at.ravel())
        thrown += n
        time = at[:, -1]
        more = time < first.max()
        active, time = active[more], time[more]


def log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of a similarity j, where `more` registers of a set are above another's, `less` below; u: the set's share of both sizes."""
    share = (BASE - 1) / BASE
    v = 1 - u

    def chance(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.clip(x, 0, 1) * share) / math.log(BASE), 1e-12)

    over, under = chance(u - v * j), chance(v - u * j)
    return more * np.log(over) + less * np.log(under) + same * np.log(np.maximum(1 - over - under, 1e-12))


def estimate(more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The likeliest similarity."""
    lo, hi = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(20):
        third = (hi - lo) / 3
        up = log_likelihood(lo + third, more, less, same, u) < log_likelihood(hi - third, more, less, same, u)
        lo, hi = np.where(up, lo + third, lo), np.where(up, hi, hi - third)
    return (lo + hi) / 2


def possible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of sizes n and m with sketches a and b (pairs x registers) can have the similarity."""
    fits = np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9
    at = np.flatnonzero(fits)
    same, more = (a[at] == b[at]).sum(1), (a[at] > b[at]).sum(1)
    less = a.shape[1] - same - more
    u = n[at] / (n[at] + m[at])
    best = estimate(more, less, same, u)
    behind = log_likelihood(best, more, less, same, u) - log_likelihood(np.minimum(similarity, np.minimum(u / (1 - u), (1 - u) / u)), more, less, same, u)
    fits[at] = (best >= similarity) | (2 * behind <= RATIO)
    return fits


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("setsketch_dedup")
        for batch in batches:
            sets = [shingles(t, n, WORD_TABLE) for t in batch.column("text").to_pylist()]
            sketches = [registers(s).tobytes() if len(s) else b"" for s in sets]
            cols = [batch.column("doc_id"), pa.array([digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "c", "n", "registers"])

    return run


def _load(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("setsketch_dedup")
        for batch in batches:
            k, c = batch.column("k").to_pylist(), batch.column("c").to_pylist()
            for i, text in enumerate(batch.column("text").to_pylist()):
                s = shingles(text, n, WORD_TABLE)
                if digest(s) == c[i]:  # rows that share a doc_id may have other texts
                    yield pa.RecordBatch.from_arrays([pa.array([k[i]], pa.int64()), pa.array([s.tobytes()], pa.binary())], ["k", "tokens"])

    return run


def _likely(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("setsketch_dedup")
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("registers", "registers2"))
                n, m = (batch.column(c).to_numpy().astype(float) for c in ("n", "n2"))
                yield batch.filter(pa.array(possible(a, b, n, m, similarity))).select(["a", "b"])

    return run


def _linked(per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("setsketch_dedup")
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("tokens"), batch.column("tokens2"), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                hit.append(100 * both >= per_cent * (len(s) + len(t) - both))
            yield batch.filter(pa.array(hit, pa.bool_())).select(["a", "b"])

    return run


def _across(similarity: float):
    """Members of groups that may link to one of another component."""
    least = REGISTERS * similarity - 7 * math.sqrt(REGISTERS * similarity * (1 - similarity))  # equal registers, 7 deviations below the mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("setsketch_dedup")
        for table, bounds in whole_groups(batches, "g"):
            g, k, own, n = (array_of(table, c).to_numpy() for c in ("g", "k", "own", "n"))
            raw = np.frombuffer(b"".join(array_of(table, "registers").to_pylist()), np.uint8).reshape(-1, REGISTERS)
            keep = np.zeros(len(k), bool)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for i in range(lo, hi - 1):
                    j = i + 1 + np.flatnonzero(own[i + 1 : hi] != own[i])
                    j = j[(raw[j] == raw[i]).sum(1) >= least]
                    if len(j):
                        sizes = np.full(len(j), float(n[i]))
                        j = j[possible(np.broadcast_to(raw[i], (len(j), REGISTERS)), raw[j], sizes, n[j].astype(float), similarity)]
                        keep[i] |= len(j) > 0
                        keep[j] = True
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (g, k, own)], ["g", "k", "own"])

    return run


def _confirmed(per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("setsketch_dedup")
        for table, bounds in whole_groups(batches, "g"):
            k, own = (array_of(table, c).to_numpy() for c in ("k", "own"))
            tokens = array_of(table, "tokens")
            out = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                members = lo + np.unique(k[lo:hi], return_index=True)[1]
                sets = [np.frombuffer(tokens[int(i)].as_buffer(), np.uint64) for i in members]
                size = np.array([len(s) for s in sets], np.int64)
                i, j = np.nonzero(np.triu(own[members][:, None] != own[members], 1))
                both = shared_tokens(sets)[i, j].astype(np.int64)
                hit = 100 * both >= per_cent * (size[i] + size[j] - both)
                out += zip(k[members[i[hit]]].tolist(), k[members[j[hit]]].tolist(), strict=True)
            cols = list(zip(*out, strict=True)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return run


def _named(rows: DataFrame, components: DataFrame, k: str = "k", own: str = "own") -> DataFrame:
    """rows with the component of their class k."""
    found = components.select(F.col("k").alias(k), F.col("component").alias("_found"))
    return rows.join(found, k, "left").withColumn(own, F.coalesce("_found", k)).drop("_found")


def _merged(components: DataFrame, links: DataFrame) -> DataFrame:
    """(k, component) after links (a, b) between classes; classes on their own aren't in it."""
    if links.isEmpty():
        return components
    ends = _named(_named(links, components, "a", "a_own"), components, "b", "b_own")
    roots = written(smallest_reachable(ends.select(F.col("a_own").alias("a"), F.col("b_own").alias("b"))), "roots")
    new = roots.select(F.col("node").alias("k"), F.col("root").alias("component"))
    moved = components.join(roots, F.col("component") == F.col("node"), "left").select("k", F.coalesce("root", "component").alias("component"))
    return written(moved.union(new.join(components.select("k"), "k", "left_anti")), "components")


class _Sets:
    """Classes with their sizes, sketches and, for those asked for, sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame, n: int, per_cent: int):
        self.docs, self.classes, self.n, self.per_cent = docs, classes, n, per_cent

    def loaded(self, wanted: DataFrame) -> DataFrame:
        """(k, tokens) of the classes wanted (k, repeated or not), from a document of each."""
        need = self.classes.join(wanted.distinct(), "k", "left_semi").select("k", "c", F.col("rep").alias("doc_id"))
        sets = self.docs.join(need.hint("shuffle_hash"), "doc_id").select("k", "c", "text").mapInArrow(_load(self.n), "k long, tokens binary")
        return written(sets.dropDuplicates(["k"]), "tokens")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link."""
        one = self.classes.select(F.col("k").alias("a"), "n", "registers")
        two = self.classes.select(F.col("k").alias("b"), F.col("n").alias("n2"), F.col("registers").alias("registers2"))
        likely = written(pairs.join(one, "a").join(two, "b").select("a", "b", "n", "n2", "registers", "registers2").mapInArrow(_likely(self.per_cent / 100), "a long, b long"), "likely")
        sets = self.loaded(likely.select(F.col("a").alias("k")).union(likely.select("b")))
        one, two = sets.select(F.col("k").alias("a"), "tokens"), sets.select(F.col("k").alias("b"), F.col("tokens").alias("tokens2"))
        sent = likely.join(one, "a").join(two, "b").select("a", "b", "tokens", "tokens2")
        return written(sent.mapInArrow(_linked(self.per_cent), "a long, b long"), "links")


def _groups(rows: DataFrame, brute: int) -> DataFrame:
    """(g, k, own): rows (b, k, own) of buckets in several components, so dealt that rows of two components meet in a group.

    The largest component of a bucket is the main one, whose rows never meet. Buckets of more than `brute`
    rows are met chunk by chunk: main chunks with the others, and these with each other.
    """
    sizes = rows.groupBy("b", "own").agg(F.count("*").alias("s"))
    sizes = sizes.groupBy("b").agg(F.max(F.struct("s", "own")).alias("main"), F.sum("s").alias("m"), F.count("*").alias("parts")).where("parts > 1")
    rows = rows.join(written(sizes, "open"), "b").withColumn("half", F.lit(max(1, brute // 2)))
    rows = rows.withColumn("few", F.col("m") <= brute).withColumn("leads", F.col("own") == F.col("main.own"))
    rows = rows.withColumn("mains", F.ceil(F.col("main.s") / F.col("half"))).withColumn("others", F.ceil((F.col("m") - F.col("main.s")) / F.col("half")))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("k"), F.when(F.col("leads"), F.col("mains")).otherwise(F.col("others"))))
    with_main = F.transform(F.sequence(F.lit(0).cast("long"), F.when(F.col("leads"), F.col("others")).otherwise(F.col("mains")) - 1), lambda x: F.when(F.col("leads"), F.xxhash64("b", F.lit("m"), "side", x)).otherwise(F.xxhash64("b", F.lit("m"), x, "side")))
    with_others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda x: F.xxhash64("b", F.lit("o"), F.least(x, "side"), F.greatest(x, "side")))
    names = F.when(F.col("few"), F.array("b")).when(F.col("leads"), with_main).otherwise(F.concat(with_main, with_others))
    return rows.select(F.explode(names).alias("g"), "k", "own")


def components(docs: DataFrame, per_cent: int = PER_CENT, n: int = WORDS, brute: int = BRUTE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Documents link where 100 x intersection >= per_cent x union of their sets of distinct runs of n words;
    words are parted by white space and A-Z lower-cased. component_id is the smallest doc_id that links lead
    to. Texts of fewer words are one run; null, empty and wordless texts have no set, no links and their own
    doc_id. Rows without doc_id are linked with nothing, have a null component and are kept. Repeated rows
    are copies of each other. Columns but doc_id and text are not read.

    A pair at 0.85 shares no band with a chance of 1e-5, and the likelihood drops it with one of 1e-7.
    """
    spark = ship(docs.sparkSession)
    src = documents(docs).where("doc_id is not null")
    rows = written(src.mapInArrow(_describe(n), "doc_id long, c binary, n int, registers binary"), "sets")
    classes = rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("k"), "*"), "classes")
    sets = _Sets(src, classes, n, per_cent)
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * BAND + 1, F.lit(BAND))))
    named = classes.select("k", F.explode(band).alias("b"))
    shared = written(named.groupBy("b").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    buckets = written(named.join(shared, "b"), "buckets")
    central = buckets.groupBy("k").agg(F.sum("m").alias("w"))
    stars = buckets.join(central, "k").groupBy("b").agg(F.min(F.struct(-F.col("w"), "k")).alias("star")).select("b", F.col("star.k").alias("star"))
    pairs = buckets.join(stars, "b").where("k <> star").groupBy(F.col("k").alias("a"), F.col("star").alias("b")).agg(F.count("*").alias("bands"))
    pairs = written(pairs, "pairs")
    best = pairs.groupBy("a").agg(F.max(F.struct("bands", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    found = spark.createDataFrame([], "k long, component long")
    found = _merged(found, sets.links(best))
    ends = _named(_named(pairs, found, "a", "a_own"), found, "b", "b_own").where("a_own <> b_own")
    rest = ends.join(best, ["a", "b"], "left_anti").select("a", "b")
    found = _merged(found, sets.links(rest))
    groups = written(_groups(_named(buckets.select("b", "k"), found), brute), "groups")
    met = groups.join(classes.select("k", "n", "registers"), "k").select("g", "k", "own", "n", "registers")
    met = met.repartition("g").sortWithinPartitions("g", "k")
    wanted = written(met.mapInArrow(_across(per_cent / 100), "g long, k long, own long").distinct(), "wanted")
    sent = wanted.join(sets.loaded(wanted.select("k")), "k").select("g", "k", "own", "tokens")
    sent = sent.repartition("g").sortWithinPartitions("g", "k")
    found = _merged(found, written(sent.mapInArrow(_confirmed(per_cent), "a long, b long").distinct(), "late"))
    owned = written(_named(classes.select("k", "c", "rep"), found), "owned")
    least = owned.groupBy("own").agg(F.min("rep").alias("component_id"))
    answers = written(owned.join(least, "own").select("c", "component_id"), "answers")
    out = rows.select("doc_id", "c", "n").join(answers, "c", "left")
    lost = documents(docs).where("doc_id is null").select("doc_id", F.col("text"))
    lost = lost.mapInArrow(_counted(n), "doc_id long, n int").select("doc_id", "n", F.lit(None).cast("long").alias("component_id"))
    out = out.select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id")).union(lost)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _counted(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(shingles(t, n, WORD_TABLE)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32())], ["doc_id", "n"])

    return run


def op11_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return finished(lambda: components(docs))
