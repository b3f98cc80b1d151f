"""Language-model scoring with a hidden Markov model over word classes.

Words are counted over all training text. The most frequent are classes of their own, more of them the more
distinct words there are (`own` at least, `heavy` at most); all others share classes by spelling (first two
and last three bytes), and a word's share of its class comes from its count. Latent states emit classes:
Baum-Welch runs over all training texts, whole, each task adding up expected counts for its partition, which
are summed across partitions by class; the scaled forward recursion then gives the exact log-probability of
every whole document. Nothing is learnt from held-out text, not even which words are frequent.

What is broadcast has a fixed bound: at most `heavy` words with their counts, and the state tables. Rarer
words, none of which holds more than about 1/heavy of the training tokens, are looked up by a join. A text of
n tokens takes about 100 n bytes in its task.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import documents, only, pieces, ship, utf8, worker_cache, written

STATES = 8
OWN = 1 << 14
SPELLED = 1 << 12
HEAVY = 1 << 18
#: An own class for so many distinct words.
WORDS_A_CLASS = 256
#: Longer texts wait for others of their kind, so that steps of the recursions are shared; about so many tokens at once.
SHORT = 512
AT_ONCE = 1_000_000
PASSES = 5
END = b""


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, and the end."""
    out = utf8(text).lower().split()
    out.append(END)
    return out


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the tokens of all texts, in a row, where each text's end); what tokens() gives, cut by Arrow."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    # the empty string after a last space is the end, as an empty text is
    ended = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(texts, " ", ""))
    lists = pc.ascii_split_whitespace(ended)
    ends = lists.offsets.to_numpy()[1:].astype(np.int64)
    return lists.values.cast(pa.binary()), ends


def spelled(word: bytes) -> int:
    return zlib.crc32(word[:2] + b"\0" + word[-3:]) % SPELLED


@dataclass
class Vocabulary:
    """The heavy words, most frequent first, and what every class holds in training text."""

    words: list[bytes]
    train: np.ndarray
    own: int
    total: int
    distinct: int
    held: np.ndarray  # tokens and distinct words of each spelled class
    kinds: np.ndarray

    def arrays(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
        """Index of each heavy word; its class, log10 of its base probability and of its share of its class."""
        cls = np.array([i if i < self.own else self.own + spelled(w) for i, w in enumerate(self.words)], np.int32)
        base = np.log10((self.train + 0.5) / (self.total + 0.5 * (self.distinct + 1)))
        share = np.zeros(len(self.words))
        rest = cls[self.own :] - self.own
        share[self.own :] = np.log10((self.train[self.own :] + 0.5) / (self.held[rest] + 0.5 * (self.kinds[rest] + 1)))
        # one more entry, for words that aren't there
        return {w: i for i, w in enumerate(self.words)}, np.r_[cls, np.int32(0)], np.r_[base, 0.0], np.r_[share, 0.0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", 16 << 20):
            words, _ = cut(part.column("text"))
            yield pa.RecordBatch.from_arrays(pc.value_counts(words).flatten(), ["word", "train"])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cls = pa.array([spelled(w) for w in batch.column("word").to_numpy(zero_copy_only=False).tolist()], pa.int32())
        yield pa.RecordBatch.from_arrays([cls, batch.column("train")], ["cls", "train"])


_ARRAYS: dict[str, tuple] = worker_cache("hmm")

ROWS = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base double, share double, "
    "classes array<int>, rare array<struct<word:binary,cls:int,tf:int>>"
)
_RARE = pa.list_(pa.struct([("word", pa.binary()), ("cls", pa.int32()), ("tf", pa.int32())]))


def _sequences(sent):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("hmm")
        if key not in _ARRAYS:
            _ARRAYS.clear()
            _ARRAYS[key] = (sent.value, *sent.value.arrays())
        vocabulary, index, cls_of, base_of, share_of = _ARRAYS[key]
        known_of = np.r_[vocabulary.train > 0, False]
        for batch in batches:
            for part in pieces(batch, "text"):
                flat, e = cut(part.column("text"))
                coded = flat.dictionary_encode()
                words, code = coded.dictionary, coded.indices.to_numpy()
                named = words.to_numpy(zero_copy_only=False)
                found = np.fromiter(map(index.get, named.tolist(), repeat(-1)), np.int64, len(words))
                kind = cls_of[found]
                kind[found < 0] = [vocabulary.own + spelled(w) for w in named[found < 0].tolist()]
                starts = np.r_[0, e[:-1]]
                add = lambda v: np.add.reduceat(np.where(found >= 0, v[found], 0)[code], starts)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, e].astype(np.int32)), pa.array(kind[code]))
                rare = np.flatnonzero((found < 0)[code])
                by_doc, tf = np.unique(np.searchsorted(e, rare, side="right") * len(words) + code[rare], return_counts=True)
                doc, which = np.divmod(by_doc, max(1, len(words)))
                rows = pa.StructArray.from_arrays([words.take(pa.array(which)), pa.array(kind[which]), pa.array(tf.astype(np.int32))], fields=list(_RARE.value_type))
                rares = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(e) + 1)).astype(np.int32)), rows)
                cols = [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array(e - starts),
                    pa.array(add(known_of).astype(np.int64)),
                    pa.array(add(base_of)),
                    pa.array(add(share_of)),
                    lists,
                    rares,
                ]
                names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "share", "classes", "rare"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


@dataclass
class Hmm:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states), rows sum to 1
    emit: np.ndarray  # (classes, states), columns sum to 1

    @property
    def states(self) -> int:
        return len(self.start)


def initial(counts: np.ndarray, states: int = STATES, seed: int = 7) -> Hmm:
    """Corpus frequencies with random tilts for each state, and states that last."""
    rng = np.random.default_rng(seed)
    emit = (counts[:, None] + 0.01) * np.exp(rng.normal(0, 1, (len(counts), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    if states == 1:
        move[:] = 1
    return Hmm(np.full(states, 1 / states), move, emit / emit.sum(0))


def _ordered(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences longest first, and how many of them reach each step."""
    order = np.argsort(-lengths, kind="stable")
    reach = np.bincount(lengths, minlength=1)[::-1].cumsum()[::-1]
    return order, reach[1:]


def _by_step(flat: np.ndarray, begin: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The classes that all sequences have at step 0, at step 1, and so on."""
    out = np.empty(int(reach.sum()), np.int64)
    i = 0
    for t, n in enumerate(reach.tolist()):
        out[i : i + n] = flat.take(begin[:n] + t)
        i += n
    return out


def log_likelihoods(model: Hmm, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural logs of the probabilities of class sequences, by the scaled forward recursion."""
    order, reach = _ordered(lengths)
    cls = _by_step(flat, starts[order], reach)
    logs = np.zeros(len(lengths))
    a = np.broadcast_to(model.start, (len(lengths), model.states))
    ones = np.ones(model.states)
    i = 0
    for n in reach.tolist():
        e = model.emit.take(cls[i : i + n], 0)  # take copies rows many times faster than an index does
        e *= a[:n] @ model.move if i else a
        s = e @ ones
        e /= s[:, None]
        logs[:n] += np.log(s)
        a = e
        i += n
    out = np.empty(len(lengths))
    out[order] = logs
    return out


def expected_counts(model: Hmm, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected first states, moves and emissions of class sequences."""
    k = model.states
    order, reach = _ordered(lengths)
    cls = _by_step(flat, starts[order], reach)
    move, emit = model.move.astype(np.float32), model.emit.astype(np.float32)
    ones, least = np.ones(k, np.float32), np.float32(1e-30)
    bounds = np.r_[0, np.cumsum(reach)].tolist()
    alpha = emit.take(cls, 0)
    scale = np.empty((len(cls), 1), np.float32)
    a = np.broadcast_to(model.start.astype(np.float32), (len(lengths), k))
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        here = alpha[i:j]
        here *= a[: j - i] @ move if i else a
        np.maximum(here @ ones, least, out=scale[i:j, 0])
        here /= scale[i:j]
        a = here
    moves = np.zeros((k, k))
    after = np.zeros((0, k), np.float32)  # emission x backward / scale, of the next step
    for i, j in zip(bounds[-2::-1], bounds[:0:-1], strict=True):
        m = len(after)
        here = emit.take(cls[i:j], 0)
        here /= scale[i:j]
        if m:
            reached = alpha[i : i + m]
            moves += (reached.T @ after) * move
            beta = after @ move.T
            reached *= beta
            here[:m] *= beta
        after = here
    alpha /= np.maximum(alpha @ ones, least)[:, None]
    first = alpha[: reach[0]].sum(0).astype(float) if len(reach) else np.zeros(k)
    emitted = np.stack([np.bincount(cls, alpha[:, j], minlength=len(emit)) for j in range(k)], 1)
    return first, moves, emitted


class Batches:
    """Sequences of like lengths together: short ones as they come, long ones when AT_ONCE tokens of them are there."""

    def __init__(self) -> None:
        self.long: list[np.ndarray] = []
        self.held = 0

    def add(self, flat: np.ndarray, offsets: np.ndarray) -> Iterator[list[np.ndarray]]:
        lengths = np.diff(offsets)
        order = np.argsort(lengths, kind="stable")
        short, held = [], 0
        for i in order.tolist():
            x = flat[offsets[i] : offsets[i + 1]]
            if len(x) > SHORT:
                if self.held and self.held + len(x) > AT_ONCE:
                    yield self.rest()
                self.long.append(np.array(x))
                self.held += len(x)
                continue
            short.append(x)
            held += len(x)
            if held > AT_ONCE:
                yield short
                short, held = [], 0
        if short:
            yield short

    def rest(self) -> list[np.ndarray]:
        out, self.long, self.held = self.long, [], 0
        return out


def _e_step(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Hmm = sent.value
        k, classes = model.states, len(model.emit)
        total = np.zeros((classes + k + 1, k))

        def count(sequences: list[np.ndarray]) -> None:
            if sequences:
                lengths = np.array([len(x) for x in sequences], np.int64)
                first, moves, emitted = expected_counts(model, np.concatenate(sequences), np.cumsum(lengths) - lengths, lengths)
                total[:classes] += emitted
                total[classes : classes + k] += moves
                total[-1] += first

        waiting = Batches()
        for batch in batches:
            lists = batch.column(0)
            for sequences in waiting.add(lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)):
                count(sequences)
        count(waiting.rest())
        keep = np.flatnonzero(total.any(1))
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), *(pa.array(total[keep, j]) for j in range(k))], ["row", *(f"s{j}" for j in range(k))])

    return run


def baum_welch(classes: DataFrame, counts: np.ndarray, states: int = STATES, passes: int = PASSES) -> Hmm:
    """Fit to the one array<int> column of `classes`; counts: tokens of each class in it."""
    spark = ship(classes.sparkSession)
    model = initial(counts, states)
    n = len(counts)
    schema = "row int, " + ", ".join(f"s{j} double" for j in range(states))
    for _ in range(passes):
        sent = spark.sparkContext.broadcast(model)
        sums = classes.mapInArrow(_e_step(sent), schema).groupBy("row").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(states)))
        got = sums.toPandas()
        total = np.zeros((n + states + 1, states))
        total[got["row"].to_numpy(int)] = got.drop(columns="row").to_numpy(float)
        emit = total[:n] + 0.02 * (counts[:, None] + 0.5) / (counts.sum() + 0.5 * n) + 1e-9
        move = total[n : n + states] + 0.1
        start = total[-1] + 0.1
        model = Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return model


def _forward(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Hmm = sent.value
        for batch in batches:
            lists = batch.column("classes")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            logs = log_likelihoods(model, lists.values.to_numpy(), offsets[:-1], np.diff(offsets)) / np.log(10)
            cols = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "classes"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(logs)], [*(x for x in batch.schema.names if x != "classes"), "hmm"])

    return run


def _vocabulary(counts: DataFrame, own: int, heavy: int) -> Vocabulary:
    totals = counts.agg(F.sum("train").alias("n"), F.count("*").alias("v")).first()
    # a top-k of this size would send k words from every task; a bound on the count, from a histogram, doesn't
    level = F.floor(F.log2("train") * 64)
    levels = sorted(((r["level"], r["words"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, room = math.inf, heavy
    for at, many in levels:
        if many > room:
            break
        least, room = at, room - many
    top = counts.where(level >= F.lit(float(least))).toPandas().sort_values(["train", "word"], ascending=[False, True])
    held, kinds = np.zeros(SPELLED), np.zeros(SPELLED)
    own = min(max(own, int(totals["v"]) // WORDS_A_CLASS), len(top))
    by_class = counts.mapInArrow(_classes, "cls int, train long").groupBy("cls").agg(F.sum("train").alias("n"), F.count("*").alias("v"))
    for r in by_class.collect():
        held[r["cls"]], kinds[r["cls"]] = r["n"], r["v"]
    words, train = [bytes(w) for w in top["word"]], top["train"].to_numpy(np.int64)
    for w, n in zip(words[:own], train[:own], strict=True):  # words that are classes of their own
        held[spelled(w)] -= n
        kinds[spelled(w)] -= 1
    return Vocabulary(words, train, own, int(totals["n"] or 0), int(totals["v"] or 0), held, kinds)


def score(docs: DataFrame, held_out: F.Column, states: int = STATES, passes: int = PASSES, own: int = OWN, heavy: int = HEAVY) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows where held_out is true aren't learnt from; null counts as false. Null and empty texts are the
    end alone; repeated rows count as often as they occur. With no training rows every word is unknown.
    Only doc_id, text and what held_out needs are read.
    """
    spark = ship(docs.sparkSession)
    src = documents(docs, F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = src.where("not held_out").select("text").mapInArrow(_count, "word binary, train long").groupBy("word").agg(F.sum("train").alias("train"))
    counts = written(counts, "counts")
    vocabulary = _vocabulary(counts, own, heavy)
    rows = src.mapInArrow(_sequences(spark.sparkContext.broadcast(vocabulary)), ROWS)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "sequences", compression="zstd")
    per_class = np.r_[vocabulary.train[: vocabulary.own], vocabulary.held].astype(float)
    model = baum_welch(rows.where("not held_out").select("classes"), per_class, states, passes)
    scored = rows.drop("rare").mapInArrow(
        _forward(spark.sparkContext.broadcast(model)),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base double, share double, row long, hmm double",
    )
    shares = [(vocabulary.own + i, float(h), float(k)) for i, (h, k) in enumerate(zip(vocabulary.held, vocabulary.kinds, strict=True))]
    per = F.broadcast(spark.createDataFrame(shares, "cls int, held double, kinds double"))
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    n = F.col("train")
    total = float(vocabulary.total + 0.5 * (vocabulary.distinct + 1))
    sums = (
        rare.join(counts, "word", "left")  # words that no training text has count 0
        .withColumn("train", F.coalesce("train", F.lit(0)))
        .join(per, "cls")
        .groupBy("row")
        .agg(
            F.sum(F.col("tf") * F.log10((n + 0.5) / total)).alias("rare_base"),
            F.sum(F.col("tf") * F.log10((n + 0.5) / (F.col("held") + 0.5 * (F.col("kinds") + 1)))).alias("rare_share"),
            F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("rare_known"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("rare_known")).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("hmm") + F.col("share") + zero("rare_share")).alias("score"),
    )


def op2_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
