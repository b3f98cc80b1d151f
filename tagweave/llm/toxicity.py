"""Toxicity by compression distance.

zstandard dictionaries are trained on text (`train_dictionary`, the COVER algorithm, on windows of whole
texts), one on toxic and one on ordinary text as they are, of equal size. A document's text (A-Z
lower-cased, ASCII white space and punctuation as single spaces) is cut into windows of WIDE bytes over all
of it; a window's distance is its compressed length with the ordinary dictionary less that with the toxic
one.

Most of what two such dictionaries know is common to both kinds of text, so a finer pair stands beside them:
both hold a base trained on ordinary text, and one holds a short dictionary trained on what toxic text has
beyond that base, the other on what other ordinary text has beyond it (bytes that no `GRAM`-byte string of
the base covers, and a little around them). With these, windows of WINDOW bytes, half overlapping, are
compressed, as a toxic term in a long text changes a small window more.

Features are how many and what share of the windows reach each of several distances, their mean and extremes;
thresholds on them are calibrated by a logistic regression on documents that the dictionaries have not seen.

Learning uses a bounded sample: `max_docs` labelled rows of each class, drawn by hash, with all of their
text. Scoring covers every byte of every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import WORD_BYTES, documents, only, pieces, ship, utf8, words, worker_cache, written

MAX_DOCS = 2500
TRAINED = 512
KIND, BASE, OWN = 60_000, 60_000, 2_048
GRAM = 7
AROUND = 3
WINDOW = 64
WIDE = 256
DISTANCES = (1, 2, 4, 6, 8)
WIDE_DISTANCES = (2, 6, 12)
N_FEATURES = len(DISTANCES) + len(WIDE_DISTANCES) + 8


def plain(text: str | None) -> bytes:
    return b" " + b" ".join(utf8(text).translate(WORD_BYTES).split()) + b" "


def windows(data: bytes, size: int = WINDOW, step: int = WINDOW // 2) -> list[bytes]:
    """Windows that cover all of data; the last may be shorter."""
    return [data[i : i + size] for i in range(0, max(1, len(data) - size + step), step)]


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary's content from samples; the samples themselves where they are too few to train on."""
    whole = b"".join(samples)
    if len(whole) <= size or len(samples) < 16:
        return whole[-size:]
    try:
        return zstandard.train_dictionary(size, samples, k=16 if size < BASE else 32, d=6).as_bytes()
    except zstandard.ZstdError:
        return whole[-size:]


def grams(data: bytes) -> np.ndarray:
    """The strings of GRAM bytes (at most 7) at every place of data, as numbers."""
    held = data + b"\0" * 8
    return np.ndarray((len(data),), "<u8", held, 0, (1,)) & np.uint64((1 << 8 * GRAM) - 1)


def known_grams(samples: list[bytes]) -> np.ndarray:
    return np.unique(np.concatenate([grams(x)[: max(0, len(x) - GRAM + 1)] for x in samples] or [np.empty(0, np.uint64)]))


def beyond(data: bytes, known: np.ndarray) -> bytes:
    """What of data no known gram covers, with AROUND bytes on either side."""
    mine = grams(data)[: max(0, len(data) - GRAM + 1)]
    place = np.searchsorted(known, mine)
    place[place == len(known)] = 0
    at = np.flatnonzero(known[place] == mine) if len(known) else np.empty(0, np.int64)
    step = np.zeros(len(data) + GRAM + 1, np.int32)
    step[at] += 1
    step[at + GRAM] -= 1
    covered = np.cumsum(step)[: len(data)] > 0
    edge = np.flatnonzero(np.diff(np.r_[True, covered, True].astype(np.int8)))
    return b"".join(data[max(0, b - AROUND) : e + AROUND] for b, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


@dataclass(frozen=True)
class Model:
    """The contents of the dictionaries, toxic and ordinary, and the calibrated weights; some 250 KB."""

    kinds: tuple[bytes, bytes]
    fine: tuple[bytes, bytes]
    weights: tuple[float, ...] = ()
    bias: float = 0.0


def compressor(content: bytes):
    held = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=17, chain_log=17, search_log=5, min_match=4, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    content = zstandard.ZstdCompressionDict(content.rjust(64, b"\x03"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=held).compress


def of_one_size(pair: list[bytes], before: bytes = b"") -> tuple[bytes, bytes]:
    size = max(map(len, pair))
    one, other = (before + x.rjust(size, b"\x03") for x in pair)
    return one, other


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """The model without weights, from training windows of both classes; half of the ordinary ones train the base."""
    one, other = ordinary[::2], ordinary[1::2]
    base = trained(other, BASE)
    sides = ((toxic, ordinary), (one, other + toxic))
    own = [trained([x for w in side if (x := beyond(w, known))], OWN) for side, known in ((s, known_grams(t)) for s, t in sides)]
    return Model(of_one_size([trained(toxic, KIND), trained(ordinary, KIND)]), of_one_size(own, base))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.kinds = [compressor(x) for x in model.kinds]
        self.fine = [compressor(x) for x in model.fine]

    def distances(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows of WIDE bytes, by the two kinds of text, and of those of WINDOW bytes."""
        data = plain(text)
        cut = (self.kinds, windows(data, WIDE, WIDE)), (self.fine, windows(data))
        wide, fine = (np.array([len(ordinary(w)) - len(toxic(w)) for w in own], np.int64) for (toxic, ordinary), own in cut)
        return wide, fine

    def features(self, text: str | None) -> np.ndarray:
        wide, d = self.distances(text)
        out = [math.log1p(int((d >= t).sum())) for t in DISTANCES]
        shares = [math.sqrt((d >= 2).mean()), math.sqrt((d <= -2).mean())]
        of_kinds = [math.log1p(int((wide >= t).sum())) for t in WIDE_DISTANCES]
        return np.array([*out, *shares, int(d.max()) / 10, float(d.mean()), math.log1p(len(d)), *of_kinds, float(wide.mean()), int(wide.max()) / 10, int(wide.min()) / 10])

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.features(text), self.model.weights)) + self.model.bias
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest hash of five words in a row: near copies mostly share it."""
    for batch in batches:
        least = []
        for text in batch.column("text").to_pylist():
            w = words(text)
            least.append(min(xxhash.xxh64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))) >> 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], [*batch.schema.names, "h"])


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of TRAINED bytes, each with its document and place."""
    for batch in (piece for whole in batches for piece in pieces(whole, "text")):
        own = [windows(plain(text), TRAINED, TRAINED) for text in batch.column("text").to_pylist()]
        sizes = [len(x) for x in own]
        at = pa.array(np.repeat(np.arange(len(own)), sizes), pa.int64())
        place = np.concatenate([np.arange(n) for n in sizes]) if sizes else []
        cols = [batch.column("toxic").take(at), batch.column("h").take(at), pa.array(place, pa.int64()), pa.array([w for x in own for w in x], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["toxic", "h", "place", "window"])


_SCORERS: dict[Model, Scorer] = worker_cache("toxicity")


def scorer(model: Model) -> Scorer:
    only("toxicity")
    if model not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model] = Scorer(model)
    return _SCORERS[model]


def _features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(model)
        for batch in batches:
            rows = [s.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("h"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "h", "features"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Newton's method on standardised features, with the mean penalty `ridge`; weights for raw features."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        return np.zeros(x.shape[1] if x.ndim == 2 else 0), math.log((rate + 1e-6) / (1 - rate + 1e-6)) if len(y) else -10.0
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / std, np.ones(len(x))]
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty * w
        hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / std, float(w[-1] - (w[:-1] * mean / std).sum())


def in_fold(fold: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == fold


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, fold: int = 0) -> Model:
    """Fit on at most max_docs labelled rows of each class, none of them from the held-out fold.

    The model depends on the rows alone, not on how they are partitioned: rows are drawn by their doc_id's
    hash; of near copies (one smallest hash of five words) the smallest (doc_id, text) counts, with its
    label; windows come in the order of documents' hashes. A document with labels that conflict is toxic if
    one of them is; near copies with labels that conflict have the label of the one that counts. Rows without
    doc_id, rows whose label is null or not 0 or 1, and labels without document take no part; a doc_id that
    stands for several texts is drawn with all of them. Null and empty texts are one window of white space.
    Without labels of both classes the score is their share, or near 0 where there are none.
    """
    ship(docs.sparkSession)
    src = documents(docs).where("doc_id is not null")
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~in_fold(fold)).where("toxic in (0, 1)")
    there = known.join(src.select("doc_id").distinct(), "doc_id", "left_semi")
    drawn = [there.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs) for k in (0, 1)]
    sample = F.broadcast(drawn[0].union(drawn[1]).coalesce(1))  # at most 2 * max_docs rows of two numbers
    rows = src.join(sample, "doc_id").mapInArrow(_sketch, "doc_id long, text string, toxic int, h long")
    # near copies count once, or they'd make their own words look typical
    rows = rows.groupBy("h").agg(F.min(F.struct("doc_id", "text", "toxic")).alias("one")).select("h", "one.text", "one.toxic")
    rows = written(rows.withColumn("fit", F.pmod(F.xxhash64("h"), F.lit(3)) > 0), "labelled")
    cut = rows.where("fit").select("text", "toxic", "h").mapInArrow(_training_windows, "toxic int, h long, place long, window binary")
    # of a bounded number of documents
    sides = [[bytes(r["window"]) for r in cut.where(F.col("toxic") == k).orderBy("h", "place").select("window").collect()] for k in (1, 0)]
    model = dictionaries(*sides)
    seen = rows.where("not fit").select("text", "toxic", "h").mapInArrow(_features(model), "toxic int, h long, features array<double>").orderBy("h").collect()
    x = np.array([r["features"] for r in seen], float).reshape(len(seen), N_FEATURES)
    weights, bias = fit_logistic(x, np.array([r["toxic"] for r in seen], float))
    return Model(model.kinds, model.fine, tuple(float(v) for v in weights), bias)


def _score(model: Model, at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(model)
        for batch in batches:
            scores = [s.score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return run


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with `score`, 0 to 1; a column of that name is replaced.

    Null and empty texts are one window of white space and get the score of no evidence; repeated rows get
    equal scores. A model without toxic or without ordinary labels knows only their share.
    """
    ship(docs.sparkSession)
    docs = docs.drop(name).withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{name}` double"
    return docs.mapInArrow(_score(model, docs.columns.index("text"), name), schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(documents(docs), model)
    return out.select("doc_id", in_fold(0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
