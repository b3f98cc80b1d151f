"""Line deduplication with a sharded minimal perfect hash.

Distinct line hashes (128 bits) are dealt to shards of about `shard_keys` keys. Each shard becomes a
minimal perfect hash, a cascade of bitmaps with ranks, that leads to compact arrays: a fingerprint,
the number of rows that hold the line, and the smallest and largest doc_id among them. Documents send
line hashes to the shards and probe the arrays; lines themselves are never joined.

The most frequent keys (`hot_keys` at most) are one more such index, broadcast whole, and never travel:
any other key has at most 1/hot_keys of all probes, so no shard gets a lump of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import fresh, only, ship, utf8, written

MIN_CHARS = 10
SHARD_KEYS = 1 << 17
HOT_KEYS = 4096
NO_DOC = np.iinfo(np.int64).min


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The stripped and lower-cased line, or None if it is too short to count."""
    key = line.strip().lower()
    n = len(key)
    if n < min_chars or (n < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return key


def line_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def as_pair(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (h2.view(np.uint64) + np.uint64(0xD1B54A32D192ED03 * (level + 1) & (2**64 - 1)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys: level by level, keys alone at their place stay there."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, gamma: float = 1.6) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # base, bits, rank before each byte
        base = 0
        while len(h1):
            m = max(64, int(gamma * len(h1)) + 7 & ~7)
            at = (_mix(h1, h2, len(self.levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            bits = np.packbits(alone)
            ranks = np.zeros(len(bits), np.int64)
            np.cumsum(alone.reshape(-1, 8).sum(1)[:-1], out=ranks[1:])
            self.levels.append((base, bits, ranks.astype(np.uint32)))
            base += int(alone.sum())
            stay = ~alone[at]
            h1, h2 = h1[stay], h2[stay]
            if len(self.levels) > 200:
                raise ValueError("keys must be distinct")
        self.size = base

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key; a key that isn't there gets any slot, or -1."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, (base, bits, ranks) in enumerate(self.levels):
            at = (_mix(h1[left], h2[left], level) % np.uint64(len(bits) * 8)).astype(np.int64)
            byte, bit = at >> 3, at & 7
            here = bits[byte]
            hit = (here >> (7 - bit)) & 1 == 1
            before = _POP[here >> (8 - bit).astype(np.uint8)]
            out[left[hit]] = base + ranks[byte[hit]] + before[hit]
            left = left[~hit]
        return out


_POP = np.array([bin(i).count("1") for i in range(256)], np.int64)


def build_index(h1: np.ndarray, h2: np.ndarray, count: np.ndarray, least: np.ndarray, most: np.ndarray) -> dict:
    ph = PerfectHash(h1, h2)
    at = ph.find(h1, h2)
    arrays = {"ph": ph}
    for name, values in (("fingerprint", h2), ("count", count), ("least", least), ("most", most)):
        arrays[name] = np.empty(ph.size, np.int64)
        arrays[name][at] = values
    return arrays


def probe(index: dict, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, repeated, least) of each key: whether it is there, under two documents or more, and the smallest."""
    at = index["ph"].find(h1, h2)
    if not index["ph"].size:
        return np.zeros(len(h1), bool), np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
    found = (at >= 0) & (index["fingerprint"][at] == h2)
    # a count of 1 settles it; rows of one doc_id may count twice, so the largest doc_id decides the rest
    return found, found & (index["count"][at] > 1) & (index["least"][at] != index["most"][at]), index["least"][at]


def _keys(text: str | None, min_chars: int) -> list[bytes]:
    found = {k for line in utf8(text).split(b"\n") if (k := line_key(line, min_chars)) is not None}
    return [line_hash(k) for k in found]


def _emit(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("line_dedup")
        for batch in batches:
            ids, digests = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if doc is not None:
                    found = _keys(text, min_chars)
                    digests += found
                    ids += [doc] * len(found)
            pair = as_pair(digests)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["doc_id", "h1", "h2"])

    return run


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    a = {c: pdf[c].to_numpy(np.int64) for c in ("h1", "h2", "n", "least", "most")}
    blob = pickle.dumps(build_index(a["h1"], a["h2"], a["n"], a["least"], a["most"]), protocol=5)
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "arrays": [blob]})


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, place): a shard's arrays come first, then its probes, a batch at a time."""
    only("line_dedup")
    held, index = None, None
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        edge = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)] if len(shard) else [0]
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if held != shard[lo]:
                held, index = shard[lo], None
            part = batch.slice(lo, hi - lo)
            first = part.column("arrays")[0]
            if first.is_valid:
                index, part = pickle.loads(first.as_py()), part.slice(1)
            if index is None or not part.num_rows:
                continue
            h1, h2, doc = (part.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
            _, repeated, least = probe(index, h1.copy(), h2.copy())
            lose = pa.array(repeated & (doc != least))
            yield part.select(["doc_id", "h1", "h2"]).filter(lose)


def _finish(at_id: int, at_text: int, min_chars: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("line_dedup")
        index = pickle.loads(hot.value)
        for batch in batches:
            n_lines, n_dropped, texts = [], [], []
            drops = batch.column(batch.num_columns - 1)
            for doc, text, gone in zip(batch.column(at_id).to_pylist(), batch.column(at_text).to_pylist(), drops.to_pylist(), strict=True):
                lines = utf8(text).split(b"\n")
                n_lines.append(len(lines))
                keys = [line_key(x, min_chars) for x in lines] if doc is not None else [None] * len(lines)
                digests = [line_hash(k) for k in keys if k is not None]
                lost: set[bytes] = set()
                if digests and index["ph"].size:
                    pair = as_pair(digests)
                    _, repeated, least = probe(index, pair[:, 0].copy(), pair[:, 1].copy())
                    lost = {d for d, x in zip(digests, repeated & (least != doc), strict=True) if x}
                lost.update(gone or ())
                if lost:
                    kept = [x for x, k in zip(lines, keys, strict=True) if k is None or line_hash(k) not in lost]
                    n_dropped.append(len(lines) - len(kept))
                    texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                else:
                    n_dropped.append(0)
                    texts.append(text or "")
            cols = batch.columns[:-1]
            cols[at_text] = pa.array(texts, pa.string())
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = np.stack([batch.column("h1").to_numpy(), batch.column("h2").to_numpy()], 1).astype("<i8").tobytes()
        keys = [raw[i : i + 16] for i in range(0, len(raw), 16)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary())], ["id", "key"])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """docs with repeated lines taken out of `text`, and n_lines (before) and n_dropped.

    A line's key is the line, stripped of ASCII white space and with A-Z lower-cased. A key of at least
    `min_chars` code points found under two or more doc_ids loses its lines everywhere but in the
    smallest. Null and empty texts are one empty line; rows of one doc_id count as one document and are
    treated alike; rows without doc_id neither count nor lose lines. Other columns stay as they are,
    but for columns named n_lines and n_dropped, which are replaced.
    """
    spark = ship(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    lines = docs.select("doc_id", "text").mapInArrow(_emit(min_chars), "doc_id long, h1 long, h2 long")
    lines = written(lines, "lines")
    keys = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    keys = written(keys, "keys")
    top = keys.where("least <> most").orderBy(F.desc("n"), "h1", "h2").limit(hot_keys).toPandas()
    hot = build_index(*(top[c].to_numpy(np.int64) for c in ("h1", "h2", "n", "least", "most")))
    sent = spark.sparkContext.broadcast(pickle.dumps(hot, protocol=5))
    shards = max(1, -(-keys.count() // shard_keys))
    shard = F.pmod(F.col("h1"), F.lit(shards)).cast("long").alias("shard")
    index = written(keys.select("*", shard).groupBy("shard").applyInPandas(_build, "shard long, arrays binary"), "index")

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pickle.loads(sent.value)
        for batch in batches:
            found, _, _ = probe(held, batch.column("h1").to_numpy().copy(), batch.column("h2").to_numpy().copy())
            yield batch.filter(pa.array(~found))

    probes = lines.mapInArrow(cold, lines.schema).select("*", shard)
    lost = fresh(docs, "lost")
    none = F.lit(None)
    both = index.select("shard", none.cast("long").alias("h1"), none.cast("long").alias("h2"), none.cast("long").alias("doc_id"), "arrays", F.lit(0).alias("place"))
    both = both.union(probes.select("shard", "h1", "h2", "doc_id", none.cast("binary").alias("arrays"), F.lit(1).alias("place")))
    both = both.repartition("shard").sortWithinPartitions("shard", "place")  # streamed: no shard's probes are held whole
    drops = both.drop("place").mapInArrow(_probe, "doc_id long, h1 long, h2 long")
    drops = drops.mapInArrow(_pack, "id long, key binary").groupBy("id").agg(F.collect_set("key").alias(lost))
    both = docs.join(drops.hint("shuffle_hash"), docs["doc_id"] == drops["id"], "left").select(*[docs[c] for c in docs.columns], drops[lost])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_lines long, n_dropped long"
    return both.mapInArrow(_finish(docs.columns.index("doc_id"), docs.columns.index("text"), min_chars, sent), schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
