"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items (questions and answers) become windows of `window` consecutive normalised words; an
item of fewer words, but not none, is one window. All windows of a block of items go into one
automaton, and every document's normalised text is scanned once; a match's end gives word numbers
and, through the words' places, offsets in the original text.

The automaton is broadcast. Its size is bounded: `block_bytes` of a worker at most; a larger
benchmark is cut into blocks of items, each with its own scan, and the documents' hits are merged.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from itertools import chain
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import documents, only, ship, words, worker_cache, written

WINDOW = 10
#: Bytes of a worker's automaton; larger benchmarks are met block by block.
BLOCK_BYTES = 64 << 20
#: Bytes of a trie's node with the link to it, and of what a window stands for.
NODE, VALUE = 56, 300
#: The words of common.words(), before lower-casing.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def windows(text: str | None, window: int = WINDOW) -> set[bytes]:
    w = words(text)
    if not w:
        return set()
    return {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))}


def automaton(items: list[tuple[str, str | None]], window: int = WINDOW) -> ahocorasick.Automaton:
    """Matches ` w1 w2 ... ` in ` text `; a value is (number of words, items that have the window)."""
    found: dict[bytes, list[str]] = {}
    for item, text in items:
        for x in windows(text, window):
            found.setdefault(x, []).append(item)
    a = ahocorasick.Automaton()
    for x, ids in found.items():
        a.add_word(f" {x.decode('utf-8', 'surrogatepass')} ", (x.count(b" ") + 1, sorted(set(ids))))
    if found:
        a.make_automaton()
    return a


def scan(a: ahocorasick.Automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged runs [first, last) of hit words, and the items found."""
    w = words(text)
    if not w or not len(a):
        return len(w), [], set()
    flat = b" ".join(w).decode("utf-8", "surrogatepass")
    ends: list[int] | None = None
    runs: list[tuple[int, int]] = []
    items: set[str] = set()
    for end, (n, ids) in a.iter(f" {flat} "):
        if ends is None:  # the place of the space after each word, counted with the leading space
            ends, at = [], 0
            for x in flat.split(" "):
                at += len(x) + 1
                ends.append(at)
        last = bisect.bisect_left(ends, end) + 1
        items.update(ids)
        runs.append((last - n, last))
    merged: list[tuple[int, int]] = []
    for b, e in sorted(runs):
        if merged and b <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], e))
        else:
            merged.append((b, e))
    return len(w), merged, items


def original_spans(text: str | None, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of runs of words."""
    if not runs:
        return []
    at = [m.span() for m in WORD.finditer(text or "")]
    return [(at[b][0], at[e - 1][1]) for b, e in runs]


def _runs(item: tuple[str | None, str], most: int, window: int) -> Iterator[tuple[int, tuple[str | None, str]]]:
    """(bytes, item) for an item, or for runs of its windows where all of them would take more than `most` bytes."""
    w = words(item[1])
    if not w:
        return
    sizes = np.r_[0, np.cumsum([len(x) + 1 for x in w])]
    count = max(1, len(w) - window + 1)
    costs = np.cumsum(NODE * (sizes[np.minimum(np.arange(count) + window, len(w))] - sizes[:count] + 1) + VALUE)
    begin, before = 0, 0
    while begin < count:
        end = max(begin + 1, int(np.searchsorted(costs, before + most, "right")))
        yield int(costs[end - 1] - before), (item[0], b" ".join(w[begin : end + window - 1]).decode("utf-8", "surrogatepass"))
        begin, before = end, int(costs[end - 1])


def _blocks(items: Iterator[tuple[str | None, str]], most: int, window: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items whose automaton takes at most so many bytes; large items in several blocks. One window at least."""
    held: list[tuple[str | None, str]] = []
    size = 0
    for item in items:
        for n, run in _runs(item, most, window):
            if held and size + n > most:
                yield held
                held, size = [], 0
            held.append(run)
            size += n
    if held:
        yield held


def _items(benchmark: DataFrame) -> Iterator[tuple[str | None, str]]:
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null")
    return ((r[0], r[1]) for r in rows.toLocalIterator())


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items (sorted), spans (offsets in the text).

    Null and empty texts have no words and no hits; benchmark rows without words have no window; items
    that share a window are all reported, those without item_id as one null at the end; repeated documents and ids are rows of their own; other
    columns of either table are not read. The benchmark, a set of questions, passes the driver in
    blocks whose automaton takes `block_bytes` in a worker; each is a broadcast and a scan of its own. An item
    of more windows than fit is in several blocks.
    """
    spark = ship(docs.sparkSession)
    blocks = _blocks(_items(benchmark), block_bytes, window)
    first, second = next(blocks, []), next(blocks, None)
    src = documents(docs)
    if second is None:
        return src.mapInArrow(_scanner(spark, first, window), _SPANS)
    src = written(src.withColumn("row", F.monotonically_increasing_id()), "docs")
    both = None
    for block in chain([first, second], blocks):  # one block at a time on the driver
        part = written(src.mapInArrow(_scanner(spark, block, window), _SPANS_ROW), "scan")
        both = part if both is None else both.union(part)
    merged = both.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    return merged.join(src.select("row", "text"), "row").mapInArrow(_merge, _SPANS)


_SPANS = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_SPANS_ROW = _SPANS + ", row long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several scans may overlap: merge them and count the words they cover."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            spans: list[list[int]] = []
            for s in r["spans"]:
                if spans and s["start"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], s["end"])
                else:
                    spans.append([s["start"], s["end"]])
            hit = sum(len(words(r["text"][b:e])) for b, e in spans)
            out.append((r["doc_id"], r["n_words"], hit, r["items"], [{"start": b, "end": e} for b, e in spans]))
        yield _batch(out, False)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _batch(out: list[tuple], row: bool) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[] for _ in range(5 + row)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), _SPAN] + [pa.int64()] * row
    names = ["doc_id", "n_words", "n_hit", "items", "spans"] + ["row"] * row
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


_BUILT: dict[str, ahocorasick.Automaton] = worker_cache("decontaminate")


def _scanner(spark: SparkSession, items: list[tuple[str, str | None]], window: int):
    key = hashlib.sha256(repr((items, window)).encode("utf-8", "surrogatepass")).hexdigest()
    sent = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("decontaminate")
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = automaton(sent.value, window)
        a = _BUILT[key]
        for batch in batches:
            cols = batch.to_pydict()
            row = "row" in cols
            out = []
            for i, text in enumerate(cols["text"]):
                n, runs, found = scan(a, text)
                spans = [{"start": b, "end": e} for b, e in original_spans(text, runs)]
                out.append((cols["doc_id"][i], n, sum(e - b for b, e in runs), sorted(found, key=lambda x: (x is None, x or "")), spans) + ((cols["row"][i],) if row else ()))
            yield _batch(out, row)

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs."""
    spark = ship(docs.sparkSession)
    window, most = kw.get("window", WINDOW), kw.get("block_bytes", BLOCK_BYTES)
    blocks = _blocks(_items(benchmark), most, window)
    items = next(blocks, None)
    while items is not None:
        docs = docs.mapInArrow(_cleaner(spark, items, window, docs.columns.index("text")), docs.schema)
        items = next(blocks, None)
        if items is not None:
            docs = written(docs, "cleaned")
    return docs


def _cleaner(spark: SparkSession, items: list[tuple[str, str | None]], window: int, at: int):
    key = hashlib.sha256(repr((items, window)).encode("utf-8", "surrogatepass")).hexdigest()
    sent = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("decontaminate")
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = automaton(sent.value, window)
        a = _BUILT[key]
        for batch in batches:
            yield batch.filter(pa.array([not scan(a, t)[1] for t in batch.column(at).to_pylist()], pa.bool_()))

    return run


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
