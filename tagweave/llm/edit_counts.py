"""Token counts that follow edits.

A document's pre-tokens are kept in leaves of about `LEAF` words, and a segment tree over the leaves holds the
numbers of characters, pre-tokens and tokens below every node. An edit descends to the leaf where it
starts, steps back until the text before is out of reach of any pre-token rule, cuts and encodes anew
from there until a boundary falls on the start of a later leaf, and updates the sums above what changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import documents, only, pieces, ship, utf8, worker_cache
from tagweave.llm.tokens import BYTE_LEVEL, CROWDED, Encoder, pattern, public_path, shown

TOKENIZER = "byte_bpe_50k.json"
LEAF = 64
#: Characters after a pre-token that can decide where it ends: an apostrophe looks at two, others at one.
REACH = 3
_SPLIT = pattern(BYTE_LEVEL)


class Counter:
    """Tokens of pre-tokens; every distinct one is encoded once. Special strings are ordinary text."""

    def __init__(self, path: str) -> None:
        self.encoder = Encoder(path, special=False)

    def counts(self, pre: list[str]) -> np.ndarray:
        return np.fromiter(map(len, self.encoder.ids(list(map(shown, pre)))), np.int64, len(pre)) // 4

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows (characters, pre-tokens, tokens) of the texts' parts, and where each text's rows end.

        Parts are words between lone spaces, each with the space before it (a space that no space precedes
        always begins a pre-token), else pre-tokens. Every distinct word of the texts is cut and counted once.
        """
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
        offsets -= offsets[0]
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = self._cut_rows(words, " ")
        which = coded.indices.to_numpy().astype(np.int64)
        first = [words[i] for i in which[offsets[:-1]].tolist()]
        own = list(dict.fromkeys(first))
        at = {w: len(rows) + i for i, w in enumerate(own)}
        rows = np.concatenate([rows, self._cut_rows(own, "")])
        which[offsets[:-1]] = [at[w] for w in first]
        out, ends = rows[which], offsets[1:]
        crowded = np.flatnonzero(pc.match_substring_regex(texts, CROWDED).to_numpy(zero_copy_only=False))
        empty = np.flatnonzero(pc.binary_length(texts).to_numpy() == 0)
        if len(crowded) or len(empty):  # cut whole; an empty text has no parts
            parts, begin = [], np.r_[0, ends]
            whole = dict.fromkeys(crowded.tolist()) | dict.fromkeys(empty.tolist())
            last, sizes = 0, np.diff(begin)
            for i in sorted(whole):
                parts.append(out[begin[last] : begin[i]])
                pre = _SPLIT.findall(texts[i].as_py())
                parts.append(np.stack([np.fromiter(map(len, pre), np.int64, len(pre)), np.ones(len(pre), np.int64), self.counts(pre)], 1))
                sizes[i], last = len(pre), i + 1
            parts.append(out[begin[last] :])
            out, ends = np.concatenate(parts), np.cumsum(sizes)
        return out, ends

    def _cut_rows(self, words: list[str], before: str) -> np.ndarray:
        cuts = [self._cut(w, before) for w in words]
        n = np.fromiter(map(len, cuts), np.int64, len(cuts))
        total = np.r_[0, np.cumsum(self.counts([p for c in cuts for p in c]))]
        ends = np.cumsum(n)
        return np.stack([np.fromiter(map(len, words), np.int64, len(words)) + len(before), n, total[ends] - total[ends - n]], 1)

    def _cut(self, word: str, before: str) -> list[str]:
        if word.isalpha():
            return [before + word]
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return [before + word[:-1], word[-1]]
        return _SPLIT.findall(before + word)


class SegmentTree:
    """Sums of (characters, pre-tokens, tokens) over the leaves of one document."""

    def __init__(self, text: str, counter: Counter, units: np.ndarray | None = None) -> None:
        self.text, self.counter, self.encoded = text, counter, 0
        self._build(counter.units(pa.array([text]))[0] if units is None else units)

    @classmethod
    def of_leaves(cls, text: str, counter: Counter, leaves: np.ndarray) -> SegmentTree:
        """The tree of a text whose leaves' sums were kept."""
        tree = cls.__new__(cls)
        tree.text, tree.counter, tree.encoded = text, counter, 0
        tree._grow(leaves)
        return tree

    def _build(self, units: np.ndarray) -> None:
        self._grow(np.add.reduceat(units, np.arange(0, len(units), LEAF), axis=0) if len(units) else np.zeros((1, 3), np.int64))

    def _grow(self, leaves: np.ndarray) -> None:
        self.size = 1 << (max(1, len(leaves)) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 3), np.int64)
        self.sums[self.size : self.size + len(leaves)] = leaves
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def leaves(self) -> np.ndarray:
        """Sums of the leaves, to be kept; empty ones at the end are left out."""
        low = self.sums[self.size :]
        full = np.flatnonzero(low[:, 0])
        return low[: full[-1] + 1 if len(full) else 1]

    @property
    def totals(self) -> tuple[int, int, int]:
        return tuple(int(x) for x in self.sums[1])

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf starts; the last for the end of the text."""
        at, start = 1, 0
        while at < self.size:
            at *= 2
            left = int(self.sums[at, 0])
            if place >= start + left and self.sums[at + 1, 0]:
                start += left
                at += 1
        return at - self.size, start

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace text[start:end]; bounds are brought into the text."""
        start = min(max(0, start), len(self.text))
        end = min(max(start, end), len(self.text))
        leaf, begin = self._leaf_at(start)
        while leaf > 0 and begin + REACH > start:
            leaf -= 1
            begin -= int(self.sums[self.size + leaf, 0])
        self.text = self.text[:start] + replacement + self.text[end:]
        shift = len(replacement) - (end - start)
        after, bound = leaf + 1, begin + int(self.sums[self.size + leaf, 0])  # the first leaf that may stay, and its start
        while after < self.size and bound < end:
            bound += int(self.sums[self.size + after, 0])
            after += 1
        bound += shift
        pre, at = [], begin
        for m in _SPLIT.finditer(self.text, begin):
            while after < self.size and bound < at:
                bound += int(self.sums[self.size + after, 0])
                after += 1
            if at == bound and at >= start + len(replacement):
                break
            pre.append(m.group())
            at = m.end()
        else:
            after = self.size
        self.encoded += len(pre)
        counts = self.counter.counts(pre) if pre else np.zeros(0, np.int64)
        if len(pre) > 4 * LEAF * max(1, after - leaf):
            # too many for the old leaves: the touched ones are cut anew and the tree grows; no text is encoded again
            low = self.sums[self.size : 2 * self.size]
            units = np.stack([np.fromiter(map(len, pre), np.int64, len(pre)), np.ones(len(pre), np.int64), counts], 1)
            new = np.add.reduceat(units, np.arange(0, len(units), LEAF), axis=0)
            held = np.concatenate([low[:leaf], new, low[after:]])
            self._grow(held[held[:, 0] > 0] if held[:, 0].any() else held[:1])
            return
        changed = np.arange(leaf, after)
        share = -(-len(pre) // max(1, len(changed)))
        low = self.sums[self.size : 2 * self.size]
        for i, x in enumerate(changed.tolist()):
            own = slice(i * share, (i + 1) * share)
            low[x] = (sum(map(len, pre[own])), len(pre[own]), int(counts[own].sum()))
        up = np.unique((changed + self.size) // 2)
        while len(up) and up[0] >= 1:
            self.sums[up] = self.sums[2 * up] + self.sums[2 * up + 1]
            up = np.unique(up // 2)


_HELD: dict[str, Counter] = worker_cache("edit_counts")

#: Leaves and the SHA-256 of the text that they are of.
LEAVES = "struct<of:binary,sums:array<struct<chars:long,pretokens:long,tokens:long>>>"
COUNTS = "n_edits long, n_tokens long, n_tokens_edited long, n_pretokens long, n_pretokens_edited long, n_encoded_again long"
SCHEMA = f"doc_id long, {COUNTS}, edited string, leaves {LEAVES}"


def _of(text: str) -> bytes:
    return hashlib.sha256(utf8(text)).digest()


def _kept(trees: list[tuple[bytes, np.ndarray]]) -> pa.Array:
    flat = np.concatenate([x for _, x in trees]) if trees else np.zeros((0, 3), np.int64)
    struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, j])) for j in range(3)], ["chars", "pretokens", "tokens"])
    sums = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for _, x in trees])].astype(np.int32)), struct)
    return pa.StructArray.from_arrays([pa.array([of for of, _ in trees], pa.binary()), sums], ["of", "sums"])


def _trees(part: pa.RecordBatch, counter: Counter) -> Iterator[SegmentTree]:
    """The trees of a part's texts: from kept leaves where these are of the text, else counted."""
    texts = part.column("text")
    plain = texts.to_pylist()
    fits = [False] * len(plain)
    if "leaves" in part.schema.names:
        held = [v or {"of": None, "sums": None} for v in part.column("leaves").to_pylist()]
        sums = [np.array([[x["chars"], x["pretokens"], x["tokens"]] for x in v["sums"] or ()], np.int64).reshape(-1, 3) for v in held]
        fits = [bool(len(x)) and v["of"] == _of(t or "") for x, v, t in zip(sums, held, plain, strict=True)]
    missing = [i for i, f in enumerate(fits) if not f]
    units, ends = counter.units(texts.take(pa.array(missing, pa.int64()))) if missing else (None, np.zeros(0, np.int64))
    spans = dict(zip(missing, zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True), strict=True)) if missing else {}
    for i, text in enumerate(plain):
        if fits[i]:
            yield SegmentTree.of_leaves(text or "", counter, sums[i])
        else:
            b, e = spans[i]
            yield SegmentTree(text or "", counter, units[b:e])


def _counter(path: str) -> Counter:
    only("edit_counts")
    if path not in _HELD:
        _HELD[path] = Counter(path)
    return _HELD[path]


def _count(path: str, digest: bool):
    """digest: the edited text's SHA-256 in place of the text and of the leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for part in pieces(batch, "text"):
                out, edited, kept = [], [], []
                for edits, tree in zip(part.column("edits").to_pylist(), _trees(part, counter), strict=True):
                    _, pre, tokens = tree.totals
                    done = [e for e in edits or () if e is not None and e["start"] is not None]
                    for e in done:
                        tree.edit(e["start"], e["start"] if e["end"] is None else e["end"], e["replacement"] or "")
                    _, pre_now, tokens_now = tree.totals
                    out.append((len(done), tokens, tokens_now, pre, pre_now, tree.encoded))
                    edited.append(hashlib.sha256(tree.text.encode("utf-8", "surrogatepass")).hexdigest() if digest else tree.text)
                    if not digest:
                        kept.append((_of(tree.text), tree.leaves))
                cols = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True)), pa.array(edited, pa.string())]
                names = ["doc_id", *(c.split()[0] for c in COUNTS.split(", ")), "edited_sha256" if digest else "edited"]
                if not digest:
                    cols.append(_kept(kept))
                    names.append("leaves")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _leaves(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for part in pieces(batch, "text"):
                kept = _kept([(_of(t.text), t.leaves) for t in _trees(part, counter)])
                yield pa.RecordBatch.from_arrays([*part.columns, kept], [*part.schema.names, "leaves"])

    return run


def with_leaves(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text, leaves): the leaves of each document's segment tree, to be kept in a table beside the documents.

    count_tokens takes them up, so that later edits encode what they touch and nothing else.
    """
    ship(docs.sparkSession)
    return documents(docs).mapInArrow(_leaves(tokenizer or public_path(TOKENIZER)), f"doc_id long, text string, leaves {LEAVES}")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the array `edits` of each doc_id: rows (doc_id, seq, start, end, replacement), in the order of seq."""
    kept = F.array_sort(F.collect_list(F.struct("seq", "start", "end", "replacement")))
    lists = edits.groupBy("doc_id").agg(F.transform(kept, lambda x: x.dropFields("seq")).alias("edits"))
    return docs.drop("edits").join(lists.hint("shuffle_hash"), "doc_id", "left")


def count_tokens(docs: DataFrame, tokenizer: str | None = None, digest: bool = False) -> DataFrame:
    """Token counts before and after the edits of each row of docs (doc_id, text, edits[, leaves]), the edited text and its leaves.

    edits: array<struct<start, end, replacement>>, in code points of the text as the edits before have left
    it; bounds outside the text are brought inside, null edits or starts are skipped, a null end is the
    start, a null replacement deletes. Null texts and lists are empty. Repeated rows are rows of their own.
    leaves: what with_leaves or an earlier count_tokens returned for the same text; leaves of any other text,
    as their hash tells, are not believed, and such rows are counted whole. digest: only the SHA-256 of the edited text comes back.
    """
    ship(docs.sparkSession)
    edits = F.col("edits").cast("array<struct<start:long,end:long,replacement:string>>").alias("edits")
    kept = [F.col("leaves").cast(LEAVES).alias("leaves")] if "leaves" in docs.columns else []
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits, *kept)
    schema = f"doc_id long, {COUNTS}, edited_sha256 string" if digest else SCHEMA
    return src.mapInArrow(_count(tokenizer or public_path(TOKENIZER), digest), schema)


def sample_edits() -> F.Column:
    """Edits for any document, from its id and length: one replaced, one inserted, one deleted, one at the end."""
    size = F.length(F.coalesce("text", F.lit("")))
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), size + 1)
    span = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(100 + k)), F.lit(24))
    one = lambda a, b, r: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), r.alias("replacement"))
    return F.array(
        one(place(0), place(0) + span(0), F.concat(F.lit(" [edit "), F.col("doc_id").cast("string"), F.lit("] "))),
        one(place(1), place(1), F.substring(F.coalesce("text", F.lit("")), 1, 40)),
        one(place(2), place(2) + span(2), F.lit("")),
        one(size + 1000, size + 1000, F.lit("\n\nRevised.")),
    )


def op5_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs.withColumn("edits", sample_edits()), digest=True)
