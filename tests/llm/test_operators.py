"""Each operator against a plain version, on odd rows and on empty tables."""

import glob
import hashlib
import math
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagweave.llm import common, decontaminate, edit_counts, exact_dedup, hmm, jaccard_join, line_dedup, packing, substring_dedup, token_files, toxicity
from tagweave.llm.common import words
from tagweave.llm.tokens import public_path

SF = "/root/testdata/sf0.001"


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def bag(rows):
    return Counter(map(str, rows))


def test_exact_dedup(odd, none):
    for kw in ({}, {"block": 16}, {"block": 16, "hasher": lambda b: len(b) % 3}):
        groups = defaultdict(list)
        for doc, text in plain(odd):
            groups[lower(text)].append(doc)
        got = defaultdict(list)
        for r in exact_dedup.exact_groups(odd, **kw).collect():
            got[r.text_sha256].append(r)
        for text, ids in groups.items():
            rows = got[hashlib.sha256(text.encode()).hexdigest()]
            best = max((i for i in ids if i is not None), default=None)
            assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in rows)
            assert {r.keep_id for r in rows} == {best} and {r.group_size for r in rows} == {len(ids)}
            assert [r.doc_id for r in rows if r.kept] == [best]
    assert exact_dedup.exact_groups(none).count() == 0


def lines_plain(rows):
    keys, seen = [], defaultdict(set)
    for doc, text in rows:
        own = []
        for line in (text or "").split("\n"):
            k = lower(line.strip(" \t\n\x0b\x0c\r"))
            own.append((line, k if len(k) >= 10 and doc is not None else None))
            if own[-1][1] is not None:
                seen[k].add(doc)
        keys.append((doc, own))
    out = []
    for doc, own in keys:
        kept = [line for line, k in own if k is None or len(seen[k]) < 2 or min(seen[k]) == doc]
        out.append((doc, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("kw", [{}, {"shard_keys": 4, "hot_keys": 2}])
def test_line_dedup(odd, none, kw):
    out = line_dedup.dedup_lines(odd, **kw)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()]
    assert bag(got) == bag(lines_plain(plain(odd))) and "lost" in out.columns
    assert line_dedup.dedup_lines(none, **kw).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(3)
    h = rng.integers(-(2**63), 2**63, (5000, 2))
    ph = line_dedup.PerfectHash(h[:, 0].copy(), h[:, 1].copy())
    assert sorted(ph.find(h[:, 0].copy(), h[:, 1].copy()).tolist()) == list(range(5000))


def test_token_files(spark, odd, none, tmp_path):
    t = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    path = token_files.write_tokens(odd, f"{tmp_path}/t")
    rows = token_files.with_starts(token_files.read_tokens(spark, path), path).orderBy("start").collect()
    want = [(doc, [*t.encode(text or "", add_special_tokens=False).ids, 1]) for doc, text in plain(odd)]
    assert bag((r.doc_id, r.ids) for r in rows) == bag(want)
    at = 0
    for r, doc in zip(rows, sorted((d for d, _ in want), key=lambda d: (d is not None, d or 0)), strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, len(r.ids))
        at += len(r.ids)
    few = token_files.read_tokens(spark, path, ("doc_id", "n_tokens"), lowest=5, highest=7)
    assert sorted(r.doc_id for r in few.collect()) == [5, 6, 7, 7]
    assert token_files.read_tokens(spark, token_files.write_tokens(none, f"{tmp_path}/n")).count() == 0


def test_token_files_are_read_selectively(spark, tmp_path):
    """Encodings, page indexes and what a selective read touches, from the files' own footers."""
    path = token_files.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), f"{tmp_path}/t")
    seen = Counter()
    hadoop, conf = spark._jvm.org.apache.parquet.hadoop, spark._jsc.hadoopConfiguration()
    for file in glob.glob(f"{path}/*.parquet"):
        reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(spark._jvm.org.apache.hadoop.fs.Path(file), conf))
        for block in reader.getFooter().getBlocks():
            for c in block.getColumns():
                name = c.getPath().toDotString().split(".")[0]
                encodings = {e.name() for e in c.getEncodings()}
                assert c.getColumnIndexReference() and c.getOffsetIndexReference()
                assert ("RLE_DICTIONARY" in encodings) == (name == "ids") and (name == "ids" or "DELTA_BINARY_PACKED" in encodings)
                seen[name] += c.getTotalSize()
        reader.close()
    assert sum(seen[c] for c in token_files.META) < 0.1 * seen["ids"]
    plan = token_files.read_tokens(spark, path, ("doc_id", "n_tokens"), lowest=5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,5)" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_packing(odd, none):
    t = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    out = packing.pack(odd, with_ids=True, group_pieces=8).collect()
    texts = defaultdict(list)
    for doc, text in plain(odd):
        texts[doc].append([*t.encode(text or "", add_special_tokens=False).ids, 1])
    for doc, lists in texts.items():
        own = [r for r in out if r.doc_id == doc]
        assert sum(r.length for r in own) == sum(map(len, lists))
        for r in own:
            assert any(r.ids == x[r.start : r.start + r.length] and r.doc_tokens == len(x) for x in lists)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(none).count() == 0


def test_packing_in_the_pipeline_leaves_nothing_in_workers(spark, odd):
    import corpus_pipeline as P

    def held(batches):
        from tagweave.llm import tokens

        for batch in batches:
            n = sum("onlyhere" in k for e in tokens._HELD.values() for x in (e.pretokens, e.kept, e.stems) for k in [*x.new, *x.old])
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], ["n"])

    docs = odd.select("doc_id", F.concat("text", F.lit(" onlyhere")).alias("text")).coalesce(1)
    got = P.packing(spark, docs, "").collect()
    assert [r.n for r in spark.range(8).repartition(8).mapInArrow(held, "n long").collect()] == [0] * 8
    assert sorted(map(str, got)) == sorted(map(str, packing.pack(docs).collect()))
    assert sorted(map(str, packing.pack(docs, keep=0, piece_bytes=1, forget=True).collect())) == sorted(map(str, got))


def test_first_fit():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 100, 300)
    bins = packing.first_fit_decreasing(sizes, 100)
    left: list[int] = []
    want = np.empty(300, int)
    for i in np.argsort(-sizes, kind="stable"):
        at = next((j for j, room in enumerate(left) if room >= sizes[i]), len(left))
        left += [100] * (at == len(left))
        left[at] -= sizes[i]
        want[i] = at
    assert (bins == want).all()


@pytest.mark.parametrize("most", [decontaminate.BLOCK_BYTES, 8000, 1])
def test_decontaminate(spark, odd, none, most):
    bench = spark.createDataFrame([(1, "beta gamma delta epsilon zeta ETA theta iota kappa the same line"), (2, "short"), (3, None), (4, ""), (5, "zzz yyy"), (6, "word1 token1 word2 token2")], "item_id long, text string")
    items = {}
    for r in bench.collect():
        w = words(r.text)
        items[str(r.item_id)] = {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    want = []
    for doc, text in plain(odd):
        w = words(text)
        hit, found = set(), set()
        for item, wins in items.items():
            for win in wins:
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit.update(range(i, i + len(win)))
                        found.add(item)
        want.append((doc, len(w), len(hit), sorted(found)))
    out = decontaminate.find(odd, bench, block_bytes=most).collect()
    assert bag((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in out) == bag(want)
    texts = dict(plain(odd))
    for r in out:
        for s in r.spans:
            assert words(texts[r.doc_id][s.start : s.end])
    clean = decontaminate.remove_contaminated(odd, bench, block_bytes=most)
    assert bag(r.doc_id for r in clean.collect()) == bag(d for d, _, n, _ in want if not n) and clean.columns == odd.columns
    assert decontaminate.find(none, bench).count() == 0
    assert decontaminate.find(odd, bench.where("false")).where("n_hit > 0").count() == 0


def test_decontaminate_blocks_are_bounded():
    """An automaton takes what its block is counted to take, however large an item is; no window is lost or made up."""
    rng = np.random.default_rng(2)
    items = [(str(i), " ".join(f"word{x}" for x in rng.integers(0, 10**6, n))) for i, n in enumerate([3, 40, 9000, 11, 2500, 1])]
    most = 4 << 20
    blocks = list(decontaminate._blocks(iter(items), most, 10))
    assert len(blocks) > 3
    found = defaultdict(set)
    for block in blocks:
        a = decontaminate.automaton(block)
        assert a.get_stats()["total_size"] + decontaminate.VALUE * len(a) <= 1.05 * most
        for item, text in block:
            found[item] |= decontaminate.windows(text)
    assert found == {item: decontaminate.windows(text) for item, text in items}


def near_plain(rows, similarity=0.8):
    sets = []
    for doc, text in rows:
        w = words(text)
        sets.append((doc, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w and doc is not None else frozenset()))
    links, root = Counter(), list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and len(a & b) >= similarity * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(sets):
        least[find(i)].append(doc)
    return bag((doc, min(least[find(i)]) if doc is not None else None, links[i]) for i, (doc, _) in enumerate(sets))


@pytest.mark.parametrize("kw", [{}, {"brute": 4, "levels": 2}])
def test_jaccard_join(spark, odd, none, kw):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 500, 60)]
    rows = []
    for i in range(25):
        w = list(base)
        for j in rng.integers(0, 60, i % 4):
            w[j] = f"x{i}"
        rows.append((100 + i, " ".join(w)))
    df = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = bag((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(df, **kw).collect())
    assert got == near_plain(plain(df))
    assert jaccard_join.near_duplicates(none).count() == 0


@pytest.mark.parametrize("part_rows", [1 << 14, 8])
def test_jaccard_join_small_tables_have_few_parts(spark, monkeypatch, part_rows):
    """Also in a session that keeps all its shuffle partitions, each part being files of their own."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 500, 60)]
    rows = [(i, " ".join([*base[:-1], f"x{i % 40}"] if i < 60 else [f"y{i}w{j}" for j in range(30)])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    made = []
    monkeypatch.setattr(common, "_WRITTEN", made)
    monkeypatch.setattr(common, "PART_ROWS", part_rows, raising=False)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        got = bag((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(df, brute=16).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == near_plain(plain(df))
    files = {path: len(glob.glob(f"{path.removeprefix('file://')}/part-*")) for path in made}
    wide = {path for path, n in files.items() if n > 1}
    free = {path for path in files if path.rsplit("/", 1)[-1] in ("sets", "links", "edges")}
    assert free < files.keys() and (wide <= free if part_rows > 8 else wide - free)


def test_jaccard_join_of_frequent_passages(spark):
    """Pairs at 0.82 all of whose shared shingles are in 200 classes: a run that parts one must not do so in all runs."""
    rng = np.random.default_rng(3)
    pool = [" ".join(f"p{p}w{i}" for i in range(48)) for p in range(75)]
    rows, fresh = [], 0
    for _ in range(100):
        chosen = rng.choice(75, 25, replace=False)
        for _ in range(6):
            text = pool[chosen[0]]
            for p in chosen[1:]:
                text += f" x{fresh} {pool[p]}"
                fresh += 1
            rows.append((len(rows), text))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), brute=16).collect()
    assert Counter(r.n_links for r in got) == {5: 600}
    assert all(r.class_id == r.doc_id // 6 * 6 for r in got)


def test_jaccard_join_sketch_loss():
    for similarity in (0.5, 0.8, 0.95):
        least = jaccard_join.least_equal(similarity)
        p = [math.comb(64, k) * similarity**k * (1 - similarity) ** (64 - k) for k in range(64)]
        assert sum(p[:least]) <= jaccard_join.DROPPED < sum(p[: least + 1])


def repeats_plain(rows, length):
    at = defaultdict(int)
    data = [(doc, (text or "").encode()) for doc, text in rows]
    for _, b in data:
        for i in range(len(b) - length + 1):
            at[b[i : i + length]] += 1
    out = []
    for doc, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if at[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("small", [4096, 1])
def test_substring_dedup(spark, odd, none, small):
    rng = np.random.default_rng(2)
    passage = "".join(rng.choice(list("abcdé "), 90))
    more = [(200 + i, "".join(rng.choice(list("xyz"), 30)) + passage[i : 60 + i * 3] + "".join(rng.choice(list("uvw"), 40))) for i in range(12)]
    more.append((300, "a" * 200))
    rows = [(d, t[:3000] if t else t) for d, t in plain(odd)] + more
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring_dedup.remove_repeats(df, length=40, gram=10, small=small, short=25, with_kept=True).collect()
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == bag(repeats_plain(rows, 40))
    assert bag((r.doc_id, r.n_repeated) for r in out) == bag((r[0], r[2]) for r in repeats_plain(rows, 25))
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in out)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_tells_rows_apart(spark):
    """Rows with and without id or text whose values read alike in a row."""
    long = "".join(f"{i}-" for i in range(300))
    rows = [(None, "5|" + long), (5, long), (5, None), (None, "5"), (None, None), (5, ""), (None, "")]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_kept=True).collect()
    assert bag((r.doc_id, r.n_bytes, bytes(r.kept)) for r in out) == bag((d, len(t or ""), b"5|" if t and "|" in t else b"" if t == long else (t or "").encode()) for d, t in rows)


def test_substring_dedup_of_texts_longer_than_a_piece(spark):
    """Repeats on either side of a cut and across it, by the hashes of all windows."""
    rng = np.random.default_rng(4)
    long = bytes(rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz     ", np.uint8), 700_000)).decode()
    cut = substring_dedup.PIECE
    assert cut < len(long) - 1000
    rows = [(1, long), (2, "x" * 50 + long[cut - 300 : cut + 350] + "y" * 50), (3, long[1000:1450] + " and " + long[-420:]), (4, long[cut - 400 : cut]), (5, "short")]
    hashes = [[hash(t[i : i + 400]) for i in range(len(t) - 399)] for _, t in rows]
    times = Counter(h for own in hashes for h in own)
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for (doc, text), own in zip(rows, hashes, strict=True):
        gone = np.zeros(len(text) + 1, int)
        for i, h in enumerate(own):
            if times[h] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        kept = "".join(c for c, g in zip(text, np.cumsum(gone)[:-1], strict=True) if not g)
        assert (out[doc].n_removed, out[doc].kept_sha256) == (len(text) - len(kept), hashlib.sha256(kept.encode()).hexdigest())
    assert out[1].n_spans == 3 and out[1].n_removed == 750 + 450 + 420


def test_substring_dedup_as_registered(spark):
    rows = plain(spark.read.parquet(f"{SF}/documents.parquet"))
    out = substring_dedup.op6_substring_dedup(spark, SF).collect()
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == bag(repeats_plain(rows, 400))
    assert bag((r.doc_id, r.n_repeated) for r in out) == bag((r[0], r[2]) for r in repeats_plain(rows, 240))


def test_refine():
    data = np.frombuffer(bytes(np.random.default_rng(3).integers(97, 99, 400, dtype=np.uint8)) * 2, np.uint8)
    for n, names in zip((8, 11, 40), substring_dedup.refine(data, (8, 11, 40)), strict=True):
        found = [data[i : i + n].tobytes() for i in range(len(data) - n + 1)]
        times = Counter(found)
        assert all((names[i] >= 0) == (times[x] > 1) for i, x in enumerate(found)) and len(set(names.tolist()) - {-1}) == sum(t > 1 for t in times.values())


def test_edit_counts(spark, odd, none):
    t = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    edits = spark.createDataFrame([(1, 0, 3, 9, "X"), (1, 1, 0, 0, None), (4, 0, 5, 2, "new text"), (5, 0, 100, 90_000, ""), (7, 0, None, None, "no")], "doc_id long, seq int, start long, end long, replacement string")
    out = edit_counts.count_tokens(edit_counts.with_edits(odd, edits)).collect()
    assert len(out) == odd.count()
    for r in out:
        assert r.n_tokens_edited == len(t.encode(r.edited, add_special_tokens=False).ids)
    by = {r.doc_id: r for r in out}
    assert by[4].edited == "new text" and by[1].edited.startswith("AlpX") and by[7].n_edits == 0
    assert edit_counts.count_tokens(none.withColumn("edits", edit_counts.sample_edits())).count() == 0
    # kept leaves stand in for the texts' own, and leaves of another text are not believed
    kept = edit_counts.with_leaves(odd).select("doc_id", "text", "leaves")
    again = edit_counts.count_tokens(edit_counts.with_edits(kept, edits))
    counts = lambda rows: bag((r.doc_id, r.n_tokens, r.n_tokens_edited, r.n_pretokens_edited, r.edited) for r in rows)
    assert counts(again.collect()) == counts(out)
    other = [F.when(F.length("text") > 3, F.expr("overlay(text PLACING '?!, ' FROM 1)")).otherwise(F.reverse("text")).alias("text")]  # as long, and another
    for r in edit_counts.count_tokens(edit_counts.with_edits(kept.select("doc_id", *other, "leaves"), edits)).collect():
        assert r.n_tokens_edited == len(t.encode(r.edited, add_special_tokens=False).ids)
    more = again.select("doc_id", F.col("edited").alias("text"), "leaves", F.expr("array(named_struct('start', 1, 'end', 2, 'replacement', 'Z'))").alias("edits"))
    for r in edit_counts.count_tokens(more).collect() + edit_counts.count_tokens(more.withColumn("text", F.concat("text", F.lit("!")))).collect():
        assert r.n_tokens_edited == len(t.encode(r.edited, add_special_tokens=False).ids)


def test_hmm(odd, none):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    out = hmm.score(odd, fold, states=3, passes=2, own=50, heavy=100).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter()
    for doc, text in plain(odd):
        if not held(doc):
            counts.update(hmm.tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for doc, text in plain(odd):
        w = hmm.tokens(text)
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want.append((doc, held(doc), len(w), sum(counts[x] > 0 for x in w), n, f"{base:.6g}"))
    assert bag((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6g}") for r in out) == bag(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert hmm.score(none, fold).count() == 0


def test_hmm_cuts_texts_together(monkeypatch):
    """Counts and sequences come from a batch's texts at once, not text by text, and equal what tokens() gives."""
    texts = [None, "", " ", "\t\n", "A b", " É é\x0bB\xa0c \r\n", "x\x1cy z\x85", "b B  b", "日本 ÀB", "\x00 a\x0c"]
    words = [hmm.tokens(t) for t in texts]
    counts = Counter(w for x in words for w in x)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "held_out": pa.array([False] * len(texts)), "text": pa.array(texts)}).slice(1)
    monkeypatch.setattr(hmm, "tokens", None)
    counted = [r for b in hmm._count(iter([batch])) for r in b.to_pylist()]
    assert {r["word"]: r["train"] for r in counted} == counts - Counter([b""])
    heavy = [b"", b"b", b"a"]
    held = np.bincount([hmm.spelled(w) for w in counts if w not in heavy], minlength=hmm.SPELLED)
    known = hmm.Vocabulary(heavy, np.array([counts[w] for w in heavy]), 2, counts.total(), len(counts), held, held)
    out = [r for b in hmm._sequences(SimpleNamespace(value=known))(iter([batch])) for r in b.to_pylist()]
    of = lambda w: heavy.index(w) if w in heavy[:2] else 2 + hmm.spelled(w)
    for r, x in zip(out, words[1:], strict=True):
        assert (r["n_tokens"], r["n_known"], r["classes"]) == (len(x), sum(w in heavy for w in x), [of(w) for w in x])
        assert {y["word"]: (y["cls"], y["tf"]) for y in r["rare"]} == {w: (of(w), n) for w, n in Counter(x).items() if w not in heavy}


def test_hmm_scores_are_exact_with_one_state(spark, odd):
    """With one state a text's probability is a product of shares, which is written out here."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter()
    for doc, text in plain(odd):
        if not held(doc):
            counts.update(hmm.tokens(text))
    top = sorted(counts, key=lambda w: (-counts[w], w))[:10]
    of = lambda w: top.index(w) if w in top else 10 + hmm.spelled(w)
    per, kinds = Counter(), Counter()
    for w, n in counts.items():
        per[of(w)] += n
        kinds[of(w)] += 1
    classes, total = 10 + hmm.SPELLED, sum(counts.values())
    emit = [per[c] + 0.02 * (per[c] + 0.5) / (total + 0.5 * classes) + 1e-9 for c in range(classes)]
    whole = sum(emit)
    want = []
    for doc, text in plain(odd):
        logs = [math.log10(emit[of(w)] / whole) + (0 if w in top else math.log10((counts[w] + 0.5) / (per[of(w)] + 0.5 * (kinds[of(w)] + 1)))) for w in hmm.tokens(text)]
        want.append((doc, f"{sum(logs):.5g}"))
    out = hmm.score(odd, fold, states=1, passes=2, own=10, heavy=10_000).collect()
    assert all(math.isfinite(r.score) for r in hmm.score(odd, fold, states=2, passes=1, own=10, heavy=1).collect())
    assert bag((r.doc_id, f"{r.score:.5g}") for r in out) == bag(want)


def test_hmm_learns_nothing_from_held_out_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    fold = F.col("doc_id") % 4 == 0
    other = docs.withColumn("text", F.when(fold, F.concat(F.lit("zebra zebra the of "), F.reverse("text"))).otherwise(F.col("text")))
    a, b = ({r.doc_id: (r.score, r.base_score) for r in hmm.score(d, fold, passes=2).where("not held_out").collect()} for d in (docs, other))
    assert a.keys() == b.keys() and all(math.isclose(x, y, rel_tol=1e-6) for k in a for x, y in zip(a[k], b[k], strict=True))


def test_baum_welch_reads_whole_texts():
    """Waiting and sorting lose no sequence, and a long one is not cut."""
    rng = np.random.default_rng(1)
    lengths = np.array([3, 700, 1, 513, 2, 40, 900])
    flat = rng.integers(0, 9, lengths.sum()).astype(np.int32)
    waiting = hmm.Batches()
    met = [tuple(x) for part in waiting.add(flat, np.r_[0, np.cumsum(lengths)]) for x in part] + [tuple(x) for x in waiting.rest()]
    assert bag(met) == bag(tuple(x) for x in np.split(flat, np.cumsum(lengths)[:-1])) and not waiting.held


def test_forward_is_exact():
    rng = np.random.default_rng(4)
    model = hmm.initial(rng.random(6) * 9, 3)
    seqs = [rng.integers(0, 6, n) for n in (1, 4, 5, 3)]
    flat, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    got = hmm.log_likelihoods(model, flat, np.cumsum(lengths) - lengths, lengths)
    for s, g in zip(seqs, got, strict=True):
        total = 0.0
        for path in np.ndindex(*[3] * len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, x in zip(path[:-1], path[1:], s[1:], strict=True):
                p *= model.move[a, b] * model.emit[x, b]
            total += p
        assert math.isclose(g, math.log(total), rel_tol=1e-9)


def test_baum_welch_counts():
    rng = np.random.default_rng(6)
    model = hmm.initial(rng.random(4) * 5, 2)
    s = rng.integers(0, 4, 6)
    first, moves, emitted = hmm.expected_counts(model, s, np.array([0]), np.array([6]))
    f, m, e, total = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for path in np.ndindex(*[2] * 6):
        p = model.start[path[0]] * model.emit[s[0], path[0]]
        for a, b, x in zip(path[:-1], path[1:], s[1:], strict=True):
            p *= model.move[a, b] * model.emit[x, b]
        total += p
        f[path[0]] += p
        for a, b in zip(path[:-1], path[1:], strict=True):
            m[a, b] += p
        for k, x in zip(path, s, strict=True):
            e[x, k] += p
    for got, want in ((first, f), (moves, m), (emitted, e)):
        assert np.allclose(got, want / total, atol=1e-4)


def test_hmm_beats_counts_on_held_out_text(spark):
    out = hmm.op2_hmm_score(spark, "/root/testdata/sf0.01").where("held_out")
    r = out.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    out = toxicity.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not r.text or not r.text.strip()}) == 1
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert toxicity.score(odd, toxicity.train(odd, labels.where("false"))).where("score >= 0.5").count() == 0


def test_toxicity_held_out(spark):
    """Labels that no text tells (copies without any term) can't be met; what is met must be right."""
    sf = "/root/testdata/sf0.1"
    out = toxicity.op1_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    c = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert c[1, 1] / (c[1, 1] + c.get((1, 0), 0)) > 0.45 and c.get((0, 1), 0) / (c[0, 0] + c.get((0, 1), 0)) < 0.01


def test_toxicity_is_repeatable(spark):
    """The same rows give the same model, whatever their partitions; near copies' labels may conflict."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 60)) for _ in range(120)]
    rows = [(i, texts[i % 120] + (" vile stuff" if i % 9 == 0 else "") + f" end{i % 3}") for i in range(360)]
    docs = spark.createDataFrame([*rows, (3, "another text of this id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 == 0 or i % 50 == 0)) for i in range(360)] + [(9, 0), (10, 2), (11, None)], "doc_id long, toxic int")
    first = toxicity.train(docs.repartition(1), labels.repartition(1))
    assert any(first.weights)
    for n in (4, 32):
        assert toxicity.train(docs.repartition(n, "text"), labels.repartition(n)) == first


def test_toxicity_is_compression_distance():
    """Distances equal those of plain compressors, windows cover whole texts, and a late term counts."""
    rng = np.random.default_rng(5)
    usual = [bytes(rng.choice(list(b"abcdefgh "), 400).astype(np.uint8)) for _ in range(300)]
    toxic = [w[:100] + b" vilestword " + w[112:] for w in usual[:60]]
    model = toxicity.dictionaries(toxic, usual[60:])
    for one, other in (model.kinds, model.fine):
        assert len(one) == len(other) and one != other
    scorer = toxicity.Scorer(model)
    text = "Abc, def! " * 30 + "日本語の文章です" * 20
    data = b" " + b" ".join(words(text)) + b" "
    cut = [data[i : i + 64] for i in range(0, max(1, len(data) - 32), 32)]
    assert toxicity.windows(data) == cut and cut[-1].endswith(data[-1:]) and set(range(len(data))) == {j for i in range(len(cut)) for j in range(32 * i, 32 * i + len(cut[i]))}
    wide, fine = scorer.distances(text)
    for got, (toxic_, usual_), own in ((fine, model.fine, cut), (wide, model.kinds, [data[i : i + 256] for i in range(0, len(data), 256)])):
        toxic_, usual_ = toxicity.compressor(toxic_), toxicity.compressor(usual_)
        assert got.tolist() == [len(usual_(w)) - len(toxic_(w)) for w in own]
    run = "文" * 300
    assert scorer.distances(run + "vilestword" + run)[1].max() >= 4 > scorer.distances(run + run)[1].max()
    x = np.array([scorer.features(t) for t in ("", None, "  ")])
    assert x.shape == (3, toxicity.N_FEATURES) and (x == x[0]).all()


def test_sql(spark):
    import compare
    from tagweave.llm import queries

    con = compare.connection(SF)
    for name, sql in queries.oracle_sql().items():
        compare.assert_same(queries.queries()[name](spark, SF), con, sql)


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.8])
def test_jaccard_recall(spark, similarity):
    """Links of distinct sets, counted a set, against all pairs; at other thresholds than the usual one too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for doc, text in plain(docs):
        x = frozenset(jaccard_join.shingles(text).tolist())
        if x:
            sets.setdefault(x, []).append(doc)
    keys = list(sets)
    holders = defaultdict(set)
    for i, x in enumerate(keys):
        for t in x:
            holders[t].add(i)
    links = 0
    for i, x in enumerate(keys):
        near = Counter(j for t in x for j in holders[t] if j < i)
        links += sum(n >= similarity * (len(x) + len(keys[j]) - n) - 1e-9 for j, n in near.items())
    rows = jaccard_join.near_duplicates(docs, similarity).select("set_id", "n_set_links").distinct().collect()
    found = sum(r.n_set_links for r in rows) / 2
    assert links >= 5 and found <= links and found / links >= 0.999


def test_written_tables_are_dropped(spark):
    before = len(common._WRITTEN)
    out = common.finished(lambda: common.written(common.written(spark.range(5).toDF("a")).where("a > 1")))
    assert out.count() == 3 and len(common._WRITTEN) == before + 1


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_odd_tables(spark, odd, none, empty, tmp_path):
    """Nulls, repeats, clashing columns and no rows at all pass every stage, and columns keep their values."""
    import corpus_pipeline as P

    docs = (none if empty else odd.withColumn("toxicity", F.lit("t")).withColumn("n_dropped", F.lit("d")).withColumn("gone", F.lit("g"))).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 1), (None, 1)], "doc_id long, toxic int").where(F.lit(not empty)).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing that occurs in any of these documents at all"), (None, None)], "item_id long, text string").where(F.lit(not empty)).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r.n_lines == "x" and r.toxicity == "t" and r.n_dropped == "d" for r in rows) if not empty else not rows, name
        assert sum(r.doc_id is None for r in rows) == (0 if empty else 2), name
    packed = P.run(spark, str(tmp_path))
    assert packed.count() == 0 if empty else packed.select("doc_id").distinct().count() > 3


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = P.line_dedup(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert bag((r.doc_id, r.text) for r in kept.collect()) == bag((d, t) for d, _, _, t in lines_plain(plain(docs)))
    near = P.near_dedup(spark, docs, SF)
    want = [d for d, c, _ in map(eval, near_plain(plain(docs)).elements()) if d == c]
    assert sorted(r.doc_id for r in near.collect()) == sorted(want) and near.columns == docs.columns
    clean = P.decontamination(spark, docs, SF)
    hits = {r.doc_id for r in decontaminate.find(docs, bench).where("n_hit > 0").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - hits
    civil = P.toxicity(spark, docs, SF)
    assert civil.columns == docs.columns and 0 < civil.count() <= docs.count()
    out = P.run(spark, SF)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    left = {r.doc_id for r in out.select("doc_id").collect()}
    assert left <= {r.doc_id for r in civil.collect()} and not left & hits
