"""HTML, gazetteers, containment, packing and shuffling against plain versions, where their plans must not depend on depth or length."""

import random
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave import schemas
from tagweave.functions import exprs
from tagweave.operators import html, linearize, sampling, taggers
from tagweave.plans import training


def extracted(spark, page, policy):
    return html.extract_html(spark.createDataFrame([(page,)], "html string"), policy=policy).first()


def test_removal_from_the_bottom_up_is_one_pass(spark):
    """An element goes by what is left in it; rounds would take the depth's number of jobs."""
    rng = random.Random(4)

    def tree(depth):
        tag = rng.choice(["div", "section", "article"])
        inside = "".join(tree(depth - 1) for _ in range(rng.randrange(3))) if depth else ""
        return f"<{tag}>" + "x" * rng.randrange(4) + inside + f"</{tag}>"

    def plain(page):
        """What is left, element by element from the inside."""
        stack, out = [["", ""]], ""
        for token in page.replace("<", "\0<").replace(">", ">\0").split("\0"):
            if token.startswith("</"):
                tag, text = stack.pop()
                stack[-1][1] += "" if tag in ("div", "article") and len(text) <= 3 else text
            elif token.startswith("<"):
                stack.append([token[1:-1], ""])
            else:
                stack[-1][1] += token
        return stack[0][1] + out

    rules = (html.Rule("div", most=3, bottom_up=True), html.Rule("article", most=3, bottom_up=True))
    pages = ["".join(tree(6) for _ in range(3)) + "end" for _ in range(40)]
    df = spark.createDataFrame([(i, f"<body>{p}</body>") for i, p in enumerate(pages)], "id long, html string").repartition(3)
    got = {r.id: r.text for r in html.extract_html(df, policy=html.HtmlPolicy(drop=rules)).collect()}
    for i, p in enumerate(pages):
        assert got[i].replace("\n", "") == plain(p)
    began = time.time()
    deep = extracted(spark, "<body>" + "<div>" * 1200 + "abc" + "</div>" * 1200 + "<p>stays</p></body>", html.HtmlPolicy(drop=rules))
    assert deep.text == "stays\n" and [n.value for n in deep.tags_html] == ["p", "body"] and time.time() - began < 60


def test_decided():
    rules = (html.Rule("b", most=2, bottom_up=True), html.Rule(most=0, but=("i",), bottom_up=True))
    edges, tags = [1, 1, -1, 1, -1, -1], ["a", "b", "b", "i", "i", "a"]
    assert html.decided(edges, tags, [0, 2, 0, 0, 0, 9], [False] * 6, rules) == [True, True, False, False, False, False]
    assert html.decided(edges, tags, [1, 2, 0, 0, 0, 9], [False] * 6, rules) == [False, True, False, False, False, False]


def test_isolated_elements_are_cut_by_offsets(spark):
    many = "".join(f'<footer id="{i}">é{i} &amp; <b>{i}</b><footer>inner</footer></footer>' for i in range(2000))
    out = extracted(spark, f"<html><head><title>t</title></head><body>{many}<footer></footer></body></html>", html.HtmlPolicy(isolate=("footer", "title")))
    assert len(out.html_footer) == 4001 and out.html_title == ["<title>t</title>"]
    assert out.html_footer[2] == '<footer id="1">é1 &amp; <b>1</b><footer>inner</footer></footer>' and out.html_footer[3] == "<footer>inner</footer>"
    assert out.html_footer[-1] == "<footer/>"


def mentions(texts, names):
    return sorted((i, a, e, t.find(a)) for i, t in texts if t is not None for a, e in names if a and a in t)


def test_gazetteers(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("abcé \n日") for _ in range(rng.randrange(80)))) for i in range(150)] + [(900, None), (901, ""), (902, "\U0001f600ab")]
    names = sorted({("".join(rng.choice("abcé \n日") for _ in range(n)), f"E{k}") for k in range(40) for n in (1, 2, 3, 4, 5, 7)}) + [("\U0001f600", "smile"), ("", "none"), ("zzzzz", "nowhere"), ("ab", "twice"), ("ab", "again")]
    df = spark.createDataFrame(texts, "id long, text string")
    gazetteer = spark.createDataFrame(names, "alias string, entity string").union(spark.createDataFrame([(None, "null")], "alias string, entity string"))
    got = sorted((r.id, r.alias, r.entity, r.start) for r in taggers.entity_mentions(df, gazetteer, "id").collect())
    want = mentions([(i, t) for i, t in texts if i < 902], names)  # places are counted in characters, one for a pair of surrogates
    assert [g for g in got if g[0] < 902] == want and {g[1:3] for g in got if g[0] == 902} == {(a, e) for a, e in names if a and a in "\U0001f600ab"}
    assert taggers.entity_mentions(df, gazetteer.where("false"), "id").count() == 0
    assert taggers.entity_mentions(df.where("false"), gazetteer, "id").count() == 0


def test_a_word_of_a_megabyte(spark):
    rng = random.Random(2)
    run = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1 << 20))
    df = spark.createDataFrame([(1, run), (2, "short Paris")], "id long, text string")
    names = [(run[500_000:500_009], "deep"), (run[-3:], "end"), ("Paris", "P"), ("Rome", "R")]
    got = sorted((r.id, r.alias, r.entity, r.start) for r in taggers.entity_mentions(df, spark.createDataFrame(names, "alias string, entity string"), "id").collect())
    assert got == mentions([(1, run), (2, "short Paris")], names)


@pytest.mark.parametrize("ordered", [True, False])
def test_holders(ordered):
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = rng.integers(0, 12, 2)
        starts = rng.integers(0, 30, n)
        ends = starts + rng.integers(0, 8, n)
        if ordered:
            cuts = np.sort(rng.integers(0, 40, m + 1))
            begins, stops = cuts[:-1], cuts[1:]
        else:
            begins = rng.integers(0, 30, m)
            stops = begins + rng.integers(0, 20, m)
        want = [next((k for k in range(m) if begins[k] <= s and stops[k] >= e), -1) for s, e in zip(starts, ends, strict=True)]
        assert exprs._holders(starts, ends, begins, stops).tolist() == want


def packed(lists, block, pad):
    ids = [x for own in lists for x in own]
    cut = [ids[i : i + block] for i in range(0, len(ids), block)]
    kept = [c for i, c in enumerate(cut) if len(c) == block or i == 0]
    return [c + [pad] * (block - len(c)) for c in kept]


@pytest.mark.parametrize("groups", [1, 7])
def test_packing_in_groups_of_any_size(spark, groups):
    rng = random.Random(groups)
    rows = [(i % groups, i, [rng.randrange(1, 99) for _ in range(rng.choice([0, 1, 5, 40]))]) for i in range(400)]
    df = spark.createDataFrame(rows, "g long, o long, ids array<int>").repartition(9)
    out = linearize.pack(df, 16, "g", "o", pad_id=0).collect()
    for g in range(groups):
        got = [r.input_ids for r in sorted((r for r in out if r.g == g), key=lambda r: r.block_idx)]
        assert got == packed([ids for k, _, ids in rows if k == g], 16, 0)


@pytest.mark.parametrize("batch", [2, None])
def test_texts_without_tags_are_joined(spark, batch):
    """Only what is left at a group's end is dropped."""
    sizes = [5, 15, 3, 12, 2]
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(n))) for i, n in enumerate(sizes)], "id long, text string")
    cfg = replace(linearize.LinearizeConfig(), max_seq_len=10)
    own = {r.id: r.n for r in df.select("id", F.size(linearize.regex_tokens("text")).alias("n")).collect()}
    groups = [list(own)[i : i + (batch or 9)] for i in range(0, 5, batch or 9)]
    want = [(g, k) for g, ids in enumerate(groups) for k in range(max(1, sum(own[i] for i in ids) // 10))]
    out = training.build_dataset(df, cfg, "without_tags", "id", batch=batch).collect()
    assert sorted((r.group, r.block_idx) for r in out) == want
    tokens = [t["id"] for r in df.select("id", linearize.regex_tokens("text").alias("t")).orderBy("id").collect() for t in r.t]
    if batch is None:
        assert [x for r in sorted(out, key=lambda r: r.block_idx) for x in r.input_ids] == tokens[: len(tokens) // 10 * 10]


@pytest.mark.parametrize("size", [1, 5, 64, 1000])
def test_buffered_shuffle(spark, monkeypatch, size):
    monkeypatch.setattr(sampling, "STRETCH", 60)
    df = spark.range(200).select((F.col("id") * 3).alias("id"), F.concat(F.lit("t"), "id").alias("text"))
    want, place = {}, 0
    for k in range(0, 200, 60):
        rows = list(range(k, min(200, k + 60)))
        rng = np.random.default_rng([9, k // 60])
        last, held, out = rng.random(size), [], []
        for x in rows:  # a buffer read row by row
            if len(held) < size:
                held.append(x)
            else:
                j = int(rng.random() * size)
                out.append(held[j])
                held[j] = x
        for i in range(len(held)):
            j = i + int(last[i] * (len(held) - i))
            held[i], held[j] = held[j], held[i]
        for x in out + held:
            want[x * 3] = place
            place += 1
    for parts in (1, 4):
        got = {r.id: (r.place, r.text) for r in sampling.shuffle(df.repartition(parts), 9, "id", buffer_size=size).collect()}
        assert {i: p for i, (p, _) in got.items()} == want and all(t == f"t{i // 3}" for i, (_, t) in got.items())
    assert size == 1 or want != {i * 3: i for i in range(200)}
    assert sampling.shuffle(df.where("false"), 9, "id", buffer_size=size).count() == 0


def test_a_rows_types_are_drawn_once(spark):
    """Where each node draws its row's types again, the row below takes minutes."""
    n = 6_000
    node = "named_struct('char_end_idx', i, 'char_start_idx', i, 'key', concat('k', i % 500), 'type', 'local', 'value', 'v')"
    df = spark.range(1).selectExpr("id", "'text' as text", f"transform(sequence(1L, {n}L), i -> {node}) as tags")
    began = time.time()
    kept = [x.key for x in sampling.sample_tags(df, {"k1": 2.0}, 3, "id").first().tags]
    took = time.time() - began
    assert took < 20 and 0 < len(kept) == 12 * len(set(kept)) < n


def test_insertion_needs_no_exchange(spark):
    """Nodes are in a row with their text, so rows of equal or no ids keep their own."""
    node = lambda v: (3, 0, ([], []), "entity", None, None, None, "local", v)
    rows = [(1, "one", [node("a")]), (1, "two", [node("b")]), (None, "six", [node("c")]), (2, None, [node("d")]), (3, "ten", None)]
    df = spark.createDataFrame(rows, f"id long, text string, tags array<{schemas.ANY}>").repartition(2)
    out = linearize.insert_local(df, linearize.LinearizeConfig(), "id")
    assert {(r.id, r.text_with_tags) for r in out.collect()} == {(1, "one [[a]]"), (1, "two [[b]]"), (None, "six [[c]]"), (2, None), (3, "ten")}
    rows = linearize.train_rows(df.withColumn("id", F.coalesce("id", F.lit(9))), linearize.LinearizeConfig(max_seq_len=8), "id").collect()
    assert sorted((r.id, sum(r.attention_mask), r.tags_mask) for r in rows) == [(1, 4, [0, 1, 1, 1] + [0] * 4)] * 2 + [(3, 1, [0] * 8), (9, 4, [0, 1, 1, 1] + [0] * 4)]


@pytest.mark.parametrize("regular", [False, True])
def test_tokenizers_as_columns_code_alike(spark, monkeypatch, regular):
    """The tokenizer's own Arrow function, in pieces of a few characters, against the same as a column."""
    monkeypatch.setattr(linearize, "CUT_AT_ONCE", 20)
    node = lambda s, e, v: (e, s, ([], []), "entity", None, None, None, "local", v)
    tags = [[], [node(0, 3, "a_b"), node(4, 9, "c")], [node(2, 2, "mid"), ((None, None, None, "url", None, None, None, "global", "u"))]]
    df = spark.createDataFrame([(i, "some text, in parts" * (i % 4 + 1), tags[i % 3]) for i in range(30)], f"id long, text string, tags array<{schemas.ANY}>")
    cfg = linearize.LinearizeConfig(max_seq_len=16, local_as_regular_text=regular)
    one, many = (sorted(map(tuple, linearize.train_rows(df, cfg, "id", tokenizer=t).collect())) for t in (None, lambda text: linearize.regex_tokens(text)))
    assert one == many and len({r[0] for r in one}) == 30 and any(sum(r[4]) for r in one)
