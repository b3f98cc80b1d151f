"""SetSketch near duplicates, conversation repair and hard negatives against plain versions."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from tagweave.llm import conversation_repair, hard_negatives, queries, setsketch_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connection(SF)


@pytest.mark.parametrize("name", ["op11_setsketch_dedup", "op12_conversation_repair", "op13_hard_negatives"])
def test_sql(spark, con, name):
    compare.assert_same(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name])


# --- near duplicates


def components_plain(rows, per_cent=85):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")
    sets = []
    for _, text in rows:
        w = [x for x in (text or "").translate(table).split(" ") if x]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= per_cent * len(a | b):
            root[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((str((doc, len(sets[i]), least.get(find(i)), doc is None or doc == least[find(i)])) for i, (doc, _) in enumerate(rows)))


def told(df):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in df.collect())


@pytest.mark.parametrize("kw", [{}, {"brute": 4}, {"per_cent": 60}])
def test_components_on_odd_rows(odd, none, kw):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert told(setsketch_dedup.components(odd, **kw)) == components_plain(rows, kw.get("per_cent", 85))
    assert setsketch_dedup.components(none, **kw).count() == 0


@pytest.mark.parametrize("brute", [1024, 8])
def test_components_of_chains_and_stars(spark, brute):
    """Copies whose edits pile up, copies of one text with edits of their own, and texts that share half."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for _ in range(3):
        text = [word() for _ in range(120)]
        for _ in range(25):  # a chain: neighbours link, the ends don't
            rows.append(text)
            text = list(text)
            text[rng.randrange(len(text))] = word()
        hub = [word() for _ in range(150)]
        for _ in range(25):  # many of these link by the hub only
            copy = list(hub)
            for _ in range(2):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
        rows.append(hub)
        half = [word() for _ in range(60)]
        rows += [half + [word() for _ in range(rng.randrange(5, 60))] for _ in range(15)]
    rows = [(i, " ".join(t)) for i, t in enumerate(rng.sample(rows, len(rows)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(setsketch_dedup.components(df, brute=brute)) == components_plain(rows)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(11)
    pool = rng.integers(0, 2**64, 6000, dtype=np.uint64)
    for n, m, both in ((400, 400, 370), (3000, 2600, 2500), (30, 30, 29), (1, 1, 1), (700, 700, 100)):
        a, b = pool[:n], pool[n - both : n - both + m]
        x, y = setsketch_dedup.registers(a), setsketch_dedup.registers(b)
        assert (np.maximum(x, y) == setsketch_dedup.registers(np.union1d(a, b))).all()
        assert (setsketch_dedup.registers(a[::-1].copy()) == x).all() and x.min() > 0 and x.max() < 255
        true = both / (n + m - both)
        args = [np.array([float(v)]) for v in ((x > y).sum(), (x < y).sum(), (x == y).sum(), n / (n + m))]
        got = float(setsketch_dedup.estimate(*args)[0])
        assert abs(got - true) < 5 * math.sqrt(max(true * (1 - true), 0.01) / setsketch_dedup.REGISTERS)
        pair = (x[None], y[None], np.array([float(n)]), np.array([float(m)]))
        assert setsketch_dedup.possible(*pair, min(true, 0.99))[0]
        assert not setsketch_dedup.possible(*pair, min(1.0, true + 0.3))[0] or true > 0.7


def test_a_group_of_near_copies_costs_what_its_size_does(spark, monkeypatch):
    """Pairs sent for exact comparison grow with the rows, not with their square."""
    rng = random.Random(3)
    hub = [f"w{rng.randrange(10**6)}" for _ in range(300)]

    def copy(_):
        c = list(hub)
        c[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        return " ".join(c)

    sent = []
    was = setsketch_dedup._Sets.links
    monkeypatch.setattr(setsketch_dedup._Sets, "links", lambda self, pairs: (sent.append(pairs.count()), was(self, pairs))[1])
    df = spark.createDataFrame([(i, copy(i)) for i in range(1500)], "doc_id long, text string")
    out = setsketch_dedup.components(df)
    assert out.where("component_id <> 0").count() == 0 and sum(sent) < 3 * 1500


# --- conversations


def repair_plain(turns):
    """turns: (role, text, must go, truncated) -> (cost, audit, hash) by all items at each place."""
    live = {"": (0, "", [])}  # the last role's initial, or none

    def inserted(live):
        for _ in range(4):
            for last, (cost, audit, lines) in list(live.items()):
                then = "a" if last == "u" else "u"
                new = cost + 3, audit + "I", [*lines, ("assistant:" if then == "a" else "user:")]
                if then not in live or new[:2] < live[then][:2]:
                    live[then] = new
        return live

    for role, text, gone, cut in turns:
        new = {}
        for last, (cost, audit, lines) in inserted(live).items():
            then = "a" if last == "u" else "u"
            ways = [(last, cost + 4, audit + "D", lines)]
            if not gone:
                ways.append((then, cost + 3 + 3 * cut, audit + "R", [*lines, f"{'assistant' if then == 'a' else 'user'}:{text}"]))
                if role[:1] == then:
                    ways.append((then, cost + 3 * cut, audit + "K", [*lines, f"{role}:{text}"]))
                if last == "" and role[:1] == "s":
                    ways.append(("s", cost + 3 * cut, audit + "K", [*lines, f"{role}:{text}"]))
            for state, *way in ways:
                if state not in new or tuple(way[:2]) < new[state][:2]:
                    new[state] = tuple(way)
        live = new
    cost, audit, lines = min(v for k, v in inserted(live).items() if k in ("", "a"))
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("segment", [1, 2, 3, 256])
def test_repair_of_any_turns(segment):
    rng = random.Random(segment)
    for n in [0, 1, 2, 3, 5, 8, 13, 40] * 12:
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", " ", "u"]), rng.choice(["a.", "b", "c!", ""]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]
        r = conversation_repair.Repair(segment)
        for t in turns:
            r.add(*t)
        assert r.finish() == repair_plain(turns)


def test_all_audits_of_few_turns():
    """Against every string of edits there is, not only the best of each state."""
    rng = random.Random(5)
    for _ in range(60):
        turns = [(rng.choice(["user", "assistant", "system"]), str(i), rng.random() < 0.2, rng.random() < 0.3) for i in range(rng.randrange(4))]
        best = None
        for size in range(len(turns) + 4):
            for audit in itertools.product("DIKR", repeat=size):
                if sum(c != "I" for c in audit) != len(turns):
                    continue
                i, last, cost, legal = 0, "", 0, True
                for c in audit:
                    then = "a" if last == "u" else "u"
                    if c == "I":
                        cost, last = cost + 3, then
                        continue
                    role, _, gone, cut = turns[i]
                    i += 1
                    if c == "D":
                        cost += 4
                    elif gone:
                        legal = False
                    elif c == "R":
                        cost, last = cost + 3 + 3 * cut, then
                    elif role[0] == then or (role[0] == "s" and last == ""):
                        cost, last = cost + 3 * cut, role[0]
                    else:
                        legal = False
                if legal and last in ("", "a") and (best is None or (cost, audit) < best):
                    best = cost, audit
        r = conversation_repair.Repair()
        for t in turns:
            r.add(*t)
        cost, audit, _ = r.finish()
        assert (cost, audit) == (best[0], "".join(best[1]))


def test_a_very_long_conversation():
    r = conversation_repair.Repair()
    for i in range(20_001):
        r.add("user" if i % 2 == 0 else "assistant", f"text {i}.", i % 1000 == 7, i % 1000 == 9)
    cost, audit, _ = r.finish()
    assert audit.count("D") >= 20 and cost > 0 and len(audit) >= 20_001


ODD = [
    (1, 0, "user", "Hello there."),
    (1, 0, "user", "Hello there."),
    (1, 4, "assistant", "Yes"),
    (1, None, "system", "Be kind."),
    (2, None, None, None),
    (2, None, "tool", " \t "),
    (None, 3, "user", "no id."),
    (None, None, "assistant", "no id either!"),
    (3, -5, "assistant", "first?"),
    (3, 2**40, "user", "x. " + "y" * 100_000),
    (4, 1, "", "."),
]


def test_repair_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("x")).withColumn("there", F.lit(1)).repartition(3)
    got = {r.conv_id: r for r in conversation_repair.repair(df).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert (got[1].gaps, got[1].duplicate, got[1].truncated, got[1].illegal, got[1].audit) == (3, 1, 1, 1, "KKDK")
    assert (got[2].gaps, got[2].blank, got[2].audit, got[2].cost) == (0, 2, "DD", 8)
    assert got[3].gaps == 2**40 + 5 - 1 and got[3].truncated == 1
    assert got[2].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].audit == "D" and got[4].cost == 4 and got[None].audit in ("DKD", "DD", "KI", "RR", "IKKI", "IKK", "DKI")
    none = conversation_repair.repair(df.where("false"))
    assert none.count() == 0
    away = conversation_repair.repair(df, F.lit(False)).collect()
    assert {(r.conv_id, r.cost, r.audit, r.repaired_sha256) for r in away} == {(c, 0, "", hashlib.sha256(b"").hexdigest()) for c in (1, 2, 3, 4, None)}


def test_damage_keeps_names(spark):
    df = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    out = conversation_repair.damage(df)
    assert out.columns == ["conv_id", "turn", "role", "text", "there"] and out.count() >= len(ODD)
    assert out.where("role is null or text is null").count() == 0


# --- hard negatives


def mined_plain(rows, anchors, k=5, most=10, lowest=30, highest=90):
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i, (a, label, v) in enumerate(rows):
        if a not in anchors:
            continue
        scored = sorted(((-dot(v, w), b, other == label) for j, (b, other, w) in enumerate(rows) if i != j))
        for ps, p, _ in [x for x in scored if x[2]][:k]:
            window = [(s, b) for s, b, same in scored if not same and lowest * -ps <= 100 * -s <= highest * -ps]
            out += [(a, p, n + 1, b, -ps, -s) for n, (s, b) in enumerate(window[:most])]
    return sorted(out)


def mined(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("kw", [{}, {"block": 40, "chunk": 3}])
@pytest.mark.parametrize("kind", ["round", "near", "huge", "ties"])
def test_mine(spark, kw, kind):
    rng = np.random.default_rng(len(kind))
    n, d = 220, 20
    x = rng.normal(size=(n, d)) * 100
    if kind == "near":
        x = np.abs(x) + 300 * (np.arange(n) % 3)[:, None] * (np.arange(d) % 3 == np.arange(n)[:, None] % 3)
    if kind == "huge":
        x *= 2**19
    if kind == "ties":
        x = rng.integers(-1, 3, (n, d))
    rows = [(i, int(i % 4), [int(v) for v in np.floor(x[i])]) for i in range(n)]
    rows[5] = (5, 1, rows[5][2][:7])  # shorter
    rows[6] = (6, 2, [])
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<long>").withColumn("q", F.lit("x")).withColumn("norm", F.lit("x")).repartition(5)
    anchors = {0, 5, 6, 50, 100, 150, 200}
    got = mined(hard_negatives.mine(df, df.where(F.col("vec_id").isin(*anchors)), **kw))
    assert got == mined_plain(rows, anchors)


def test_mine_odd_rows(spark):
    bad = [(None, 1, [1]), (1, None, [1]), (2, 1, None), (3, 1, [None])]
    df = spark.createDataFrame(bad, "vec_id long, label int, v array<long>")
    assert hard_negatives.mine(df, df).count() == 0
    x = spark.createDataFrame([(7, 1, [1.0, float("nan")]), (8, 1, [float("inf")]), (9, 1, [None, 1.0]), (10, 1, None), (11, 1, [-0.001, 0.5])], "vec_id long, label int, embedding array<float>")
    assert {r.vec_id: r.v for r in hard_negatives.whole_numbers(x).collect()} == {7: None, 8: None, 9: None, 10: None, 11: [-1, 128]}


def test_mine_repeated_rows(spark):
    rows = [(0, 0, [5, 1]), (0, 0, [5, 1]), (1, 0, [4, 0]), (2, 1, [2, 1]), (2, 1, [2, 1]), (3, 1, [3, 0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<long>")
    assert mined(hard_negatives.mine(df, df.where("vec_id = 0"))) == mined_plain(rows, {0})
