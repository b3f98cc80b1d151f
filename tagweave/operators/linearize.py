"""Tag into text and text into training rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.exprs import MONTHS, col, let, uniform, unquote
from tagweave.operators.html import Rule, any_rule
from tagweave.sources import settled


@dataclass(frozen=True)
class HtmlRules:
    """Which html nodes are rendered, and with which attributes (None: all)."""

    attributes_to_keep: tuple[str, ...] | None = None
    drop: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class LinearizeConfig:
    tags_list: tuple[str, ...] = ("html", "timestamp", "website_description", "title", "url", "datasource", "length", "entity", "entity_paragraph")
    tags_sep: str = " | "
    tags_key_value_sep: str = ": "
    tags_prefix_sep: str = " |||"
    tags_prefix_start_seq: str = ""
    tags_probability: float = 1.0
    entity_setting: str = "beg"
    special_tokens_in_prefix: bool = False
    special_tokens: dict[str, str] = field(default_factory=dict)
    wrap_start: dict[str, str] = field(default_factory=dict)
    wrap_end: dict[str, str] = field(default_factory=dict)
    local_as_regular_text: bool = False
    same_context_without_tags: bool = False
    #: Annotations (keys) to use; None: all.
    tags_columns: tuple[str, ...] | None = None
    #: Draw some of a row's types, by weights or by inverse frequency over sample_size rows (None: all).
    random_sample: bool = False
    sample_size: int | None = None
    sample_weights: dict[str, float] | None = None
    html_rate: float = 1.0
    #: Special tokens and wrappers of keys are tokens of their own.
    special_token_state: bool = False
    max_seq_len: int = 1024
    pad_id: int = 0
    html: HtmlRules = HtmlRules()

    def specials(self) -> tuple[str, ...]:
        held = (*self.special_tokens.values(), *self.wrap_start.values(), *self.wrap_end.values())
        return tuple(dict.fromkeys(held)) if self.special_token_state else ()

    def for_prompt(self) -> LinearizeConfig:
        return replace(self, tags_sep="; ", tags_prefix_sep="")


#: What stands before the value of a global node instead of its key, and before lists of entities.
LABELS = {"title": "Title", "website_description": "Website Description", "datasource": "Datasource", "length": "Text Length"}
PROMPT_LABELS = LABELS | {"datasource": "Data source", "length": "Number of characters"}
LISTED = {"entity": "Entities", "entity_paragraph": "Entity Paragraphs"}


def timestamp_of(value: Column) -> Column:
    """An epoch in digits, the last three of them milliseconds, or ISO text, whose offset is ignored."""
    digits = F.regexp_replace(value, "[.]", "")
    epoch = F.timestamp_millis(digits.try_cast("bigint")).cast("timestamp_ntz")
    plain = F.regexp_replace(F.regexp_replace(value, r"(Z|[+-]\d{2}:?\d{2})$", ""), "T", " ")
    return F.when(value.rlike(r"^\d{11,13}$|^\d{9,10}\.?\d{3}$"), epoch).otherwise(F.try_to_timestamp(plain).cast("timestamp_ntz"))


def render_timestamp(value: Column, cfg: LinearizeConfig) -> Column:
    ts = timestamp_of(value)
    names = F.array(*(F.lit(m.capitalize()) for m in MONTHS))
    return F.concat(F.lit("Year: "), F.year(ts).cast("string"), F.lit(cfg.tags_sep + "Month: "), F.get(names, F.month(ts) - 1))


Renderer = Callable[[Column, LinearizeConfig], Column]
#: Renderers of global nodes by key; copy and change to render a key differently.
GLOBAL_RENDERERS: dict[str, Renderer] = {
    "timestamp": lambda n, cfg: render_timestamp(n["value"], cfg),
    "url": lambda n, cfg: F.concat(F.lit("url" + cfg.tags_key_value_sep), unquote(n["value"], plus=True)),
    **{k: (lambda n, cfg, label=v: F.concat(F.lit(label + cfg.tags_key_value_sep), n["value"])) for k, v in LABELS.items()},
}
PROMPT_RENDERERS = GLOBAL_RENDERERS | {
    k: (lambda n, cfg, label=v: F.concat(F.lit(label + cfg.tags_key_value_sep), n["value"])) for k, v in PROMPT_LABELS.items()
}


def render_global(node: Column, cfg: LinearizeConfig, renderers: dict[str, Renderer] = GLOBAL_RENDERERS) -> Column:
    out = F.concat(node["key"], F.lit(cfg.tags_key_value_sep), node["value"])
    for key, f in renderers.items():
        out = F.when(node["key"] == key, f(node, cfg)).otherwise(out)
    return out


def _html_shown(node: Column, rules: HtmlRules) -> Column:
    return ~any_rule(rules.drop, node["value"], node["char_end_idx"] - node["char_start_idx"])


def render_local(node: Column, cfg: LinearizeConfig, renderers: dict[str, Renderer] | None = None) -> Column:
    """struct<start, end>: texts put at both ends of a node; null where the node isn't shown.

    renderers: such structs for keys that are to be rendered differently.
    """
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    kv = F.concat(node["key"], F.lit(cfg.tags_key_value_sep), node["value"])
    name = F.replace(node["value"], F.lit("_"), F.lit(" "))
    attrs = F.arrays_zip(node["html_attrs"]["attrs"].alias("a"), node["html_attrs"]["values"].alias("v"))
    if cfg.html.attributes_to_keep is not None:
        attrs = F.filter(attrs, lambda x: x["a"].isin(list(cfg.html.attributes_to_keep)))
    shown = F.coalesce(F.array_join(F.transform(attrs, lambda x: F.concat(F.lit(" "), x["a"], F.lit(":"), x["v"])), ""), F.lit(""))
    bar = F.concat(F.lit(" |"), name, F.lit("|"))
    none = F.lit("")
    html = pair(F.concat(F.lit("<"), node["value"], shown, F.lit(">")), F.concat(F.lit("</"), node["value"], F.lit(">")))
    out = (
        F.when(node["key"] == "entity", pair(none, F.concat(F.lit(" [["), name, F.lit("]]"))))
        .when(node["key"] == "entity_paragraph", pair(bar, none) if cfg.entity_setting == "beg" else pair(none, bar))
        .when(node["key"] == "basic_start_local", pair(node["value"], none))
        .when((node["key"] == "html") & _html_shown(node, cfg.html), html)
        .when(node["key"] != "html", pair(F.concat(F.lit("["), kv, F.lit("]")), F.concat(F.lit("[/"), kv, F.lit("]"))))
    )
    for key, f in (renderers or {}).items():
        out = F.when(node["key"] == key, f(node, cfg)).otherwise(out)
    return out


def tags_prefix(df: DataFrame, cfg: LinearizeConfig, style: str = "prefix", out: str = "prefix", nodes: str = "tags", renderers: dict[str, Renderer] | None = None) -> DataFrame:
    """The rendered last node of each key, in the order of tags_list; "" without any.

    style "prompt": entities are listed once each, sorted, and other local keys appear as titles.
    """
    prompt = style == "prompt"
    use = renderers or (PROMPT_RENDERERS if prompt else GLOBAL_RENDERERS)
    parts = []
    of = lambda key: F.filter(nodes, lambda n: n["key"] == key)
    for key in cfg.tags_list:
        own = of(key)
        last = F.try_element_at(own, F.lit(-1))
        text = F.when(last["type"] == "global", render_global(last, cfg, {k: f for k, f in use.items() if k == key}))
        if prompt and key in LISTED:
            values = F.array_sort(F.array_distinct(F.transform(own, lambda n: F.replace(n["value"], F.lit("_"), F.lit(" ")))))
            local = F.concat(F.lit(LISTED[key] + cfg.tags_key_value_sep), F.array_join(values, ", "))
        elif cfg.special_tokens_in_prefix:
            local = F.lit(cfg.special_tokens.get(key, key.title() if prompt else key))
        else:
            local = F.lit(key.title()) if prompt else F.lit(None).cast("string")
        parts.append(F.when(F.size(own) > 0, text.otherwise(local)))
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull())
    return df.withColumn(out, F.when(F.size(kept) > 0, F.concat(F.array_join(kept, cfg.tags_sep), F.lit(cfg.tags_prefix_sep))).otherwise(""))


def _inserts(cfg: LinearizeConfig, nodes: str, text: str, renderers: dict[str, Renderer] | None) -> Column:
    """array<struct<at, text>>: what is put into a row's text, in the order in which local_events has it."""
    keys = F.array(*(F.lit(k) for k in cfg.tags_list))
    rank = lambda n: F.array_position(keys, n["key"])

    def event(at: Column, slot: Column, order: tuple[Column, ...], text: Column, joint: tuple[Column, int, Column] | None = None) -> Column:
        """Sorted by all fields in turn; joint: position, edge and key of what is merged."""
        p, edge, key = joint or (None, None, None)
        by = [o.cast("long").alias(f"order{k}") for k, o in enumerate(order)]
        lit = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
        return F.struct(at.alias("at"), slot.cast("int").alias("slot"), *by, lit(p, "long").alias("p"), lit(edge, "int").alias("edge"), text.alias("text"), lit(key, "string").alias("key"))

    def plain(n: Column, i: Column, rank: Column, r: Column) -> Column:
        start, end = n["char_start_idx"], n["char_end_idx"]
        empty, order = start == end, lambda sign: (sign * rank * 2, sign * end, sign * i)
        return F.array(event(start, F.when(empty, 1).otherwise(3), order(-1), r["start"]), event(end, F.when(empty, 2).otherwise(0), order(1), r["end"]))

    def merged(n: Column, rank: Column, r: Column) -> Column:
        start, end = n["char_start_idx"], n["char_end_idx"]
        order = lambda at: (-(rank * 2 + 1), -at, F.lit(0))
        return F.array(
            event(start, F.lit(1), order(start), r["start"], (n["relative_start_pos"], 0, n["key"])),
            event(end, F.lit(1), order(end), r["end"], (n["relative_end_pos"], 1, n["key"])),
        )

    def of(own: Column) -> Column:
        relative = F.filter(keys, lambda k: F.get(F.filter(own, lambda n: n["key"] == k), F.lit(0))["relative_start_pos"].isNotNull())
        shown = F.transform(own, lambda n, i: F.struct(n.alias("n"), i.alias("i"), rank(n).alias("rank"), render_local(n, cfg, renderers).alias("r")))

        of_node = lambda x, keys: F.when(F.array_contains(keys, x["n"]["key"]), merged(x["n"], x["rank"], x["r"])).otherwise(plain(x["n"], x["i"], x["rank"], x["r"]))
        return let(relative, lambda keys: F.flatten(F.transform(shown, lambda x: of_node(x, keys))))

    def wrapped(es: Column) -> Column:
        alike = lambda e, other: F.coalesce((other["at"] == e["at"]) & (other["key"] == e["key"]), F.lit(False))

        def one(e: Column, i: Column) -> Column:
            out = e["text"]
            for k in cfg.wrap_start.keys() | cfg.wrap_end.keys():
                a = F.when(alike(e, F.get(es, i - 1)), "").otherwise(cfg.wrap_start.get(k, ""))
                b = F.when(alike(e, F.get(es, i + 1)), "").otherwise(cfg.wrap_end.get(k, ""))
                out = F.when(e["key"] == k, F.concat(a, e["text"], b)).otherwise(out)
            return F.struct(e["at"].alias("at"), out.alias("text"))

        return F.transform(es, one)

    own = F.filter(nodes, lambda n: (n["type"] == "local") & (rank(n) > 0))
    held = let(F.length(text), lambda n: F.filter(let(own, of), lambda e: (e["text"] != "") & e["at"].between(0, n)))
    return F.coalesce(let(F.array_sort(held), wrapped), F.array().cast("array<struct<at:bigint,text:string>>"))


def local_events(df: DataFrame, cfg: LinearizeConfig, id_col: str, nodes: str = "tags", text_col: str = "text", renderers: dict[str, Renderer] | None = None) -> DataFrame:
    """(id, offset, text): all that is inserted at each offset of the text, in order; other offsets are left out.

    Nodes of a key that have relative positions are first merged at every offset, in that order, with the
    key's wrapper texts around. Then, at an offset: ends of spans, starts and ends of empty spans, starts of
    spans; of starts the later in order comes first.
    """
    flat = df.select(F.col(id_col).alias("_id"), F.posexplode(_inserts(cfg, nodes, text_col, renderers)).alias("i", "e"))
    lists = flat.groupBy("_id", F.col("e.at").alias("offset")).agg(F.array_sort(F.collect_list(F.struct("i", "e.text"))).alias("es"))
    return lists.select("_id", "offset", F.array_join(F.transform("es", lambda e: e["text"]), "").alias("text"))


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Bounds of lists in their values, and the values."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.r_[0, np.cumsum(sizes, dtype=np.int64)], lists.flatten()


def _longs(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def _woven(texts: pa.Array, places: pa.Array, inserts: pa.Array) -> pa.Array:
    """Texts with inserts, and where these start and end in them."""
    bounds, parts = _flat(inserts)
    at = _longs(places.flatten())
    sizes = _longs(pc.utf8_length(parts))
    upto = np.r_[0, np.cumsum(sizes)]
    starts = at + upto[:-1] - np.repeat(upto[bounds[:-1]], np.diff(bounds))
    out = [pa.array([], pa.string())]
    for a, b in in_pieces(_longs(pc.fill_null(pc.utf8_length(texts), 0)), CUT_AT_ONCE):
        lo, hi = int(bounds[a]), int(bounds[b])
        rest, made = zip(at[lo:hi].tolist(), parts.slice(lo, hi - lo).to_pylist(), strict=True), []
        for text, n in zip(texts.slice(a, b - a).to_pylist(), np.diff(bounds[a : b + 1]).tolist(), strict=True):
            pieces, last = [], 0
            for place, part in islice(rest, n):
                pieces += (text[last:place], part)
                last = place
            made.append("".join((*pieces, text[last:])) if n else text)
        out.append(pa.array(made, pa.string()))
    lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v.astype(np.int32))) for v in (starts, starts + sizes)]
    return pa.StructArray.from_arrays([pa.concat_arrays(out), *lists], ["text", "starts", "ends"])


# nondeterministic by name, as the tokenizer's
_PLACES = T.ArrayType(T.IntegerType())
_weave = F.arrow_udf(_woven, T.StructType([T.StructField("text", T.StringType()), T.StructField("starts", _PLACES), T.StructField("ends", _PLACES)])).asNondeterministic()


def _with_inserts(df: DataFrame, cfg: LinearizeConfig, nodes: str, text: str, renderers: dict[str, Renderer] | None) -> DataFrame:
    """df with `_woven`, a struct of the text with its inserts and the places of these.

    A node list is in a row with its text, so nothing is exchanged. Inserts are a column that is read twice, so the
    optimizer leaves it: with nested lambdas in its arguments it doesn't find a Python function again.
    """
    held = df.withColumn("_inserts", _inserts(cfg, nodes, text, renderers))
    return held.withColumn("_woven", _weave(F.col(text), F.col("_inserts.at"), F.col("_inserts.text"))).drop("_inserts")


def insert_local(df: DataFrame, cfg: LinearizeConfig, id_col: str, nodes: str = "tags", text: str = "text", renderers: dict[str, Renderer] | None = None) -> DataFrame:
    """df with `text_with_tags` and `char_mask` (1 for inserted characters); offsets past the text are left out."""
    mask = F.expr(
        "concat(flatten(transform(_woven.starts, (s, i) -> concat(array_repeat(0, s - if(i = 0, 0, _woven.ends[i - 1])), array_repeat(1, _woven.ends[i] - s)))),"
        " array_repeat(0, length(_woven.text) - if(size(_woven.ends) = 0, 0, element_at(_woven.ends, -1))))"
    )
    both = _with_inserts(df, cfg, nodes, text, renderers)
    return both.withColumns({"text_with_tags": F.col("_woven.text"), "char_mask": mask}).drop("_woven")


#: White space is what SQL's regular expressions take for it, the ASCII kinds; re has more.
BLANK = r"\t\n\f\r "
#: Word with the white space before it, other characters likewise, or white space: every character is in a token.
TOKEN = rf"[{BLANK}]*\w+|[{BLANK}]*[^\w{BLANK}]+|[{BLANK}]+"
#: Characters of text whose tokens a worker holds as Python objects at once, a longer text apart, and words whose ids it remembers.
CUT_AT_ONCE, KNOWN = 1 << 20, 1 << 16
Tokenizer = Callable[[Column], Column]
_TOKENS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("id", "start", "end")]))


class _Ids(dict):
    """Ids of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = found = int(hashlib.md5(word.encode()).hexdigest()[:7], 16)
        return found


def in_pieces(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of neighbours that start in the same stretch of `most`, of the sums of sizes."""
    stretch = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(stretch[1:] != stretch[:-1]) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]


def tokens_with(specials: tuple[str, ...] = ()) -> Tokenizer:
    """A tokenizer to array<struct<id, start, end>>; specials are tokens of their own wherever they stand.

    An id is the first 28 bits of the token's md5. Offsets are running sums over a text's tokens, which array
    functions only give in quadratic time, so texts are cut in Arrow batches.
    """
    special = "|".join(map(re.escape, sorted(filter(None, specials), key=len, reverse=True)))
    kept = rf"(?:{special})|[{BLANK}]+(?={special})|[{BLANK}]*(?:(?!{special})\w)+|[{BLANK}]*(?:(?!{special})[^\w{BLANK}])+|[{BLANK}]+"
    pattern = kept if special else TOKEN

    def cut(texts: pa.Array) -> pa.Array:
        find, known, counts = re.compile(pattern).findall, _Ids(), []
        none = np.empty(0, np.int32)
        ids, starts, ends = [none], [none], [none]
        for a, b in in_pieces(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64), CUT_AT_ONCE):
            words, sizes = [], []
            for text in texts.slice(a, b - a).to_pylist():
                own = find(text or "")
                words += own
                sizes.append(len(own))
            ids.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            # every character is in a token, so places are sums of lengths
            upto = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
            base = np.repeat(upto[np.r_[0, np.cumsum(sizes)][:-1]], sizes)
            starts.append((upto[:-1] - base).astype(np.int32))
            ends.append((upto[1:] - base).astype(np.int32))
            counts += sizes
            if len(known) > KNOWN:
                known.clear()
        tokens = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in (ids, starts, ends)], ["id", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), tokens, mask=texts.is_null())

    # nondeterministic by name, so that it isn't run once for every field that is read
    split = F.arrow_udf(cut, _TOKENS).asNondeterministic()

    def tokenizer(text: Column | str) -> Column:
        return split(col(text))

    tokenizer.cut = cut
    return tokenizer


def regex_tokens(text: Column | str) -> Column:
    """The tokens of a text, without special ones."""
    return tokens_with()(text)


def token_id(word: Column) -> Column:
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 7), 16, 10).cast("int")


def gate(cfg: LinearizeConfig, seed: int, id_col: str) -> Column:
    return uniform(seed, id_col, tag="gate") < F.lit(cfg.tags_probability)


def cap_prefix(ids: Column | str, max_seq_len: int) -> Column:
    """At most half of max_seq_len ids, of which the last two are the prefix's last two."""
    m = max_seq_len // 2
    return F.when(F.size(col(ids)) > m, F.concat(F.slice(col(ids), 1, max(0, m - 2)), F.slice(col(ids), -2, 2))).otherwise(col(ids))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _touched(starts: pd.Series, ends: pd.Series, chars: pd.Series) -> pd.Series:
    def one(b: np.ndarray, e: np.ndarray, marks: np.ndarray) -> np.ndarray:
        before = np.concatenate(([0], np.cumsum(marks)))
        n = len(marks)
        return (before[np.minimum(e, n)] > before[np.minimum(b, n)]).astype(np.int32)

    return pd.Series([None if m is None or b is None else one(np.asarray(b, int), np.asarray(e, int), np.asarray(m, int)) for b, e, m in zip(starts, ends, chars, strict=True)])


def token_mask(tokens: Column | str, chars: Column | str, regular: bool = False) -> Column:
    """1 for tokens that touch a marked character."""
    if regular:
        return F.transform(col(tokens), lambda t: F.lit(0))
    return _touched(F.transform(col(tokens), lambda t: t["start"]), F.transform(col(tokens), lambda t: t["end"]), col(chars))


def _met(tokens: pa.Array, starts: pa.Array, ends: pa.Array, lead: pa.Array) -> pa.Array:
    bounds, held = _flat(tokens)
    from_, to = held.field("start"), held.field("end")
    spans, begins, stops = _flat(starts)[0], _longs(starts.flatten()), _longs(ends.flatten())
    base = np.arange(len(tokens), dtype=np.int64) << 32  # places of all rows in one order
    begins, stops = (v + np.repeat(base, np.diff(spans)) for v in (begins, stops))
    shift, met = base - _longs(lead), [np.empty(0, np.int32)]
    for a, b in in_pieces(np.diff(bounds), CUT_AT_ONCE):
        own, (lo, hi), row = slice(spans[a], spans[b]), bounds[[a, b]].tolist(), np.repeat(shift[a:b], np.diff(bounds[a : b + 1]))
        # spans are in order and apart: of those that start before a token's end, one ends after its start
        started = np.searchsorted(begins[own], _longs(to.slice(lo, hi - lo)) + row, "left")
        met.append((started > np.searchsorted(stops[own], _longs(from_.slice(lo, hi - lo)) + row, "right")).astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(met)), mask=tokens.is_null())


_meet = F.arrow_udf(_met, T.ArrayType(T.IntegerType())).asNondeterministic()


def span_mask(tokens: Column | str, starts: Column | str, ends: Column | str, lead: Column, regular: bool = False) -> Column:
    """1 for tokens that touch a span; spans are in order and don't meet, and count from `lead` characters on."""
    if regular:
        return F.transform(col(tokens), lambda t: F.lit(0))
    return _meet(col(tokens), col(starts), col(ends), lead)


_CODED = T.StructType([T.StructField(n, _PLACES) for n in ("head", "ids", "mask")])


def _encode(cut: Callable[[pa.Array], pa.Array], regular: bool) -> Callable[..., Column]:
    """struct<head, ids, mask> from texts, their inserts, heads and whether a space leads, by a tokenizer's Arrow function.

    One pass in Python, a few texts at once, so a task holds one worker for it and no more than ids and masks of a batch.
    """

    def run(texts: pa.Array, places: pa.Array, inserts: pa.Array, heads: pa.Array, led: pa.Array) -> pa.Array:
        ids = lambda tokens: pa.ListArray.from_arrays(pa.array(_flat(tokens)[0], pa.int32()), tokens.flatten().field("id"))
        out = [[pa.array([], pa.list_(pa.int32()))] for _ in range(3)]
        for a, b in in_pieces(_longs(pc.fill_null(pc.utf8_length(texts), 0)), CUT_AT_ONCE):
            part = lambda x, a=a, b=b: x.slice(a, b - a)
            woven = _woven(part(texts), part(places), part(inserts))
            tokens = cut(pc.binary_join_element_wise(pc.if_else(part(led), " ", ""), woven.field("text"), ""))
            mask = _met(tokens, woven.field("starts"), woven.field("ends"), part(led).cast(pa.int32()))
            if regular:
                mask = pa.ListArray.from_arrays(mask.offsets, pa.array(np.zeros(len(mask.values), np.int32)))
            for kept, made in zip(out, (ids(cut(part(heads))), ids(tokens), mask), strict=True):
                kept.append(made)
        return pa.StructArray.from_arrays([pa.concat_arrays(kept) for kept in out], _CODED.names)

    return F.arrow_udf(run, _CODED).asNondeterministic()


def chunk(df: DataFrame, max_seq_len: int, pad_id: int = 0, ids: str = "ids", mask: str = "mask", prefix: str = "prefix_ids", same_context: bool = False) -> DataFrame:
    """A row a window: chunk_idx, input_ids, attention_mask, tags_mask, all max_seq_len long; no ids, no rows.

    The prefix stands at the head of every window. same_context cuts at the same places and leaves it out.
    """
    n = F.size(prefix)
    step = F.lit(max_seq_len) - n
    at = F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.size(ids) - 1, F.greatest(step, F.lit(1))))
    rows = df.select("*", F.posexplode(at).alias("chunk_idx", "_at"))
    own, marks = F.slice(ids, F.col("_at") + 1, step), F.slice(mask, F.col("_at") + 1, step)
    pad = (F.lit(max_seq_len) - F.size(own)) if same_context else step - F.size(own)
    zeros = F.array_repeat(F.lit(0), pad)
    head = F.array().cast("array<int>") if same_context else F.col(prefix)
    used = F.size(own) if same_context else n + F.size(own)
    out = {
        "input_ids": F.concat(head, own, F.array_repeat(F.lit(pad_id), pad)),
        "attention_mask": F.concat(F.array_repeat(F.lit(1), used), zeros),
        "tags_mask": F.array_repeat(F.lit(0), max_seq_len) if same_context else F.concat(F.array_repeat(F.lit(1), n), marks, zeros),
    }
    return rows.withColumns(out).drop("_at")


def pack(df: DataFrame, block: int, group_by: str, order_by: str, ids: str = "ids", pad_id: int = 0) -> DataFrame:
    """(group, block_idx, input_ids, attention_mask): a group's ids one after another, in blocks.

    The rest is dropped if the group fills a block, else padded. Rows are placed by the sum of the sizes
    before them and cut at the block bounds they cross, so no group is gathered: sums are taken in ranges of
    (group, order), and then over a group's ranges, of which each is one number.
    """
    held = df.where(F.size(ids) > 0).select(F.col(group_by), F.col(order_by).alias("_o"), F.col(ids).alias("_ids"))
    ranged = settled(held.repartitionByRange(group_by, "_o").withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy(group_by, "_range").orderBy("_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranged.groupBy(group_by, "_range").agg(F.sum(F.size("_ids")).alias("_all"))
    earlier = Window.partitionBy(group_by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col(group_by).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_base"))
    placed = ranged.withColumn("_b", F.sum(F.size("_ids")).over(own) - F.size("_ids"))
    placed = placed.join(bases, F.col(group_by).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    placed = placed.select(F.col(group_by), "_ids", (F.col("_b") + F.col("_base")).alias("_b"))
    last = F.col("_b") + F.size("_ids") - 1
    cut = placed.select("*", F.explode(F.sequence(F.floor(F.col("_b") / block), F.floor(last / block))).alias("block_idx"))
    lo = F.greatest(F.col("_b"), F.col("block_idx") * block)
    hi = F.least(last + 1, (F.col("block_idx") + 1) * block)
    cut = cut.select(group_by, "block_idx", lo.alias("_lo"), F.slice("_ids", (lo - F.col("_b") + 1).cast("int"), (hi - lo).cast("int")).alias("_part"))
    blocks = cut.groupBy(group_by, "block_idx").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_lo", "_part"))), lambda x: x["_part"])).alias("_ids"))
    full = F.size("_ids")
    kept = blocks.where((full == block) | (F.col("block_idx") == 0))
    return kept.select(
        group_by, F.col("block_idx").cast("long").alias("block_idx"),
        F.concat("_ids", F.array_repeat(F.lit(pad_id), F.lit(block) - full)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), full), F.array_repeat(F.lit(0), F.lit(block) - full)).alias("attention_mask"),
    )


def fix_length(df: DataFrame, n: int, pad_id: int = 0, ignore: int = -100, ids: str = "input_ids") -> DataFrame:
    """input_ids, attention_mask and labels cut or padded to n."""
    own = F.slice(ids, 1, n)
    pad = F.lit(n) - F.size(own)
    return df.withColumns(
        {
            "attention_mask": F.concat(F.array_repeat(F.lit(1), F.size(own)), F.array_repeat(F.lit(0), pad)),
            "labels": F.concat(own, F.array_repeat(F.lit(ignore), pad)),
            ids: F.concat(own, F.array_repeat(F.lit(pad_id), pad)),
        }
    )


def train_rows(
    df: DataFrame,
    cfg: LinearizeConfig,
    id_col: str,
    seed: int = 0,
    tokenizer: Tokenizer | None = None,
    nodes: str = "tags",
    renderers: dict[str, Renderer] | None = None,
    local_renderers: dict[str, Renderer] | None = None,
) -> DataFrame:
    """Training rows of documents (id, text, tags): id, chunk_idx, input_ids, attention_mask, tags_mask, labels."""
    tokenizer = tokenizer or tokens_with(cfg.specials())
    src = df.where(F.length("text") > 0).select(F.col(id_col), "text", F.when(gate(cfg, seed, id_col), F.col(nodes)).otherwise(F.array().cast(df.schema[nodes].dataType)).alias("tags"))
    prefixed = tags_prefix(src, cfg, renderers=renderers)
    has = F.col("prefix") != ""
    head = F.concat(F.lit(cfg.tags_prefix_start_seq), F.col("prefix"))
    if hasattr(tokenizer, "cut"):
        held = prefixed.withColumn("_inserts", _inserts(cfg, "tags", "text", local_renderers))
        encode = _encode(tokenizer.cut, cfg.local_as_regular_text)
        coded = held.withColumn("_coded", encode(F.col("text"), F.col("_inserts.at"), F.col("_inserts.text"), head, has))
        head_ids, ids, mask = (F.col(f"_coded.{c}") for c in _CODED.names)
    else:
        woven = _with_inserts(prefixed, cfg, "tags", "text", local_renderers)
        text = F.concat(F.when(has, " ").otherwise(""), F.col("_woven.text"))
        coded = woven.withColumns({"_head": tokenizer(head), "_tokens": tokenizer(text)})
        head_ids, ids = F.col("_head.id"), F.col("_tokens.id")
        mask = span_mask("_tokens", "_woven.starts", "_woven.ends", F.when(has, 1).otherwise(0), cfg.local_as_regular_text)
    coded = coded.withColumns({"prefix_ids": F.when(has, cap_prefix(head_ids, cfg.max_seq_len)).otherwise(F.array().cast("array<int>")), "ids": ids, "mask": mask})
    rows = chunk(coded, cfg.max_seq_len, cfg.pad_id, same_context=cfg.same_context_without_tags)
    return rows.select(id_col, "chunk_idx", "input_ids", "attention_mask", "tags_mask", F.col("input_ids").alias("labels"))


def paired_examples(df: DataFrame, cfg: LinearizeConfig, id_col: str, include_chunked: bool = False, tokenizer: Tokenizer | None = None) -> DataFrame:
    """id, normal_ids, normal_attention, tags_ids, tags_attention, tags_mask of first windows.

    Only documents of one window, unless include_chunked; a window that is tags throughout is left out.
    """
    with_ = train_rows(df, cfg, id_col, tokenizer=tokenizer)
    without = train_rows(df, replace(cfg, same_context_without_tags=True), id_col, tokenizer=tokenizer)
    chunks = with_.groupBy(id_col).agg(F.max("chunk_idx").alias("_last"))
    first = with_.where("chunk_idx = 0 and not forall(tags_mask, m -> m = 1)").join(chunks, id_col)
    first = first if include_chunked else first.where("_last = 0")
    normal = without.where("chunk_idx = 0").select(id_col, F.col("input_ids").alias("normal_ids"), F.col("attention_mask").alias("normal_attention"))
    return first.select(id_col, F.col("input_ids").alias("tags_ids"), F.col("attention_mask").alias("tags_attention"), "tags_mask").join(normal, id_col)
