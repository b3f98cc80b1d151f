"""Taggers: projections that append tags nodes to a list column and keep the rows.

Each is tag_x(df, out=..., inputs...) -> df. A null list counts as empty; null inputs give no node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions.exprs import col, first_value, global_node, holders, local_node, no_nodes, path_date, places_in_runs, running_sums, unquote, url_keyword, url_netloc, url_path
from tagweave.schemas import GLOBAL, LOCAL, LOCAL_REL, PARAGRAPH
from tagweave.sources import settled

#: Tags that end a paragraph.
PARAGRAPH_TAGS = (
    "p div li ul ol hr pre blockquote dt dd dl menu figcaption figure "
    "h3 h2 h1 h4 h5 h6 nav article main section address aside"
).split()
#: Descriptions that are no descriptions, and their length in words.
CORRUPT_DESCRIPTION = r"(?dU)^(.* refer(|s) to.?:|\[\[\w*:)"
MIN_WORDS, MAX_WORDS = 5, 50


def append(df: DataFrame, out: str, nodes: Column, kind: str) -> DataFrame:
    nodes = F.coalesce(nodes, no_nodes(kind))
    held = F.coalesce(F.col(out), no_nodes(kind)) if out in df.columns else no_nodes(kind)
    return df.withColumn(out, F.concat(held, nodes))


def tag_url(df: DataFrame, out: str = "tags_url", url: str = "url") -> DataFrame:
    return append(df, out, F.when(F.length(url) > 0, F.array(global_node("url", F.col(url)))), GLOBAL)


def tag_timestamp(df: DataFrame, out: str = "tags_timestamp", urls: str = "tags_url") -> DataFrame:
    """The date in the path of the first url node."""
    date = path_date(unquote(url_path(first_value(urls, "url"))))
    node = global_node("timestamp", F.date_format(date, "yyyy-MM-dd HH:mm:ss"))
    return append(df, out, F.when(date.isNotNull(), F.array(node)), GLOBAL)


def tag_length_text(df: DataFrame, out: str = "tags_generation_length_text", text: str = "text") -> DataFrame:
    """The number of code points of the text."""
    return append(df, out, F.when(F.col(text).isNotNull(), F.array(global_node("length", F.length(text)))), GLOBAL)


def tag_length_sentence(df: DataFrame, out: str = "tags_generation_length_sentence", text: str = "text") -> DataFrame:
    """A node for every full stop: from the stop before it (or 0) to it, valued at the characters between."""
    parts = F.split(F.col(text), "\\.")
    sizes = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.length(s))
    held = df.withColumn("_sizes", sizes).withColumn("_upto", running_sums("_sizes"))

    def node(n: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get("_upto", i - 1) + i - 1)
        return local_node("length", start.cast("long"), (F.get("_upto", i) + i).cast("long"), n)

    return append(held, out, F.transform("_sizes", node), LOCAL).drop("_sizes", "_upto")


def datasource(url: Column | str) -> Column:
    """Authority and path segments as words, without leading and trailing numbers.

    A segment that begins with a number disappears whole; of any other, a number at its end goes.
    """
    segments = F.split(F.regexp_replace(url_path(url), "^/+|/+$", ""), "/")
    digits = lambda x: x.rlike("^[0-9]+$")

    def clean(segment: Column) -> Column:
        words = F.split(segment, "[-_+.&=]")
        kept = F.when(digits(words[0]), F.slice(words, 1, 0)).when(
            digits(F.element_at(words, -1)), F.slice(words, 1, F.size(words) - 1)
        )
        return F.coalesce(kept, words)

    lists = F.filter(F.transform(segments, clean), lambda w: F.size(w) > 0)
    return F.concat(url_netloc(url), F.lit(" > "), F.array_join(F.transform(lists, lambda w: F.array_join(w, " ")), " > "))


def tag_datasource(df: DataFrame, out: str = "tags_generation_datasource", url: str = "url") -> DataFrame:
    return append(df, out, F.when(F.col(url).isNotNull(), F.array(global_node("datasource", datasource(url)))), GLOBAL)


def tag_title(df: DataFrame, out: str = "tags_title", titles: str = "html_title") -> DataFrame:
    """What stands in the first title element, on one line."""
    pattern = "(?d)<title[^>]*>(.*)</title>"
    first = F.get(F.col(titles), F.lit(0))
    return append(df, out, F.when(first.rlike(pattern), F.array(global_node("title", F.regexp_extract(first, pattern, 1)))), GLOBAL)


def site_redirects(redirects: DataFrame) -> DataFrame:
    """(alias, title) with lower-cased aliases; of several titles for one, the largest `seq` or title wins."""
    order = F.col("seq") if "seq" in redirects.columns else F.col("title")
    return redirects.groupBy(F.lower("alias").alias("alias")).agg(F.max_by("title", order).alias("title"))


def first_sentence(text: Column) -> Column:
    """Up to the first `.`, `!` or `?` before white space and a capital, without bracketed parts."""
    bare = F.regexp_replace(text, r"\((?:[^)(]|\([^)(]*\))*\)", "")
    found = F.regexp_extract(bare, r"(?s)^(.*?[.!?])\s+[A-Z]", 1)
    return F.when(found != "", found).otherwise(bare)


def _paragraphs(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.where("seq = 0").groupBy(F.col("title").alias("_t")).agg(F.max("text").alias("_p"))


def describe_sites(df: DataFrame, keyword: str, redirects: DataFrame, paragraphs: DataFrame, out: str = "description") -> DataFrame:
    """First sentence of the first paragraph under the keyword's redirect, or its capitalised first label.

    Keywords are looked up once each: two equi-joins over the distinct keywords, then one back.
    """
    keys = df.select(F.col(keyword).alias("_k")).where("_k is not null").distinct()
    named = keys.join(site_redirects(redirects).withColumnRenamed("title", "_r"), F.lower("_k") == F.col("alias"), "left")
    label = F.substring_index("_k", ".", 1)
    own = F.concat(F.upper(F.left(label, F.lit(1))), F.lower(F.substring(label, 2, 1 << 30)))
    titled = named.select("_k", F.coalesce("_r", own).alias("_title"))
    texts = titled.join(_paragraphs(paragraphs), F.col("_title") == F.col("_t"), "left").where("length(_p) > 0")
    found = texts.select("_k", first_sentence(F.col("_p")).alias(out))
    return df.drop(out).join(found, F.col(keyword) == F.col("_k"), "left").drop("_k")


def describe_entities(df: DataFrame, keyword: str, redirects: DataFrame, paragraphs: DataFrame, out: str = "description") -> DataFrame:
    """First paragraph under the keyword with capitalised words, else under its redirect, else ""."""
    keys = df.select(F.col(keyword).alias("_k")).where("_k is not null").distinct()
    own = F.initcap("_k")
    named = keys.join(site_redirects(redirects).withColumnRenamed("title", "_r"), F.lower("_k") == F.col("alias"), "left")
    p = _paragraphs(paragraphs)
    both = named.join(p.select(F.col("_t").alias("_t1"), F.col("_p").alias("_p1")), own == F.col("_t1"), "left")
    both = both.join(p.select(F.col("_t").alias("_t2"), F.col("_p").alias("_p2")), F.col("_r") == F.col("_t2"), "left")
    found = both.select("_k", F.coalesce(first_sentence(F.col("_p1")), first_sentence(F.col("_p2")), F.lit("")).alias(out))
    return df.drop(out).join(found, F.col(keyword) == F.col("_k"), "left").drop("_k").withColumn(out, F.coalesce(out, F.lit("")))


def tag_website_description(
    df: DataFrame, redirects: DataFrame, paragraphs: DataFrame, out: str = "tags_website_desc", urls: str = "tags_url"
) -> DataFrame:
    keyed = df.withColumn("_keyword", url_keyword(first_value(urls, "url")))
    found = describe_sites(keyed, "_keyword", redirects, paragraphs, "_description")
    node = F.when(F.length("_description") > 0, F.array(global_node("website_description", F.col("_description"))))
    return append(found, out, node, GLOBAL).drop("_keyword", "_description")


def clean_website_description(df: DataFrame, column: str = "tags_website_desc") -> DataFrame:
    """Empty the list if its first value only refers elsewhere or has too few or too many words."""
    value = F.get(F.col(column), F.lit(0))["value"]
    count = F.size(F.filter(F.split(value, r"(?U)\s+"), lambda w: w != ""))
    bad = value.rlike(CORRUPT_DESCRIPTION) | (count < MIN_WORDS) | (count > MAX_WORDS)
    return df.withColumn(column, F.when(F.coalesce(bad, F.lit(False)), no_nodes(GLOBAL)).otherwise(F.col(column)))


#: Characters of the strings that the index of aliases holds; shorter aliases are their own.
GRAM = 4
#: The filter of grams that aliases have: so many bits.
FILTER_BITS = 22
_LOW = np.uint64((1 << FILTER_BITS) - 1)


def grams(text: str, size: int) -> np.ndarray:
    """A hash of every run of `size` characters, the size included."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.full(max(0, len(c) - size + 1), size, np.uint64)
    for i in range(size):
        h = (h ^ c[i : len(c) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _grams_of_aliases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [np.unique(grams(a, min(len(a), GRAM)).astype(np.int64)) for a in batch.column("alias").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("alias"), pa.array([min(len(a), GRAM) for a in batch.column("alias").to_pylist()], pa.int32()), pa.array(lists, pa.list_(pa.int64()))], ["alias", "size", "grams"])


def _grams_of_texts(sizes: list[int], known: np.ndarray):
    """(id, gram): distinct grams of every text that pass the filter."""

    def rows(ids: pa.Array, places: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        at = pa.array(np.repeat(np.array(places, np.int64), [len(x) for x in found]))
        return pa.RecordBatch.from_arrays([ids.take(at), pa.array(np.concatenate(found) if found else [], pa.int64())], ["id", "gram"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for h in (grams(text, n) for n in sizes):
                    places.append(i)
                    found.append(np.unique(h[known[(h & _LOW).astype(np.int64)]]).astype(np.int64))
                if sum(map(len, found)) > 1 << 18:
                    yield rows(batch.column(0), places, found)
                    places, found = [], []
            yield rows(batch.column(0), places, found)

    return run


def entity_mentions(df: DataFrame, gazetteer: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, alias, entity, start): the first place of every alias in every text, at any boundary.

    An inverted index: of the runs of GRAM characters that an alias has, the one that the fewest texts hold
    leads to it. Texts' distinct runs meet the index in an equi-join, and what meets is looked through. A
    filter of FILTER_BITS bits, of a fixed size, keeps runs that no alias has from travelling; an alias with
    a run that no text has is met nowhere.
    """
    named = gazetteer.where("length(alias) > 0").select("alias", "entity").distinct()
    of_aliases = settled(named.select("alias").distinct().mapInArrow(_grams_of_aliases, "alias string, size int, grams array<long>").select("alias", "size", F.explode("grams").alias("gram")))
    sizes = sorted(r["size"] for r in of_aliases.select("size").distinct().collect())
    place = F.col("gram").bitwiseAND((1 << FILTER_BITS) - 1)
    known = np.zeros(1 << FILTER_BITS, bool)
    for r in of_aliases.select(F.shiftright(place, 15).alias("b"), place.bitwiseAND((1 << 15) - 1).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect():
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        known[r["b"] << 15 : (r["b"] + 1) << 15] = bits.astype(bool)
    texts = df.select(F.col(id_col).alias("id"), F.col(text).alias("_text")).where("_text is not null")
    kind = df.schema[id_col].dataType.simpleString()
    of_texts = settled(texts.mapInArrow(_grams_of_texts(sizes, known), f"id {kind}, gram long"))
    held = of_texts.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = of_aliases.join(held, "gram", "left").groupBy("alias").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("alias", F.col("r.gram").alias("gram"))
    met = of_texts.join(rarest, "gram").select("id", "alias")
    found = met.join(texts, "id").select("id", "alias", (F.expr("instr(_text, alias)") - 1).cast("long").alias("start")).where("start >= 0")
    return found.join(named, "alias").select(F.col("id").alias(id_col), "alias", "entity", "start")


def tag_entity(df: DataFrame, gazetteer: DataFrame, id_col: str, out: str = "tags_entity", text: str = "text") -> DataFrame:
    """A node for the first mention of each alias, in the order of the aliases; value: the entity."""
    found = entity_mentions(df, gazetteer, id_col, text)
    node = local_node("entity", F.col("start"), F.col("start") + F.length("alias"), F.col("entity"))
    lists = found.groupBy(F.col(id_col).alias("_id")).agg(F.array_sort(F.collect_list(F.struct("alias", "entity", node.alias("n")))).alias("_n"))
    lists = lists.select("_id", F.transform("_n", lambda x: x["n"]).alias("_n"))
    return append(df.join(lists, F.col(id_col) == F.col("_id"), "left"), out, F.col("_n"), LOCAL).drop("_id", "_n")


def paragraphs(df: DataFrame, id_col: str, text: str = "text", nodes: str = "tags_html") -> DataFrame:
    """(id, seq, start, end, marker, value): the text cut where marker elements end.

    Markers go by end, then start; a `p` cuts one character later; an empty block still moves the cut; two
    line feeds end a segment and turn the marker into `<marker>+lf`; what is left is the remainder.
    """
    held = df.where(f"length(`{text}`) > 0 and size(`{nodes}`) > 0").select(F.col(id_col), F.col(text).alias("_text"), F.col(nodes).alias("_nodes"))
    marks = held.select(id_col, F.posexplode(F.filter("_nodes", lambda n: n["value"].isin(PARAGRAPH_TAGS))).alias("_i", "_n"))
    cut = F.col("_n.char_end_idx") + F.when(F.col("_n.value") == "p", 1).otherwise(0)
    marks = marks.select(id_col, F.struct(F.col("_n.char_end_idx").alias("e"), F.col("_n.char_start_idx").alias("s"), "_i", cut.alias("cut"), F.col("_n.value").alias("tag")).alias("m"))
    lists = marks.groupBy(id_col).agg(F.array_sort(F.collect_list("m")).alias("_m"))
    blocks = held.drop("_nodes").join(lists, id_col, "left").withColumn("_m", F.coalesce("_m", F.expr("cast(array() as array<struct<e:bigint,s:bigint,_i:int,cut:bigint,tag:string>>)")))
    block = F.expr(
        "concat(transform(_m, (x, i) -> named_struct('tag', x.tag, 'b', if(i = 0, 0L, _m[i - 1].cut), 'e', x.cut)),"
        " array(named_struct('tag', 'remainder', 'b', if(size(_m) = 0, 0L, element_at(_m, -1).cut), 'e', cast(length(_text) as bigint))))"
    )
    blocks = blocks.select(id_col, "_text", F.posexplode(block).alias("_b", "x")).withColumn("_blk", F.expr("if(x.e > x.b, substring(_text, cast(x.b + 1 as int), cast(x.e - x.b as int)), '')"))
    blocks = blocks.where("_blk <> ''").withColumn("_segs", F.expr(r"regexp_extract_all(_blk, '(?s).*?\\n\\n|.+', 0)"))
    marker = F.concat(F.col("x.tag"), F.when(F.size("_segs") > 1, "+lf").otherwise(""))
    segments = blocks.select(id_col, "_b", F.col("x.b").alias("_at"), marker.alias("marker"), F.posexplode("_segs").alias("_s", "value"))
    # both windows need the rows of a document in one order
    seq = F.row_number().over(Window.partitionBy(id_col).orderBy("_b", "_s"))
    upto = F.sum(F.length("value")).over(Window.partitionBy(id_col, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.col("_at") + upto
    return segments.select(id_col, seq.alias("seq"), (end - F.length("value")).alias("start"), end.alias("end"), "marker", "value")


def tag_paragraph(df: DataFrame, id_col: str, out: str = "tags_paragraph", text: str = "text", nodes: str = "tags_html") -> DataFrame:
    found = paragraphs(df, id_col, text, nodes)
    node = F.struct(F.col("end").alias("char_end_idx"), F.col("start").alias("char_start_idx"), F.lit("paragraph").alias("key"), "marker", F.lit("local").alias("type"), "value").cast(PARAGRAPH)
    lists = found.groupBy(F.col(id_col).alias("_id")).agg(F.array_sort(F.collect_list(F.struct("seq", node.alias("n")))).alias("_n"))
    lists = lists.select("_id", F.transform("_n", lambda x: x["n"]).alias("_n"))
    return append(df.join(lists, F.col(id_col) == F.col("_id"), "left"), out, F.col("_n"), PARAGRAPH).drop("_id", "_n")


def snap_to_paragraph(entities: Column, paragraphs: Column | str, holder: Column) -> Column:
    """Each entity with the span of its paragraph (its own if there is none), repeats left out.

    holder: the number of each entity's paragraph, the first that holds it, or -1.
    """

    def snapped(e: Column, i: Column) -> Column:
        at = F.get(holder, i)
        hit = F.when(at >= 0, F.get(col(paragraphs), at.cast("int")))
        return local_node(
            "entity_paragraph", F.coalesce(hit["char_start_idx"], e["char_start_idx"]), F.coalesce(hit["char_end_idx"], e["char_end_idx"]), e["value"]
        )

    return F.array_distinct(F.transform(entities, snapped))


def number_runs(nodes: Column, places: Column) -> Column:
    """Nodes with relative positions; places: where each stands in a run of neighbours with equal starts."""

    def numbered(n: Column, i: Column) -> Column:
        at = F.get(places, i)
        return F.struct(
            n["char_end_idx"].alias("char_end_idx"), n["char_start_idx"].alias("char_start_idx"), n["key"].alias("key"),
            at.alias("relative_end_pos"), at.alias("relative_start_pos"), n["type"].alias("type"), n["value"].alias("value"),
        )

    return F.transform(nodes, numbered)


def tag_entity_paragraph(df: DataFrame, out: str = "tags_entity_paragraph", entities: str = "tags_entity", paragraphs: str = "tags_paragraph") -> DataFrame:
    some = (F.size(entities) > 0) & (F.size(paragraphs) > 0)
    held = df.withColumn("_entities", F.when(some, F.filter(entities, lambda e: e["key"] == "entity")))
    edges = [F.col(c)[f] for c in ("_entities", paragraphs) for f in ("char_start_idx", "char_end_idx")]
    held = held.withColumn("_holder", holders(*edges))
    held = held.withColumn("_snapped", snap_to_paragraph(F.col("_entities"), paragraphs, F.col("_holder")))
    held = held.withColumn("_places", places_in_runs(F.transform("_snapped", lambda n: n["char_start_idx"])))
    return append(held, out, number_runs(F.col("_snapped"), F.col("_places")), LOCAL_REL).drop("_snapped", "_places", "_entities", "_holder")
