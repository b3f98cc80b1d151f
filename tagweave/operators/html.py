"""Text, element spans and isolated sub-trees from HTML, as a relation of tags.

A page is cut into tokens by a regular expression. A small stack helper writes out the ends that HTML
implies, so that every start has its end. From there on a page is rows (page, pos, edge, tag, text): one
for each start and end of an element, with the text that follows it. Depth is a running sum of edges, an
element's end is the next row of its depth, text lengths are differences of running sums, removal is
containment in a removed span, and places in the cleaned text are running sums of what is written. All
windows share the page as key, so there is one exchange; pages with equal markup are worked on once.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tagweave.functions.exprs import col
from tagweave.schemas import HTML

INF = float("inf")

#: Elements that begin and end a line, and elements that are set off by a space.
BLOCK = (
    "address article aside blockquote body br button canvas caption col colgroup dd div dl dt embed fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li map noscript object ol output p pre progress section table "
    "tbody textarea tfoot th thead tr ul video"
).split()
SPACED = "address cite details datalist iframe img input label legend optgroup q select summary tbody td time".split()
#: Fixed values of HTML: elements without an end tag, and starts that close an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
    "pre section table ul".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"},
    "thead": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th"},
}
STOPS = frozenset("table ul ol dl select body html div".split())
HEAD_ONLY = frozenset("base link meta title".split())
RAW = ("script", "style")


@dataclass(frozen=True)
class Rule:
    """An element (any but those of `but`, if tag is None) goes where its text has `least` to `most` characters.

    bottom_up: the text is measured when what goes inside has gone; else as the page has it.
    """

    tag: str | None = None
    least: float = 0
    most: float = INF
    but: tuple[str, ...] = ()
    bottom_up: bool = False

    def fits(self, tag: str, n: int) -> bool:
        named = tag == self.tag if self.tag is not None else tag not in self.but
        return named and self.least <= n <= self.most

    def holds(self, tag: Column, n: Column) -> Column:
        named = tag == self.tag if self.tag is not None else ~tag.isin(list(self.but)) if self.but else F.lit(True)
        n = n.cast("double")
        return named & (n >= F.lit(float(self.least))) & (n <= F.lit(float(self.most)))


def any_rule(rules: tuple[Rule, ...], tag: Column, n: Column) -> Column:
    return reduce(lambda a, r: a | r.holds(tag, n), rules, F.lit(False))


@dataclass(frozen=True)
class HtmlPolicy:
    """What extract_html removes, folds and keeps.

    drop: rules for elements that go with their text; unwrap: rules for elements whose node goes but whose
    text stays; root: the first element of this tag is the page (None: all of it); fold: tags of which an
    only child of the same tag melts into its parent; newlines: <br> is a line feed; isolate: tags whose
    markup is returned apart; keep_attrs: attributes that nodes keep (None: all).
    """

    drop: tuple[Rule, ...] = ()
    unwrap: tuple[Rule, ...] = ()
    root: str | None = "body"
    fold: tuple[str, ...] = ()
    newlines: bool = False
    isolate: tuple[str, ...] = ()
    keep_attrs: tuple[str, ...] | None = None


#: What annotation of a corpus uses.
PRODUCTION = HtmlPolicy(
    drop=(*map(Rule, "script style header iframe footer form".split()), *(Rule(t, most=64) for t in "body div p section table ul ol dl".split())),
    fold=("div",),
    newlines=True,
    isolate=("head", "footer", "title"),
)

_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[\w:.-]+")


def attributes(raw: str) -> dict[str, str]:
    """Name and value of a start tag's attributes; the first of equal names holds, one without value is its own."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw.strip("<>").removesuffix("/"), re.match(r"<[A-Za-z][^\s/>]*", raw).end() - 1):
        value = m[2]
        if _NAME.fullmatch(m[1]):
            found.setdefault(m[1].lower(), m[1] if value is None else markup.unescape(value[1:-1] if value[0] in "\"'" else value))
    return found


def balance(kinds: list[str], tags: list[str], raws: list[str]) -> list[list]:
    """Rows [edge, tag, text after it, attributes]: html, head and body in place, and an end (edge -1) for each start (1)."""
    rows: list[list] = [[1, "html", "", {}]]
    stack, met = ["html"], set()

    def begin(tag: str, attrs: dict[str, str]) -> None:
        rows.append([1, tag, "", attrs])
        stack.append(tag)
        met.add(tag)

    def shrink(depth: int) -> None:
        while len(stack) > depth:
            rows.append([-1, stack.pop(), "", {}])

    def into_body(attrs: dict[str, str] | None = None) -> None:
        if "body" not in met:
            shrink(1)
            begin("body", attrs or {})

    def end_before(tag: str) -> None:
        shut, at = CLOSED_BY.get(tag, set()) | ({"p"} if tag in CLOSES_P else set()), len(stack) - 1
        while at > 0 and ((here := stack[at]) in shut or here not in STOPS):
            if here in shut:
                shrink(at)
                if tag in CLOSES_P or here not in ("td", "th", "tr"):
                    return
            at -= 1

    for kind, tag, raw in zip(kinds, tags, raws, strict=True):
        if kind == "text":
            text = markup.unescape(raw)
            if len(stack) == 1 or stack[-1] == "head":
                if not text.strip():
                    if rows[-1][0] < 0:
                        rows[-1][2] += text
                    continue
                into_body()
                if rows[-1][1] == "body":
                    begin("p", {})
            rows[-1][2] += text
        elif kind == "open":
            attrs = attributes(raw.split(">", 1)[0] + ">")
            if tag in ("html", "head", "body"):
                if tag == "html":
                    rows[0][3] = attrs | rows[0][3]
                elif tag == "head" and not met & {"head", "body"}:
                    begin("head", attrs)
                elif tag == "body":
                    into_body(attrs)
                continue
            if "body" not in met and (tag in HEAD_ONLY or (tag in (*RAW, "noscript") and "head" in met)):
                if "head" not in met:
                    begin("head", {})
            elif len(stack) < 3:
                into_body()
                end_before(tag)
            else:
                end_before(tag)
            begin(tag, attrs)
            if tag in RAW and "</" in raw:
                rows[-1][2] = raw.split(">", 1)[1].rsplit("</", 1)[0]
            if tag in VOID or tag in RAW or raw.endswith("/>"):
                shrink(len(stack) - 1)
        elif kind == "close" and tag not in ("html", "head", "body") and tag in stack:
            at = len(stack) - 1 - stack[::-1].index(tag)
            if "body" not in stack[at:]:
                shrink(at)
    shrink(0)
    return rows


_ROWS = "array<struct<edge:int,tag:string,text:string,attrs:array<string>,vals:array<string>>>"


def _balanced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        token, bounds = lists.flatten(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
        kinds, tags, raws = (token.field(i).to_pylist() for i in range(3))
        rows, sizes = [], []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = balance(kinds[lo:hi], tags[lo:hi], raws[lo:hi])
            rows += own
            sizes.append(len(own))
        edge, tag, text, attrs = zip(*rows, strict=True) if rows else ((),) * 4
        held = pa.array(np.r_[0, np.cumsum([len(x) for x in attrs])], pa.int32())
        cols = [
            pa.array(edge, pa.int32()), pa.array(tag, pa.string()), pa.array(text, pa.string()),
            *(pa.ListArray.from_arrays(held, pa.array(flat, pa.string())) for flat in ([k for x in attrs for k in x], [v for x in attrs for v in x.values()])),
        ]
        struct = pa.StructArray.from_arrays(cols, ["edge", "tag", "text", "attrs", "vals"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), struct)], ["page", "rows"])


def html_tokens(html: Column | str) -> Column:
    """Markup and text in order: array<struct<kind, tag, raw>>; kind: open, close, comment or text."""
    pattern = r"(?s)<!--.*?-->|<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>|</?[A-Za-z][^>]*>|[^<]+|<"
    raw = F.regexp_extract_all(col(html), F.lit(pattern), F.lit(0))

    def token(x: Column) -> Column:
        kind = (
            F.when(x.startswith("<!--"), "comment").when(x.rlike("^</[A-Za-z]"), "close").when(x.rlike("^<[A-Za-z]"), "open").otherwise("text")
        )
        return F.struct(kind.alias("kind"), F.lower(F.regexp_extract(x, "^</?([A-Za-z][A-Za-z0-9]*)", 1)).alias("tag"), x.alias("raw"))

    return F.transform(raw, token)


def tag_rows(pages: DataFrame) -> DataFrame:
    """(page, pos, edge, tag, text, attrs, vals) of pages (page, html): a row for every start and end, in order.

    Declarations and bogus end tags are left out; a page that is blank or declares an XML encoding has no rows.
    """
    pages = pages.where(r"html rlike '\\S' and not html rlike '(?s)^\\s*<\\?xml[^>]*encoding'")
    plain = F.regexp_replace(F.regexp_replace("html", r"<[!?](?!--)[^>]*>", ""), r"</(?![A-Za-z])", "")
    tokens = pages.select("page", html_tokens(plain).alias("tokens")).where("size(tokens) > 0")
    rows = tokens.mapInArrow(_balanced, f"page binary, rows {_ROWS}")
    return rows.select("page", F.posexplode("rows").alias("pos", "r")).select("page", "pos", "r.*")


_INSIDE_RAW = ["pre", "textarea", *RAW]


def page_order(*also: str) -> WindowSpec:
    return Window.partitionBy("page", *also).orderBy("pos")


def so_far(*also: str) -> WindowSpec:
    return page_order(*also).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(*also: str) -> WindowSpec:
    return page_order(*also).rowsBetween(Window.unboundedPreceding, -1)


def same_depth() -> WindowSpec:
    return page_order("depth")


def spans(rows: DataFrame) -> DataFrame:
    """rows with depth, and, at starts, `end`: the position of the element's end."""
    rows = rows.withColumn("depth", F.sum("edge").over(so_far()) + F.when(F.col("edge") < 0, 1).otherwise(0))
    return rows.withColumn("end", F.when(F.col("edge") > 0, F.lead("pos").over(same_depth())))


def within(hit: Column) -> Column:
    """The last position of the spans met so far that `hit` chooses; a row up to it is inside one, as spans nest."""
    return F.coalesce(F.max(F.when(hit & (F.col("edge") > 0), F.col("end"))).over(so_far()), F.lit(-1))


def squeezed(rows: DataFrame) -> DataFrame:
    """Runs of white space in `text` become one space, but inside pre, textarea, script and style."""
    kept = F.col("pos") < within(F.col("tag").isin(_INSIDE_RAW))
    return rows.withColumn("text", F.when(kept, F.col("text")).otherwise(F.regexp_replace("text", r"[ \t\r\n\f\x0B]+", " ")))


def folded(rows: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """rows with `melts`: starts and ends of only children that melt into a parent of the same tag.

    A chain of such elements follows each other in the order of starts, so its number is a running count of
    the others; the first of the chain takes all attributes, those of one name with a space between.
    """
    if not tags:
        return rows.withColumn("melts", F.lit(False))
    rows = rows.withColumns(
        {"_first": (F.lag("edge").over(page_order()) == 1) & (F.lag("tag").over(page_order()) == F.col("tag")) & F.col("tag").isin(list(tags)), "_next": F.lead("edge").over(page_order())}
    )
    only = F.col("_first") & (F.lead("_next").over(same_depth()) == -1)
    rows = rows.withColumn("melts", F.coalesce((F.col("edge") > 0) & only, F.lit(False)))
    rows = rows.withColumn("melts", F.when(F.col("edge") > 0, F.col("melts")).otherwise(F.lag("melts").over(same_depth())))
    rows = rows.withColumn("_chain", F.sum(F.when((F.col("edge") > 0) & ~F.col("melts"), 1).otherwise(0)).over(so_far()))
    starts = Window.partitionBy("page", "_chain").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pairs = F.when((F.col("edge") > 0) & (F.size("attrs") > 0), F.arrays_zip(F.col("attrs").alias("a"), F.col("vals").alias("v")))
    rows = rows.withColumn("_pairs", F.when((F.col("edge") > 0) & ~F.col("melts"), F.flatten(F.collect_list(pairs).over(starts))))
    names = F.array_distinct(F.transform("_pairs", lambda p: p["a"]))
    merged = F.transform(names, lambda n: F.array_join(F.transform(F.filter("_pairs", lambda p: p["a"] == n), lambda p: p["v"]), " "))
    return rows.withColumns({"attrs": names, "vals": merged}).drop("_first", "_next", "_chain", "_pairs")


def decided(edges: list[int], tags: list[str], sizes: list[int], goes: list[bool], rules: tuple[Rule, ...]) -> list[bool]:
    """goes, and true at starts of elements that a rule removes by the text left in them when what goes inside has gone.

    Whole pages in order, each start with its end; a stack holds the text inside the open elements so far.
    """
    out, open_ = list(goes), []
    for i, (edge, size) in enumerate(zip(edges, sizes, strict=True)):
        if edge > 0:
            open_.append([i, size])
            continue
        at, inside = open_.pop()
        out[at] = out[at] or any(r.fits(tags[at], inside) for r in rules)
        if open_:
            open_[-1][1] += size + (0 if out[at] else inside)
    return out


def _bottom_up(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def met() -> Iterator[pa.RecordBatch]:
            for batch in pa.Table.from_batches(held).combine_chunks().to_batches() if held else ():
                goes = decided(*(batch.column(c).to_pylist() for c in ("edge", "_tag", "_size", "goes")), rules)
                at = batch.schema.get_field_index("goes")
                yield batch.set_column(at, batch.schema.field(at), pa.array(goes, pa.bool_()))

        last = None
        for batch in batches:
            pages = batch.column("page").to_pylist()
            # up to where the batch's last page begins all pages are whole
            begin = next((i for i in range(len(pages) - 1, -1, -1) if pages[i] != (pages[i - 1] if i else last)), None)
            last = pages[-1] if pages else last
            if begin is None:
                held.append(batch)
                continue
            held.append(batch.slice(0, begin))
            yield from met()
            held = [batch.slice(begin)]
        yield from met()

    return run


def removed(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rows without what lies in a removed element; the text after one stays, with `joint` true.

    Rules that measure from the bottom up are met after the others, in one pass over the pages' rows in
    order, however deep elements nest.
    """
    size = F.length("text")
    first = tuple(r for r in rules if not r.bottom_up)
    later = tuple(r for r in rules if r.bottom_up)
    tag = F.when(F.col("melts"), F.lit("")).otherwise(F.col("tag"))
    # the rise of a running sum from an element's start to its end is what lies inside
    rows = rows.withColumn("_sum", F.coalesce(F.sum(size).over(before()), F.lit(0)))
    inside = F.lead("_sum").over(same_depth()) - F.col("_sum")
    rows = rows.withColumn("goes", F.coalesce((F.col("edge") > 0) & any_rule(first, tag, inside), F.lit(False))).drop("_sum")
    if later:
        sized = rows.withColumns({"_tag": tag, "_size": size}).sortWithinPartitions("page", "pos")
        rows = sized.mapInArrow(_bottom_up(later), sized.schema).drop("_tag", "_size")
    rows = rows.withColumn("_last", within(F.col("goes"))).where("pos >= _last")
    return rows.withColumn("joint", F.col("pos") == F.col("_last")).drop("_last", "goes")


_WHITE = r"(?U)\s"


def placed(rows: DataFrame, newlines: bool) -> DataFrame:
    """rows with `at`, the length of the text before the row, and `piece`, what the row adds to the text.

    Text without white space at its ends is a core. Whatever lies between two cores (white space, elements)
    comes to one line feed if there is an edge of a block element, to one space if there is white space or
    an edge of a spaced element, else to nothing. <br> is a core of its own, and text of pre is kept.
    """
    tag, text = F.when(F.col("joint"), F.lit("")).otherwise(F.col("tag")), F.col("text")
    block = [t for t in BLOCK if not (newlines and t == "br")]
    verbatim = tag == "pre"
    plain = F.regexp_replace(F.regexp_replace(text, "[\u00a0\r\n]", " "), r"(?U)(\s)\s+", "$1")
    core = F.when(verbatim, F.regexp_replace(text, r" \z", "")).otherwise(F.regexp_replace(plain, r"(?U)^\s|\s\z", ""))
    is_br = (tag == "br") & (F.col("edge") > 0) if newlines else F.lit(False)
    # text after a removed element is set off from the text before it within the same element
    rows = rows.withColumn("_part", F.sum(F.when(F.col("joint"), 0).otherwise(1)).over(so_far()))
    set_off = F.col("joint") & (F.length(text) > 0) & F.coalesce(F.max(F.length(text)).over(before("_part")) > 0, F.lit(False))
    rows = rows.withColumns(
        {
            "_core": F.when(is_br, F.concat(F.lit("\n"), core)).otherwise(core),
            "_line": tag.isin(block) & ~is_br,
            "_gap": tag.isin([*block, *SPACED]) | (~verbatim & text.rlike(f"^{_WHITE}")) | set_off,
            "_trail": F.when(verbatim, text.endswith(" ")).otherwise(text.rlike(rf"{_WHITE}\z")),
        }
    )
    # a core that begins with a line feed of <br> is met after its element's own edge
    rows = rows.withColumn("_has", F.length("_core") > 0)
    rows = rows.withColumns(
        {
            "_group": F.coalesce(F.sum(F.col("_has").cast("int")).over(before()), F.lit(0)),
            "_open": F.coalesce(F.last(F.when(F.col("_has"), ~F.col("_core").endswith("\n")), True).over(before()), F.lit(False)),
            "_tail": F.coalesce(F.last(F.when(F.col("_has"), F.col("_trail")), True).over(before()), F.lit(False)),
            "_long": F.coalesce(F.sum(F.length("_core")).over(before()), F.lit(0)),
        }
    )
    upto = F.max("_gap").over(so_far("_group"))
    earlier = F.coalesce(F.max("_gap").over(before("_group")), F.lit(False))
    rows = rows.withColumns({"_now": F.col("_open") & (F.col("_tail") | upto), "_then": F.col("_open") & (F.col("_tail") | earlier), "_feed": F.max("_line").over(so_far("_group"))})
    is_last = F.lead("pos").over(page_order()).isNull()
    rows = rows.withColumn("_filled", F.coalesce(F.sum((F.col("_has") & F.col("_now")).cast("int")).over(before()), F.lit(0)))
    gap = F.when(F.col("_now"), F.when(F.col("_feed"), "\n").otherwise(" ")).otherwise("")
    rows = rows.withColumn("at", F.col("_long") + F.col("_filled") + F.col("_then").cast("int"))
    # a page whose last core ends in white space keeps it
    rows = rows.withColumn("piece", F.when(F.col("_has"), F.concat(gap, F.col("_core"))).when(is_last, gap))
    return rows.drop("_part", "_core", "_line", "_gap", "_trail", "_has", "_group", "_open", "_tail", "_long", "_now", "_then", "_feed", "_filled")


def nodes_of(rows: DataFrame, policy: HtmlPolicy) -> DataFrame:
    """rows with `node` at the start of every element that keeps its node, and `end`, by which nodes are ordered."""
    rows = rows.withColumn("_to", F.when(F.col("edge") > 0, F.lead("at").over(same_depth())))
    unwrap = (*policy.unwrap, *((Rule("br"),) if policy.newlines else ()), *((Rule("html"),) if policy.root not in (None, "html") else ()))
    stays = (F.col("edge") > 0) & ~F.col("melts") & ~F.col("joint") & ~any_rule(unwrap, F.col("tag"), F.col("_to") - F.col("at"))
    rows = rows.withColumn("_stays", F.coalesce(stays, F.lit(False)))
    rows = rows.withColumn("_stays", F.when(F.col("edge") > 0, F.col("_stays")).otherwise(F.coalesce(F.lag("_stays").over(same_depth()), F.lit(False))))
    rows = rows.withColumn("_rank", F.row_number().over(page_order("at", "_stays")).cast("long") - 1).withColumn("_rank_to", F.lead("_rank").over(same_depth()))
    node = F.struct(
        F.col("_to").cast("long").alias("char_end_idx"), F.col("at").cast("long").alias("char_start_idx"),
        F.struct(F.coalesce("attrs", F.array().cast("array<string>")).alias("attrs"), F.coalesce("vals", F.array().cast("array<string>")).alias("values")).alias("html_attrs"),
        F.lit("html").alias("key"), F.col("_rank_to").alias("relative_end_pos"), F.col("_rank").alias("relative_start_pos"),
        F.lit("local").alias("type"), F.col("tag").alias("value"),
    )
    return rows.withColumn("node", F.when(F.col("_stays") & (F.col("edge") > 0), node)).drop("_to", "_stays", "_rank", "_rank_to")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def isolated(rows: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(page, html_<tag> of each tag): the markup of its elements in order, empty ones closed in place.

    A page's markup is put together once; an element is the bytes from its start to its end.
    """
    inside = rows.withColumn("_last", within(F.col("tag").isin(list(tags)))).where("pos <= _last")
    attrs = F.array_join(
        F.transform(F.arrays_zip(F.col("attrs").alias("a"), F.col("vals").alias("v")), lambda p: F.concat(F.lit(" "), p["a"], F.lit('="'), F.replace(_escaped(p["v"]), F.lit('"'), F.lit("&quot;")), F.lit('"'))), ""
    )
    text = F.when(F.col("tag").isin(*RAW) & (F.col("edge") > 0), F.col("text")).otherwise(_escaped(F.col("text")))
    empty = (F.col("end") == F.col("pos") + 1) & (F.col("text") == "")
    was_empty = F.lag(F.coalesce(empty, F.lit(False))).over(page_order()) & (F.col("edge") < 0)
    begin = F.concat(F.lit("<"), F.col("tag"), attrs, F.when(empty, "/>").otherwise(">"))
    close = F.when(F.coalesce(was_empty, F.lit(False)), F.lit("")).otherwise(F.concat(F.lit("</"), F.col("tag"), F.lit(">")))
    inside = inside.withColumn("_edge", F.when(F.col("edge") > 0, begin).otherwise(close))
    inside = inside.withColumns({"_bytes": F.concat("_edge", text).cast("binary"), "_own": F.octet_length("_edge")})
    inside = inside.withColumn("_at", F.coalesce(F.sum(F.octet_length("_bytes").cast("long")).over(before()), F.lit(0)))
    inside = inside.withColumn("_to", F.lead(F.col("_at") + F.col("_own")).over(same_depth()))

    def of(tag: str) -> Column:
        return F.array_sort(F.collect_list(F.when((F.col("tag") == tag) & (F.col("edge") > 0), F.struct("_at", "_to")))).alias(f"html_{tag}")

    whole = F.expr("listagg(_bytes) within group (order by pos)").alias("_whole")
    parts = inside.groupBy("page").agg(whole, *map(of, tags))
    cut = lambda x: F.substring("_whole", (x["_at"] + 1).cast("int"), (x["_to"] - x["_at"]).cast("int")).cast("string")
    return parts.select("page", *(F.transform(f"html_{t}", cut).alias(f"html_{t}") for t in tags))


def extract_html(df: DataFrame, html: str = "html", policy: HtmlPolicy = PRODUCTION) -> DataFrame:
    """df with text, tags_html, html_<tag> of each isolated tag, and the error columns; same names are replaced.

    Null and blank pages, pages that declare an XML encoding and pages without a root element have an empty
    text and no nodes. Text after a removed element stays where it stood. Nesting has no limit; no page
    fails, so the error columns (kept for readers of the annotated layout) are 0 and "".
    """
    new = ["text", "tags_html", *(f"html_{t}" for t in policy.isolate), "html_error", "html_error_comment"]
    df = df.drop(*(c for c in new if c != html))
    held = {c.lower() for c in df.columns}
    key = next(k for k in ("page", *(f"page_{i}" for i in range(len(held) + 1))) if k not in held)
    df = df.withColumn(key, F.unhex(F.md5(F.col(html).cast("binary"))))
    pages = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("page")).agg(F.first(html).alias("html"))
    rows = spans(tag_rows(pages))
    root = policy.root
    if root is not None:
        found = F.min(F.when((F.col("tag") == root) & (F.col("edge") > 0), F.struct("pos", "end"))).over(Window.partitionBy("page"))
        rows = rows.withColumn("_root", found).where("_root is not null")
        part = rows.where("pos between _root.pos and _root.end").withColumn("text", F.when(F.col("pos") == F.col("_root.end"), "").otherwise(F.col("text")))
        part = part.drop("_root")
    else:
        part = rows
    flat = removed(folded(squeezed(part), policy.fold), policy.drop)
    flat = nodes_of(placed(flat, policy.newlines), policy)
    pieces = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece"))))
    nodes = F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("end", "node"))))
    out = flat.groupBy("page").agg(pieces.alias("_pieces"), nodes.alias("_nodes"))
    kept = keep_attrs(F.transform("_nodes", lambda n: n["node"]), policy.keep_attrs).cast(f"array<{HTML}>")
    out = out.select("page", F.array_join(F.transform("_pieces", lambda p: p["piece"]), "").alias("text"), kept.alias("tags_html"))
    if policy.isolate:
        out = out.join(isolated(rows, policy.isolate), "page", "left")
    out = out.withColumnRenamed("page", "_of")
    full = df.drop("text").join(out, df[key] == out["_of"], "left")
    none = F.array().cast("array<string>")
    return full.select(
        *(F.col(c) for c in df.columns if c not in (key, "text")),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("tags_html", F.array().cast(f"array<{HTML}>")).alias("tags_html"),
        *(F.coalesce(f"html_{t}", none).alias(f"html_{t}") for t in policy.isolate),
        F.lit(0).cast("long").alias("html_error"),
        F.lit("").alias("html_error_comment"),
    )


def drop_tags(nodes: Column | str, rules: tuple[Rule, ...] = ()) -> Column:
    """Nodes without those whose span is as long as one of the rules says."""
    return F.filter(col(nodes), lambda x: ~any_rule(rules, x["value"], x["char_end_idx"] - x["char_start_idx"]))
def keep_attrs(nodes: Column | str, names: tuple[str, ...] | None) -> Column:
    """Nodes with the named attributes only; None keeps all."""
    if names is None:
        return col(nodes)

    def kept(x: Column) -> Column:
        pairs = F.filter(F.arrays_zip(x["html_attrs"]["attrs"].alias("attrs"), x["html_attrs"]["values"].alias("values")), lambda p: p["attrs"].isin(list(names)))
        return x.withField("html_attrs", F.struct(F.transform(pairs, lambda p: p["attrs"]).alias("attrs"), F.transform(pairs, lambda p: p["values"]).alias("values")))

    return F.transform(col(nodes), kept)


def renumber(df: DataFrame, id_col: str, column: str = "tags_html") -> DataFrame:
    """Relative positions counted anew: at every offset, starts and ends in their old order from 0."""
    nodes = df.select(F.col(id_col).alias("_id"), F.posexplode(column).alias("_i", "_x"))
    start = F.struct(F.lit("start").alias("edge"), F.col("_x.char_start_idx").alias("at"), F.col("_x.relative_start_pos").alias("old"))
    end = F.struct(F.lit("end").alias("edge"), F.col("_x.char_end_idx").alias("at"), F.col("_x.relative_end_pos").alias("old"))
    events = nodes.select("_id", "_i", F.explode(F.array(start, end)).alias("e")).select("_id", "_i", "e.*")
    place = F.row_number().over(Window.partitionBy("_id", "at").orderBy("old", F.desc("edge"), "_i")) - 1
    new = events.withColumn("new", place.cast("long")).groupBy("_id", "_i")
    new = new.agg(F.max(F.when(F.col("edge") == "start", F.col("new"))).alias("s"), F.max(F.when(F.col("edge") == "end", F.col("new"))).alias("e"))
    moved = F.col("_x").withField("relative_start_pos", F.col("s")).withField("relative_end_pos", F.col("e"))
    lists = nodes.join(new, ["_id", "_i"]).groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_i", moved.alias("x")))).alias("_n"))
    lists = lists.select("_id", F.transform("_n", lambda n: n["x"]).alias("_n"))
    return df.join(lists, F.col(id_col) == F.col("_id"), "left").withColumn(column, F.coalesce("_n", F.col(column))).drop("_id", "_n")
