"""The tagger chain."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.operators import html, taggers
from tagweave.sources import settled, with_annotations

Tagger = Callable[[DataFrame], DataFrame]
#: The order in which taggers run; paragraphs come before what needs them.
ORDER = (
    "html url timestamp title website_description clean_description entity paragraph entity_paragraph length_text length_sentence datasource"
).split()


def chain(lookups: dict[str, DataFrame], id_col: str = "page_id") -> dict[str, Tagger]:
    """Taggers by name; lookups: redirects, paragraphs, gazetteer, as far as they're needed."""
    return {
        "html": html.extract_html,
        "url": taggers.tag_url,
        "timestamp": taggers.tag_timestamp,
        "title": taggers.tag_title,
        "website_description": lambda df: taggers.tag_website_description(df, lookups["redirects"], lookups["paragraphs"]),
        "clean_description": taggers.clean_website_description,
        "entity": lambda df: taggers.tag_entity(df, lookups["gazetteer"], id_col),
        "paragraph": lambda df: taggers.tag_paragraph(df, id_col),
        "entity_paragraph": taggers.tag_entity_paragraph,
        "length_text": taggers.tag_length_text,
        "length_sentence": taggers.tag_length_sentence,
        "datasource": taggers.tag_datasource,
    }


def run_taggers(df: DataFrame, include: list[str] | None = None, lookups: dict[str, DataFrame] | None = None, id_col: str = "page_id") -> DataFrame:
    """The taggers of `include` (all by default), in ORDER; what no tagger fills is an empty list."""
    unknown = set(include or ()) - set(ORDER)
    if unknown:
        raise ValueError(f"no taggers named {sorted(unknown)}")
    named = chain(lookups or {}, id_col)
    steps = [named[name] for name in ORDER if include is None or name in include]
    return with_annotations(reduce(lambda d, f: f(d), steps, df))


def with_error_capture(name: str, expressions: dict[str, str], defaults: dict[str, object], keep_old: bool = False) -> Tagger:
    """Columns from SQL expressions that give null on failure (try_*), with their error columns.

    Where an expression is null, <name>_error is 1 and <name>_error_comment the column's name (else 0 and ""),
    and the column is the default, or what it was before if keep_old is set and the table has it.
    """

    def run(df: DataFrame) -> DataFrame:
        new = {c: F.expr(e) for c, e in expressions.items()}
        failed = [F.when(v.isNull(), F.lit(c)) for c, v in new.items()]
        comment = F.concat_ws(",", *failed)
        kind = {c: df.select(v).schema[0].dataType for c, v in new.items()}
        old = {c: F.col(c).cast(kind[c]) for c in new if keep_old and c in df.columns}
        out = {c: F.coalesce(v, *([old[c]] if c in old else []), F.lit(defaults.get(c)).cast(kind[c])) for c, v in new.items()}
        return df.withColumns({f"{name}_error": (comment != "").cast("long"), f"{name}_error_comment": comment} | out)

    return run


def halved(f: Callable[[pa.RecordBatch], pa.RecordBatch], batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch | None, str]]:
    """(part, result, comment): the batch in parts, in order. A part for which f fails is halved until single rows fail, which have no result."""
    todo = [batch] if batch.num_rows else []
    while todo:
        part = todo.pop()
        try:
            out = f(part)
            if out.num_rows != part.num_rows:
                raise ValueError(f"{out.num_rows} rows for {part.num_rows}")
        except Exception as e:  # whatever a tagger raises is told in the row
            if part.num_rows == 1:
                yield part, None, str(e)
            else:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
        else:
            yield part, out, ""


def python_tagger(name: str, f: Callable[[pa.RecordBatch], pa.RecordBatch], outputs: dict[str, tuple[str, object]]) -> Tagger:
    """A tagger of Arrow batches with a fault boundary; outputs: column -> (type, default).

    f gives the output columns for a batch of rows. A row for which it fails keeps what it had in them, or
    the default, with <name>_error 1 and the error as <name>_error_comment (else 0 and ""); all others have
    their result.
    """

    def run(df: DataFrame) -> DataFrame:
        own = {f"{name}_error": "long", f"{name}_error_comment": "string"}
        kept = [c for c in df.columns if c not in own and c not in outputs]
        empty = df.sparkSession.createDataFrame([], ", ".join(f"`{c}` {t}" for c, (t, _) in outputs.items()))
        old = {c: F.col(c).cast(empty.schema[c].dataType) if c in df.columns else F.lit(default).cast(empty.schema[c].dataType) for c, (_, default) in outputs.items()}
        src = df.withColumns(old).select(*kept, *outputs)
        like = T.StructType([T.StructField(x.name, x.dataType) for x in src.withColumns({c: F.lit(None).cast(t) for c, t in own.items()}).schema])

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, out, comment in halved(f, batch):
                    new = part if out is None else out
                    cols = [*(part.column(c) for c in kept), *(new.column(c).cast(part.schema.field(c).type) for c in outputs)]
                    told = [pa.array([int(out is None)] * part.num_rows, pa.int64()), pa.array([comment] * part.num_rows)]
                    yield pa.RecordBatch.from_arrays([*cols, *told], [*kept, *outputs, *own])

        return src.mapInArrow(met, like)

    return run


def _told(e: Exception) -> str:
    """The line of an error that says what it was."""
    lines = [x.strip() for x in str(e).split("\n")]
    lines = [x for x in lines if x and not x.startswith(("at ", "=="))]
    causes = [x.removeprefix("Caused by: ") for x in lines if x.startswith("Caused by: ")]
    told = [x for x in lines if x.startswith("[") or "Error: " in x] or [x[2:] for x in lines if x.startswith(": ")]
    return [*causes[-1:], *told, *lines, type(e).__name__][0]


def with_fault_boundary(name: str, tagger: Tagger, outputs: dict[str, str], ways: int = 4) -> Tagger:
    """Any tagger, joins and groupings included, with a fault boundary; outputs: column -> SQL of its default.

    The rows are tagged at once; where that fails they are parted in `ways` by a hash of their number, and
    each part is tagged on its own, level by level by another hash, until rows that fail stand alone. These keep what they
    had in the output columns, or the default, with <name>_error 1 and the first line of the error as
    <name>_error_comment (else 0 and ""). What has been tagged is written and not done again, so a row that
    fails costs some ways x log(rows) small jobs. The tagger must keep its rows and look at each on its own
    or by its id; a failure that isn't a row's, such as a lost table, is told of every row.
    """

    def run(df: DataFrame) -> DataFrame:
        src = settled(df.withColumn("_row", F.monotonically_increasing_id()))
        done: list[DataFrame] = []
        faults: list[tuple[int, str]] = []
        todo: list[tuple[int, DataFrame]] = [(0, src)]
        error, comment = f"{name}_error", f"{name}_error_comment"
        while todo:
            level, part = todo.pop()
            few = part.select("_row").limit(2).collect()
            if level and not few:
                continue
            try:
                done.append(settled(tagger(part.drop("_row", error, comment))))
            except Exception as e:  # whatever a tagger raises is told in the row
                if len(few) == 1:
                    faults.append((few[0]["_row"], _told(e)))
                else:
                    digit = F.expr(f"pmod(xxhash64(_row, {level}), {ways})")
                    todo += [(level + 1, part.where(digit == i)) for i in range(ways)]
        good = [d.withColumns({error: F.lit(0).cast("long"), comment: F.lit("")}) for d in done]
        if not faults:
            return good[0]
        told = df.sparkSession.createDataFrame(faults, "_row long, _comment string")
        bad = src.join(F.broadcast(told), "_row").drop("_row", error, comment)  # a row for each fault
        bad = bad.withColumns({c: F.expr(sql) for c, sql in outputs.items() if c not in df.columns})
        bad = bad.withColumns({error: F.lit(1).cast("long"), comment: F.col("_comment")}).drop("_comment")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*good, bad])

    return run
