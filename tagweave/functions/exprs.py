"""Column builders: URL parts, decoding, dates, seeded uniforms, nodes."""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.schemas import GLOBAL, LOCAL

#: scheme, authority and path as RFC 3986 splits them; parse_url fails on URLs that it finds invalid.
URL_PATTERN = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*)"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once a row; the optimizer moves other columns into lambdas, where each element evaluates them anew."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def url_netloc(url: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(url), F.lit("")), URL_PATTERN, 1)


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(url), F.lit("")), URL_PATTERN, 2)


def unquote(value: Column | str, plus: bool = False) -> Column:
    """Percent-decoding that leaves malformed escapes as they are; `+` is a space only with plus."""
    v = F.regexp_replace(col(value), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(v if plus else F.replace(v, F.lit("+"), F.lit("%2B"))), col(value))


def url_keyword(url: Column | str) -> Column:
    """The authority without any "www."."""
    return F.replace(url_netloc(url), F.lit("www."), F.lit(""))


def path_date(path: Column | str) -> Column:
    """The first year, month and day in a row in a path, as a timestamp without zone; years 1983 to 2021.

    Parts stand between `/`, `-` or blanks; the month is a number or an English name or its first three
    letters. A path without all three has no date.
    """
    p = F.lower(col(path))
    names = "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "may" else "may" for m in MONTHS)
    pattern = rf"(?:^|[^0-9])([0-9]{{4}})[/\- ]+([0-9]{{1,2}}|{names})[/\- ]+([0-9]{{1,2}})(?![0-9])"
    part = [F.regexp_extract(p, pattern, i) for i in (1, 2, 3)]
    named = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.left(part[1], F.lit(3)))
    month = F.when(part[1].rlike("^[0-9]+$"), part[1].try_cast("int")).otherwise(named.cast("int"))
    year, day = part[0].try_cast("int"), part[2].try_cast("int")
    valid = (part[0] != "") & year.between(1983, 2021) & month.between(1, 12) & day.between(1, 31)
    text = F.concat_ws("-", part[0], F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(valid, F.try_to_date(text, "yyyy-MM-dd").cast("timestamp_ntz"))


def uniform(seed: int | str, *keys: Column | str, tag: str = "") -> Column:
    """A number in [0, 1) that depends on the seed, the keys and the tag only."""
    name = F.concat_ws("|", F.lit(str(seed)), *(col(k).cast("string") for k in keys), F.lit(tag))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def global_node(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.lit("global").alias("type"), value.cast("string").alias("value")).cast(GLOBAL)


def local_node(key: str, start: Column, end: Column, value: Column) -> Column:
    return F.struct(
        end.cast("long").alias("char_end_idx"),
        start.cast("long").alias("char_start_idx"),
        F.lit(key).alias("key"),
        F.lit("local").alias("type"),
        value.cast("string").alias("value"),
    ).cast(LOCAL)


def no_nodes(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def first_value(nodes: Column | str, key: str) -> Column:
    """The value of the first node with a key; null if there is none."""
    return F.get(F.filter(col(nodes), lambda n: n["key"] == key), F.lit(0))["value"]


def _sums(lists: pd.Series) -> pd.Series:
    return lists.map(lambda v: None if v is None else np.cumsum(np.asarray(v, np.int64)))


def _places(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.int64)
    first = np.r_[True, v[1:] != v[:-1]] if len(v) else np.empty(0, bool)
    at = np.arange(len(v))
    return at - np.maximum.accumulate(np.where(first, at, 0)) if len(v) else at


def _all_places(lists: pd.Series) -> pd.Series:
    return lists.map(lambda v: None if v is None else _places(v))


def _holders(starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The first of the spans (begins, stops) that holds each span (starts, ends), -1 for none."""
    if not len(begins):
        return np.full(len(starts), -1)
    if (begins[1:] >= begins[:-1]).all() and (stops[1:] >= stops[:-1]).all():
        # of spans in order the first that ends late enough is the first that can hold anything, and begins first
        at = np.searchsorted(stops, ends)
        held = at < len(stops)
        held[held] = begins[at[held]] <= starts[held]
        return np.where(held, at, -1)
    # one sweep over the starts, largest first, leaves the spans that begin early enough; the first by number is kept by its end
    order, out = np.argsort(starts, kind="stable"), np.full(len(starts), -1)
    by_begin, met = np.argsort(begins, kind="stable"), 0
    stairs: list[tuple[int, int]] = []  # (end, number): later ends have later numbers
    for i in order.tolist():
        while met < len(by_begin) and begins[by_begin[met]] <= starts[i]:
            new = int(stops[by_begin[met]]), int(by_begin[met])
            met += 1
            k = bisect.bisect_left(stairs, (new[0], -1))
            if k < len(stairs) and stairs[k][1] < new[1]:
                continue
            k = bisect.bisect_right(stairs, (new[0], len(begins)))
            low = k
            while low and stairs[low - 1][1] > new[1]:
                low -= 1
            stairs[low:k] = [new]
        k = bisect.bisect_left(stairs, (int(ends[i]), -1))
        if k < len(stairs):
            out[i] = stairs[k][1]
    return out


def _all_holders(starts: pd.Series, ends: pd.Series, begins: pd.Series, stops: pd.Series) -> pd.Series:
    none = lambda *lists: any(v is None for v in lists)
    return pd.Series([None if none(*v) else _holders(*(np.asarray(x, np.int64) for x in v)) for v in zip(starts, ends, begins, stops, strict=True)], dtype=object)


# Called nondeterministic so that the optimizer doesn't move them into lambdas, where Python can't be called.
#: Sums of each array up to every place; array functions only give them in quadratic time.
running_sums = F.pandas_udf(_sums, T.ArrayType(T.LongType())).asNondeterministic()
#: The place of every value in its run of equal neighbours.
places_in_runs = F.pandas_udf(_all_places, T.ArrayType(T.LongType())).asNondeterministic()
#: For spans given by starts and ends: the number of the first of other spans that holds each, -1 for none.
holders = F.pandas_udf(_all_holders, T.ArrayType(T.LongType())).asNondeterministic()
