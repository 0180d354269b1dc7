"""Text and hash expressions. All but norm_full and the parsers are built-in functions."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters, digits and underscore, spelled out so that other engines can use the same class.
WORD = r"[\p{L}\p{N}_]+"
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def norm(x: Column) -> Column:
    """Lower case, white space as single spaces. See norm_full for the Unicode form."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


@F.arrow_udf(T.StringType())
def norm_full(x: pa.Array) -> pa.Array:
    """NFKC, case fold, white space (Unicode) as single spaces; null stays null. Few texts at a time are Python objects."""
    one = lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).casefold().split())
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([one(s.as_py()) for s in x.slice(lo, 256)], pa.string()) for lo in range(0, len(x), 256))])


def sha(*parts: Column | str) -> Column:
    """SHA-256 (hex) of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def piped_sha(*parts: Column | str) -> Column:
    """SHA-256 (hex) of the parts joined by bars."""
    return F.sha2(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def joint_input(rendered: Column, candidate: Column) -> Column:
    """What a joint scorer reads: the rendered state and one candidate, as they are."""
    return F.concat(rendered, F.lit("\n\nCandidate action:\n"), candidate)


def hex_int(digest: Column, digits: int) -> Column:
    """The first hex digits as a number (up to 15 fit a bigint)."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def bucket(digest: Column, digits: int, n: int) -> Column:
    return hex_int(digest, digits) % n


def unsigned_key(digest: Column) -> Column:
    """The first 16 hex digits as a decimal: unsigned 64-bit values keep their order."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def head_tail(x: Column, limit: int, part: int) -> Column:
    """Texts over the limit: their first and last part, with a space between."""
    return F.when(F.length(x) > limit, F.concat_ws(" ", F.left(x, F.lit(part)), F.right(x, F.lit(part)))).otherwise(x)


def prettify(label: Column) -> Column:
    return F.trim(F.replace(F.replace(label, F.lit("_"), F.lit(" ")), F.lit("?"), F.lit("")))


def section(x: Column, begin: str, end: str) -> Column:
    """What lies between two marks; a mark that is missing cuts nothing."""
    after = F.element_at(F.split(x, begin, 2), -1)
    return F.element_at(F.split(after, end, 2), 1)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def state_text(a: Column, b: Column) -> Column:
    """Both parts stripped, with a blank line between where both have text."""
    return F.concat_ws("\n\n", *(F.nullif(strip(F.coalesce(x, F.lit(""))), F.lit("")) for x in (a, b)))


def strip_prefix(x: Column, prefix: str) -> Column:
    return F.when(F.startswith(x, F.lit(prefix)), F.substring(x, len(prefix) + 1, 1 << 30)).otherwise(x)


def right_split(x: Column, sep: str) -> Column:
    """struct<before, last> at the last separator; without one, all is `before` and last is null."""
    last = F.substring_index(x, sep, -1)
    whole = F.instr(x, sep) == 0
    before = F.left(x, F.length(x) - F.length(last) - len(sep))
    return F.struct(F.when(whole, x).otherwise(before).alias("before"), F.when(~whole, last).alias("last"))


def legacy_render(state: Column, question: Column) -> Column:
    """Both parts stripped with a blank line between, then all stripped."""
    return strip(F.concat(strip(F.coalesce(state, F.lit(""))), F.lit("\n\n"), strip(F.coalesce(question, F.lit("")))))


def action_text(kind: Column, name: Column, args: Column, lang: Column, content: Column) -> Column:
    """An action by its class: a call with sorted arguments, code under its language, or the content itself."""
    return F.when(kind == "api", call_text(name, args)).when(kind == "code", F.concat(lang, F.lit(":\n"), content)).otherwise(content)


def call_text(name: Column, args: Column) -> Column:
    """f(k=v, ...) with sorted keys, from a name and a map of strings."""
    pairs = F.array_sort(F.transform(F.map_entries(args), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.concat(name, F.lit("("), F.array_join(pairs, ", "), F.lit(")"))


def _prose(value, depth: int = 0) -> str:
    """Fields as `key: value` (blank lines between those at the top), items as `- value`, what is nested below and indented."""
    if not isinstance(value, dict | list):
        return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    marked = [(f"{k}:", v) for k, v in value.items()] if isinstance(value, dict) else [("-", v) for v in value]
    body = lambda v: "\n" + _prose(v, depth + 2) if isinstance(v, dict | list) and v else " " + _prose(v)
    return ("\n\n" if isinstance(value, dict) and not depth else "\n").join(" " * depth + mark + body(v) for mark, v in marked)


@F.pandas_udf(T.StringType())
def prose(x: pd.Series) -> pd.Series:
    """JSON objects and arrays written out as prose; other texts stay as they are."""

    def one(s):
        try:
            value = json.loads(s)
        except (TypeError, ValueError):
            return s
        return _prose(value) if isinstance(value, dict | list) else s

    return x.map(one)


def _canonical(s: str | None) -> str | None:
    try:
        return json.dumps(json.loads(s), sort_keys=True, separators=(",", ":"))
    except (TypeError, ValueError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(x: pd.Series) -> pd.Series:
    """Sorted keys, no spaces, ASCII escapes; null if it is no JSON."""
    return x.map(_canonical)


def _strict(s: str | None) -> bool:
    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ValueError("repeated key")
        return dict(items)

    def constant(name):
        raise ValueError(name)

    try:
        json.loads(s, object_pairs_hook=pairs, parse_constant=constant)
    except (TypeError, ValueError):
        return False
    return True


@F.pandas_udf(T.BooleanType())
def strict_json(x: pd.Series) -> pd.Series:
    """Whether a text is JSON without repeated keys, NaN or Infinity."""
    return x.map(_strict)


def percent(x: Column) -> Column:
    return F.format_string("%.2f%%", x * 100)


def points(x: Column) -> Column:
    return F.format_string("%+.2f pp", x * 100)


def interval(low: Column, high: Column) -> Column:
    return F.format_string("[%+.2f, %+.2f]", low * 100, high * 100)
