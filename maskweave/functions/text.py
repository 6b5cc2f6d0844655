"""Native text functions with offsets: regex matches, tokens around a span, decoders.

All offsets are code points, 0-based and half-open. Everything is a Column expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "array<struct<start:int,end:int,value:string>>"
_SPACE = "[ \\t\\n\\x0B\\f\\r\\x1c-\\x1f\\x85\\p{Z}]"
_BLACK = "[^ \\t\\n\\x0B\\f\\r\\x1c-\\x1f\\x85\\p{Z}]"


def empty(kind: str = MATCH) -> Column:
    return F.array().cast(kind)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value made once: an expression written inside a lambda is made again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quoted(value: str) -> str:
    """A string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_of(values) -> str:
    return f"array({', '.join(map(quoted, values))})" if values else "cast(array() as array<string>)"


def applied(body: str, *values: Column) -> Column:
    """An SQL lambda ``x -> ...`` on a column; of several columns, x is a struct of a, b, c...

    An expression written as text is one call to the JVM, however large it is.
    """
    one = values[0] if len(values) == 1 else F.struct(*[v.alias(k) for v, k in zip(values, "abcdef", strict=False)])
    return F.element_at(F.call_function("transform", F.array(one), F.expr(body)), 1)


_BLOCK = 64


def running_sql(lengths: str) -> str:
    total = lambda xs: f"aggregate({xs}, 0, (a, b) -> a + b)"
    blocks = f"transform(sequence(0, cast((size(n) - 1) div {_BLOCK} as int)), b -> {total(f'slice(n, b * {_BLOCK} + 1, {_BLOCK})')})"
    bases = f"transform(array({blocks}), bs -> transform(bs, (_, i) -> {total('slice(bs, 1, i)')}))[0]"
    sums = f"transform(array({bases}), base -> transform(n, (_, i) -> base[cast(i div {_BLOCK} as int)] + {total(f'slice(n, i - i % {_BLOCK} + 1, i % {_BLOCK})')}))[0]"
    return f"transform(array({lengths}), n -> CASE WHEN size(n) > 0 THEN {sums} ELSE cast(array() as array<int>) END)[0]"


def running(lengths: Column) -> Column:
    """For each element the sum of those before it, by blocks: far fewer steps than a sum from the start for each."""
    return applied(f"q -> {running_sql('q')}", lengths)


def cut_sql(text: str, pattern: str, group: int = 0) -> str:
    """Matches m of a literal pattern (compiled once), gaps g around them, and values v: the matches, or a group of each."""
    m = f"regexp_extract_all({text}, {quoted(pattern)}, 0)"
    return f"named_struct('m', {m}, 'g', split({text}, {quoted(pattern)}, -1), 'v', {f'regexp_extract_all({text}, {quoted(pattern)}, {group})' if group else m})"


def placed_sql(x: str, last_group: str = "false") -> str:
    """start, end, value of what ``cut_sql`` gives. A value ends its match if last_group, else it is the match.

    Matches and the gaps between them alternate, so running sums of lengths give the offsets.
    """
    lengths = f"zip_with({x}.m, slice({x}.g, 1, size({x}.m)), (m, g) -> length(m) + length(g))"
    begin = f"at[i] + length({x}.g[i])"
    start = begin if last_group == "false" else f"CASE WHEN {last_group} THEN {begin} + length(m) - length({x}.v[i]) ELSE {begin} END"
    return f"transform(array({running_sql(lengths)}), at -> transform({x}.m, (m, i) -> named_struct('start', {start}, 'end', {begin} + length(m), 'value', {x}.v[i])))[0]"


def find_all_sql(text: str, pattern: str, group: int = 0) -> str:
    found = placed_sql("x", "true" if group else "false")
    return f"coalesce(transform(array({cut_sql(text, pattern, group)}), x -> CASE WHEN size(x.m) > 0 THEN {found} ELSE cast(array() as {MATCH}) END)[0], cast(array() as {MATCH}))"


def holds(text: Column, guard: str) -> Column:
    """Whether a guard is found in the text; one without special signs is sought as bytes."""
    return F.contains(text, F.lit(guard)) if re.fullmatch(r"[\w@:/ -]+", guard) else text.rlike(guard)


def find_all(text: Column, pattern: str, group: int = 0, guard: str = "") -> Column:
    """start, end, value of every match, left to right; with a group, those of a group that ends its match.

    Where the guard (a pattern that any match contains) fails, the pattern isn't tried.
    """
    found = applied(f"t -> {find_all_sql('t', pattern, group)}", text)
    return F.when(text.rlike(guard), found).otherwise(empty()) if guard else found


def replace_all(text: Column, pattern: str, change: Callable[[Column], Column], guard: str = "") -> Column:
    """text with every match m replaced by change(m)."""
    gaps = F.split(text, pattern, -1)
    new = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    joined = F.array_join(F.zip_with(gaps, new, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.when(text.rlike(guard or pattern), joined).otherwise(text)


_NEAR = 400
#: Code points in a piece of a text. Its end and the next piece's start hold what is near a place.
PIECE = 1024


def pieces_sql(text: str) -> str:
    """The text in pieces, so that what is near a place is found without reading from the start."""
    return f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)"


def left_sql(pieces: str, at: str, n: int) -> str:
    """Up to n (a piece at most) code points before a place."""
    return f"right(concat(CASE WHEN {at} >= {PIECE} THEN {pieces}[cast({at} div {PIECE} as int) - 1] ELSE '' END, left(coalesce(get({pieces}, cast({at} div {PIECE} as int)), ''), {at} % {PIECE})), {n})"


def right_sql(pieces: str, at: str, n: int) -> str:
    """Up to n (a piece at most) code points from a place on."""
    piece = f"coalesce(get({pieces}, cast({at} div {PIECE} as int)), '')"
    return f"left(concat(substring({piece}, cast({at} % {PIECE} as int) + 1), coalesce(get({pieces}, cast({at} div {PIECE} as int) + 1), '')), {n})"


def context_sql(text: str, pieces: str, start: str, window: int = 5) -> str:
    """The tokens around the token at start, up to window on either side, joined by single blanks and lower-cased.

    Only the first token of a span is left out, so the span's later tokens are context. The nearest
    characters are tried first; where the words reach past them, the whole side is read.
    """
    words = quoted(f"^{_BLACK}*((?:{_SPACE}+{_BLACK}+){{0,{window}}})")
    own = quoted(f"^{_BLACK}+")

    def side(near: str, whole: str) -> str:
        return f"regexp_replace(transform(array(regexp_extract({near}, {words}, 0)), w -> CASE WHEN length(w) < {_NEAR} THEN w ELSE regexp_extract({whole}, {words}, 0) END)[0], {own}, '')"

    left = side(f"reverse({left_sql(pieces, start, _NEAR)})", f"reverse(substring({text}, 1, {start}))")
    right = side(right_sql(pieces, start, _NEAR), f"substring({text}, {start} + 1)")
    return f"lower(trim(regexp_replace(concat(reverse({left}), ' ', {right}), {quoted(_SPACE + '+')}, ' ')))"


def context(text: Column, start: Column, window: int = 5) -> Column:
    """``context_sql`` of columns."""
    return applied(f"x -> transform(array({pieces_sql('x.a')}), p -> {context_sql('x.a', 'p', 'x.b', window)})[0]", text, start)


def strip(value: Column) -> Column:
    return F.regexp_replace(value, f"^{_SPACE}+|{_SPACE}+\\z", "")


def decoded(raw: Column) -> Column:
    """Bytes as text if they are valid UTF-8, else null."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


#: Characters that print: none of the C and Z classes but the blank. A possessive loop: a long text needs no stack.
PRINTABLE = "^(?:[\\P{C}&&[^\\p{Z}]]| )*+\\z"


def distinct_chars(value: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")))
