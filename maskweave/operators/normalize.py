"""Normalisation: decoders, removal of adversarial spacing with an index map, context type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions import text as X
from .signature import folded_sql, trie

# Patterns of context types.
CONTEXTS = {
    "source_code": (r"\bdef\s+\w+\s*\(", r"\bimport\s+\w+", r"\bfunction\s+\w+\s*\(", r"\bconst\s+\w+\s*=", r"\bvar\s+\w+\s*=", r"\bclass\s+\w+", r"=>", r"\breturn\b", r"//\s", r"/\*", r"\bpublic\b|\bprivate\b"),
    "config_file": (r"^[A-Z_]+=.+", r'"[^"]+"\s*:\s*"[^"]+"', r"^\w+:\s+\S+", r"\.env", r"config\.", r"settings\."),
    "log_output": (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", r"\b(INFO|ERROR|DEBUG|WARN|CRITICAL|FATAL)\b", r"Traceback \(most recent call", r"at \w+\.\w+\([\w.]+:\d+\)", r"\[[\d\-:T]+\]"),
    "natural_language": (r"\b(please|can you|could you|help me|I need|check|verify|update|send)\b", r"\b(customer|account|transfer|balance|loan|payment)\b"),
}
#: Lower-cased text that any match of a pattern holds, one of these at least; they save the pattern most texts.
_HINTS = {
    "source_code": (("def",), ("import",), ("function",), ("const",), ("var",), ("class",), ("=>",), ("return",), ("//",), ("/*",), ("public", "private")),
    "config_file": (("=",), ('"',), (":",), (".env",), ("config.",), ("settings.",)),
    "log_output": (("-",), ("info", "error", "debug", "warn", "critical", "fatal"), ("traceback",), ("at ",), ("[",)),
    "natural_language": (("please", "can you", "could you", "help me", "i need", "check", "verify", "update", "send"), ("customer", "account", "transfer", "balance", "loan", "payment")),
}
#: Those of them that a pattern has at the start of a word: one scan finds all.
_STARTS = tuple(sorted(h for hints in _HINTS.values() for some in hints for h in some if h[0].isalpha() and h not in ("config.", "settings.", "traceback", "at ")))
_SHORT = "(?:[A-Za-z0-9]{1,2}|[@\\-])"
#: Three short tokens and more. Each ends before another sign, so none is ever given back: a possessive loop, which needs no stack for a long run.
_TOKEN = f"{_SHORT}(?![A-Za-z0-9])"
RUN = f"(?<![A-Za-z0-9]){_TOKEN}(?:[ \\t]{_TOKEN}){{2,}}+"
DASH = r"\d-\d"


#: Signs of which three stand alone between blanks, or a digit beside a short token: any run that looks spaced out has one.
_ONE = "[A-Za-z0-9@\\-]"
_ALONE = f"[ \\t]{_ONE}[ \\t]{_ONE}[ \\t]{_ONE}(?![A-Za-z0-9])"
_DIGIT = f"[0-9](?:[A-Za-z0-9]?[ \\t]{_SHORT}(?![A-Za-z0-9])|(?<={_ONE}[ \\t][A-Za-z0-9]?[0-9]))"


def url_sql(t: str) -> str:
    """Percent escapes as UTF-8; a plus and a malformed escape stay."""
    safe = f"regexp_replace(replace({t}, '+', '%2B'), '%(?![0-9a-fA-F]{{2}})', '%25')"
    return f"CASE WHEN contains({t}, '%') THEN coalesce(try_url_decode({safe}), {t}) ELSE {t} END"


def _replaced_sql(t: str, pattern: str, change: str, guard: str) -> str:
    """t with every match m changed."""
    p = X.quoted(pattern)
    joined = f"array_join(zip_with(split({t}, {p}, -1), transform(regexp_extract_all({t}, {p}, 0), m -> {change}), (g, m) -> concat(g, coalesce(m, ''))), '')"
    return f"CASE WHEN {t} RLIKE {X.quoted(guard)} THEN {joined} ELSE {t} END"


def _decoded_sql(raw: str, ok: str) -> str:
    """Bytes as text if they are valid UTF-8 that prints and ok holds of text and match, else the match."""
    return f"transform(array(cast({raw} as string)), p -> CASE WHEN is_valid_utf8(p) AND {ok} AND p RLIKE {X.quoted(X.PRINTABLE)} THEN p ELSE m END)[0]"


def hex_sql(t: str, keep_digits: bool = False) -> str:
    """Runs of ten hexadecimal digits and more, of even length, that spell printable text."""
    ok = "length(m) % 2 = 0 AND length(p) > 4" + (" AND NOT m RLIKE '^[0-9]+$'" if keep_digits else "")
    return _replaced_sql(t, r"(?U)\b[0-9a-fA-F]{10,}\b", _decoded_sql("unhex(m)", ok), "[0-9a-fA-F]{10}")


def base64_sql(t: str) -> str:
    """Runs of twenty Base64 signs and more that spell printable text; web tokens stay for their own rules."""
    bare = "regexp_replace(m, '=+$', '')"
    raw = f"try_to_binary(concat({bare}, repeat('=', (4 - length({bare}) % 4) % 4)), 'base64')"
    start = "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20"  # a run is tried at its start alone
    return _replaced_sql(t, start + ",}={0,2}", _decoded_sql(raw, "NOT startswith(m, 'eyJ') AND length(p) > 5"), start + "}")


def _obfuscated_sql(run: str) -> str:
    singles = X.quoted(f"^{_ONE}(?:[ \\t]{_ONE}){{3,}}\\z")
    return f"(length(regexp_replace({run}, '[^0-9]', '')) >= 2 OR {run} RLIKE {singles})"


def blanks_sql(t: str) -> str:
    """Indexes of the blanks inside runs that look like spaced-out values."""
    inside = "filter(transform(split(m.value, ''), (c, i) -> CASE WHEN c IN (' ', '\\t') THEN m.start + i END), i -> i IS NOT NULL)"
    return f"flatten(transform(filter({X.find_all_sql(t, RUN)}, m -> {_obfuscated_sql('m.value')}), m -> {inside}))"


def dashes_sql(t: str) -> str:
    """Indexes of dashes between digits; a digit serves one dash."""
    return f"transform({X.find_all_sql(t, '(?U)' + DASH)}, m -> m.start + 1)"


def _picked_sql(t: str, indexes: str) -> str:
    return f"transform(array(split({t}, '')), c -> array_join(transform({indexes}, i -> c[i]), ''))[0]"


def _starts_sql(low: str) -> str:
    """Which words of _STARTS the folded text has."""
    return f"array_distinct(regexp_extract_all(concat(' ', {low}), {X.quoted(trie(_STARTS, ''))}, 1))"


def _type_sql(t: str, low: str, starts: str) -> str:
    """The type with most of its patterns in the text; none: natural language; a tie: mixed. low is the folded text, starts its words of _STARTS."""

    def hit(pattern: str, hints: tuple[str, ...]) -> str:
        some = " OR ".join(f"array_contains({starts}, {X.quoted(h)})" if h in _STARTS else f"contains({low}, {X.quoted(h)})" for h in hints)
        return f"cast((({some}) AND {t} RLIKE {X.quoted('(?dmiU)' + pattern)}) as int)"

    score = ", ".join(f"'{k}', " + " + ".join(hit(p, h) for p, h in zip(ps, _HINTS[k], strict=True)) for k, ps in CONTEXTS.items())
    each = [f"s.{k}" for k in CONTEXTS]
    best = f"greatest({', '.join(each)})"
    ties = " + ".join(f"cast({e} = {best} as int)" for e in each)
    pick = " ".join(f"WHEN s.{k} = {best} THEN '{k}'" for k in CONTEXTS)
    return f"transform(array(named_struct({score})), s -> CASE WHEN {best} = 0 THEN 'natural_language' WHEN {ties} > 1 THEN 'mixed' {pick} END)[0]"


def context_type(t: Column) -> Column:
    """The type of context of a text."""
    return X.applied(f"t -> transform(array({folded_sql('t')}), low -> transform(array({_starts_sql('low')}), w -> {_type_sql('t', 'low', 'w')})[0])[0]", t)


def _typed(df: DataFrame, raw: str) -> DataFrame:
    """df with context_type, a column for each step."""
    df = df.selectExpr("*", f"{folded_sql(raw)} AS _low").selectExpr("*", f"{_starts_sql('_low')} AS _starts")
    return df.selectExpr("*", f"{_type_sql(raw, '_low', '_starts')} AS context_type").drop("_low", "_starts")


def normalize(df: DataFrame, text: str = "text", keep_digits: bool = False, types: bool = True, as_written: bool = False) -> DataFrame:
    """Adds normalized, despaced and despaced_map (both null where nothing was removed), transformations, context_type.

    A null text is empty here; the caller keeps its own column. With as_written nothing is decoded or removed. Row-local: no exchange.
    """
    raw = f"coalesce(`{text}`, '')"
    own = df.columns
    if as_written:
        df = df.selectExpr("*", f"{raw} AS normalized", "cast(NULL AS array<int>) AS despaced_map", "cast(NULL AS string) AS despaced", "cast(array() AS array<string>) AS transformations")
        return _typed(df, raw) if types else df
    df = df.selectExpr("*", f"{url_sql(raw)} AS _u")
    df = df.selectExpr("*", f"{hex_sql('_u', keep_digits)} AS _h")
    df = df.selectExpr("*", f"{base64_sql('_h')} AS normalized")
    # index maps are made for texts with something to remove alone, a column for each step
    spaced = f"(normalized RLIKE {X.quoted(_ALONE)} OR normalized RLIKE {X.quoted(_DIGIT)}) AND exists(regexp_extract_all(normalized, {X.quoted(RUN)}, 0), r -> {_obfuscated_sql('r')})"
    df = df.selectExpr("*", f"({spaced}) OR normalized RLIKE {X.quoted('(?U)-(?<=' + DASH[:-2] + ')' + DASH[-2:])} AS _odd")
    df = df.selectExpr("*", f"CASE WHEN _odd THEN array_except(sequence(0, length(normalized) - 1), {blanks_sql('normalized')}) END AS _kept")
    df = df.selectExpr("*", f"CASE WHEN _kept IS NOT NULL THEN {_picked_sql('normalized', '_kept')} END AS _closed")
    df = df.selectExpr("*", f"CASE WHEN _kept IS NOT NULL THEN transform(array_except(sequence(0, size(_kept) - 1), {dashes_sql('_closed')}), i -> _kept[i]) END AS _map")
    df = df.selectExpr("*", "CASE WHEN size(_map) < length(normalized) THEN _map END AS despaced_map")
    df = df.selectExpr("*", f"CASE WHEN despaced_map IS NOT NULL THEN {_picked_sql('normalized', 'despaced_map')} END AS despaced")
    steps = f"CASE WHEN _u <> {raw} THEN 'url_decoded' END, CASE WHEN _h <> _u THEN 'hex_decoded' END, CASE WHEN normalized <> _h THEN 'base64_decoded' END, CASE WHEN despaced <> normalized THEN 'adversarial_spacing_removed' END"
    columns = [*[f"`{c}`" for c in own], "normalized", "despaced_map", "despaced", f"filter(array({steps}), s -> s IS NOT NULL) AS transformations"]
    df = df.selectExpr(*columns)
    return _typed(df, raw) if types else df
