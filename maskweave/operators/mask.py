"""Masking: a strategy for each entity, its replacement, the spliced text, records and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.rules import CONTEXTUAL, PARTIAL, SENSITIVITY, TOKENIZED

PLANNED = "array<struct<entity_type:string,value:string,start:int,end:int,sensitivity:string,score:double,action:string,strategy:string,seq:int,replacement:string>>"


def _rank_sql(sensitivity: str) -> str:
    return f"array_position({X.array_of(SENSITIVITY)}, {sensitivity})"


def rank_of(sensitivity: Column) -> Column:
    return F.array_position(F.expr(X.array_of(SENSITIVITY)), sensitivity)


def _in(values) -> str:
    return f"IN ({', '.join(map(X.quoted, values))})"


def _strategy_sql(kind: str, sensitivity: str, action: str, high: str) -> str:
    return f"""CASE WHEN {action} IN ('ignore', 'log_suspected') THEN {action}
        WHEN {kind} {_in(CONTEXTUAL)} THEN CASE WHEN {high} OR {sensitivity} = 'CRITICAL' THEN 'full' ELSE 'contextual_skip' END
        WHEN {kind} {_in(TOKENIZED)} THEN 'tokenize' WHEN {kind} {_in(PARTIAL)} THEN 'partial'
        WHEN {sensitivity} IN ('CRITICAL', 'HIGH') THEN 'full' WHEN {sensitivity} = 'MEDIUM' THEN 'partial' ELSE 'contextual_skip' END"""


def strategy_of(e: Column, high: Column) -> Column:
    return X.applied(f"x -> {_strategy_sql('x.a.entity_type', 'x.a.sensitivity', 'x.a.action', 'x.b')}", e, high)


def _full_sql(v: str) -> str:
    return f"repeat('*', length({v}))"


def _partial_sql(v: str, kind: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '')"
    email = f"CASE WHEN length(regexp_replace({v}, '[^@]', '')) = 1 THEN concat(CASE WHEN instr({v}, '@') > 1 THEN left({v}, 1) ELSE '*' END, '***@', substring({v}, instr({v}, '@') + 1)) ELSE '***@***.***' END"
    phone = f"CASE WHEN length({d}) >= 7 THEN concat(left({d}, 3), '****', right({d}, 3)) ELSE '****' END"
    card = f"CASE WHEN length({d}) >= 8 THEN concat(left({d}, 4), ' **** **** ', right({d}, 4)) ELSE '**** **** **** ****' END"
    other = f"CASE WHEN length({v}) > 6 THEN concat(left({v}, 2), repeat('*', length({v}) - 4), right({v}, 2)) ELSE {_full_sql(v)} END"
    return f"CASE WHEN {kind} = 'EMAIL' THEN {email} WHEN {kind} IN ('PHONE_LK', 'PHONE_INTL') THEN {phone} WHEN {kind} = 'PAN' THEN {card} ELSE {other} END"


def full_mask(v: Column) -> Column:
    return F.repeat(F.lit("*"), F.length(v))


def partial_mask(v: Column, kind: Column) -> Column:
    return X.applied(f"x -> {_partial_sql('x.a', 'x.b')}", v, kind)


_MASKED = "IN ('full', 'partial', 'tokenize')"


def planned(resolved: Column, safe_splice: bool = False) -> Column:
    """Entities from right to left with strategy and replacement (null for tokens), seq their order.

    A stable order: of two that start alike, the one found first is first. With safe_splice, one
    that lies inside another masked one is left out.
    """
    strategy = _strategy_sql("e.entity_type", "e.sensitivity", "e.action", "a.high")
    own = ", ".join(f"'{k}', e.{k}" for k in ("entity_type", "value", "start", "end", "sensitivity", "score", "action"))
    new = f"CASE s WHEN 'full' THEN {_full_sql('e.value')} WHEN 'partial' THEN {_partial_sql('e.value', 'e.entity_type')} END"
    build = f"transform(array({strategy}), s -> named_struct({own}, 'strategy', s, 'seq', i, 'replacement', {new}))[0]"
    turned = "transform(sort_array(transform(r, (e, i) -> struct(-e.start AS s, i AS i, e AS e))), x -> x.e)"
    both = f"named_struct('all', {turned}, 'high', exists(r, e -> e.sensitivity IN ('HIGH', 'CRITICAL')))"
    out = f"transform(array({both}), a -> transform(a.all, (e, i) -> {build}))[0]"
    if safe_splice:
        # from right to left, what starts later comes first: an outer one is met after what it holds, or before with the same start
        inside = f"exists(p, y -> y.strategy {_MASKED} AND y.seq <> x.seq AND y.start <= x.start AND x.end <= y.end AND (y.end - y.start > x.end - x.start OR y.seq < x.seq))"
        out = f"transform(array({out}), p -> filter(p, x -> NOT x.strategy {_MASKED} OR NOT {inside}))[0]"
    return X.applied(f"r -> {out}", resolved).cast(PLANNED)


def is_masked(p: Column) -> Column:
    return p["strategy"].isin("full", "partial", "tokenize")


def splice(text: Column, masked: Column) -> Column:
    """Replacements from right to left at their own offsets, as the text stands by then.

    The text right of the last cut is a list of pieces: a cut takes what lies between, and only an
    entity that reaches into the pieces, by an overlap, has them joined.
    """

    def step(acc: Column, p: Column) -> Column:
        new = F.coalesce(p["replacement"], F.lit(""))
        between = F.substring(text, p["end"] + 1, acc["at"] - p["end"])
        tail = F.array_join(F.reverse(acc["pieces"]), "")
        rest = F.array(F.substring(tail, p["end"] - acc["at"] + 1, F.length(tail)), new)
        return F.struct(p["start"].alias("at"), F.when(p["end"] <= acc["at"], F.concat(acc["pieces"], F.array(between, new))).otherwise(rest).alias("pieces"))

    start = F.struct(F.length(text).alias("at"), X.empty("array<string>").alias("pieces"))
    return F.aggregate(masked, start, step, lambda acc: F.concat(F.substring(text, F.lit(1), acc["at"]), F.array_join(F.reverse(acc["pieces"]), "")))


def outcome(df: DataFrame) -> DataFrame:
    """Adds masked, skipped and overall_risk from planned, all with a replacement by now."""
    at = lambda k: f"CASE WHEN p.action = 'ml_flagged_mask' THEN p.{k} END"
    record = f"named_struct('entity_type', p.entity_type, 'original', p.value, 'replacement', p.replacement, 'strategy', p.strategy, 'sensitivity', p.sensitivity, 'score', p.score, 'action', p.action, 'start', {at('start')}, 'end', {at('end')})"
    logged = "named_struct('entity_type', p.entity_type, 'value', p.value, 'reason', CASE WHEN p.strategy = 'log_suspected' THEN 'low_confidence_logged' ELSE p.strategy END, 'score', p.score)"
    df = df.selectExpr("*", f"transform(filter(planned, p -> p.strategy {_MASKED}), p -> {record}) AS masked", f"transform(filter(planned, p -> NOT p.strategy {_MASKED}), p -> {logged}) AS skipped")
    return df.selectExpr("*", f"element_at({X.array_of(SENSITIVITY)}, cast(coalesce(array_max(transform(masked, m -> {_rank_sql('m.sensitivity')})), 1) as int)) AS overall_risk")


def cuts() -> Column:
    """What is replaced, from right to left: the second layer's masks are planned from left to right."""
    masked = f"filter(planned, p -> p.strategy {_MASKED})"
    return F.expr(f"CASE WHEN exists(planned, p -> p.action = 'ml_flagged_mask') THEN reverse({masked}) ELSE {masked} END")
