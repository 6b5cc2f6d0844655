"""Detection and scoring, as relations: matches are rows, and a text's matches meet in windows.

A text is read once: one projection finds the matches of all rules, and what needs the text (words
around a match, phrases before it) is worked out there. From then on only short rows are dealt out,
by text, and every later step keeps that partitioning: spans are compared by sorted windows, never in pairs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.rules import AMBIGUOUS, DANGEROUS_PAIRS, DIGIT_SHAPED, DOB_WORDS, MIN_BRANDED_KEY, REFERENCE_PHRASES, Rule, RuleSet
from . import signature
from .validate import CONDITIONS, condition

#: What is kept of an entity, in the order of its struct.
ENTITY = ("entity_type", "value", "start", "end", "sensitivity", "category", "match_quality", "points", "score", "level", "action", "breakdown", "rule")
_NAMED = 1 << 40


def alternation(words) -> str:
    return "|".join(re.escape(w) for w in words)


def _value(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else X.quoted(v)


def relation(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """Given rows as a table of literals, small enough to be broadcast."""
    names = ", ".join(f.split()[0] for f in schema.split(", "))
    typed = ", ".join(f"cast({n} as {t}) AS {n}" for n, t in (f.split() for f in schema.split(", ")))
    rows = rows or [tuple(None for _ in schema.split(", "))]
    values = ", ".join(f"({', '.join(map(_value, r))})" for r in rows)
    return F.broadcast(spark.sql(f"SELECT {typed} FROM VALUES {values} AS t({names})"))


def bare_dates(rules: RuleSet) -> list[int]:
    """Places among the named rules of those for dates whose words stand near a match, not in it."""
    return [i for i, r in enumerate(rules.named) if r.type == "DATE_OF_BIRTH"][1:]


def rule_table(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """The rules as rows, keyed by their number: what is known of a match by its rule alone."""
    plain = rules.ordered()
    dates = bare_dates(rules)
    rows = []
    for i, r in enumerate([*plain, *rules.named]):
        gate = rules.keywords.get(r.type) if r.needs_keyword and i < len(plain) else None
        rows.append((i, r.type, r.sensitivity, r.category, r.match_quality, r.container, r.suppressible, i >= len(plain), i - len(plain) in dates, alternation(gate) if gate else None))
    return relation(spark, "rule int, kind string, sensitivity string, category string, quality string, container boolean, suppressible boolean, named boolean, bare boolean, gate string", rows)


def type_table(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """Types with words near their values: a pattern of the words and one of their roots."""
    rows = [(k, alternation(w), alternation(sorted({x.split()[0][:4] for x in w}))) for k, w in rules.keywords.items() if w]
    return relation(spark, "type string, near_words string, near_roots string", rows)


def hits(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Adds _row (a number of the row's own), _hits and _hits2: numbers of the rules that match in normalized and in despaced.

    A text's signature is made first; only the rules that it lets through are tried. Names are not
    sought in the despaced copy. The row's number comes with the last hits: a filter on these isn't
    pushed below it, where each mention of a signature would make it again.
    """
    table, plain, own = [*rules.ordered(), *rules.named], len(rules.rules), df.columns
    for n, source in (("", "normalized"), ("2", "despaced")):
        some = "CASE WHEN despaced IS NOT NULL THEN {} END" if n else "{}"
        df = df.selectExpr("*", f"{some.format(signature.low_sql(source))} AS _low{n}")
        sign = signature.signature_sql(source, f"_low{n}", table, rules.keywords)
        df = df.selectExpr("*", *[f"{some.format(c)} AS _{k}{n}" for k, c in sign.items()])
        found = signature.hits_sql(source, f"_shape{n}", f"_words{n}", table, rules.keywords, plain if n else None)
        df = df.selectExpr("*", f"{some.format(found)} AS _hits{n}", *["monotonically_increasing_id() AS _row"] * bool(n))
    return df.select(*own, "_row", "_hits", "_hits2")


def _matches(source: str, hit: str, rules: RuleSet, table: list[Rule]) -> str:
    """rule, grouped, branded and what ``cut_sql`` gives of the rules that hit, in the rules' order. Each pattern is a literal."""
    of = lambda i, r: f"CASE WHEN array_contains({hit}, {i}) THEN named_struct('rule', {i}, 'grouped', {_value(r.group > 0)}, 'branded', {_value(r.type == 'API_KEY_OPENAI')}, 'x', {X.cut_sql(source, r.pattern, r.group)}) END"
    return f"filter(array({', '.join(of(i, r) for i, r in enumerate(table))}), c -> c IS NOT NULL)"


def _spans(rules: RuleSet) -> str:
    """start, end, value, demoted of the matches of one rule in _c.

    A short branded key and, unless the rules say otherwise, every such match after it in the text are of the generic type.
    """
    short = f"length(m.value) < {MIN_BRANDED_KEY}"
    late = short if rules.safe_demotion else "f > 0 AND j + 1 >= f"
    first = f"CASE WHEN _c.branded THEN array_position(transform(ms, m -> {short}), true) ELSE 0 END"
    spans = f"transform(array({first}), f -> transform(ms, (m, j) -> named_struct('start', m.start, 'end', m.end, 'value', m.value, 'demoted', _c.branded AND {late})))[0]"
    return f"transform(array({X.placed_sql('_c.x', '_c.grouped')}), ms -> {spans})[0]"


def _surroundings(text: str, pieces: str, start: str, end: str) -> str:
    """What stands near a span: words around it, and the text just before and after, lower-cased."""
    return f"named_struct('words', {X.context_sql(text, pieces, start)}, 'left', lower({X.left_sql(pieces, start, 60)}), 'right', lower({X.right_sql(pieces, end, 15)}))"


def strength(kind: str, v: str) -> str:
    """Pattern strength: 40, or 20 for the weaker forms of three types."""
    return f"CASE WHEN {kind} = 'PASSPORT' AND NOT {v} RLIKE '^[A-Z]{{2}}[0-9]{{7}}\\\\z' OR {kind} = 'SWIFT_BIC' AND length({v}) <> 11 OR {kind} = 'API_KEY_GENERIC' AND length({v}) < 40 THEN 20 ELSE 40 END"


def validity(rules: RuleSet, kind: str, v: str) -> Column:
    """Format validity: 10, 0, or 5 for a type without a validator."""
    own = " ".join(f"WHEN '{k}' THEN CASE WHEN {condition(k, v)} THEN 10 ELSE 0 END" for k in CONDITIONS)
    out = F.expr(f"CASE {kind} {own} ELSE 5 END")
    for name, check in rules.validators.items():
        out = F.when(F.col(kind) == name, F.when(F.coalesce(check(F.col(v)), F.lit(False)), 10).otherwise(0)).otherwise(out)
    return out


def candidates(rows: DataFrame, rules: RuleSet, keys: tuple[str, ...] = ("_row",)) -> DataFrame:
    """A row for each match that no phrase, missing keyword or short value rules out, with three score factors.

    rows has keys, normalized, despaced (null where it is the same), despaced_map, and hits of both as
    _hits and _hits2. Patterns run over the normalised text, then over the despaced copy where there is one, then those of names. Containers
    stay, marked dead, for the span that they claim. The texts end here: what stands near a match is cut out before it is a row.
    """
    plain = rules.ordered()
    table = [*plain, *rules.named]
    if not table:
        return rows.select(*keys, *_nothing()).where(F.lit(False))
    spark, own = rows.sparkSession, [f"`{k}`" for k in keys]
    first = "named_struct('pass', 1, 'text', normalized, 'map', cast(NULL as array<int>), 'hits', _hits)"
    second = "named_struct('pass', 2, 'text', despaced, 'map', despaced_map, 'hits', _hits2)"
    df = rows.selectExpr(*own, "normalized AS _n", f"explode(CASE WHEN size(_hits2) > 0 THEN array({first}, {second}) ELSE array({first}) END) AS _p").where("size(_p.hits) > 0")
    df = df.selectExpr(*own, "_n", "_p", f"{X.pieces_sql('_n')} AS _np", f"CASE WHEN _p.pass = 2 THEN {X.pieces_sql('_p.text')} END AS _pp", f"{_matches('_p.text', '_p.hits', rules, table)} AS _all")
    df = df.selectExpr(*own, "_n", "_p", "_np", "_pp", f"flatten(transform(_all, _c -> transform({_spans(rules)}, m -> named_struct('rule', _c.rule, 'm', m)))) AS _all")
    # the place in the normalised text, by the map where the despaced copy was searched
    begin, end = "CASE WHEN _p.map IS NULL THEN y.m.start ELSE _p.map[y.m.start] END", "CASE WHEN _p.map IS NULL THEN y.m.end ELSE _p.map[y.m.end - 1] + 1 END"
    here = _surroundings("_p.text", "coalesce(_pp, _np)", "y.m.start", "y.m.end")
    there = _surroundings("_n", "_np", "y.start", "y.end")
    placed = f"transform(_all, y -> named_struct('rule', y.rule, 'm', y.m, 'start', {begin}, 'end', {end}))"
    near = f"transform({placed}, y -> named_struct('y', y, 'near', {here}, 'own', CASE WHEN _p.pass = 2 THEN {there} END))"
    df = df.selectExpr(*own, "_p.pass AS _pass", f"posexplode({near}) AS (_at, _z)")
    df = df.join(rule_table(spark, rules).withColumnRenamed("rule", "_rule"), F.expr("_z.y.rule = _rule"))
    df = df.selectExpr(
        *own, "_rule AS rule", "container", "named", "bare", "suppressible", "gate", "sensitivity", "category", "_z.y.start AS start", "_z.y.end AS end", "_z.near AS _near", "coalesce(_z.own, _z.near) AS _own",
        "CASE WHEN _z.y.m.demoted THEN 'API_KEY_GENERIC' ELSE kind END AS entity_type", f"regexp_replace(_z.y.m.value, {X.quoted(f'^{X._SPACE}+|{X._SPACE}+' + chr(92) + 'z')}, '') AS value",
        "CASE WHEN _z.y.m.demoted THEN 'partial' ELSE quality END AS match_quality", "_z.y.m.demoted AS _demoted", "CASE WHEN named THEN 3 ELSE _pass END AS pass", f"CASE WHEN named THEN {2 * _NAMED}L ELSE (_pass - 1) * {_NAMED}L END + _at AS ord",
    )
    generic = rules.keywords.get("API_KEY_GENERIC", ())
    gate = f"CASE WHEN _demoted THEN {X.quoted(alternation(generic)) if generic else 'NULL'} ELSE gate END"
    dated = f"(right(_near.left, 40) RLIKE {X.quoted(alternation(DOB_WORDS))} OR _near.right RLIKE {X.quoted(alternation(DOB_WORDS))})"
    let_in = f"coalesce(concat(_near.words, ' ', right(_near.left, 20)) RLIKE {gate}, true)"
    live = f"CASE WHEN named THEN NOT bare OR {dated} ELSE length(value) >= 3 AND NOT (suppressible AND _near.left RLIKE {X.quoted(alternation(REFERENCE_PHRASES))}) AND {let_in} END"
    df = df.selectExpr("*", f"{live} AS live", "concat(_own.words, ' ', lower(value), ' ', right(_own.left, 25)) AS _said").where("live OR container")
    df = df.join(type_table(spark, rules), F.expr("entity_type = type"), "left")
    said = "CASE WHEN type IS NULL THEN 15 WHEN _said RLIKE near_words THEN 30 WHEN _said RLIKE near_roots THEN 15 ELSE 0 END"
    df = df.selectExpr(*own, "pass", "ord", "rule", "container", "live", "start", "end", "entity_type", "value", "sensitivity", "category", "match_quality", f"{strength('entity_type', 'value')} AS strength", f"{said} AS proximity")
    return df.withColumn("format", validity(rules, "entity_type", "value"))


def _nothing() -> list[Column]:
    kinds = {"pass": "int", "ord": "long", "rule": "int", "container": "boolean", "live": "boolean", "start": "int", "end": "int", "entity_type": "string", "value": "string", "sensitivity": "string", "category": "string", "match_quality": "string", "strength": "int", "proximity": "int", "format": "int"}
    return [F.lit(None).cast(t).alias(k) for k, t in kinds.items()]


def _partners(pairs, kind: str) -> str:
    """The types that form a pair with a type."""
    of: dict[str, list[str]] = {}
    for a, b in pairs:
        of.setdefault(a, []).append(b)
        of.setdefault(b, []).append(a)
    return f"CASE {kind} {' '.join(f'WHEN {X.quoted(k)} THEN {X.array_of(v)}' for k, v in of.items())} ELSE {X.array_of(())} END"


def _ambiguous(a: str, b: str) -> str:
    return f"array_contains({_partners(AMBIGUOUS, a)}, {b})"


def _family(kind: str) -> str:
    """A name that types which may be mistaken for each other share, also through a third."""
    root = {k: k for pair in AMBIGUOUS for k in pair}
    for a, b in AMBIGUOUS:
        old, new = root[b], root[a]
        root = {k: new if r == old else r for k, r in root.items()}
    return f"CASE {kind} {' '.join(f'WHEN {X.quoted(k)} THEN {X.quoted(v)}' for k, v in root.items())} ELSE {kind} END"


def accepted(found: DataFrame, rules: RuleSet, key: str = "_row") -> DataFrame:
    """Candidates that stand: none strictly inside a container, at one span the first type and those ambiguous with one there.

    Names, dates and addresses come last, a rule after the other, and overlap nothing that stands.
    """
    k = f"`{key}`"
    over = f"OVER (PARTITION BY {k} ORDER BY start, end DESC, container, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    claimed = [f"max(CASE WHEN container AND pass <= {p} THEN end END) {over}" for p in (1, 2)]
    # what stands before a span in this order starts no later; if it also ends no earlier, the span lies inside
    df = found.selectExpr("*", f"{claimed[0]} AS _one", f"{claimed[1]} AS _two")
    df = df.where("live AND NOT (NOT container AND coalesce(CASE pass WHEN 1 THEN _one WHEN 2 THEN _two END >= end, false))").drop("_one", "_two", "live", "container")

    # at one span stands at most one candidate of each rule and pass; a name is a group of its own
    rest = ", ".join(f"`{c}`" for c in df.columns if c not in (key, "ord", "start", "end"))
    groups = df.groupBy(key, "start", "end", F.expr("CASE WHEN pass = 3 THEN ord END AS _own")).agg(F.expr(f"array_sort(collect_list(struct(ord, {rest}))) AS _c"))
    fits = f"(size(acc) = 0 OR exists(acc, e -> {_ambiguous('e.entity_type', 'c.entity_type')})) AND NOT exists(acc, e -> e.entity_type = c.entity_type)"
    kept = f"inline(CASE WHEN size(_c) > 1 THEN aggregate(_c, slice(_c, 1, 0), (acc, c) -> CASE WHEN {fits} THEN concat(acc, array(c)) ELSE acc END) ELSE _c END)"
    df = groups.selectExpr(k, "start", "end", kept).selectExpr("*", "pass < 3 AS _ok")

    # names, a rule after the other: those free of what stands so far
    first_name, own = len(rules.ordered()), [f"`{c}`" for c in df.columns if c != "_ok"]
    by_start = f"(PARTITION BY {k} ORDER BY start, ord"
    for i in range(len(rules.named)):
        df = df.selectExpr("*", "CASE WHEN _ok THEN start END AS _begin")
        df = df.selectExpr(*own, "_ok", f"max(CASE WHEN _ok THEN end END) OVER {by_start} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _ended", f"lead(_begin, 1) IGNORE NULLS OVER {by_start}) AS _begins")
        df = df.selectExpr(*own, f"_ok OR rule = {first_name + i} AND coalesce(_ended <= start, true) AND coalesce(_begins >= end, true) AS _ok")
    return df.where("_ok").drop("_ok", "pass")


LEVEL = "CASE WHEN points >= 90 THEN 'Very High' WHEN points >= 75 THEN 'High' WHEN points >= 50 THEN 'Medium' WHEN points >= 25 THEN 'Low' ELSE 'Very Low' END"
ACTION = "CASE WHEN points >= 75 THEN 'mask_immediate' WHEN points >= 50 THEN 'mask_warn' WHEN points >= 25 THEN 'log_suspected' ELSE 'ignore' END"


def scored(df: DataFrame, key: str = "_row") -> DataFrame:
    """Adds points (hundredths), score, level, action, breakdown; a dangerous pair raises the sensitivity.

    Co-occurrence looks at all other accepted entities, those that lose an overlap later included:
    a type counts as other if it isn't one's own or stands more than once.
    """
    alike = F.count(F.lit(1)).over(Window.partitionBy(key, "entity_type"))
    types = F.collect_set("entity_type").over(Window.partitionBy(key))  # no more than there are rules
    df = df.withColumn("_alike", alike).withColumn("_types", types)
    df = df.selectExpr("*", "size(_types) - cast(_alike = 1 as int) AS _others", f"arrays_overlap({_partners(DANGEROUS_PAIRS, 'entity_type')}, _types) AS _raised")
    df = df.selectExpr("*", "CASE WHEN _others = 0 THEN 0 WHEN _raised THEN 20 WHEN _others >= 3 THEN 15 ELSE 10 END AS together")
    shaped = f"entity_type IN ({', '.join(map(X.quoted, DIGIT_SHAPED))}) AND proximity = 0 AND together = 0"
    df = df.selectExpr("*", f"CASE WHEN {shaped} THEN 0 ELSE format END AS _form").selectExpr("*", "strength + proximity + together + _form AS points")
    parts = {"pattern_strength": "strength", "keyword_proximity": "proximity", "co_occurrence": "together", "format_validity": "_form", "total": "points"}
    detail = ", ".join(f"'{k}', {c} / 100" for k, c in parts.items())
    rest = [f"`{c}`" for c in df.columns if c not in ("sensitivity", "_alike", "_types", "_others", "_raised", "together", "strength", "proximity", "format", "_form")]
    return df.selectExpr(*rest, "CASE WHEN _raised THEN 'CRITICAL' ELSE sensitivity END AS sensitivity", "points / 100 AS score", f"{LEVEL} AS level", f"{ACTION} AS action", f"named_struct({detail}, 'elevated_by_cooccur', CASE WHEN _raised THEN 'CRITICAL' END) AS breakdown")


def resolved(df: DataFrame, key: str = "_row") -> DataFrame:
    """Entities that no overlapping one of their type, or of one that may be mistaken for it, beats.

    A higher score wins, then the longer span, then the earlier. Those that are beaten beat others still.
    Only entities of one chain of overlaps in one family of types are compared.
    """
    family = Window.partitionBy(key, "_family").orderBy("start", "ord")
    df = df.withColumn("_family", F.expr(_family("entity_type")))
    ended = F.max("end").over(family.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.coalesce((ended <= F.col("start")).cast("int"), F.lit(1)))
    df = df.withColumn("_chain", F.sum("_new").over(family.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    rest = [c for c in df.columns if c not in (key, "_family", "_chain", "start", "ord")]
    chains = df.groupBy(key, "_family", "_chain").agg(F.sort_array(F.collect_list(F.struct("start", "ord", F.struct(*rest).alias("e")))).alias("_c"))

    alike = f"(x.e.entity_type = y.e.entity_type OR {_ambiguous('x.e.entity_type', 'y.e.entity_type')})"
    longer, same = "y.e.end - y.start > x.e.end - x.start", "y.e.end - y.start = x.e.end - x.start"
    earlier = "(y.start < x.start OR y.start = x.start AND y.ord < x.ord)"
    beats = f"y.ord <> x.ord AND {alike} AND x.start < y.e.end AND y.start < x.e.end AND (y.e.points > x.e.points OR y.e.points = x.e.points AND ({longer} OR {same} AND {earlier}))"
    kept = F.expr(f"CASE WHEN size(_c) > 1 THEN filter(_c, x -> NOT exists(_c, y -> {beats})) ELSE _c END")
    return chains.select(key, F.explode(kept).alias("_k")).select(key, "_k.start", "_k.ord", "_k.e.*")


def entities(rows: DataFrame, rules: RuleSet, keys: tuple[str, ...] = ("_row",)) -> DataFrame:
    """A row for each resolved entity of the normalised rows, keyed by the first of keys: one exchange of short rows."""
    return resolved(scored(accepted(candidates(rows, rules, keys), rules, keys[0]), keys[0]), keys[0])
