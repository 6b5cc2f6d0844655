"""The public calls: find entities, analyse, protect (mask, number tokens, add the safety net and instructions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.rules import RuleSet
from ..sources.staging import staged
from . import anomaly, detect, instruct, mask, normalize, registry

_ENTITY = "struct<entity_type:string,value:string,start:int,end:int,sensitivity:string,category:string,match_quality:string,points:int,score:double,level:string,action:string,breakdown:struct<pattern_strength:double,keyword_proximity:double,co_occurrence:double,format_validity:double,total:double,elevated_by_cooccur:string>,rule:int>"


_TEXTS = ("normalized", "despaced", "despaced_map", "_hits", "_hits2")
_INNER = _TEXTS[2:]


def _prepared(df: DataFrame, text: str, rules: RuleSet, types: bool = True) -> DataFrame:
    """df with the columns of normalize, _row (a number of the row's own), the rules' hits and _maybe (there are some).

    To be staged before anything is filtered: the optimiser would compare every expression of this
    chain with every other to infer filters.
    """
    out = detect.hits(normalize.normalize(df, text, rules.keep_digits, types, rules.as_written), rules)
    return out.selectExpr("*", "size(_hits) > 0 OR coalesce(size(_hits2), 0) > 0 AS _maybe")


def find(df: DataFrame, text: str = "text", rules: RuleSet | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each resolved entity, with the columns of df named in keep.

    One pass finds which rules match where; of the texts, those with a match are staged. One
    exchange follows, of entities.
    """
    rules = rules or RuleSet()
    names = [f"_keep_{k}" for k in keep]
    some = [f"CASE WHEN _maybe THEN {c} END AS {c}" for c in ("normalized", "despaced", "despaced_map")]
    rows = _prepared(df, text, rules, types=False).selectExpr("_row", "_maybe", *[f"`{k}` AS `{n}`" for k, n in zip(keep, names, strict=True)], *some, "_hits", "_hits2")
    found = detect.entities(staged(rows, "hits").where("_maybe"), rules, ("_row", *names))
    return found.select(*[F.col(n).alias(k) for k, n in zip(keep, names, strict=True)], *detect.ENTITY)


def _planned(rows: DataFrame, rules: RuleSet, session: str | None, order: str | None) -> DataFrame:
    """_row, _session, _order, resolved, planned of the rows with entities (with a second layer: of all rows that may have any)."""
    keys = {"_session": F.col(session) if session else F.col("_row"), "_order": F.col(order) if order else F.lit(0)}
    known = rows.where("_maybe").select("_row", *[c.alias(k) for k, c in keys.items()], *_TEXTS)
    found = detect.entities(known, rules, ("_row", *keys))
    one = F.struct("start", "ord", F.struct(*detect.ENTITY).alias("e"))
    out = found.groupBy("_row").agg(*[F.first(k).alias(k) for k in keys], F.sort_array(F.collect_list(one)).alias("_e"))
    out = out.select("_row", *keys, F.transform("_e", lambda x: x["e"]).cast(f"array<{_ENTITY}>").alias("resolved"))
    if "_ml" in rows.columns:
        base = rows.where("_maybe").select("_row", *[c.alias(k) for k, c in keys.items()], "_ml")
        out = base.join(out.select("_row", "resolved"), "_row", "left")
    out = out.withColumn("planned", mask.planned(F.coalesce("resolved", _none()), rules.safe_splice))
    return anomaly.safety_net(out) if "_ml" in rows.columns else out


def _none() -> Column:
    return X.empty(f"array<{_ENTITY}>")


def _joined(rows: DataFrame, per_row: DataFrame, empty: dict[str, Column]) -> DataFrame:
    """rows with the columns of per_row; texts that no guard let through aren't exchanged."""
    some = rows.where("_maybe").join(per_row, "_row", "left")
    none = rows.where("NOT _maybe")
    fill = lambda df, c, e: F.coalesce(F.col(c), e).alias(c) if c in df.columns else e.alias(c)
    return some.select(*rows.columns, *[fill(some, c, e) for c, e in empty.items()]).unionByName(none.select(*rows.columns, *[e.alias(c) for c, e in empty.items()]))


def analyse(df: DataFrame, text: str = "text", rules: RuleSet | None = None) -> DataFrame:
    """Adds the columns of normalisation, resolved entities and planned masks (tokens still without a name)."""
    rules = rules or RuleSet()
    rows = staged(_prepared(df, text, rules), "normalized")
    out = _joined(rows, _planned(rows, rules, None, None).select("_row", "resolved", "planned"), {"resolved": _none(), "planned": X.empty(mask.PLANNED)})
    return out.drop("_row", "_maybe", *_INNER)


def risks(df: DataFrame, text: str = "text", rules: RuleSet | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns named in keep, and overall_risk, of every row of df: as ``protect`` has it, where no masked text is asked for.

    Of the texts, those with a match are staged; decisions alone meet the rows again.
    """
    rules = rules or RuleSet()
    some = [f"CASE WHEN _maybe THEN {c} END AS {c}" for c in ("normalized", "despaced", "despaced_map")]
    rows = staged(_prepared(df, text, rules, types=False).selectExpr("_row", "_maybe", *[f"`{k}`" for k in keep], *some, "_hits", "_hits2"), "risks")
    decided = mask.outcome(_planned(rows, rules, None, None)).select("_row", "overall_risk")
    return _joined(rows.select("_row", "_maybe", *keep), decided, {"overall_risk": F.lit("LOW")}).select(*keep, "overall_risk")


def protect(df: DataFrame, text: str = "text", session: str | None = None, order: str | None = None, anomaly_model=None, rules: RuleSet | None = None, instructions: bool = True, known: DataFrame | None = None, types: bool = True) -> DataFrame:
    """df with masked_text, masked, skipped, overall_risk, resolved, normalized, context_type, transformations (and instructions).

    With session and order, tokens are numbered by session; without, every row is a session of its
    own. known is a token map of earlier rows: its values keep their tokens and numbers go on from
    it. A null text gives a null masked text, no entities and LOW. Without types there is no context_type. The rows with texts are staged once
    and meet the decisions about them in one join; entities alone are exchanged before.
    """
    return protect_with_tokens(df, text, session, order, anomaly_model, rules, instructions, known, types)[0]


def protect_with_tokens(df: DataFrame, text: str = "text", session: str | None = None, order: str | None = None, anomaly_model=None, rules: RuleSet | None = None, instructions: bool = True, known: DataFrame | None = None, types: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of ``protect``, and the token map of these rows' new values."""
    rules = rules or RuleSet()
    rows = _prepared(df, text, rules, types)
    if anomaly_model is not None:
        rows = anomaly.with_second_layer(rows, anomaly_model)
    rows = staged(rows, "normalized")
    plans = staged(_planned(rows, rules, session, order), "planned")
    tokens = registry.token_map(registry.occurrences(plans, "_session", "_order"), known)
    decided = mask.outcome(registry.fill(plans, tokens if known is None else tokens.select(*registry.MAP).unionByName(known.select(*registry.MAP))))
    empty = {"resolved": _none(), "masked": F.array().cast(decided.schema["masked"].dataType), "skipped": F.array().cast(decided.schema["skipped"].dataType), "overall_risk": F.lit("LOW"), "_cuts": X.empty(mask.PLANNED)}
    if anomaly_model is not None:
        empty["ml_flagged"] = F.lit(False)
    out = _joined(rows, decided.withColumn("_cuts", mask.cuts()).select("_row", *empty), empty)
    changed = F.when(F.size("_cuts") > 0, mask.splice(F.col("normalized"), F.col("_cuts"))).otherwise(F.col("normalized"))
    out = out.withColumn("masked_text", F.when(F.col(text).isNotNull(), changed))
    if anomaly_model is not None:
        out = out.withColumn("anomaly_score", F.col("_ml.score"))
    if instructions:
        out = out.withColumn("instructions", instruct.payload())
    return out.drop("_row", "_maybe", "_ml", "_cuts", *_INNER), tokens
