"""Canonical requests: a prompt and context blocks masked as the prompts of one session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rules import SENSITIVITY
from ..sources.staging import staged
from .mask import rank_of
from .protect import protect

_OBJECT = "map<string,variant>"
# Fixed value: the status of a processed request.
STATUS = "masked_ready_for_next_component"


def _put(obj: Column, new: dict[str, Column]) -> Column:
    """An object with some fields set, the others as they are; a null object is empty."""
    rest = F.map_filter(F.coalesce(obj, F.create_map().cast(_OBJECT)), lambda k, _: ~k.isin(*new))
    return F.map_concat(rest, F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v)]))


def _filled(v: Column) -> Column:
    """A variant as text where it is a string that isn't empty."""
    return F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.try_variant_get(v, "$", "string"), F.lit("")))


def process(df: DataFrame, column: str = "payload", anomaly_model=None, component: str = "maskweave") -> DataFrame:
    """df with the JSON text in column masked: prompt, contents, masking_summary and metadata are set, all other fields are as they came.

    Every prompt or content that isn't empty is a prompt of the request's session, the prompt first and
    then the blocks in order, so a value has one token throughout; a request is a session of its own,
    also if the same id or payload comes twice. A payload that is no object gives null; blocks that are
    no objects stay. A field is a row meanwhile: a request of many blocks is spread like any rows.
    """
    names = df.columns
    whole = F.try_parse_json(column)
    df = df.withColumns({"_request": F.try_variant_get(whole, "$.request", _OBJECT), "_context": F.try_variant_get(whole, "$.context", "array<variant>"), "_id": F.monotonically_increasing_id()})
    df = staged(df.withColumn("_texts", F.concat(F.array(_filled(F.col("_request")["prompt"])), F.transform(F.coalesce("_context", F.array().cast("array<variant>")), lambda b: _filled(F.try_variant_get(b, "$.content", "variant"))))).select(*names, "_id", "_texts"), "requests")
    fields = df.select("_id", F.posexplode("_texts").alias("_at", "_text")).where("_text IS NOT NULL")
    done = protect(fields, "_text", "_id", "_at", anomaly_model, instructions=False)
    flagged = F.col("ml_flagged") if anomaly_model is not None else F.lit(False)
    secret = F.exists("masked", lambda m: m["entity_type"] == "ML_FLAGGED_ANOMALY")
    records = F.transform("masked", lambda m: F.struct(m["entity_type"].alias("entity_type"), m["strategy"].alias("strategy"), m["sensitivity"].alias("sensitivity")))
    masking = F.struct("overall_risk", records.alias("masked_entities"), flagged.alias("ml_flagged"), (flagged & secret).alias("ml_masked"))
    one = F.struct("_at", F.struct(F.col("masked_text").alias("text"), masking.alias("masking")))
    grouped = done.groupBy("_id").agg(F.map_from_entries(F.collect_list(one)).alias("_m"), F.max(rank_of(F.col("overall_risk"))).alias("_risk"))
    out = df.join(grouped, "_id", "left")

    top, whole = F.from_json(F.col(column), _OBJECT), F.try_parse_json(column)
    request, context, meta, summary = (F.try_variant_get(whole, f"$.{k}", t) for k, t in (("request", _OBJECT), ("context", "array<variant>"), ("metadata", _OBJECT), ("masking_summary", _OBJECT)))
    variant = F.to_variant_object
    at = lambda i: F.try_element_at("_m", i)
    text = lambda i: at(i)["text"].cast("variant")
    prompt = F.when(at(F.lit(0)).isNotNull(), variant(_put(request, {"prompt": text(F.lit(0)), "masking": variant(at(F.lit(0))["masking"])}))).otherwise(top["request"])
    blocks = variant(F.transform(context, lambda b, i: F.when(at(i + 1).isNotNull(), variant(_put(F.try_variant_get(b, "$", _OBJECT), {"content": text(i + 1), "masking": variant(at(i + 1)["masking"])}))).otherwise(b)))
    risk = F.element_at(F.array(*map(F.lit, SENSITIVITY)), F.coalesce("_risk", F.lit(1)).cast("int"))
    fixed = {"masking_summary": variant(_put(summary, {"overall_risk": risk.cast("variant")})), "metadata": variant(_put(meta, {"masking_component": F.lit(component).cast("variant"), "status": F.lit(STATUS).cast("variant")}))}
    body = _put(top, fixed)
    body = F.when(F.map_contains_key(top, "request"), _put(body, {"request": prompt})).otherwise(body)
    body = F.when(context.isNotNull(), _put(body, {"context": blocks})).otherwise(body)
    return out.select(*[F.when(top.isNotNull(), F.to_json(body)).alias(column) if c == column else F.col(c) for c in names])
