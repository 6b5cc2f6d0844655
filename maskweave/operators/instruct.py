"""Handling instructions for the model downstream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.rules import CRITICAL_TYPES

# The instruction texts.
STANDARD = (
    "This prompt contains masked sensitive data represented by tokens (e.g., <APIKEY_1>) or asterisks.",
    "Do not attempt to infer, reconstruct, or request the original values of any masked tokens.",
    "Treat all masked values as placeholders. Do not generate content based on their likely real values.",
    "Do not request the user to reveal masked information.",
    "If a token (e.g., <PERSON_1>) appears in multiple messages, treat it as consistently referring to the same entity.",
)
CRITICAL = (
    "CRITICAL: This prompt contained highly sensitive data (credentials/financial identifiers/SWIFT data) that has been masked.",
    "Do not attempt to reconstruct, predict, or suggest the likely values of any masked tokens.",
    "Do not provide any guidance, code, or reasoning that would assist in recovering masked values.",
    "Treat this interaction as security-sensitive. Flag for security review if applicable.",
    "Token references are session-consistent. Each token refers to the same masked value throughout this session.",
)
TOKENS_BEFORE, TOKENS_AFTER = "Session tokens present: ", ". Each token consistently refers to the same original value across all prompts in this session."


def payload(masked: str = "masked", risk: str = "overall_risk") -> Column:
    """tier, instructions, masked_count, risk_level, token_refs; the tokens in order of their names."""
    refs = f"sort_array(array_distinct(filter(transform({masked}, m -> m.replacement), r -> startswith(r, '<'))))"
    critical = f"{risk} IN ('CRITICAL', 'HIGH') OR exists({masked}, m -> m.entity_type IN ({', '.join(map(X.quoted, CRITICAL_TYPES))}))"
    note = f"array(concat({X.quoted(TOKENS_BEFORE)}, array_join(x.refs, ', '), {X.quoted(TOKENS_AFTER)}))"
    lines = f"CASE WHEN x.critical THEN {X.array_of(CRITICAL)} ELSE {X.array_of(STANDARD)} END"
    said = f"CASE WHEN size(x.refs) > 0 THEN concat({lines}, {note}) ELSE {lines} END"
    body = f"named_struct('tier', CASE WHEN x.critical THEN 'critical' ELSE 'standard' END, 'instructions', {said}, 'masked_count', size({masked}), 'risk_level', {risk}, 'token_refs', x.refs)"
    return F.expr(f"transform(array(named_struct('refs', {refs}, 'critical', {critical})), x -> {body})[0]")


def as_json(p: Column) -> Column:
    return F.to_json(F.struct(p["instructions"].alias("masking_instructions")))


def as_text(p: Column) -> Column:
    """The payload as a framed block."""
    head = F.concat(F.lit("┌─ INSTRUCTION BLOCK ["), F.upper(p["tier"]), F.lit("] ─ Risk: "), p["risk_level"], F.lit(" ─ Entities masked: "), p["masked_count"].cast("string"))
    lines = F.transform(p["instructions"], lambda s, i: F.concat(F.lit("│  "), (i + 1).cast("string"), F.lit(". "), s))
    return F.array_join(F.concat(F.array(head), lines, F.array(F.lit("└" + "─" * 60))), "\n")
