"""Patterns over long runs: matches as before, and no stack for each step of a loop."""

import base64
import random
import re

import pytest

from maskweave.functions import text as X
from maskweave.operators import normalize, signature
from maskweave.operators.protect import find, protect, risks

#: As they were, with a loop that gives signs back.
SHORT = r"(?:[A-Za-z0-9]{1,2}|[@\-])"
BEFORE = {
    "run": (rf"(?<![A-Za-z0-9]){SHORT}(?:[ \t]{SHORT}){{2,}}(?![A-Za-z0-9])", normalize.RUN),
    "shape": (r"[0-9](?:[ \-]?[0-9])*|[A-Z]{6,}", signature.SHAPE.replace(r"\p{Nd}", "[0-9]")),
}
LONG = {
    "run": (normalize.RUN, "a1 b " * 40_000),
    "shape": (signature.SHAPE, "1 " * 100_000),
    "printable": (X.PRINTABLE, "a b" * 60_000),
}


@pytest.mark.parametrize("name", BEFORE)
def test_matches_are_as_before(name):
    before, now = (re.compile(p) for p in BEFORE[name])
    dice = random.Random(7)
    for _ in range(20_000):
        text = "".join(dice.choice("aB1 \t@-. 7") for _ in range(dice.randrange(24)))
        assert [m.span() for m in before.finditer(text)] == [m.span() for m in now.finditer(text)], text


@pytest.mark.parametrize("name", LONG)
def test_long_runs_need_no_stack(spark, name):
    pattern, text = LONG[name]
    assert spark._jvm.java.util.regex.Pattern.compile(pattern).matcher(text).find()


def test_queries_of_texts_with_long_runs(spark):
    """Spaced-out runs, numbers and encoded text of thousands of signs: found, masked and judged by all calls."""
    coded = base64.b64encode(b"plain words " * 3000).decode()
    tail = " mail ann@example.com"
    texts = [("spaced", "is it " + "a1 b " * 2000 + tail), ("digits", "n " + "12 " * 2000 + tail), ("coded", f"see {coded} end{tail}")]
    df = spark.createDataFrame(texts, "doc_id string, text string")
    found = {r.doc_id: r.n for r in find(df, "text", keep=("doc_id",)).where("entity_type = 'EMAIL'").groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert set(found) == {"spaced", "digits", "coded"}
    out = {r.doc_id: r for r in protect(df, "text").collect()}
    assert all("a***@example.com" in r.masked_text for r in out.values())
    assert "adversarial_spacing_removed" in out["spaced"].transformations and out["coded"].transformations == ["base64_decoded"]
    assert {r.doc_id: r.overall_risk for r in risks(df, "text", keep=("doc_id",)).collect()} == {k: r.overall_risk for k, r in out.items()}
