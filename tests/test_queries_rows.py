"""Queries against their SQL on small rows of their own."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from maskweave import fixtures
from maskweave.operators import anomaly
from maskweave.operators.protect import protect, risks
from maskweave.plans.rules import RuleSet
from maskweave.sources import datagen

DOCUMENTS = "doc_id long, text string, lang string, source string"
TURNS = "conv_id long, turn int, role string, text string"


def agree(spark, folder, name, **tables):
    """The query's rows are those of its SQL over the given tables; gives them."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(folder))
    mine = sorted(repr(tuple(r)) for r in df.collect())
    assert mine == sorted(repr(r) for r in con.sql(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    return mine


def test_a_turn_is_no_context_of_the_prompt_before_it(spark, tmp_path):
    turns = [(1, 0, "user", "Vipa oipaou les étioneux"), (2, 0, "user", "the server has an ip"), (3, 1, "user", "Le un le"), (3, 0, "user", None)]
    assert len(agree(spark, tmp_path, "golden_prompts", conversations=(TURNS, turns))) == 36


@pytest.mark.parametrize("name", ["mask_emails", "email_scores"])
def test_addresses_in_texts_as_written(spark, tmp_path, name):
    texts = ["mail a.b@x.lk of 4738745156746829 here", "%41 c@y.com and cGFzc3dvcmQ9U2VjdXJlOTk5QA== too", "1 2 3 @ y.com", "x@z.lk y@z.lk", None, ""]
    agree(spark, tmp_path, name, documents=(DOCUMENTS, [(i, t, "en", "s") for i, t in enumerate(texts)]))


def test_the_gate_of_a_text_equals_that_of_its_features(spark, tmp_path):
    words = ["averylongwordofprose", "abcdefghijkl", "short", "x" * 30, "q1w2e3r4t5y6u7i8", "AKIA", "tokEn", "my_token", "Key", "sk-a", "ask-a", "0123456789ab", "Abc+/" * 4, "", "é" * 14, "ñandúÉíóúäöüßçêà"]
    texts = [f"{sep.join([a, b])}{end}" for a in words for b in words for sep, end in ((" ", ""), ("\n\n", " "), (" of the and in ", " "))] + ["", " ", "\n\n", *[f"{words[1]} " + "so " * n for n in range(6)], *[f"{words[0]} " + "so " * n for n in range(6)]]
    rows = spark.createDataFrame([(t,) for t in texts], "normalized string")
    got = anomaly.add_features(rows).select("normalized", anomaly.gate(F.col("features")).alias("a"), anomaly.opened(F.col("normalized")).alias("b")).collect()
    assert [r for r in got if r.a != r.b] == [] and {r.a for r in got} == {True, False}
    agree(spark, tmp_path, "structural_gate", documents=(DOCUMENTS, [(i, t, "en", "s") for i, t in enumerate(["so long", "averylongwordofprose", "abcdefghijkl is", None, "a token"])]))


def test_every_rule_counts_what_its_pattern_finds(spark, tmp_path):
    table = [*RuleSet().rules, *RuleSet().named]
    texts = [f.replace("JWTTOKEN", fixtures._JWT) for f, _ in fixtures.FORMS] + [r.prompt for r in datagen.prompts(spark, 300).collect()] + ["", "TOKEN", "４１１１ 1111"]
    rows = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate([*texts, None])], DOCUMENTS)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for r, n in zip(table, rows.agg(*[F.sum(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r.pattern), F.lit(0)))) for r in table]).first(), strict=True):
        want[r.type] = want.get(r.type, 0) + n
    df = entry.queries()["all_rule_matches"](spark, str(tmp_path))
    assert {r.entity_type: r.n_matches for r in df.collect()} == {k: n for k, n in want.items() if n} and len(want) > 25
    assert "shape" in df._jdf.queryExecution().optimizedPlan().toString()  # patterns are tried by signature


def test_risks_and_blocks_without_types_are_those_of_protect(spark):
    texts = [f.replace("JWTTOKEN", fixtures._JWT) for f, _ in fixtures.FORMS] + ["", "so long", "1 9 9 0 1 2 3 4 5 V", "\nimport os\nclass A", None]
    rows = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCUMENTS)
    whole = protect(rows, "text")
    want = sorted((r.doc_id, r.overall_risk) for r in whole.collect())
    assert sorted(tuple(r) for r in risks(rows, "text", keep=("doc_id",)).collect()) == want and len({r for _, r in want}) == 4
    bare = protect(rows, "text", types=False)
    assert "context_type" not in bare.columns
    block = ["doc_id", "masked_text", "instructions"]
    assert sorted(map(repr, bare.select(block).collect())) == sorted(map(repr, whole.select(block).collect()))


def test_names_of_one_file_are_dealt_out(spark, tmp_path):
    spark.range(40).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    df = entry.queries()["decoded_texts"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism and df.count() == 160
