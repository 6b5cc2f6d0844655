"""What operator 2 leaves on the disk and what it exchanges and broadcasts."""

import random
import re
import time
from pathlib import Path

from maskweave.llm import jaccard, util


def texts(spark, n=60):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        w = [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(80)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[1:] + ["z"]))]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def local_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f.name for d in dirs for f in Path(d).rglob("shuffle_*")}


def test_a_write_leaves_no_shuffle_files(spark):
    before = local_files(spark)
    out = util.written(texts(spark).repartition(5, "doc_id"), "rows")
    until = time.time() + 20  # they go in the background
    while (left := {f for f in local_files(spark) - before if f.endswith(".data")}) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert out.count() == 120


def plans(spark, monkeypatch):
    """Formatted plans of all that near_duplicates stages."""
    seen, write = [], spark.range(0).write.__class__.parquet

    def parquet(self, path, *a, **k):
        seen.append(self._df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return write(self, path, *a, **k)

    monkeypatch.setattr(spark.range(0).write.__class__, "parquet", parquet)
    out = jaccard.near_duplicates(texts(spark))
    monkeypatch.undo()
    return out, seen


def inputs(plan, operator):
    return re.findall(rf"\(\d+\) {operator}\nInput \[\d+\]: \[(.*)\]", plan)


def test_many_candidates_exchange_no_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, seen = plans(spark, monkeypatch)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len({r.component_id for r in out.collect()}) == 60
    joins = [p for p in seen if "SortMergeJoin" in p]
    assert joins
    assert not [x for p in joins for x in inputs(p, "Exchange") if re.search(r"\btext#", x)]


def test_staged_sets_go(spark):
    shared = Path(util.shared_dir(spark).removeprefix("file:"))
    staged = lambda: {p.name for p in shared.iterdir() if re.match("(met|sets)-", p.name)}
    before = staged()
    assert jaccard.near_duplicates(texts(spark)).count() == 120
    assert not staged() - before
