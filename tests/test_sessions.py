"""The registry as keyed state: two sessions, late prompts, a restart, an exit and quiet sessions."""

import time

import pytest

from maskweave.operators import registry
from maskweave.streaming.sessions import STORE, token_stream

SCHEMA = "session string, prompt bigint, seq int, value string, entity_type string, event string"


@pytest.fixture
def run(spark, tmp_path):
    spark.conf.set(*STORE)

    def more(name, rows, quiet_ms=3_600_000):
        """Writes a file of events and runs the stream anew over what has come: a restart each time."""
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = token_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*"), quiet_ms)
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        return {(r.session, r.prompt, r.seq): r.token for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()}

    yield more
    spark.conf.unset(STORE[0])


def test_tokens_of_a_stream(spark, run):
    first = [("s", 1, 0, "k1", "IBAN", "value"), ("s", 1, 1, "k2", "IBAN", "value"), ("t", 1, 0, "k2", "JWT_TOKEN", "value"), (None, 1, 0, "k1", "IBAN", "value"), ("s", 2, 0, "k1", "JWT_TOKEN", "value"), ("s", 2, 1, "k3", "API_KEY_GENERIC", "value")]
    got = run("a", first[::-1])
    batch = registry.token_map(spark.createDataFrame(first, SCHEMA).select("session", "prompt", "seq", "value", "entity_type"))
    known = {(r.session, r.value): r.token for r in batch.collect()}
    assert got == {(s, p, q): known[(s, v)] for s, p, q, v, *_ in first}
    # after a restart: a late prompt is numbered as it comes, an exit ends one session alone
    got = run("b", [("s", 0, 0, "k9", "IBAN", "value"), ("s", 3, 0, "k2", "IBAN", "value"), ("t", 2, None, None, None, "exit"), ("t", 2, 0, "k2", "IBAN", "value"), ("t", 3, 0, "k2", "IBAN", "value")])
    assert got[("s", 0, 0)] == "<IBAN_3>" and got[("s", 3, 0)] == "<IBAN_2>"
    assert got[("t", 2, 0)] == "<JWTTOKEN_1>" and got[("t", 3, 0)] == "<IBAN_1>"


def test_quiet_sessions_end(run):
    assert run("a", [("s", 1, 0, "k1", "IBAN", "value"), ("s", 1, 1, "k2", "IBAN", "value")], 1)[("s", 1, 1)] == "<IBAN_2>"
    time.sleep(0.1)
    run("b", [("other", 1, 0, "k", "IBAN", "value")], 1)  # a batch in which the timer goes off
    assert run("c", [("s", 2, 0, "k2", "IBAN", "value")], 1)[("s", 2, 0)] == "<IBAN_1>"
