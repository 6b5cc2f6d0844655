"""The registry as a versioned table: batches against one batch, epochs, merges, sessions that leave the disk."""

import os
import random
import time

import pytest

from maskweave.operators import registry
from maskweave.sources import staging
from maskweave.streaming.store import TokenStore
from maskweave.streaming.tokens import protect_stream

SCHEMA = "session string, prompt bigint, seq int, value string, entity_type string"


def put(spark, store, rows):
    found = spark.createDataFrame(rows, SCHEMA)
    known, heard = store.known(found)
    store.append(registry.token_map(found, known), heard)


def read(store):
    return {(r.session, r.value): r.token for r in store.tokens().collect()}


def on_disk(path):
    """All bytes of the files below a folder."""
    return b"".join(open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(path) for n in names)


def test_batches_equal_one_batch(spark, tmp_path):
    dice = random.Random(5)
    rows = [(dice.choice(["s", "t", "u", None]), p, 0, f"v{dice.randrange(9)}", dice.choice(["IBAN", "PAN"])) for p in range(40)]
    store = TokenStore(spark, str(tmp_path / "r"), buckets=3, most=2)
    for k in range(0, 40, 8):
        put(spark, store, rows[k : k + 8])
    want = {(r.session, r.value): r.token for r in registry.token_map(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert read(store) == want
    # merged: no bucket has more than two folders, and nothing is kept that no bucket needs
    folders = [f"{v}/{b}" for v in os.listdir(tmp_path / "r/rows") for b in os.listdir(tmp_path / "r/rows" / v) if b.startswith("bucket=")]
    assert len(folders) <= 3 * 2 and len(os.listdir(tmp_path / "r/live")) == 1
    # a batch that is run again changes nothing
    put(spark, store, rows[32:])
    assert read(store) == want
    with pytest.raises(ValueError, match="3 buckets"):
        TokenStore(spark, str(tmp_path / "r"), buckets=4).tokens()


def test_destroyed_sessions_leave_the_disk(spark, tmp_path):
    path = str(tmp_path / "r")
    store = TokenStore(spark, path, buckets=2)
    put(spark, store, [("s", 1, 0, "secret-of-s", "IBAN"), ("t", 1, 0, "secret-of-t", "IBAN"), (None, 1, 0, "secret-of-none", "IBAN")])
    put(spark, store, [("s", 2, 0, "second-of-s", "IBAN")])
    assert b"secret-of-s" in on_disk(path)
    store.destroy(spark.createDataFrame([("s",), ("unknown",)], "session string"))
    assert read(store) == {("t", "secret-of-t"): "<IBAN_1>", (None, "secret-of-none"): "<IBAN_1>"}
    left = on_disk(path)
    assert b"of-s" not in left and b"secret-of-t" in left
    put(spark, store, [("s", 3, 0, "third-of-s", "IBAN")])
    assert read(store)[("s", "third-of-s")] == "<IBAN_1>"
    store.destroy(spark.createDataFrame([("s",), ("t",), (None,)], "session string"))
    assert read(store) == {} and b"secret" not in on_disk(path)


def test_quiet_sessions_begin_anew_and_stay_so(spark, tmp_path):
    store = TokenStore(spark, str(tmp_path / "r"), buckets=1, ttl="4 SECONDS")
    put(spark, store, [("s", 1, 0, "a", "IBAN"), ("s", 2, 0, "b", "IBAN")])
    time.sleep(5)
    assert read(store) == {}
    put(spark, store, [("s", 3, 0, "b", "IBAN")])
    store.ttl = "1 HOUR"
    put(spark, store, [("s", 4, 0, "c", "IBAN")])
    # the values of the epoch before are not known again, though the session lives
    assert read(store) == {("s", "b"): "<IBAN_1>", ("s", "c"): "<IBAN_2>"}


def test_a_writer_lost_midway_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    store = TokenStore(spark, path, buckets=2)
    put(spark, store, [("s", 1, 0, "a", "IBAN")])
    found = spark.createDataFrame([("s", 2, 0, "b", "IBAN")], SCHEMA)
    known, heard = store.known(found)
    commit, store._commit = store._commit, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        store.append(registry.token_map(found, known), heard)
    store._commit = commit
    assert read(store) == {("s", "a"): "<IBAN_1>"}
    put(spark, store, [("s", 2, 0, "b", "IBAN")])
    assert read(store) == {("s", "a"): "<IBAN_1>", ("s", "b"): "<IBAN_2>"}


def test_a_stream_leaves_nothing_staged(spark, tmp_path):
    schema, before = "session string, prompt bigint, text string", list(staging._WRITTEN)
    staged = set(os.listdir(staging.shared_dir(spark).removeprefix("file:")))
    spark.createDataFrame([("s", 1, "api key sk-abcdefghijklmnop1234567890abcde1"), (None, 1, "api key sk-abcdefghijklmnop1234567890abcde2")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    reg = str(tmp_path / "registry")
    protect_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), "text", "session", "prompt", f"{tmp_path}/out", reg).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    store = TokenStore(spark, reg)
    assert sorted(k[1][-6:] for k in read(store)) == ["abcde1", "abcde2"]
    store.destroy(spark.createDataFrame([("s",)], "session string"))
    assert [k[0] for k in read(store)] == [None]
    assert b"abcde1" not in on_disk(reg)
    assert staging._WRITTEN[len(before) :] == [] or all("heard" in p for p in staging._WRITTEN[len(before) :])
    assert not {d for d in os.listdir(staging.shared_dir(spark).removeprefix("file:")) if not d.startswith("heard")} - staged
