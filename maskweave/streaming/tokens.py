"""Masking in Structured Streaming: each micro-batch is protected as a batch, the token registry is a ``TokenStore``.

A batch reads what the registry knows of its own sessions, numbers on from there and adds its new values. A batch that
is run again after a failure finds the values it had added, so it gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.protect import protect_with_tokens
from ..plans.rules import RuleSet
from ..sources.staging import scope
from .store import TokenStore


def protect_stream(stream: DataFrame, text: str, session: str, order: str, out: str, path: str, rules: RuleSet | None = None, ttl: str = "24 HOURS", buckets: int = 64) -> DataStreamWriter:
    """A writer to be started: protected rows in ``out`` and the registry in ``path``, folders that the cluster shares.

    Within a batch a session's prompts are taken in their order; one that comes in a later batch is
    numbered then. A session ends after ttl without prompts, or by ``TokenStore.destroy``: its tokens start anew.
    Rows without a session are one session. What a batch stages is deleted with it.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.withColumn(session, F.col(session).cast("string")).withColumn(order, F.col(order).cast("long"))
        store = TokenStore(df.sparkSession, path, buckets, ttl=ttl)
        with scope(df.sparkSession):
            known, heard = store.known(df.select(F.col(session).alias("session")))
            rows, tokens = protect_with_tokens(df, text, session, order, rules=rules, known=known)
            rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            store.append(tokens, heard)

    return stream.writeStream.foreachBatch(batch)
