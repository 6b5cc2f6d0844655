"""Session tokens as keyed state: the registry of a stream, without a read of earlier batches.

Each session keeps its values' tokens and its types' counters in the state store. It ends by an event
of its own or when it was quiet for too long; its state is deleted then, and its tokens start anew.
Timers need batches to go off, also without data: start the stream with a processing-time trigger (with ``availableNow`` it
would not end by itself). The Spark session must run with the RocksDB state store (``STORE``); what is kept lies in the stream's checkpoint, in the
folder that the cluster shares.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EXIT = "exit"
_OUT = "session string, prompt bigint, seq int, value string, entity_type string, token string, number bigint, first_seen bigint"


def _label(kind: str) -> str:
    return "ML_SECRET" if kind == "ML_FLAGGED_ANOMALY" else kind.replace("_", "")[:10].upper()


class Registry(StatefulProcessor):
    """Numbers a session's values by type in their order; a known value keeps its token whatever its type."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "value string", "entity_type string, number bigint, first_seen bigint")
        self.counts = handle.getMapState("counts", "entity_type string", "n bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # a micro-batch's rows of one session come in any order; one that comes in a later batch is numbered then
        for r in sorted(rows, key=lambda r: (r.prompt, r.event == EXIT, r.seq if r.seq is not None else -1)):
            if r.event == EXIT:
                self._forget()
                continue
            if self.known.containsKey((r.value,)):
                kind, number, first = self.known.getValue((r.value,))
            else:
                kind, first = r.entity_type, r.prompt
                number = (self.counts.getValue((kind,))[0] if self.counts.containsKey((kind,)) else 0) + 1
                self.counts.updateValue((kind,), (number,))
                self.known.updateValue((r.value,), (kind, number, first))
            yield Row(session=r.session, prompt=r.prompt, seq=r.seq, value=r.value, entity_type=kind, token=f"<{_label(kind)}_{number}>", number=number, first_seen=first)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if self.known.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self._forget()
        return iter(())

    def _forget(self) -> None:
        self.known.clear()
        self.counts.clear()

    def close(self) -> None:
        pass


def token_stream(events: DataFrame, quiet_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """The token of each value on a stream of session, prompt, seq, value, entity_type and event (``exit`` ends a session, after its prompt's values).

    Null sessions are one session. A session lives in one task, as its order asks for.
    """
    rows = events.select(F.col("session").cast("string").alias("session"), F.col("prompt").cast("long").alias("prompt"), F.col("seq").cast("int").alias("seq"), "value", "entity_type", "event")
    return rows.groupBy("session").transformWithState(Registry(quiet_ms), _OUT, "Append", "ProcessingTime")
