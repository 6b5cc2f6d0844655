"""The token registry as a versioned table by bucket of session: deltas, merges, sessions that can be forgotten.

A version is a manifest: which folders are live in each bucket. A batch reads the buckets of its own sessions and
adds one folder to each; a bucket of more than ``most`` folders is written anew as one, without the sessions that are over.
So what a batch costs depends on the live rows of its buckets, not on how many batches came before. A manifest
counts once it is whole, so a writer that was lost midway has changed nothing; there is one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import MAP
from ..sources.staging import staged

_NUMBERS = ("number", "first_seen", "last_seen")
#: Rows of values; a row without a value says when a session was heard from. A session that was over and began anew has another epoch.
ROW = ", ".join(f"{c} {'bigint' if c in _NUMBERS else 'string'}" for c in MAP) + ", epoch bigint, at timestamp"
_COLUMNS = (*MAP, "epoch", "at")


class TokenStore:
    """The registry in ``path``, a folder that the cluster shares; a session without prompts for ``ttl`` is over.

    Sessions are strings and compare null-safe: rows without a session are one session. ``buckets`` holds for the
    life of the folder.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, most: int = 8, ttl: str = "24 HOURS"):
        self.spark, self.path, self.buckets, self.most, self.ttl = spark, path.rstrip("/"), buckets, most, ttl

    # --- folders and manifests

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _listed(self, path: str) -> list[str]:
        fs, at = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def _versions(self) -> list[int]:
        """Versions whose manifest is whole, in order."""
        names = [n for n in self._listed(f"{self.path}/live") if n.startswith("version=")]
        return sorted(int(n[8:]) for n in names if "_SUCCESS" in self._listed(f"{self.path}/live/{n}"))

    def _live(self) -> tuple[int, dict[int, list[int]]]:
        """The newest version (-1 without any), and the versions of the live folders of each bucket: at most buckets x most numbers."""
        versions = self._versions()
        if not versions:
            return -1, {}
        rows = self.spark.read.schema("bucket int, folders array<bigint>, buckets int").json(f"{self.path}/live/version={versions[-1]}").collect()
        if any(r.buckets != self.buckets for r in rows):
            raise ValueError(f"{self.path} is dealt into {rows[0].buckets} buckets, not {self.buckets}")
        return versions[-1], {r.bucket: list(r.folders) for r in rows if r.bucket is not None}

    def _commit(self, version: int, live: dict[int, list[int]]) -> None:
        rows = [(b, vs, self.buckets) for b, vs in live.items()] or [(None, [], self.buckets)]
        self.spark.createDataFrame(rows, "bucket int, folders array<bigint>, buckets int").coalesce(1).write.mode("overwrite").json(f"{self.path}/live/version={version}")

    def _bucket(self):
        return F.pmod(F.xxhash64("session"), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, sessions: DataFrame) -> set[int]:
        return {r.b for r in sessions.select(self._bucket().alias("b")).distinct().collect()}

    def _rows(self, live: dict[int, list[int]], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/rows/version={v}/bucket={b}" for b, vs in live.items() if only is None or b in only for v in vs]
        return self.spark.read.schema(ROW).parquet(*paths) if paths else self.spark.createDataFrame([], ROW)

    def _write(self, rows: DataFrame, version: int) -> None:
        """A bucket's rows are few files, but a hot one's are split."""
        rows.select(*_COLUMNS, self._bucket().alias("bucket")).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={version}")

    # --- what is in force

    def _alive(self, rows: DataFrame) -> DataFrame:
        """session, epoch, at of the sessions that aren't over, a row each."""
        last = rows.where("value IS NULL").groupBy("session").agg(F.max(F.struct("epoch", "at")).alias("l"))
        return last.select("session", "l.epoch", "l.at").where(F.col("at") >= F.current_timestamp() - F.expr(f"INTERVAL {self.ttl}"))

    @staticmethod
    def _of(rows: DataFrame, sessions: DataFrame) -> DataFrame:
        """The values of sessions in their epoch."""
        s = sessions.select(F.col("session").alias("_s"), F.col("epoch").alias("_e"))
        values = rows.where("value IS NOT NULL")
        return values.join(s, values["session"].eqNullSafe(s["_s"]) & (values["epoch"] == s["_e"]), "left_semi")

    def tokens(self) -> DataFrame:
        """The token map of all sessions that aren't over."""
        rows = self._rows(self._live()[1])
        return self._of(rows, self._alive(rows)).select(*MAP)

    def known(self, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The token map of these sessions, and the sessions with their epoch, for ``append``: a new one is that of the next version."""
        version, live = self._live()
        one = sessions.select(F.col("session").cast("string").alias("session")).distinct()
        rows = self._rows(live, self._buckets_of(one))
        old = self._alive(rows).select(F.col("session").alias("_s"), F.col("epoch").alias("_e"))
        joined = one.join(old, one["session"].eqNullSafe(old["_s"]), "left")
        heard = staged(joined.select("session", F.coalesce("_e", F.lit(version + 1)).cast("bigint").alias("epoch")), "heard")
        return self._of(rows, heard).select(*MAP), heard

    # --- changes

    def append(self, tokens: DataFrame, heard: DataFrame) -> int:
        """Adds new values of the sessions in heard, as ``known`` gave them, and that they were heard from now; gives the version."""
        version, live = self._live()
        version += 1
        h = heard.select(F.col("session").alias("_s"), "epoch")
        values = tokens.join(h, tokens["session"].eqNullSafe(h["_s"])).select(*MAP, "epoch", F.lit(None).cast("timestamp").alias("at"))
        beats = heard.select("session", "epoch", F.current_timestamp().alias("at"))
        self._write(values.unionByName(beats, allowMissingColumns=True), version)
        for b in self._buckets_of(heard):
            live[b] = [*live.get(b, []), version]
        self._commit(version, live)
        full = {b for b, vs in live.items() if len(vs) > self.most}
        return self._rewrite(full) if full else self._swept(version, live)

    def destroy(self, sessions: DataFrame) -> int:
        """Ends sessions: their values leave the disk, in all versions, before this returns; gives the version."""
        gone = sessions.select(F.col("session").cast("string").alias("session")).distinct()
        return self._rewrite(self._buckets_of(gone), gone)

    def _rewrite(self, buckets: set[int], gone: DataFrame | None = None) -> int:
        """Writes buckets anew as one folder each, without sessions that are over or gone."""
        version, live = self._live()
        version += 1
        rows = self._rows(live, buckets)
        beats = self._alive(rows)
        if gone is not None:
            g = gone.select(F.col("session").alias("_g"))
            beats = beats.join(g, beats["session"].eqNullSafe(g["_g"]), "left_anti")
        beats = staged(beats, "heard")
        self._write(self._of(rows, beats).unionByName(beats, allowMissingColumns=True), version)
        left = self._buckets_of(beats)
        live = {b: vs for b, vs in live.items() if b not in buckets} | {b: [version] for b in left}
        self._commit(version, live)
        return self._swept(version, live)

    def _swept(self, version: int, live: dict[int, list[int]]) -> int:
        """Deletes folders that no bucket needs, and older manifests."""
        needed = {(v, b) for b, vs in live.items() for v in vs}
        of = {v for v, _ in needed}
        for name in self._listed(f"{self.path}/rows"):
            v = int(name[8:])
            if v not in of:
                self._delete(f"{self.path}/rows/{name}")
                continue
            for folder in self._listed(f"{self.path}/rows/{name}"):
                if folder.startswith("bucket=") and (v, int(folder[7:])) not in needed:
                    self._delete(f"{self.path}/rows/{name}/{folder}")
        for old in self._listed(f"{self.path}/live"):
            if int(old[8:]) != version:
                self._delete(f"{self.path}/live/{old}")
        return version
