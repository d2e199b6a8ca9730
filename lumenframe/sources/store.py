"""The stored history: versioned Parquet folders partitioned by day, never overwritten while they are read.

A version is written whole, then the pointer file names it; readers of the version before are undisturbed. Each append
is a segment of the current version; that of a stream's micro-batch has the batch's name, and the pointer keeps the last
batch of each stream, so a batch that is tried again is stored once. The pointer also keeps the last id and the time from
which frames count, so neither new ids nor pruning read the history. Writers take turns by a lock file. Days are derived
from the time, so a time filter prunes partitions. A plain history has a search index of the same version beside it.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.crypto import encrypt_fields
from lumenframe.operators import frames as R
from lumenframe.operators import maintain
from lumenframe.operators.dedup import duplicate_ids
from lumenframe.operators.search import SearchIndex

SCHEMA = "id long, ts timestamp, timestamp double, app_name string, window_title string, text string, extra_context string, phash string, project string, user_id long"
DEFAULTS = {"app_name": "", "window_title": "", "extra_context": "", "phash": "", "project": ""}
INSERT = ["timestamp", "app_name", "window_title", "text", "extra_context", "phash", "project", "user_id"]


class MemoryStore:
    """A history at ``path`` (any Hadoop file system). Cheap to create; state lives in the folder alone."""

    def __init__(self, spark: SparkSession, path: str, key: str | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _fs(self, name: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _pointer(self) -> dict:
        fs, pointer = self._fs("CURRENT")
        if not fs.exists(pointer):
            return {}
        found = self.spark.read.text(f"{self.path}/CURRENT", wholetext=True).head()[0]
        return json.loads(found)

    def _version(self) -> str | None:
        return self._pointer().get("version")

    def _put(self, name: str, value: str, overwrite: bool) -> None:
        fs, path = self._fs(name)
        out = fs.create(path, overwrite)
        out.write(bytearray(value.encode()))
        out.close()

    def _point(self, **changes) -> None:
        """Writes the pointer beside the old one and moves it there."""
        self._put("NEXT", json.dumps({**self._pointer(), **changes}), True)
        fs, new = self._fs("NEXT")
        _, old = self._fs("CURRENT")
        fs.delete(old, False)
        if not fs.rename(new, old):
            raise OSError(f"the pointer of {self.path} couldn't be moved")

    @contextmanager
    def _turn(self, wait: float = 120.0):
        """Holds the lock file, which only one writer can create; waits for another one's."""
        until = time.monotonic() + wait
        while True:
            try:
                self._put("LOCK", uuid.uuid4().hex, False)
                break
            except Exception as error:  # the file system's own error that the file exists
                if time.monotonic() > until:
                    raise TimeoutError(f"{self.path} is locked by another writer") from error
                time.sleep(0.2)
        try:
            yield
        finally:
            fs, lock = self._fs("LOCK")
            fs.delete(lock, False)

    def frames(self, start: float | None = None, end: float | None = None) -> DataFrame:
        """All frames, or those of a range of time whose days alone are read. Missing columns are filled."""
        pointer = self._pointer()
        if "version" not in pointer:
            return self.spark.createDataFrame([], SCHEMA)
        found = self.spark.read.schema(SCHEMA + ", segment string, dt date").parquet(f"{self.path}/{pointer['version']}")
        day = lambda t: F.to_date(F.timestamp_seconds(F.lit(t)))
        if pointer.get("since") is not None:
            kept = (F.col("dt") >= day(pointer["since"])) & (F.col("timestamp") >= pointer["since"])
            found = found.where(F.col("dt").isNull() | F.col("timestamp").isNull() | kept)
        if start is not None:
            found = found.where((F.col("dt") >= day(start)) & (F.col("timestamp") >= start))
        if end is not None:
            found = found.where((F.col("dt") <= day(end)) & (F.col("timestamp") <= end))
        return found.drop("segment", "dt").fillna(DEFAULTS)

    def _write(self, frames: DataFrame, version: str, segment: str) -> None:
        day = F.to_date(F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("long")))
        frames.withColumn("dt", day).write.mode("overwrite").partitionBy("dt").parquet(f"{self.path}/{version}/segment={segment}")

    def search_index(self) -> SearchIndex | None:
        """The index of the current version, built where there is none yet; None for a sealed history."""
        if self.key:
            return None
        pointer = self._pointer()
        if "version" not in pointer:
            return None
        if not pointer.get("index"):
            with self._turn():
                name = f"index-{self._new()}"
                SearchIndex(self.spark, f"{self.path}/{name}").add(self.frames().where("id is not null"))
                self._point(index=name)
            pointer = self._pointer()
        return SearchIndex(self.spark, f"{self.path}/{pointer['index']}")

    def append(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Adds rows with new ids in the order of their partitions; returns how many. Fields are sealed if there is a key.

        A batch of a stream that is stored already adds nothing.
        """
        from pyspark.sql import Window

        for c in INSERT:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(DEFAULTS.get(c)))
        with self._turn():
            pointer = self._pointer()
            batches = pointer.get("batches", {})
            if stream is not None and batches.get(stream, -1) >= batch:
                return 0
            last = pointer.get("last_id", 0)
            # Ids: position within a partition plus the partitions before; one small count per partition, no global sort.
            placed = rows.select(*INSERT, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
            placed = placed.persist()
            counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
            offset = F.sum("n").over(Window.orderBy("_p")) - F.col("n")
            within = F.row_number().over(Window.partitionBy("_p").orderBy("_m"))
            numbered = placed.withColumn("_r", within).join(F.broadcast(counts.select("_p", offset.alias("_o"))), "_p")
            numbered = numbered.withColumn("id", (F.col("_r") + F.col("_o") + F.lit(last)).cast("long"))
            numbered = numbered.withColumn("ts", F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("long")))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            out = numbered.select(*names).withColumn("user_id", F.col("user_id").cast("long")).fillna(DEFAULTS)
            total = placed.count()
            version = pointer.get("version") or self._new()
            if total or "version" not in pointer:
                segment = f"{stream}-{batch}" if stream is not None else uuid.uuid4().hex
                self._write(encrypt_fields(out, self.key) if self.key else out, version, segment)
                if pointer.get("index") and not self.key:
                    SearchIndex(self.spark, f"{self.path}/{pointer['index']}").add(out, segment)
            placed.unpersist()
            if stream is not None:
                batches = {**batches, stream: batch}
            self._point(version=version, last_id=last + total, batches=batches)
            return total

    def insert(self, **row) -> int:
        """Adds one row; returns its id."""
        values = {**DEFAULTS, "user_id": 1, **row}
        schema = "timestamp double, app_name string, window_title string, text string, extra_context string, phash string, project string, user_id long"
        self.append(self.spark.createDataFrame([tuple(values[c] for c in INSERT)], schema))
        return self._pointer()["last_id"]

    def insert_batch(self, rows: list[tuple]) -> int:
        """Rows of (timestamp, app_name, window_title, text, extra_context, phash[, project[, user_id]])."""
        full = [tuple(r) + ("", 1)[len(r) - 6 :] if len(r) < 8 else tuple(r) for r in rows]
        schema = "timestamp double, app_name string, window_title string, text string, extra_context string, phash string, project string, user_id long"
        return self.append(self.spark.createDataFrame(full, schema))

    @staticmethod
    def _new() -> str:
        return f"v{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"

    def rewrite(self, change) -> None:
        """Writes ``change`` of the frames as a new version and points to it; the one before stays until ``vacuum``."""
        with self._turn():
            version = self._new()
            self._write(change(self.frames()), version, "whole")
            self._point(version=version, since=None, index=None)

    def vacuum(self) -> int:
        """Deletes all versions and indexes but the current ones, and days that are pruned; returns how many folders."""
        with self._turn():
            fs, root = self._fs(".")
            pointer, gone = self._pointer(), 0
            for status in fs.listStatus(root):
                name = status.getPath().getName()
                if name.startswith(("v", "index-")) and name not in (pointer.get("version"), pointer.get("index")):
                    gone += bool(fs.delete(status.getPath(), True))
            if pointer.get("since") is not None:
                first = datetime.fromtimestamp(pointer["since"], timezone.utc).date().isoformat()
                for segment in fs.listStatus(self._fs(pointer["version"])[1]):
                    for day in fs.listStatus(segment.getPath()) if segment.isDirectory() else ():
                        name = day.getPath().getName()
                        if name[3:4].isdigit() and name[3:] < first:
                            gone += bool(fs.delete(day.getPath(), True))
            return gone

    def size_mb(self) -> float:
        fs, root = self._fs(self._version() or ".")
        return round(fs.getContentSummary(root).getLength() / 1e6, 2) if fs.exists(root) else 0.0

    def stats(self) -> dict:
        row = R.store_stats(self.frames()).head()
        return {**row.asDict(), "size_mb": self.size_mb()}

    def compress_old(self, now: float, days: float = 3) -> dict:
        report = maintain.compress_report(self.frames(), now, days, self.key).head().asDict()
        if report["compressed"]:
            self.rewrite(lambda frames: maintain.compress_old(frames, now, days, self.key))
        return report

    def deduplicate(self, now: float, hours: float = 24) -> int:
        removed = duplicate_ids(self.frames(), after=now - 3600.0 * hours).count()
        if removed:
            self.rewrite(lambda frames: maintain.deduplicate(frames, after=now - 3600.0 * hours))
        return removed

    def prune(self, now: float, days: float = 7) -> int:
        """Frames older than ``days`` no longer count; nothing is written but the pointer. ``vacuum`` deletes their days."""
        since = now - days * maintain.DAY
        removed = self.frames().where(F.col("timestamp") < F.lit(since)).count()
        if removed:
            with self._turn():
                self._point(since=max(since, self._pointer().get("since") or since), index=None)
        return removed

    def auto_maintain(self, now: float, max_mb: float = 500, compress_days: float = 3, dedup_hours: float = 24) -> None:
        """Cut, drop repeats (one rewrite) and, only if the store is still larger than ``max_mb``, prune to 7 days."""
        self.rewrite(lambda frames: maintain.deduplicate(maintain.compress_old(frames, now, compress_days, self.key), after=now - 3600.0 * dedup_hours))
        if self.size_mb() > max_mb:
            self.prune(now)

    def encrypt_existing(self) -> dict:
        self.rewrite(lambda frames: maintain.encrypt_existing(frames, self.key))
        return maintain.migration_report(self.frames()).head().asDict()

    def decrypt_existing(self) -> dict:
        self.rewrite(lambda frames: maintain.decrypt_existing(frames, self.key))
        return maintain.migration_report(self.frames()).head().asDict()


SETTINGS = {"ignore_apps": [], "session_gap_minutes": 15, "capture_interval": 10, "encryption": False, "privacy_patterns": {}, "privacy_disabled_types": []}
HOME_VARIABLE = "LUMENFRAME_HOME"
_settings: dict = {}


def data_home() -> str:
    """Folder of the settings and, by default, of the store: $LUMENFRAME_HOME or ~/.lumenframe."""
    return os.environ.get(HOME_VARIABLE) or os.path.join(os.path.expanduser("~"), ".lumenframe")


def load_config(path: str | None = None) -> dict:
    """Settings of a JSON file over the defaults; a broken file gives the defaults.

    Without ``path`` the file is settings.json in :func:`data_home`; one that is missing is written with the defaults
    where that is possible. A file is read again only when its time or size changes.
    """
    path = path or os.path.join(data_home(), "settings.json")
    try:
        if not os.path.exists(path):
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            with open(path, "w", encoding="utf-8") as file:
                json.dump(SETTINGS, file, indent=2)
        state = os.stat(path)
        stamp = (state.st_mtime_ns, state.st_size)
        if _settings.get(path, (None,))[0] != stamp:
            with open(path, encoding="utf-8") as file:
                loaded = json.load(file)
            _settings[path] = stamp, {**SETTINGS, **loaded} if isinstance(loaded, dict) else SETTINGS
        return dict(_settings[path][1])
    except (OSError, ValueError):
        return dict(SETTINGS)
