"""Lines and streams as Parquet: a directory for each day, sorted within files by tenant, stream and time.

What replaces files, and what must not come twice, is written beside the tables first. A journal then names the new files
and those that they replace: once it is there the change happens, as whoever opens the store next carries it on, and before
that nothing has happened. Old files go last, and files that were not named are never touched.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.lang.times import day_key
from logweir.operators.streams import new_streams
from logweir.plans.compiler import PROMOTED

ORDER = ["tenant_id", "stream_id", "ts_ns"]
LINES = "tenant_id long, stream_id string, ts_ns long, ts timestamp, msg string, fields map<string,string>"
STREAMS = "tenant_id long, stream_id string, tags map<string,string>"
#: Rows of a day's file at most; a file is a unit of scanning and of compaction.
FILE_ROWS = 5_000_000
#: Files under SMALL_BYTES are compacted when a day has LEAST_FILES of them, up to MOST_BYTES at once.
SMALL_BYTES, LEAST_FILES, MOST_BYTES = 128 << 20, 8, 50 << 30


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's.

    Where neither is set a local master gets a temporary folder, as in tests; on a cluster ValueError is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logweir-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


@dataclass(frozen=True)
class LogStore:
    """A store under one path. promoted: field keys with a column of their own, which filters on them push to the scan."""

    spark: SparkSession
    path: str
    promoted: tuple[str, ...] = field(default=())

    @property
    def lines_path(self) -> str:
        return f"{self.path}/lines"

    @property
    def streams_path(self) -> str:
        return f"{self.path}/streams"

    def lines(self) -> DataFrame:
        more = "".join(f", `{PROMOTED}{k}` string" for k in self.promoted)
        return self._read(self.lines_path, LINES + more + ", day date")

    def streams(self) -> DataFrame:
        return self._read(self.streams_path, STREAMS + ", day date")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _files(self, path: str) -> list[tuple[str, int]]:
        """Data files under a folder, as paths below it, and their bytes."""
        fs, found = self._fs(), []
        if fs.exists(self._path(path)):
            top = fs.resolvePath(self._path(path)).toUri().getPath()
            files = fs.listFiles(self._path(path), True)
            while files.hasNext():
                status = files.next()
                name = status.getPath().toUri().getPath()[len(top) + 1 :]
                if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
                    found.append((name, status.getLen()))
        return sorted(found)

    def _read(self, path: str, schema: str) -> DataFrame:
        """The table, empty if nothing has been written."""
        self.recover()
        if not self._fs().exists(self._path(path)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def append(self, lines: DataFrame, name: str | None = None) -> bool:
        """Streams that are new on their day, then the lines (with a tags column), sorted within each day's files.

        name: of a batch; one that was taken before is left out (False), however far its writing came.
        """
        self.recover()
        fs = self._fs()
        if name is not None and fs.exists(self._path(f"{self.path}/batches/{name}")):
            return False
        new_streams(lines, self.streams()).write.mode("append").partitionBy("day").parquet(self.streams_path)
        if name is None:
            self._write(lines.drop("tags"), self.lines_path, "append")
        else:
            self._write(lines.drop("tags"), f"{self.path}/staged/{name}", "overwrite")
            self._commit(name, [], mark=True)
        return True

    def _write(self, lines: DataFrame, path: str, mode: str) -> None:
        for k in self.promoted:
            if PROMOTED + k not in lines.columns:
                lines = lines.withColumn(PROMOTED + k, F.col("fields")[k])
        # rebalance splits a hot day and joins small ones by size, at run time
        spread = lines.hint("rebalance", "day").sortWithinPartitions("day", *ORDER)
        spread.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).partitionBy("day").parquet(path)

    def _commit(self, name: str, old: list[str], mark: bool = False) -> None:
        """Makes the staged files part of the table in place of old ones: from the journal's rename on, it will happen."""
        fs = self._fs()
        journal = {"new": [f for f, _ in self._files(f"{self.path}/staged/{name}")], "old": old, "mark": mark}
        fs.mkdirs(self._path(f"{self.path}/journal"))
        draft = self._path(f"{self.path}/journal/.{name}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(journal).encode()))
        out.close()
        self._renamed(fs, draft, self._path(f"{self.path}/journal/{name}"))
        self._carry_on(name)

    def _renamed(self, fs, source, target) -> None:
        """Moves a file, unless another driver that carries on the same journal has done so."""
        if not fs.rename(source, target) and (fs.exists(source) or not fs.exists(target)):
            raise OSError(f"{source} could not be moved to {target}")

    def _carry_on(self, name: str) -> None:
        """The steps of a journal that are still to be taken; each may have been taken before."""
        fs = self._fs()
        journal_path = self._path(f"{self.path}/journal/{name}")
        if not fs.exists(journal_path):
            return
        data = fs.open(journal_path)
        journal = json.loads(bytes(data.readAllBytes()))
        data.close()
        for f in journal["new"]:
            staged, target = self._path(f"{self.path}/staged/{name}/{f}"), self._path(f"{self.lines_path}/{f}")
            if fs.exists(staged):
                fs.mkdirs(target.getParent())
                self._renamed(fs, staged, target)
            elif not fs.exists(target):
                raise OSError(f"{target} is missing and was not staged")
        if journal["mark"]:
            fs.mkdirs(self._path(f"{self.path}/batches/{name}"))
        for f in journal["old"]:
            fs.delete(self._path(f"{self.lines_path}/{f}"), False)
        fs.delete(self._path(f"{self.path}/staged/{name}"), True)
        fs.delete(journal_path, False)
        self.spark.catalog.refreshByPath(self.lines_path)

    def recover(self) -> None:
        """Carries on what a lost driver had decided on."""
        for name, _ in self._files(f"{self.path}/journal"):
            self._carry_on(name)

    def compact(self, day: str, files: list[str] | None = None) -> None:
        """Rewrites a day's files, or some of them (paths below the lines' folder), as few sorted ones.

        Lines that are appended meanwhile stay as they are. Queries that were planned before may have to be run again.
        """
        self.recover()
        old = files if files is not None else [f"day={day}/{f}" for f, _ in self._files(f"{self.lines_path}/day={day}")]
        if not old:
            return
        name = f"compact-{day}-{uuid.uuid4().hex}"
        schema = self.lines().schema
        read = self.spark.read.schema(schema).option("basePath", self.lines_path).parquet(*[f"{self.lines_path}/{f}" for f in old])
        self._write(read, f"{self.path}/staged/{name}", "overwrite")
        self._commit(name, old)

    def due(self) -> list[tuple[str, list[str]]]:
        """Days with enough small files to be compacted, and those files, within MOST_BYTES each."""
        days: dict[str, list[tuple[str, int]]] = {}
        for f, n in self._files(self.lines_path):
            if n < SMALL_BYTES and f.startswith("day="):
                days.setdefault(f.split("/")[0][4:], []).append((f, n))
        found = []
        for day, small in sorted(days.items()):
            if len(small) >= LEAST_FILES:
                group, size = [], 0
                for f, n in small:
                    if group and size + n > MOST_BYTES:
                        found.append((day, group))
                        group, size = [], 0
                    group.append(f)
                    size += n
                found.append((day, group))
        return [(day, files) for day, files in found if len(files) > 1]

    def compact_due(self) -> list[str]:
        """Compacts what is due, one group of files after the other; the days that had any."""
        done = []
        for day, files in self.due():
            self.compact(day, files)
            done.append(day)
        return sorted(set(done))

    def drop_before(self, day: str) -> list[str]:
        """Deletes days before one, of lines and streams; their keys (DDMMYYYY)."""
        from datetime import date

        self.recover()
        gone, fs = set(), self._fs()
        for top in (self.lines_path, self.streams_path):
            for status in fs.listStatus(self._path(top)) if fs.exists(self._path(top)) else ():
                name = status.getPath().getName()
                if name.startswith("day=") and name[4:] < day:
                    fs.delete(status.getPath(), True)
                    gone.add(day_key(date.fromisoformat(name[4:])))
        self.spark.catalog.refreshByPath(self.path)
        return sorted(gone)

    def disk_bytes(self) -> int:
        """Bytes of the store's files."""
        fs = self._fs()
        return fs.getContentSummary(self._path(self.path)).getLength() if fs.exists(self._path(self.path)) else 0

    def ready(self) -> bool:
        """The store's file system answers, and nothing is left half done."""
        self.recover()
        return bool(self._fs().exists(self._path("/")))
