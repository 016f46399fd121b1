"""The usage log as a data source of its own: JSON lines kept by day and kind of record.

``spark.read.format("daily_log").load(path)`` gives (day, kind, value) and opens only the days and kinds that the query's
filters leave; ``write.format("daily_log")`` puts each task's files aside and moves them in when the whole job is done, so
that a job that fails leaves nothing to read. ``read_daily_log`` and ``append_daily_log`` go between lines and log rows.

Files lie at ``day=.../kind=.../``, in any file system that Arrow opens; rows without a time or a kind are under ``none``.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)

from .logs import USAGE_FIELDS, parse_lines

SHAPE = "day date, kind string, value string"
NONE = "none"
SPLIT_BYTES = 128 << 20            # files of one day and kind read by one task, one at least
BATCH_LINES = 20_000
COMPARED = {EqualTo: lambda a, b: a == b, EqualNullSafe: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
            LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    day: datetime.date | None
    kind: str | None
    paths: tuple[str, ...] = ()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)       # (where it is, where it belongs)


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Keep comparisons of day and kind; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, (*COMPARED, In)) and f.attribute in (("day",), ("kind",)) and (isinstance(f, EqualNullSafe) or getattr(f, "value", 0) is not None):
                self.wanted.append(f)
            else:
                yield f

    def _fits(self, day: datetime.date | None, kind: str | None, names: tuple[str, ...] = ("day", "kind")) -> bool:
        for f in self.wanted:
            if f.attribute[0] not in names:
                continue
            value = day if f.attribute == ("day",) else kind
            if isinstance(f, In):
                fits = value is not None and value in f.value
            elif value is None:
                fits = isinstance(f, EqualNullSafe) and f.value is None
            else:
                fits = f.value is not None and COMPARED[type(f)](value, f.value)
            if not fits:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        """Files of the days and kinds that are left, several small ones to a task; other folders are not listed."""
        fs, root = file_system(self.path)
        out: list[InputPartition] = []
        for day_dir in _folders(fs, root, "day"):
            day = None if day_dir[1] == NONE else datetime.date.fromisoformat(day_dir[1])
            if not self._fits(day, None, ("day",)):
                continue
            for kind_path, kind in _folders(fs, day_dir[0], "kind"):
                own = None if kind == NONE else unquote(kind)
                if not self._fits(day, own):
                    continue
                held, size = [], 0
                for info in sorted(fs.get_file_info(pafs.FileSelector(kind_path)), key=lambda i: i.path):
                    if info.type != pafs.FileType.File or info.base_name.startswith(("_", ".")):
                        continue
                    if held and size + info.size > SPLIT_BYTES:
                        out.append(Files(day, own, tuple(held)))
                        held, size = [], 0
                    held.append(info.path)
                    size += info.size
                if held:
                    out.append(Files(day, own, tuple(held)))
        return out or [Files(None, None)]        # with no partition at all, one would be read that names no files

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        shape = pa.schema([("day", pa.date32()), ("kind", pa.string()), ("value", pa.string())])
        for path in partition.paths:
            with fs.open_input_stream(path) as raw:
                lines: list[str] = []
                for line in _lines(raw):
                    lines.append(line)
                    if len(lines) == BATCH_LINES:
                        yield _batch(partition, lines, shape)
                        lines = []
                if lines:
                    yield _batch(partition, lines, shape)


def _folders(fs: pafs.FileSystem, path: str, name: str) -> list[tuple[str, str]]:
    infos = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted((i.path, i.base_name.partition("=")[2]) for i in infos if i.type == pafs.FileType.Directory and i.base_name.startswith(name + "="))


def _lines(raw: pa.NativeFile) -> Iterator[str]:
    rest = b""
    while chunk := raw.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            yield line.decode("utf-8", "replace")
    if rest:
        yield rest.decode("utf-8", "replace")


def _batch(partition: Files, lines: list[str], shape: pa.Schema) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([partition.day] * n, pa.date32()), pa.array([partition.kind] * n, pa.string()), pa.array(lines, pa.string())], schema=shape)


class Writer(DataSourceWriter):
    """Tasks write under ``_pending/<job>/``; only the driver moves files to their days, when all tasks are done."""
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        fs, root = file_system(self.path)
        attempt, open_, out = uuid.uuid4().hex, {}, Written()
        try:
            for row in rows:
                key = (str(row["day"]) if row["day"] is not None else NONE, quote(row["kind"], safe="") if row["kind"] is not None else NONE)
                if key not in open_:
                    folder = f"day={key[0]}/kind={key[1]}"
                    fs.create_dir(f"{root}/_pending/{self.job}/{attempt}/{folder}", recursive=True)
                    name = f"{folder}/part-{attempt}.jsonl"
                    out.files.append((f"{root}/_pending/{self.job}/{attempt}/{name}", f"{root}/{name}"))
                    open_[key] = fs.open_output_stream(out.files[-1][0], compression=None)
                open_[key].write(row["value"].replace("\n", " ").encode() + b"\n")
        finally:
            for stream in open_.values():
                stream.close()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        old = [p for p, _ in _folders(fs, root, "day")] if self.overwrite else []
        for path in old:
            fs.delete_dir(path)
        for message in messages:
            for here, there in message.files if message else []:
                fs.create_dir(there.rpartition("/")[0], recursive=True)
                fs.move(here, there)
        self._forget(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._forget(*file_system(self.path))

    def _forget(self, fs: pafs.FileSystem, root: str) -> None:
        pending = f"{root}/_pending/{self.job}"
        if fs.get_file_info(pending).type == pafs.FileType.Directory:
            fs.delete_dir(pending)


class DailyLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "daily_log"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it."""
    spark.dataSource.register(DailyLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_daily_log(spark: SparkSession, path: str) -> DataFrame:
    """Log rows with ``day`` and ``kind``; filter on these to skip files. Lines are judged as ``read_usage_log`` does."""
    register(spark)
    return parse_lines(spark.read.format("daily_log").load(path), USAGE_FIELDS)


def append_daily_log(log: DataFrame, path: str, overwrite: bool = False) -> None:
    """Append log rows under the UTC day of ``ts`` and their ``type``; all of them or none."""
    register(log.sparkSession)
    utc = F.to_utc_timestamp("ts", F.current_timezone())
    own = [F.coalesce("timestamp", F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("timestamp") if name == "timestamp" and "timestamp" in log.columns
           else F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp") if name == "timestamp" else F.col(name)
           for name, _ in USAGE_FIELDS if name in log.columns or name == "timestamp"]
    lines = log.select(F.to_date(utc).alias("day"), F.col("type").alias("kind"), F.to_json(F.struct(*own)).alias("value"))
    lines.write.format("daily_log").mode("overwrite" if overwrite else "append").save(path)
