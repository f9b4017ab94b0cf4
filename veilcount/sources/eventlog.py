"""Event logs as a Spark data source, in batch and as a stream.

    eventlog.register(spark)
    spark.read.format("eventlog").option("prefix", "LOG_").load("s3://bucket/logs")

A log is a file or a folder of files of text lines `[650 ][prefix]CODE field field ...`. Rows are party (of a
folder `party=...` on the path, else null), code and fields. Lines without a code are left out; no other line is.

Files are read by ranges of bytes, so a large one is read by many tasks; compressed ones (by their
ending) are read whole. A filter on the code (=, IN, IS NOT NULL) is pushed down to the reader, which then
splits no other event's fields; one on the party leaves out whole files.

As a stream, a log grows by whole lines and by files. `bytesPerTrigger` bounds what a batch admits, which with
the trigger's interval is a replay's pace (S4); `offered`, a file in a shared folder, keeps the pace over a restart
(Spark's checkpoint keeps what was read, in any case). Filters aren't pushed into streams: `codes`, with commas,
tells the reader instead. Paths are URIs that pyarrow opens (file, s3, gs, hdfs).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
)

from veilcount.plans.catalog import events_for

SCHEMA = "party string, code string, fields array<string>"
#: Bytes of a file for one task, unless `splitBytes` says otherwise; bytes that are split into lines at once.
SPLIT_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")
ARROW = pa.schema([("party", pa.string()), ("code", pa.string()), ("fields", pa.list_(pa.string()))])


@dataclass
class Piece(InputPartition):
    """The lines of a file that begin within these bytes; no end: all of it."""

    path: str
    start: int
    end: int | None


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path)


def party_of(path: str) -> str | None:
    named = [part[len("party=") :] for part in path.split("/") if part.startswith("party=")]
    return named[-1] if named else None


def files_of(path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, or of all below a folder but hidden ones, by name."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    scheme = path.split("://")[0] if "://" in path else "file"
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(at) :].split("/"))
    lead = f"{scheme}://"
    return sorted((lead + f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path))


def whole_lines(source, start: int, end: int | None) -> Iterator[bytes]:
    """Blocks of whole lines that begin at or after start and before end; without an end, all of them."""
    skipping, at, held = start > 0, max(start - 1, 0), b""
    if start:
        source.seek(at)  # a line that begins at start follows a line end
    while data := source.read(BLOCK_BYTES):
        held += data
        if skipping:
            cut = held.find(b"\n")
            if cut < 0:
                at, held = at + len(held), b""
                continue
            at, held, skipping = at + cut + 1, held[cut + 1 :], False
        if end is not None and at >= end:
            return
        if end is not None and at + len(held) >= end:
            cut = held.find(b"\n", end - at - 1)  # where the last line that begins before end stops
            if cut >= 0:
                yield held[:cut]
                return
            continue
        cut = held.rfind(b"\n")
        if cut >= 0:
            yield held[:cut]
            at, held = at + cut + 1, held[cut + 1 :]
    if held and not skipping and (end is None or at < end):
        yield held


def parsed(block: bytes, prefix: str, codes: list[str] | None, party: str | None) -> pa.RecordBatch:
    """Lines to rows; with codes, only theirs are split into fields."""
    lines = pa.array(block.decode("utf-8", "replace").split("\n"), pa.string())
    lines = pc.replace_substring_regex(pc.utf8_rtrim(lines, "\r"), r"^650 ", "")
    if prefix:
        led = pc.starts_with(lines, prefix)
        lines = pc.if_else(led, pc.utf8_slice_codeunits(lines, len(prefix)), lines)
    code = pc.list_element(pc.split_pattern(lines, " ", max_splits=1), 0)
    wanted = pc.not_equal(code, "") if codes is None else pc.is_in(code, value_set=pa.array(codes, pa.string()))
    code, lines = code.filter(wanted), lines.filter(wanted)
    fields = pc.list_slice(pc.split_pattern(lines, " "), 1).cast(pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([party] * len(code), pa.string()), code, fields], schema=ARROW)


def rows_of(piece: Piece, prefix: str, codes: list[str] | None) -> Iterator[pa.RecordBatch]:
    system, at = opened(piece.path)
    whole = piece.path.endswith(COMPRESSED)
    with system.open_input_stream(at, compression="detect") if whole else system.open_input_file(at) as source:
        for block in whole_lines(source, piece.start, piece.end):
            batch = parsed(block, prefix, codes, party_of(piece.path))
            if batch.num_rows:
                yield batch


def pieces_of(path: str, size: int, start: int = 0, split: int = SPLIT_BYTES) -> list[Piece]:
    if path.endswith(COMPRESSED):
        return [Piece(path, 0, None)] if size and not start else []
    return [Piece(path, a, min(a + split, size)) for a in range(start, size, split)]


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.prefix = options["path"], options.get("prefix", "")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.codes = options["codes"].split(",") if options.get("codes") else None
        self.parties: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes what it can answer itself; the rest goes back to Spark."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if f.attribute == ("code",) and isinstance(f, IsNotNull):
                continue
            if f.attribute == ("code",) and values is not None:
                self.codes = [v for v in values if v is not None and (self.codes is None or v in self.codes)]
            elif f.attribute == ("party",) and values is not None:
                self.parties = [v for v in values if v is not None and (self.parties is None or v in self.parties)]
            else:
                yield f

    def partitions(self) -> list[Piece]:
        if self.codes == []:
            return []
        found = [f for f in files_of(self.path) if self.parties is None or party_of(f[0]) in self.parties]
        return [p for path, size in found for p in pieces_of(path, size, split=self.split)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return rows_of(partition, self.prefix, self.codes)


class LogStream(DataSourceStreamReader):
    """Offsets are bytes read by file; what grows must grow by whole lines."""

    def __init__(self, options: dict[str, str]):
        self.path, self.prefix = options["path"], options.get("prefix", "")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.codes = options["codes"].split(",") if options.get("codes") else None
        self.most = int(options["bytesPerTrigger"]) if options.get("bytesPerTrigger") else None
        self.kept = options.get("offered")
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.most is None:
            return dict(files_of(self.path))
        if self.at is None:
            self.at = self._offered()
            if self.at:
                return self.at  # offered before a restart: not beyond it yet
        left, now = self.most, dict(self.at)
        for path, size in files_of(self.path):
            more = size - now.get(path, 0)
            if more > 0 and left > 0:
                now[path] = size if path.endswith(COMPRESSED) else self._line_end(path, now.get(path, 0), min(more, left), size)
                left -= now[path] - self.at.get(path, 0)
        if now != self.at and self.kept:
            system, at = opened(self.kept)
            with system.open_output_stream(at) as out:
                out.write(json.dumps(now).encode())
        self.at = now
        return now

    def _offered(self) -> dict[str, int]:
        if not self.kept:
            return {}
        system, at = opened(self.kept)
        if system.get_file_info(at).type == fs.FileType.NotFound:
            return {}
        with system.open_input_file(at) as source:
            return json.loads(source.read())

    @staticmethod
    def _line_end(path: str, start: int, more: int, size: int) -> int:
        """Where the line ends that these bytes more end within."""
        system, name = opened(path)
        at = start + more
        with system.open_input_file(name) as source:
            source.seek(at - 1)
            while data := source.read(BLOCK_BYTES):
                cut = data.find(b"\n")
                if cut >= 0:
                    return at + cut
                at += len(data)
        return size

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [p for path, size in sorted(end.items()) for p in pieces_of(path, size, start.get(path, 0), self.split)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return rows_of(partition, self.prefix, self.codes)


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "eventlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStream:  # noqa: N802
        return LogStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format "eventlog" known to the session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventLog)


def read_log(spark: SparkSession, path: str, prefix: str = "", counters: list[str] | None = None, stream: bool = False, **options) -> DataFrame:
    """A log's rows; with counters, only the events that they need, picked by the reader."""
    register(spark)
    codes = None if counters is None else sorted(events_for(counters))
    reader = (spark.readStream if stream else spark.read).format("eventlog").option("prefix", prefix).options(**options)
    if stream:
        return (reader if codes is None else reader.option("codes", ",".join(codes))).load(path)
    rows = reader.load(path)
    return rows if codes is None else rows.where(rows["code"].isin(*codes))


def write_log(lines: DataFrame, path: str, compression: str = "none") -> str:
    """Lines (value, and party where there is one) as a log, a folder for each party; returns the path.

    A compressed log (gzip) is many times smaller; a task then reads a whole file of it.
    """
    by = ["party"] if "party" in lines.columns else []
    lines.select("value", *by).write.option("compression", compression).option("zlib.compress.level", "BEST_SPEED").partitionBy(*by).text(path)
    return path
