"""A streaming source of log lines by byte offsets, which knows a file again after it was rotated, and a sink that parts bad lines from good.

A file is known by its first line, not by its name: `app.log` that becomes `app.log.1` goes on where it was, and the new `app.log`
begins at its start. Offsets are the ends of whole lines, so a line that is still being written waits. A restart from the checkpoint
reads each line once. Large ranges are read by several tasks, each the lines that begin in its part.

Defined cases: an empty file, or one without a whole line, waits; empty lines are passed over; bytes that aren't UTF-8 are replaced;
a file that was emptied and begun anew is a new one; a folder that isn't there yet has no lines; two present files with the same
first line are an error, as neither could be told from the other; so is a file that goes away with lines that are planned but unread."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

#: Bytes of one task's range, and bytes read at once.
PART_BYTES, BLOCK_BYTES = 64 << 20, 1 << 20


class _Range(InputPartition):
    def __init__(self, known: str, path: str, low: int, high: int):
        self.known, self.path, self.low, self.high = known, path, low, high


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, prefix: str, part_bytes: int):
        self.folder, self.prefix, self.part_bytes = folder, prefix, part_bytes

    def _store(self):
        return pafs.FileSystem.from_uri(self.folder)

    def _first(self, store, path: str) -> str | None:
        """What a file is known by, once its first line is whole."""
        digest = hashlib.sha256()
        with store.open_input_file(path) as file:
            while block := file.read(BLOCK_BYTES):
                line, end, _ = bytes(block).partition(b"\n")
                digest.update(line)
                if end:
                    return digest.hexdigest()[:32]
        return None

    def _files(self, store, root: str) -> dict[str, str]:
        told: dict[str, str] = {}
        for info in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.is_file and info.base_name.startswith(self.prefix) and info.size and (known := self._first(store, info.path)):
                if known in told:
                    raise ValueError(f"{info.path} and {told[known]} begin with the same line")
                told[known] = info.path
        return told

    def _whole(self, store, path: str) -> int:
        """The end of the last whole line."""
        with store.open_input_file(path) as file:
            end = file.size()
            while end:
                low = max(0, end - BLOCK_BYTES)
                at = bytes(file.read_at(end - low, low)).rfind(b"\n")
                if at >= 0:
                    return low + at + 1
                end = low
        return 0

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = self._store()
        return {known: self._whole(store, path) for known, path in self._files(store, root).items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        store, root = self._store()
        paths, ranges = None, []
        for known, high in end.items():
            low = start.get(known, 0)
            if low < high:
                paths = self._files(store, root) if paths is None else paths
                if known not in paths:
                    raise FileNotFoundError(f"a file in {self.folder} went away with unread lines")
                ranges += [_Range(known, paths[known], at, min(at + self.part_bytes, high)) for at in range(low, high, self.part_bytes)]
        return ranges

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        store, root = self._store()
        path = part.path
        if store.get_file_info(path).type == pafs.FileType.NotFound or self._first(store, path) != part.known:
            path = self._files(store, root)[part.known]  # rotated since the batch was planned
        with store.open_input_file(path) as file:
            file.seek(max(part.low - 1, 0))
            at, rest = max(part.low - 1, 0), b""
            skip = part.low > 0  # up to the end of the line that holds the byte before
            while at < part.high:
                block = bytes(file.read(BLOCK_BYTES))
                if not block:
                    break
                lines = (rest + block).split(b"\n")
                rest, offsets, texts = lines.pop(), [], []
                for line in lines:
                    if not skip and at < part.high and line.strip():
                        offsets.append(at)
                        texts.append(line.rstrip(b"\r").decode("utf-8", "replace"))
                    skip, at = False, at + len(line) + 1
                if texts:
                    yield pa.RecordBatch.from_pydict({"file": [part.known] * len(texts), "offset": offsets, "line": texts}, schema=pa.schema([("file", pa.string()), ("offset", pa.int64()), ("line", pa.string())]))

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """Options: path (a folder, as a URI or absolute), prefix (of the files' names), partBytes."""

    @classmethod
    def name(cls) -> str:
        return "corvane_log_tail"

    def schema(self) -> str:
        return "file string, offset bigint, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], self.options.get("prefix", ""), int(self.options.get("partbytes", self.options.get("partBytes", PART_BYTES))))


def tail(spark: SparkSession, folder: str, prefix: str = "", part_bytes: int = PART_BYTES) -> DataFrame:
    """file (what it is known by), offset and line of each whole line, as a stream."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("corvane_log_tail").option("path", folder).option("prefix", prefix).option("partBytes", part_bytes).load()


def parse(lines: DataFrame, shape: str) -> DataFrame:
    """lines with the fields of shape as struct `event`, null for a line that isn't an object of it."""
    told = F.from_json("line", f"{shape}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.withColumn("event", F.when(told["_corrupt"].isNull() & F.trim("line").startswith("{"), told)).withColumn("event", F.col("event").dropFields("_corrupt"))


def follow(spark: SparkSession, folder: str, shape: str, root: str, prefix: str = "", part_bytes: int = PART_BYTES) -> StreamingQuery:
    """Reads what is there now into root/good (the fields) and root/bad (file, offset and line), a folder for each batch, which a batch that is run again replaces."""

    def write(batch: DataFrame, number: int) -> None:
        told = parse(batch, shape).persist()
        told.filter("event IS NOT NULL").select("file", "offset", "event.*").write.mode("overwrite").parquet(f"{root}/good/batch={number}")
        told.filter("event IS NULL").select("file", "offset", "line").write.mode("overwrite").parquet(f"{root}/bad/batch={number}")
        told.unpersist()

    lines = tail(spark, folder, prefix, part_bytes)
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
