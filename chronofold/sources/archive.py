"""ZIP archives of JSON files as a Spark source and sink.

Reading, the driver looks at the archives' directories alone; members are dealt to partitions by their size, so a member is read
by one task and many tasks read one archive. A member is JSON lines or one JSON array; it is decompressed as it is read, and comes out
as one row for every element: ``archive, member, place, value``. ``value`` is JSON text for ``from_json``, so that Catalyst sees the columns.

Writing, a task puts its rows ``value`` into an archive of its own, as members of so many lines, under a hidden name; the
commit of the job moves all of them into place, and a failed job deletes them. Paths may be of any file system that Arrow
knows.
"""

from __future__ import annotations

import codecs
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.json_scan import Elements

ROWS = "archive string, member string, place long, value string"
#: Rows of a batch, characters that are decompressed at once, bytes (uncompressed) of members that share a partition, and lines of a member.
BATCH, CHUNK, TOGETHER, LINES = 4096, 1 << 20, 32 << 20, 50_000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Members(InputPartition):
    names: list[tuple[str, str]]


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    name: str


class Reader(DataSourceReader):
    def __init__(self, path: str, together: int):
        self.path, self.together = path, together

    def partitions(self) -> Sequence[Members]:
        store, root = _open(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        out, held, size = [], [], 0
        for archive in sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".zip") and not f.base_name.startswith((".", "_"))):
            with store.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
                for member in z.infolist():
                    if member.is_dir() or not member.filename.endswith((".json", ".jsonl")):
                        continue
                    if held and size + member.file_size > self.together:
                        out.append(Members(held))
                        held, size = [], 0
                    held.append((archive, member.filename))
                    size += member.file_size
        return [*out, Members(held)] if held else out or [Members([])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        for archive, member in partition.names:
            with store.open_input_file(archive) as f, zipfile.ZipFile(f) as z, z.open(member) as raw:
                place, held = 0, []
                for value in _elements(raw):
                    held.append(value)
                    if len(held) == BATCH:
                        yield _batch(archive, member, place, held)
                        place, held = place + BATCH, []
                if held:
                    yield _batch(archive, member, place, held)


def _elements(raw) -> Iterator[str]:
    decode, split = codecs.getincrementaldecoder("utf-8")(), Elements()
    while chunk := raw.read(CHUNK):
        yield from split.feed(decode.decode(chunk))
    yield from split.feed(decode.decode(b"", True))
    yield from split.close()


def _batch(archive: str, member: str, place: int, values: list[str]) -> pa.RecordBatch:
    n = len(values)
    return pa.record_batch([pa.array([archive] * n), pa.array([member] * n), pa.array(range(place, place + n), pa.int64()), pa.array(values, pa.string())], names=["archive", "member", "place", "value"])


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, lines: int, overwrite: bool):
        self.path, self.lines, self.overwrite = path.rstrip("/"), lines, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.zip"
        with store.open_output_stream(f"{root}/.{name}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            member, count, number = None, 0, 0
            for batch in iterator:
                for value in batch.column(batch.schema.get_field_index("value")).to_pylist():
                    if value is None:
                        continue
                    if member is None:
                        member = z.open(f"lines-{number:06d}.jsonl", "w", force_zip64=True)
                    # JSON text has no line break outside its escapes but between tokens
                    member.write(value.replace("\n", " ").replace("\r", " ").encode("utf-8") + b"\n")
                    count += 1
                    if count == self.lines:
                        member.close()
                        member, count, number = None, 0, number + 1
            if member is not None:
                member.close()
        return Written(f".{name}", name)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        new = {m.name for m in messages if m}
        old = [f.path for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".zip") and not f.base_name.startswith(".") and f.base_name not in new]
        for m in messages:
            if m:
                store.move(f"{root}/{m.hidden}", f"{root}/{m.name}")
        if self.overwrite:
            for path in old:
                store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        for m in messages:
            if m and store.get_file_info(f"{root}/{m.hidden}").type == fs.FileType.File:
                store.delete_file(f"{root}/{m.hidden}")


class ZippedJson(DataSource):
    """``spark.read.format("zipped_json").load(path)``; options ``together`` (bytes a partition) and ``lines`` (a member)."""

    @classmethod
    def name(cls) -> str:
        return "zipped_json"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("together", TOGETHER)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("lines", LINES)), overwrite)


def read_zipped(spark: SparkSession, path: str, **options) -> DataFrame:
    """Every element of every JSON member of the archives under ``path``: ``archive, member, place, value``."""
    spark.dataSource.register(ZippedJson)
    return spark.read.format("zipped_json").options(**options).load(path)


def write_zipped(df: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Write column ``value`` (JSON texts; nulls are left out) as archives under ``path``."""
    df.sparkSession.dataSource.register(ZippedJson)
    df.select("value").write.format("zipped_json").options(**options).mode(mode).save(path)


# fixed values: the ways in which chat exports write a moment
STAMPS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd.MM.yyyy, HH:mm:ss", "MM/dd/yyyy HH:mm")


def day_of(stamp: Column) -> Column:
    """The day of a moment written in any of ``STAMPS``, blanks around it aside; else its first ten characters, as text."""
    clean = F.trim(stamp)
    days = (F.date_format(F.try_to_timestamp(clean, F.lit(s)), "yyyy-MM-dd") for s in STAMPS)
    return F.coalesce(*days, F.substring(clean, 1, 10))


#: One chat as chat exports nest it.
CHAT = "conv_id bigint, sessions array<struct<date: string, turns: array<struct<turn: bigint, role: string, text: string>>>>"


def turns_of(lines: DataFrame) -> DataFrame:
    """``conv_id, day, turn, role, text`` of nested chats; lines that are no such chat give no row."""
    chat = lines.select(F.from_json("value", CHAT).alias("chat")).where("chat.sessions is not null")
    sessions = chat.select("chat.conv_id", F.explode("chat.sessions").alias("s"))
    return sessions.select("conv_id", day_of(F.col("s.date")).alias("day"), F.explode("s.turns").alias("t")).select("conv_id", "day", "t.turn", "t.role", "t.text")
