"""Coded files and JSON text sequences as tables.

Reading goes through Spark's `binaryFile` source, so any file system Spark knows will do, batch or stream; each file is
one cell, taken apart on the executors.  A single gzip, zlib, DEFLATE or brotli file can't be split, but the members of a
gzip file and the frames of a Zstandard file become rows of their own.

Writing needs a sink for arbitrary octets, which Spark lacks: `CodedSource` is a Python data source that writes coded files
into a folder all executors share, by a URI of any file system pyarrow knows (file, hdfs, s3, gs, abfs), and reads such
folders back.  A task begins another file when one holds `max_file_len` octets.
"""

from __future__ import annotations

import contextlib
import fnmatch
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import codecs, json_text
from ..functions.verdict import Refused
from ..operators import splitters

#: What may follow the first stream of a file: another one, or nothing.
RESTART, REFUSE = ("gzip", "zstd"), ("zlib", "deflate", "brotli")


def _files(spark: SparkSession, path: str, stream: bool) -> DataFrame:
    if not stream:
        return spark.read.format("binaryFile").load(path).select("path", "content")
    kind = spark.read.format("binaryFile").load(path).schema
    return spark.readStream.format("binaryFile").schema(kind).load(path).select("path", "content")


def read_coded(spark: SparkSession, path: str, codec: str, max_output_len: int | None = None, stream: bool = False, **options) -> DataFrame:
    """path, value, error and error_class of each file. After the one stream of a zlib, DEFLATE or brotli file nothing may follow."""
    files = _files(spark, path, stream).withColumn("v", codecs.try_decode(F.col("content"), codec, max_output_len, **options))
    rest = (F.col("v.consumed") < F.octet_length("content")) & F.col("v.error").isNull()
    return files.select(
        "path", F.when(~rest, F.col("v.value")).alias("value"),
        F.when(rest, "TrailingOctets").otherwise(F.col("v.error")).alias("error"),
        F.when(rest, "corrupt").otherwise(F.col("v.error_class")).alias("error_class"),
    )


def read_members(spark: SparkSession, path: str, codec: str = "gzip", **options) -> DataFrame:
    """One row a gzip member or Zstandard frame: path, ordinal, start, stop, value, error, error_class."""
    generator = {"gzip": splitters.members, "zstd": splitters.frames}[codec]
    return splitters.explode_with(_files(spark, path, False), generator, "content", **options).drop("content")


def read_json_sequence(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One row a text of each RS-delimited file: path, ordinal, text, error, error_class."""
    out = splitters.explode_with(_files(spark, path, stream), splitters.texts, "content")
    return out.select("path", "ordinal", F.trim(F.col("value").cast("string"), F.lit(" \t\r\n")).alias("text"), "error", "error_class")


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; a plain path is this machine's."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _parts(system: pafs.FileSystem, folder: str, pattern: str = "part-*") -> list[str]:
    found = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(x.path for x in found if x.is_file and fnmatch.fnmatchcase(x.base_name, pattern))


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _CodedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.codec = options["path"].rstrip("/"), options.get("codec", "gzip")

    def partitions(self) -> list[InputPartition]:
        system, path = _system(self.path)
        folder, _, pattern = path.rpartition("/")
        return [_Part(p) for p in (_parts(system, folder, pattern) if "*" in pattern else _parts(system, path))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with _system(self.path)[0].open_input_stream(partition.path, compression=None) as f:
            data = f.read()
        if self.codec == "jsonseq":
            for start, stop, error in json_text.sequence_texts(data):
                if error:
                    raise Refused(error, start)
                yield (data[start:stop].strip(b" \t\r\n"),)
        else:
            value, consumed = codecs.DECODERS[self.codec](data)
            if consumed < len(data):
                raise Refused("TrailingOctets", consumed)
            yield (value,)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class _CodedWriter(DataSourceWriter):
    """Each task writes hidden files; the commit gives all of them their names, then an overwrite removes the old ones."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.codec, self.level = options["path"].rstrip("/"), options.get("codec", "gzip"), options.get("level")
        self.most, self.overwrite = int(options.get("max_file_len", 256 << 20)), overwrite

    def _file(self, parts: list[bytes]) -> str:
        options = {} if self.level is None else {"level": int(self.level)}
        data = b"".join(b"\x1e" + p + b"\n" for p in parts) if self.codec == "jsonseq" else codecs.ENCODERS[self.codec](b"".join(parts), **options)
        system, folder = _system(self.path)
        name = f"part-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{folder}/.{name}", compression=None) as f:
            f.write(data)
        return name

    def write(self, rows) -> WriterCommitMessage:
        system, folder = _system(self.path)
        system.create_dir(folder, recursive=True)
        names, parts, n = [], [], 0
        try:
            for r in rows:
                if r[0] is None:
                    continue
                parts.append(json_text.octets(r[0]))
                n += len(parts[-1])
                if n >= self.most:
                    names.append(self._file(parts))
                    parts, n = [], 0
            if parts:
                names.append(self._file(parts))
        except BaseException:
            self.abort([_Written(names)])
            raise
        return _Written(names)

    def commit(self, messages: list) -> None:
        system, folder = _system(self.path)
        old = _parts(system, folder) if self.overwrite else []
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{folder}/.{name}", f"{folder}/{name}")
        for path in old:
            system.delete_file(path)

    def abort(self, messages: list) -> None:
        system, folder = _system(self.path)
        for m in messages:
            for name in m.names if m else []:
                with contextlib.suppress(OSError):
                    system.delete_file(f"{folder}/.{name}")


class CodedSource(DataSource):
    """`format("coded")`: options path, codec (gzip, zlib, deflate, zstd, brotli or jsonseq), level and max_file_len (of octets before coding); one column `value`."""

    @classmethod
    def name(cls) -> str:
        return "coded"

    def schema(self) -> str:
        return "value binary"

    def reader(self, schema) -> DataSourceReader:
        return _CodedReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _CodedWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CodedSource)
