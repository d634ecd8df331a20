"""The first bytes of files, by ranged reads: a data source that never reads further than it is asked."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

SCHEMA = "path string, length long, prefix binary, status string"
#: Files of a partition; bytes of a batch, at least.
FILES, BATCH = 64, 4 << 20


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class PrefixReader(DataSourceReader):
    """Lists a folder or file once; each task opens its files and reads one range of each."""

    def __init__(self, options: dict) -> None:
        self.path, self.n = options["path"], int(options.get("bytes", 0))
        if self.n < 0:
            raise ValueError("bytes may not be negative")
        self.glob, self.recursive, self.files = options.get("glob", "*"), options.get("recursive", "false").lower() == "true", int(options.get("files", FILES))

    def opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def partitions(self) -> list[Files]:
        files, root = self.opened()
        one = files.get_file_info(root)
        if one.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [one] if one.is_file else files.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        names = sorted((f.path, f.size) for f in found if f.is_file and (one.is_file or fnmatch(f.base_name, self.glob)))
        return [Files(names[i : i + self.files]) for i in range(0, len(names), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = self.opened()
        form = pa.schema([("path", pa.string()), ("length", pa.int64()), ("prefix", pa.binary()), ("status", pa.string())])
        out, size = [], 0
        for path, length in partition.files:
            try:
                with files.open_input_file(path) as f:
                    head, status = f.read_at(min(self.n, length), 0), "completed"
            except OSError:
                head, status = None, "error"
            out.append({"path": path, "length": length, "prefix": head, "status": status})
            size += len(head or b"")
            if size >= BATCH:
                yield pa.RecordBatch.from_pylist(out, form)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, form)


class Prefixes(DataSource):
    """``spark.read.format("prefixes").option("bytes", n).load(folder)``; options glob, recursive and files (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "prefixes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PrefixReader:  # noqa: ANN001
        return PrefixReader(self.options)


def read_prefixes(spark: SparkSession, path: str, n: int, glob: str = "*", recursive: bool = False, files: int = FILES) -> DataFrame:
    """path, length, prefix (at most n bytes) and status of a file or of a folder's files.

    A file that can't be opened keeps its row with status error. Stores that
    Arrow knows are read by range; for others, ``readers.byte_prefix`` cuts what
    the engine has read whole.
    """
    ship(spark)
    spark.dataSource.register(Prefixes)
    options = {"bytes": n, "glob": glob, "recursive": str(recursive).lower(), "files": files}
    return spark.read.format("prefixes").options(**options).load(path)
