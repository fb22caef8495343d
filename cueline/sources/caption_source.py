"""Caption files as a Spark data source: spark.read.format("captions"), and df.write.format("captions").

Reading: a row a file (file, kind, text); files are listed once and dealt to partitions of some `partitionBytes` together. Options: path; kinds (comma-separated,
all by default); encoding (found out by default). The schema is fixed.

Writing: rows of file (a name) and text. Each task writes into a folder of its own; the commit names the folders of the tasks that count in a manifest, in one
file, and readers follow the manifests where there are any. A task that fails leaves nothing that is read, and an aborted job removes its folders.

Paths are those that Arrow opens (local, HDFS, S3, GCS by URI); for stores that only Spark reads there is captions.read_files().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

KINDS = {"srt": "srt", "ass": "ass", "ssa": "ass", "vtt": "vtt"}
MANIFEST = "_captions-"
SCHEMA = "file string, kind string, text string"


def _store(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _kind(name: str) -> str | None:
    return KINDS.get(name.rpartition(".")[2].lower()) if "." in name else None


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class CaptionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.kinds = set(options.get("kinds", ",".join(sorted(set(KINDS.values())))).split(","))
        self.encoding = options.get("encoding")
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", 32 << 20)))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        manifests = [x.path for x in found if x.base_name.startswith(MANIFEST)]
        if manifests:
            named = {f for m in manifests for f in json.loads(store.open_input_stream(m).read())}
            found = [x for x in found if x.path[len(root) :].lstrip("/").partition("/")[0] in named]
        out, size = [Files([])], 0
        for x in sorted((x for x in found if x.type == fs.FileType.File and _kind(x.base_name) in self.kinds), key=lambda x: x.path):
            if size and size + x.size > self.bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(x.path)
            size += x.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        from cueline.sources.captions import decode_captions

        store, _ = _store(self.path)
        for path in partition.paths:
            raw = store.open_input_stream(path, compression=None).read()
            yield path, _kind(path), raw.decode(self.encoding, "replace") if self.encoding else decode_captions(raw)


class CaptionWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.encoding, self.overwrite = options["path"].rstrip("/"), options.get("encoding", "utf-8"), overwrite

    def write(self, rows: Iterator) -> Written:
        store, root = _store(self.path)
        folder, n = f"part-{uuid.uuid4().hex}", 0
        try:
            for row in rows:
                if _kind(row.file) is None or "/" in row.file:
                    raise ValueError(f"not the name of a caption file: {row.file!r}")
                if not n:
                    store.create_dir(f"{root}/{folder}", recursive=True)
                with store.open_output_stream(f"{root}/{folder}/{row.file}", compression=None) as out:
                    out.write((row.text or "").encode(self.encoding))
                n += 1
        except Exception:
            if n:
                store.delete_dir(f"{root}/{folder}")
            raise
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        before = [x for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.startswith(MANIFEST)] if self.overwrite else []
        key, folders = uuid.uuid4().hex, [m.folder for m in messages if m and m.files]
        with store.open_output_stream(f"{root}/.{key}", compression=None) as out:
            out.write(json.dumps(folders).encode())
        store.move(f"{root}/.{key}", f"{root}/{MANIFEST}{key}.json")
        for x in before:
            for folder in json.loads(store.open_input_stream(x.path).read()):
                store.delete_dir(f"{root}/{folder}")
            store.delete_file(x.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m and m.files:
                store.delete_dir(f"{root}/{m.folder}")


class CaptionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CaptionReader:
        return CaptionReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> CaptionWriter:
        return CaptionWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    from cueline.workers import let_workers_import

    let_workers_import(spark)
    spark.dataSource.register(CaptionSource)
