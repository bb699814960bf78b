"""Paged folders as a data source: `page=N` folders of JSON lines, read in parallel and followed as a stream.

An exporter that fetches an API page by page leaves one folder for each, numbered from 1.  A batch
read takes all pages that are there; a stream takes those after its offset, so a query
that is started again from its checkpoint reads only new pages.  A page counts once the pages before it are
there and it holds a `_SUCCESS` file or, with `marked` false, any file at all.

Folders are reached through pyarrow's file systems (local or shared paths, hdfs://, s3://, gs://).

Options: path (required), pages_per_task (1), pages_per_batch (a stream's batch takes at most so
many; none by default), marked (false).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.conversion import LocalDataToArrowConversion
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "paged_json"
#: A batch on its way to the executor ends at so many bytes of lines, or so many lines.
BYTES, ROWS = 1 << 20, 10_000


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class Folder:
    """The page folders under one path."""

    def __init__(self, options):
        if "path" not in options:
            raise ValueError("give the option path")
        self.path = options["path"]
        self.per_task = max(int(options.get("pages_per_task", 1)), 1)
        self.per_batch = int(options.get("pages_per_batch", 0))
        self.marked = options.get("marked", "false").lower() == "true"

    def files(self):
        """(file system, its path)."""
        from pyarrow import fs

        path = self.path.replace("file:///", "/", 1) if self.path.startswith("file:///") else self.path.removeprefix("file:") if self.path.startswith("file:/") else self.path
        return fs.FileSystem.from_uri(path)

    def ready(self, page: int) -> bool:
        from pyarrow import fs

        store, root = self.files()
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(f"{root}/page={page}", allow_not_found=True)) if f.is_file]
        return "_SUCCESS" in names if self.marked else any(not n.startswith(("_", ".")) for n in names)

    def last_from(self, page: int) -> int:
        """The last page that is there without a gap after `page`."""
        while self.ready(page + 1):
            page += 1
        return page

    def tasks(self, first: int, last: int) -> list[Pages]:
        return [Pages(p, min(p + self.per_task - 1, last)) for p in range(first, last + 1, self.per_task)]

    def batches(self, part: Pages, schema: StructType) -> Iterator["pa.RecordBatch"]:  # noqa: F821
        """The lines of the pages as Arrow batches of about BYTES bytes, however long a line is."""
        held, size = [], 0
        for n, row in self.rows(part, schema):
            held.append(row)
            size += n
            if size >= BYTES or len(held) >= ROWS:
                yield from LocalDataToArrowConversion.convert(held, schema, False).to_batches()
                held, size = [], 0
        if held:
            yield from LocalDataToArrowConversion.convert(held, schema, False).to_batches()

    def rows(self, part: Pages, schema: StructType) -> Iterator[tuple[int, tuple]]:
        """(bytes, tuple) of the lines; a missing field is null, a line that is no object has all null."""
        from pyarrow import fs

        store, root = self.files()
        names = schema.fieldNames()
        for page in range(part.first, part.last + 1):
            for info in sorted(store.get_file_info(fs.FileSelector(f"{root}/page={page}")), key=lambda f: f.path):
                if not info.is_file or info.base_name.startswith(("_", ".")):
                    continue
                with store.open_input_stream(info.path) as raw:
                    for line in _lines(raw):
                        yield len(line), _row(line, names, page)


def _lines(raw) -> Iterator[bytes]:
    """Lines of a stream, without reading all of it at once."""
    kept = b""
    while piece := raw.read(1 << 20):
        *whole, kept = (kept + piece).split(b"\n")
        yield from (x for x in whole if x.strip())
    if kept.strip():
        yield kept


def _row(line: bytes, names: list[str], page: int) -> tuple:
    try:
        found = json.loads(line)
    except ValueError:
        found = None
    found = found if isinstance(found, dict) else {}
    return tuple(page if n == "page" else found.get(n) for n in names)


class Reader(DataSourceReader):
    def __init__(self, folder: Folder, schema: StructType):
        self.folder, self.wanted = folder, schema

    def partitions(self):
        return self.folder.tasks(1, self.folder.last_from(0)) or [Pages(1, 0)]

    def read(self, partition):
        return self.folder.batches(partition, self.wanted)


class StreamReader(DataSourceStreamReader):
    """Offsets are the number of pages read so far."""

    def __init__(self, folder: Folder, schema: StructType):
        self.folder, self.wanted = folder, schema
        self.known = 0

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        last = self.folder.last_from(self.known)
        if self.folder.per_batch:
            last = min(last, self.known + self.folder.per_batch)
        self.known = last
        return {"pages": last}

    def partitions(self, start: dict, end: dict):
        self.known = max(self.known, end["pages"])
        return self.folder.tasks(start["pages"] + 1, end["pages"])

    def commit(self, end: dict) -> None:
        self.known = max(self.known, end["pages"])

    def read(self, partition):
        return self.folder.batches(partition, self.wanted)


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        raise ValueError("give the reader a schema; a column `page` gets the page's number")

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(Folder(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(Folder(self.options), schema)


def read_pages(spark: SparkSession, path: str, schema, **options):
    """All pages under path."""
    spark.dataSource.register(PagedJson)
    return spark.read.format(NAME).schema(schema).options(path=path, **options).load()


def follow_pages(spark: SparkSession, path: str, schema, **options):
    """A stream of the pages under path."""
    spark.dataSource.register(PagedJson)
    return spark.readStream.format(NAME).schema(schema).options(path=path, **options).load()
