"""A folder of saved pages as a data source of Spark, and the links of a page as a table function.

    spark.dataSource.register(PageFolder)
    spark.read.format("page_folder").option("partition_bytes", 64 << 20).load("file:///saved/pages")
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, InputPartition, LessThan, StringStartsWith
from pyspark.sql.types import StructType

from .html import _Blocks

PARTITION_BYTES = 64 << 20
ENDINGS = (".html", ".htm")


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    names: tuple[tuple[str, int], ...]


class PageFolder(DataSource):
    """path (below the folder), size (bytes), html of every .html and .htm file in a folder, at any depth.

    Filters on path (=, prefix) and on size (=, <, >) choose files before any is opened. Files are dealt to tasks by their sizes,
    `partition_bytes` each. The folder is any that pyarrow's file systems reach, the same for driver and executors. Bytes that
    aren't UTF-8 become replacement signs; an empty file is an empty page, an empty folder no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "page_folder"

    def schema(self) -> str:
        return "path string, size long, html string"

    def reader(self, schema: StructType) -> "PageReader":
        return PageReader(self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)))


class PageReader(DataSourceReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            kind = {EqualTo: "is", StringStartsWith: "begins", LessThan: "less", GreaterThan: "more"}.get(type(f))
            name = f.attribute[0] if kind else None
            if kind and (name == "path" and kind in ("is", "begins") or name == "size" and kind != "begins"):
                self.wanted.append((name, kind, f.value))
            else:
                yield f

    def _fits(self, path: str, size: int) -> bool:
        test = {"is": lambda a, b: a == b, "begins": lambda a, b: a.startswith(b), "less": lambda a, b: a < b, "more": lambda a, b: a > b}
        return all(test[kind](path if name == "path" else size, value) for name, kind, value in self.wanted)

    def _files(self) -> tuple[pa.fs.FileSystem, str]:
        from pyarrow import fs

        return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", self.folder))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = self._files()
        found = sorted((i.path[len(root) :].lstrip("/"), i.size) for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.path.lower().endswith(ENDINGS))
        out, held, size = [], [], 0
        for name, n in found:
            if self._fits(name, n):
                if held and size + n > self.most:
                    out.append(Files(tuple(held)))
                    held, size = [], 0
                held.append((name, n))
                size += n
        return [*out, Files(tuple(held))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, root = self._files()
        for name, size in partition.names:
            with files.open_input_stream(f"{root.rstrip('/')}/{name}") as stream:
                html = stream.read().decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([html])], ["path", "size", "html"])


@F.udtf(returnType="block int, href string, anchor string")
class PageLinks:
    """The links of a page, by block and in order; none of a null page."""

    def eval(self, html: str) -> Iterator[tuple]:
        parser = _Blocks()
        parser.feed(html or "")
        parser.close()
        parser._close()
        for block, (_, _, _, spans) in enumerate(parser.blocks):
            for href, _, _, anchor in spans:
                yield block, href, anchor


def links(pages: DataFrame) -> DataFrame:
    """page_id, block, href, anchor of every link of pages (page_id, html), by the table function."""
    return pages.select("page_id", "html").lateralJoin(PageLinks(F.col("html").outer())).select("page_id", "block", "href", "anchor")
