"""Documents and fetched pages as formats of spark.read (S8 to S10, E5): listed into partitions, filtered at the source.

    register(spark)
    spark.read.format("lorewell_documents").load(folder).where("suffix = '.md'")
    spark.read.format("lorewell_pages").load(table).where("url IN (...)")

A filter on suffix or source (documents) or url (pages) is pushed down: files of other suffixes are not opened, and row groups that
cannot hold a url are not read. What cannot be read is a row with its error, and no text. Files are found by pyarrow, so the folder must be
on a file system that it opens; files.load_directory() reads any that Spark does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from lorewell.sources.files import READERS, Reader, read_html, suffix_of

#: Bytes of the files of a partition; a larger file is one of its own.
PARTITION_BYTES = 64 << 20


def _opened(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _wanted(f: Filter, columns: set[str]) -> tuple[str, set] | None:
    """Column and values of a filter that the source can keep by itself."""
    if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in columns:
        return f.attribute[0], {f.value}
    if isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in columns:
        return f.attribute[0], {v for v in f.value if v is not None}
    return None


class _Reader(DataSourceReader):
    pushed: set[str] = set()

    def __init__(self, path: str) -> None:
        self.path = path
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            found = _wanted(f, self.pushed)
            if found is None:
                yield f
            else:
                column, values = found
                self.only[column] = self.only.get(column, values) & values


@dataclass
class Files(InputPartition):
    names: list[str]


class DocumentReader(_Reader):
    pushed = {"suffix", "source"}

    def __init__(self, path: str, readers: dict[str, Reader]) -> None:
        super().__init__(path)
        self.readers = readers

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        where, base = _opened(self.path)
        found = where.get_file_info(fs.FileSelector(base, recursive=True)) if where.get_file_info(base).type == fs.FileType.Directory else [where.get_file_info(base)]
        out, held, size = [], [], 0
        for info in sorted((i for i in found if i.type == fs.FileType.File and self._kept(i.path)), key=lambda i: i.path):
            if held and size + info.size > PARTITION_BYTES:
                out.append(Files(held))
                held, size = [], 0
            held.append(info.path)
            size += info.size
        return [*out, Files(held)]

    def _kept(self, path: str) -> bool:
        of = {"suffix": suffix_of(path), "source": path}
        return of["suffix"] in self.readers and all(of[c] in values for c, values in self.only.items())

    def read(self, partition: Files) -> Iterator[tuple]:
        where, _ = _opened(self.path)
        for name in partition.names:
            suffix = suffix_of(name)
            try:
                with where.open_input_file(name) as f:
                    texts = self.readers[suffix](f.read())
            except Exception as e:  # noqa: BLE001  a bad file is quarantined
                yield None, None, suffix, name, f"{type(e).__name__}: {e}"
                continue
            for page, text in enumerate(texts):
                yield text, page, suffix, name, None


class DocumentSource(DataSource):
    """(content, page, suffix, source, error) of the files below a folder whose suffix has a reader."""

    readers: dict[str, Reader] = READERS

    @classmethod
    def name(cls) -> str:
        return "lorewell_documents"

    def schema(self) -> str:
        return "content string, page int, suffix string, source string, error string"

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(self.options["path"], dict(self.readers))


@dataclass
class RowGroup(InputPartition):
    name: str
    group: int


class PageReader(_Reader):
    pushed = {"url"}

    def partitions(self) -> list[RowGroup]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        where, base = _opened(self.path)
        info = where.get_file_info(base)
        found = [i.path for i in where.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(".parquet")] if info.type == fs.FileType.Directory else [base]
        out = []
        for name in sorted(found):
            with where.open_input_file(name) as f:
                meta = pq.ParquetFile(f).metadata
                out += [RowGroup(name, g) for g in range(meta.num_row_groups) if self._may_hold(meta.row_group(g))]
        return out or [RowGroup("", -1)]

    def _may_hold(self, group) -> bool:
        if "url" not in self.only:
            return True
        column = next(c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == "url")
        least = column.statistics if column.is_stats_set else None
        return least is None or not least.has_min_max or any(least.min <= u <= least.max for u in self.only["url"])

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        if partition.group < 0:
            return
        where, _ = _opened(self.path)
        with where.open_input_file(partition.name) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=256, row_groups=[partition.group], columns=["url", "html"]):
                if "url" in self.only:
                    batch = batch.filter(pc.is_in(batch.column("url"), pa.array(sorted(self.only["url"]), batch.schema.field("url").type)))
                texts = [read_html((h or "").encode())[0] for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("url").cast(pa.string())], ["content", "url"])


class PageSource(DataSource):
    """(content, url): visible texts of a Parquet table of fetched pages (url, html)."""

    @classmethod
    def name(cls) -> str:
        return "lorewell_pages"

    def schema(self) -> str:
        return "content string, url string"

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets it push filters to them. Readers that are added later need it once more."""

    class Bound(DocumentSource):
        # Spark makes sources in processes of their own, which do not know what this one has added
        readers = dict(READERS)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Bound, PageSource):
        spark.dataSource.register(source)
