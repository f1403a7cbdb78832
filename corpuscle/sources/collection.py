"""A collection store with a two-phase commit, as a Spark data source.

A task writes its rows to files of its own under a folder of the job and reports them; nothing reads them yet. When all tasks
have reported, the driver writes a manifest with the files and their row counts, under the next version's number. Readers take the
files of the newest manifest. A job that fails deletes its folder, and the collections stay as they were.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .lines import filesystem

MANIFESTS = "_manifests"


@dataclass
class Written(WriterCommitMessage):
    """(collection, file below the store, rows) of what a task wrote."""

    files: list[tuple[str, str, int]]


class CollectionWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.by, self.overwrite = options["path"], options.get("collection", "collection"), overwrite
        self.batch, self.job = int(options.get("batch", 10_000)), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A file a collection; row groups are batches of `batch` rows at most."""
        fs, root = filesystem(self.path)
        own, open_files, counts = uuid.uuid4().hex, {}, Counter()
        fs.create_dir(f"{root}/data/{self.job}")
        for batch in iterator:
            names = batch.column(self.by).cast(pa.string())
            if names.null_count:
                raise ValueError(f"null in {self.by!r}")
            for name in names.unique().to_pylist():
                rows = batch.filter(pc.equal(names, name))
                if name not in open_files:
                    below = f"data/{self.job}/{own}-{len(open_files)}.parquet"
                    open_files[name] = below, pq.ParquetWriter(f"{root}/{below}", rows.schema, filesystem=fs)
                open_files[name][1].write_table(pa.Table.from_batches([rows]), row_group_size=self.batch)
                counts[name] += rows.num_rows
        for _, f in open_files.values():
            f.close()
        return Written([(name, below, counts[name]) for name, (below, _) in open_files.items()])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        new = [list(f) for m in messages if m for f in m.files]
        version, old = newest(self.path)
        files = new if self.overwrite else old["files"] + new if old else new
        counts: Counter = Counter()
        for name, _, n in files:
            counts[name] += n
        fs.create_dir(f"{root}/{MANIFESTS}")
        draft = f"{root}/{MANIFESTS}/.{self.job}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps({"files": files, "counts": counts}).encode())
        fs.move(draft, f"{root}/{MANIFESTS}/{version + 1:08d}.json")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        if fs.get_file_info(folder := f"{root}/data/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class Collections(DataSource):
    """``df.write.format("collections").option("path", ...)``; :func:`put` does the rest."""

    @classmethod
    def name(cls) -> str:
        return "collections"

    def schema(self) -> str:
        return "collection string"

    def writer(self, schema, overwrite: bool) -> CollectionWriter:
        return CollectionWriter(self.options, overwrite)


def newest(path: str) -> tuple[int, dict | None]:
    """(version, manifest) of the store, (0, None) of an empty one."""
    fs, root = filesystem(path)
    if fs.get_file_info(f"{root}/{MANIFESTS}").type != pafs.FileType.Directory:
        return 0, None
    found = [f for f in fs.get_file_info(pafs.FileSelector(f"{root}/{MANIFESTS}")) if f.base_name.endswith(".json")]
    if not found:
        return 0, None
    last = max(found, key=lambda f: f.base_name)
    with fs.open_input_stream(last.path) as f:
        return int(last.base_name[:-5]), json.loads(f.read())


def put(df: DataFrame, path: str, collection: str = "collection", key: str | None = None, append: bool = False, batch: int = 10_000) -> dict[str, int]:
    """Write the rows as collections named by a text column, all or nothing; returns rows by collection from the tasks' messages.

    key: ids that must be unique in a collection; a repeated one is an error before anything is written. append: beside what
    is stored, which otherwise is replaced. One job writes a store at a time. An empty table commits no rows.
    """
    if key and (twice := df.groupBy(collection, key).count().filter("count > 1").first()):
        raise ValueError(f"id {twice[1]!r} repeats in {twice[0]!r}")
    df.sparkSession.dataSource.register(Collections)
    df.write.format("collections").mode("append" if append else "overwrite").option("path", path).option("collection", collection).option("batch", str(batch)).save()
    return counts(path)


def counts(path: str) -> dict[str, int]:
    """Rows by collection, from the manifest."""
    return (newest(path)[1] or {"counts": {}})["counts"]


def opened(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """The rows of the named collections, or of all; only their files are read."""
    manifest = newest(path)[1] or {"files": []}
    files = [f"{path.rstrip('/')}/{below}" for name, below, _ in manifest["files"] if not names or name in names]
    if not files:
        raise FileNotFoundError(f"no collection {', '.join(names)} in {path}")
    return spark.read.parquet(*files)
