"""Folders of Arrow files as a data source: a partition per range of record batches, which reads the
columns asked for and drops rows before they reach Spark.

A folder has files of Arrow's file or stream format, in the order that its
``state.json`` lists them or else of their names. Files are opened through Arrow's
own file systems (local, shared or object stores by URI).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import LongType, StructType

STATE = "state.json"
#: Record batches of a partition, rows of a batch that is written.
BATCHES, ROWS = 16, 1000
#: The column with a row's place in the folder, from 0.
PLACE = "_place"


def located(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


def files(uri: str) -> list[str]:
    """Names of a folder's Arrow files in order."""
    fs, path = located(uri)
    state = fs.get_file_info(f"{path}/{STATE}")
    if state.type == pyarrow.fs.FileType.File:
        with fs.open_input_stream(state.path) as f:
            return [x["filename"] for x in json.loads(f.read())["_data_files"]]
    return sorted(f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.base_name.endswith(".arrow"))


def opened(fs: pyarrow.fs.FileSystem, path: str) -> tuple[pa.Schema, int | None, Iterable[pa.RecordBatch] | pa.RecordBatchFileReader]:
    """(schema, batches, reader) of a file; a stream does not tell how many batches it has."""
    source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
    if source.read(6) == b"ARROW1":
        reader = pa.ipc.open_file(source)
        return reader.schema, reader.num_record_batches, reader
    source.seek(0)
    reader = pa.ipc.open_stream(source)
    return reader.schema, None, reader


@dataclass
class Batches(InputPartition):
    """Record batches ``first`` to ``last`` of a file whose first row is at ``place``."""

    file: str
    first: int
    last: int
    place: int


class ArrowFolder(DataSource):
    """Options: ``path``; ``columns`` (a JSON list of names; all without); ``keep`` (JSON: for a column the values that rows may have)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_folder"

    def schema(self) -> StructType:
        fs, path = located(self.options["path"])
        names = files(self.options["path"])
        if not names:
            raise ValueError(f"no Arrow files at {self.options['path']}")
        whole = from_arrow_schema(opened(fs, f"{path}/{names[0]}")[0])
        wanted = json.loads(self.options.get("columns", "[]"))
        if missing := [c for c in wanted if c not in whole.names]:
            raise ValueError(f"columns that the files do not have: {missing}")
        return StructType([whole[c] for c in wanted] if wanted else list(whole.fields)).add(PLACE, LongType(), False)

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(self.options["path"], schema, json.loads(self.options.get("keep", "{}")))


class FolderReader(DataSourceReader):
    """Reads the columns of ``schema`` of the rows whose columns have the values of ``keep``."""

    def __init__(self, path: str, schema: StructType, keep: dict[str, list]):
        self.path, self.schema, self.keep = path, schema, keep

    def partitions(self) -> list[InputPartition]:
        fs, path = located(self.path)
        out, place = [], 0
        for name in files(self.path):
            _, count, reader = opened(fs, f"{path}/{name}")
            sizes = [b.num_rows for b in reader] if count is None else [reader.get_batch(i).num_rows for i in range(count)]
            for at in range(0, len(sizes), BATCHES):
                part = sizes[at : at + BATCHES]
                out.append(Batches(name, at, at + len(part), place))
                place += sum(part)
        return out or [Batches("", 0, 0, 0)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, path = located(self.path)
        _, count, reader = opened(fs, f"{path}/{partition.file}")
        batches = (reader.get_batch(i) for i in range(partition.first, partition.last)) if count is not None else (b for i, b in enumerate(reader) if partition.first <= i < partition.last)
        place, target = partition.place, to_arrow_schema(self.schema)
        for batch in batches:
            keep = None
            for name, values in self.keep.items():
                hit = pc.is_in(batch.column(name), value_set=pa.array(values, batch.schema.field(name).type))
                keep = hit if keep is None else pc.and_(keep, hit)
            places = pa.array(range(place, place + batch.num_rows), pa.int64())
            place += batch.num_rows
            out = pa.RecordBatch.from_arrays([places if f.name == PLACE else batch.column(f.name).cast(f.type) for f in target], schema=target)
            yield out if keep is None else out.filter(keep)


def read_folder(spark: SparkSession, path: str, columns: list[str] | None = None, keep: dict[str, list] | None = None) -> DataFrame:
    """The rows of an Arrow folder with their place (PLACE): ``columns`` only, and only rows that have one of ``keep``'s values."""
    spark.dataSource.register(ArrowFolder)
    return spark.read.format("arrow_folder").options(path=path, columns=json.dumps(columns or []), keep=json.dumps(keep or {})).load()


def write_folder(rows: DataFrame, path: str, form: str = "stream") -> int:
    """Write ``rows`` as an Arrow folder, a file per partition, and return how many rows it has.

    Each task writes its file under a name of its own and renames it when it is
    whole, so that a repeated task replaces the same file; ``state.json`` comes last.
    """
    if form not in ("stream", "file"):
        raise ValueError(f"unknown form {form!r}")
    target = to_arrow_schema(rows.schema)
    fs, folder = located(path)
    fs.create_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = located(path)
        context = TaskContext.get()
        name, n = f"data-{context.partitionId():05d}.arrow", 0
        part = f"{folder}/.{name}.{context.taskAttemptId()}"
        with fs.open_output_stream(part) as sink, (pa.ipc.new_stream if form == "stream" else pa.ipc.new_file)(sink, target) as writer:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    writer.write_batch(batch.slice(at, ROWS).cast(target))
                n += batch.num_rows
        fs.move(part, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"name": [name], "n": [n]})

    written = sorted(map(tuple, rows.mapInArrow(run, "name string, n long").collect()))  # a row per file
    with fs.open_output_stream(f"{folder}/.{STATE}") as f:
        f.write(json.dumps({"_data_files": [{"filename": name} for name, _ in written]}).encode())
    fs.move(f"{folder}/.{STATE}", f"{folder}/{STATE}")
    return sum(n for _, n in written)
