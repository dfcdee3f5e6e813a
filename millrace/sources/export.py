"""Export as ordered nested JSON, by a data source writer of its own: all files appear, or none.

Every task writes its rows, one JSON object a line, under a name of its own in a staging folder.  The
driver's commit moves the files of the tasks that succeeded to ``part-00000.json``, ... in the order of
the partitions, and leaves a manifest with rows and digests; an abort removes the staging folder, so a
failed job leaves nothing.  Rows come out in the order of the DataFrame's partitions; ``export_nested``
sorts by range, so the files are one ordered whole however many tasks write.

The folder is any that pyarrow's file systems reach from driver and executors alike.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "ordered_json"
MANIFEST = "_manifest.json"


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    rows: int
    sha256: str


class OrderedJson(DataSource):
    """``df.write.format("ordered_json").mode("overwrite").save(path)`` of lines (one column of strings), after ``spark.dataSource.register(OrderedJson)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> OrderedJsonWriter:
        return OrderedJsonWriter(self.options["path"], overwrite)


class OrderedJsonWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.staging = path.rstrip("/"), overwrite, f"_staging-{uuid.uuid4().hex}"

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if ":/" in self.path else f"file://{self.path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        files, root = self._open()
        files.create_dir(f"{root}/{self.staging}", recursive=True)
        task = TaskContext.get()
        name, rows, digest = f"{task.partitionId():05d}-{task.taskAttemptId()}.json", 0, hashlib.sha256()
        with files.open_output_stream(f"{root}/{self.staging}/{name}") as out:
            for batch in iterator:
                if len(batch):
                    lines = ("\n".join(batch.column(0).to_pylist()) + "\n").encode()
                    out.write(lines)
                    digest.update(lines)
                    rows += len(batch)
        return Part(task.partitionId(), name, rows, digest.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        files, root = self._open()
        files.create_dir(root, recursive=True)
        old = [f.path for f in files.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-") or f.base_name == MANIFEST]
        if old and not self.overwrite:
            files.delete_dir(f"{root}/{self.staging}")
            raise FileExistsError(f"{self.path} holds an export")
        for path in old:
            files.delete_file(path)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        for i, part in enumerate(parts):
            files.move(f"{root}/{self.staging}/{part.name}", f"{root}/part-{i:05d}.json")
        with files.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps([{"file": f"part-{i:05d}.json", "rows": p.rows, "sha256": p.sha256} for i, p in enumerate(parts)]).encode())
        self._clear(files, root)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(*self._open())

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.staging}")


def nested(parents: DataFrame, children: DataFrame, key: str, child_order: Sequence[str], name: str = "children") -> DataFrame:
    """Parents with their children as an array of structs in the given order; an empty one where there are none."""
    fields = [c for c in children.columns if c != key]
    ordered = F.array_sort(F.collect_list(F.struct(*child_order, *(c for c in fields if c not in child_order))))
    held = children.groupBy(F.col(key).alias("_key")).agg(ordered.alias(name))
    joined = parents.join(held, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return joined.withColumn(name, F.coalesce(name, F.array()))


def export_nested(parents: DataFrame, children: DataFrame, key: str, order: Sequence, child_order: Sequence[str], path: str, name: str = "children") -> None:
    """Write parents in ``order`` (columns, such as F.desc("published_at")) with their ordered children."""
    spark = parents.sparkSession
    spark.dataSource.register(OrderedJson)
    rows = nested(parents, children, key, child_order, name)
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"})
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("line")).write.format(FORMAT).mode("overwrite").save(path)
