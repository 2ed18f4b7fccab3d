"""S5 in the evaluator's layout: one ``solution-problem-<id>.json`` per problem, below a folder per difficulty.

A Python data source: every task writes the files of its own rows. A file's name follows from its id and it is moved
into place whole, so a retried or speculative task replaces the same file by the same contents and leaves no second
one; ``_SUCCESS`` is written once all tasks are done. Folders are reached through ``pyarrow.fs`` (local and mounted
paths, hdfs, s3, gs). At scale ``files.write_solutions`` writes records instead, which need no file per problem.

Ids are letters, digits and underscores, as ``files.ID_REGEX`` reads them, and unique within a difficulty; any other
id, a null one too, ends the job. Null changes are written as an empty list, a null difficulty puts the file at the
top; an empty table gives a folder with ``_SUCCESS`` alone.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_ID = re.compile(r"[0-9A-Za-z_]+")
_SCHEMA = "problem_id string, changes array<int>, difficulty string"


def _put(fs, path: str, data: bytes) -> None:
    """Write beside the target under a name that no scan takes, then move into place."""
    folder, name = path.rsplit("/", 1)
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(part) as out:
            out.write(data)
        fs.move(part, path)
    except Exception:
        fs.delete_file(part)
        raise


class SolutionWriter(DataSourceWriter):
    def __init__(self, out: str):
        self.out = out

    def _target(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.out)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        fs, root = self._target()
        for row in iterator:
            if row.problem_id is None or not _ID.fullmatch(row.problem_id):
                raise ValueError(f"no file name for problem id {row.problem_id!r}")
            folder = root if row.difficulty is None else f"{root}/{row.difficulty}"
            _put(fs, f"{folder}/solution-problem-{row.problem_id}.json",
                 json.dumps({"changes": list(row.changes or [])}).encode())
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        fs, root = self._target()
        _put(fs, f"{root}/_SUCCESS", b"")

    def abort(self, messages) -> None:
        """Files already in place are whole and stay; without ``_SUCCESS`` the folder counts as unfinished."""


class SolutionFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "solution_files"

    def schema(self) -> str:
        return _SCHEMA

    def writer(self, schema, overwrite: bool) -> SolutionWriter:
        return SolutionWriter(self.options["path"].rstrip("/"))


def write_solution_files(solutions: DataFrame, out: str) -> None:
    """One file per problem of ``solutions`` (problem_id, changes, difficulty; more columns are ignored)."""
    solutions.sparkSession.dataSource.register(SolutionFiles)
    (solutions.select(F.col("problem_id").cast("string").alias("problem_id"),
                      F.col("changes").cast("array<int>").alias("changes"),
                      F.col("difficulty").cast("string").alias("difficulty"))
     .write.format("solution_files").mode("append").save(out))
