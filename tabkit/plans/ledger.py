"""Steps of a long run, noted in the shared checkpoint folder, so that a run that was cut off goes on where it stood.

A step is a table. It is written first and noted after, so a note stands for a whole table; what a lost run wrote without a
note is never read. Notes are small Parquet files of one row per step, which is all the driver sees; steps may be made at once by several threads.
"""

from __future__ import annotations

import io
import json
import os
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tabkit.session import checkpoint_dir

_NOTE = "step string, path string, rows long, schema string, settings string, noted double"
_NOTED = [field.split()[0] for field in _NOTE.split(", ")]


class Ledger:
    """The steps of the run ``run_id``. ``settings`` must be those the run began with."""

    def __init__(self, spark: SparkSession, run_id: str, settings: Mapping | None = None):
        if not run_id or os.path.basename(run_id) != run_id:
            raise ValueError(f"a run is named by one plain word, not {run_id!r}")
        self.spark = spark
        self.folder = os.path.join(checkpoint_dir(spark), "tabkit", "runs", run_id)
        self.settings = json.dumps(dict(settings or {}), sort_keys=True, default=str)
        self.notes = {r["step"]: r for r in sorted(self._read(), key=lambda r: r["noted"], reverse=True)}  # the first note of a step counts
        begun = {r["settings"] for r in self.notes.values()}
        if begun - {self.settings}:
            raise ValueError(f"run {run_id!r} was begun with other settings: {begun.pop()}; now {self.settings}")

    def _read(self) -> list:
        try:
            return self.spark.read.schema(_NOTE).parquet(os.path.join(self.folder, "notes")).collect()
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def has(self, step: str) -> bool:
        return step in self.notes

    def step(self, step: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """The table of a step: read again if it was noted, else made, written and noted. Rows with one value of the last column ``by`` get a folder."""
        if step not in self.notes:
            made = make()
            path = os.path.join(self.folder, "tables", f"{step}-{uuid.uuid4().hex}")
            writer = made.write.option("compression", "zstd")
            (writer.partitionBy(by) if by else writer).parquet(path)
            self._note(step, path, made.schema.json())
        return self.tables([step])

    def tables(self, steps: Sequence[str]) -> DataFrame:
        """Noted steps with the same columns, read as one table."""
        schema = StructType.fromJson(json.loads(self.notes[steps[0]]["schema"]))
        return self.spark.read.schema(schema).parquet(*[self.notes[s]["path"] for s in steps])

    def rows(self, step: str) -> int:
        """Rows of a noted step."""
        return self.notes[step]["rows"]

    def _note(self, step: str, path: str, schema: str) -> None:
        rows = self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(path).count()
        note = (step, path, rows, schema, self.settings, time.time())
        sink = io.BytesIO()
        pq.write_table(pa.table([pa.array([v]) for v in note], names=_NOTED), sink)
        self._add(sink.getvalue())
        self.notes[step] = dict(zip(_NOTED, note, strict=True))

    def _add(self, note: bytes) -> None:
        """One more file among the notes. It gets its name when it is whole, and notes written at once do not meet."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, "notes"))
        files = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        files.mkdirs(folder)
        name = uuid.uuid4().hex
        begun, whole = (jvm.org.apache.hadoop.fs.Path(folder, f"{x}{name}.parquet") for x in ("_", "note-"))
        out = files.create(begun)
        out.write(bytearray(note))
        out.close()
        if not files.rename(begun, whole):
            raise OSError(f"the note {whole} cannot be named")
