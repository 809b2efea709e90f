"""Run a streaming query to completion (``availableNow``) into a parquet table.

Sinks and checkpoints live below the shared ``spark.checkpoint.dir`` (a new
folder per run), so a restarted driver or a lost executor resumes from the
checkpoint.  Append-mode results are the sink files.  Update-mode results are
written by ``foreachBatch`` (see ``UpdateSink``); the table's current contents
are, per key, the row of the latest batch that touched the key.

Rows that come later than a watermark allows are dropped by Spark; the runner reads their number from
the query's progress and fails if there are any, so that no result is short without a word.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.session import scratch_path


class LateRows(RuntimeError):
    """Rows were later than the operator's delay allows; ``n`` of them (as the operators count)."""

    def __init__(self, name: str, n: int):
        super().__init__(f"{name}: {n} rows came later than the watermark's delay; ask for a longer delay")
        self.n = n


def _finish(query, name: str) -> None:
    query.awaitTermination()
    late = sum(op.get("numRowsDroppedByWatermark") or 0 for p in query.recentProgress
               for op in json.loads(p.json if hasattr(p, "json") else json.dumps(p)).get("stateOperators", []))
    if late:
        raise LateRows(name, late)


def _keep_progress(spark: SparkSession) -> None:
    """All batches of a run stay in the query's progress, not only the last hundred."""
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100000")


def run_append(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    _keep_progress(spark)
    sink, ckpt = scratch_path(spark, f"{name}-sink"), scratch_path(spark, f"{name}-ckpt")
    q = (stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    _finish(q, name)
    return spark.read.schema(stream.schema).parquet(sink)


#: Batches between two looks at what could be folded.
FOLD_EVERY = 4


class UpdateSink:
    """The table that an update-mode stream keeps, as runs of batches below ``path``.

    Batch n is written as run ``n-n``, over whatever an earlier attempt left.  Every ``FOLD_EVERY`` batches the
    runs from the first one that is no larger than all after it are folded, per key, into one run
    ``first-last``; after a fold each run is larger than all later ones together, so a row is rewritten a
    logarithmic number of times and a reader reads at most about twice the largest run.  A run counts
    when its write has ended (``_SUCCESS``); folded runs are deleted after that, and where a failure left
    some, or half a fold, readers go by the widest complete runs.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.schema = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
        self.columns = schema.names

    def _folder(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[tuple[int, int, int]]:
        """(first batch, last batch, bytes) of the complete runs that cover all batches, widest first, in order."""
        jvm, top, fs = self._folder()
        found: dict[int, tuple[int, int]] = {}
        for entry in fs.listStatus(top) if fs.exists(top) else []:
            m = re.fullmatch(r"run-(\d+)-(\d+)", entry.getPath().getName())
            if m and fs.exists(jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
                first, last = int(m[1]), int(m[2])
                if last not in found or first < found[last][0]:
                    found[last] = (first, fs.getContentSummary(entry.getPath()).getLength())
        out, at = [], max(found, default=-1)
        while at >= 0:
            if at not in found:
                raise RuntimeError(f"{self.path}: batch {at} is missing")
            first, size = found[at]
            out.append((first, at, size))
            at = first - 1
        return out[::-1]

    def _read(self, runs: Sequence[tuple[int, int, int]]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/run-{a}-{b}" for a, b, _ in runs])

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.columns if c not in self.keys]
        g = rows.groupBy(*self.keys).agg(F.max(F.struct("batch_id", *rest)).alias("_l"))
        return g.select(*self.keys, *[F.col(f"_l.{c}").alias(c) for c in [*rest, "batch_id"]]).select(*self.schema.names)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).select(*self.schema.names).write.mode("overwrite").parquet(
            f"{self.path}/run-{batch_id}-{batch_id}")
        if batch_id % FOLD_EVERY == FOLD_EVERY - 1:
            self.fold()

    def fold(self) -> None:
        runs = self.runs()
        later = [sum(size for _, _, size in runs[i + 1:]) for i in range(len(runs))]
        some = next((runs[i:] for i in range(len(runs) - 1) if runs[i][2] <= later[i]), [])
        if not some:
            return
        self._latest(self._read(some)).write.mode("overwrite").parquet(f"{self.path}/run-{some[0][0]}-{some[-1][1]}")
        jvm, _, fs = self._folder()
        for a, b, _ in some:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/run-{a}-{b}"), True)

    def table(self) -> DataFrame:
        """The current contents."""
        runs = self.runs()
        rows = self._read(runs) if runs else self.spark.createDataFrame([], self.schema)
        return self._latest(rows).select(*self.columns)


def run_update(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    spark = stream.sparkSession
    _keep_progress(spark)
    sink = UpdateSink(spark, scratch_path(spark, f"{name}-sink"), stream.schema, keys)
    ckpt = scratch_path(spark, f"{name}-ckpt")
    q = (stream.writeStream.foreachBatch(sink.write).option("checkpointLocation", ckpt)
         .outputMode("update").trigger(availableNow=True).start())
    _finish(q, name)
    return sink.table()
