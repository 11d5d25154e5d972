"""Online mining and counting over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.text import strip
from millrace.operators.relational import dense_line_id_in_files
from millrace.plans.engine import Miner
from millrace.sources.formats import FORMATS, compile_format, parse_lines
from millrace.staging import exists, path_of

STATE = "cid long, template string, into long, learned array<struct<at:long,template:string,message:string>>"
#: Versions of the state that stay: the newest, and the one that a replay of its batch starts from.
VERSIONS = 2


def log_stream(spark: SparkSession, path: str, form: str, max_files: int = 100) -> DataFrame:
    """New log files as a stream of fields with ``file`` and ``block``, which number lines; ``max_files`` bound a batch."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    return parse_lines(lines.select(*place, strip(F.col("value")).alias("value")), compile_format(FORMATS.get(form, form)))


class OnlineMiner:
    """``foreachBatch`` mining with the template dimension kept as a table version per batch.

    A replayed batch starts from the version before it and overwrites its own output, so
    replays change nothing. Lines need Content, and LineId unless they come from ``log_stream``:
    then they are numbered on from the batches before. A version that is there but cannot be read is an error.
    """

    def __init__(self, folder: str, make: Callable[[], Miner] = Miner) -> None:
        self.folder, self.make = folder.rstrip("/"), make

    def _versions(self, spark: SparkSession, kind: str) -> list[int]:
        """Rising numbers of the batches that have ``kind``."""
        system, where = path_of(spark, f"{self.folder}/{kind}")
        if not system.exists(where):
            return []
        names = [f.getPath().getName() for f in system.listStatus(where)]
        # A batch counts once its writer has committed.
        done = [n for n in names if n.startswith("batch=") and exists(spark, f"{self.folder}/{kind}/{n}/_SUCCESS")]
        return sorted(int(n.removeprefix("batch=")) for n in done)

    def _state(self, spark: SparkSession, before: int) -> list[tuple]:
        last = max((n for n in self._versions(spark, "state") if n < before), default=None)
        if last is None:
            return []
        return [tuple(r) for r in spark.read.schema(STATE).parquet(f"{self.folder}/state/batch={last}").collect()]

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        miner = self.make()
        miner.restore(self._state(spark, batch_id))
        if "LineId" not in batch.columns:
            batch = dense_line_id_in_files(batch, "file", "block").drop("file", "block")
            batch = batch.withColumn("LineId", F.col("LineId") + self._lines_before(spark, batch_id))
        batch = batch.persist()
        miner.mine(batch).write.mode("overwrite").parquet(f"{self.folder}/lines/batch={batch_id}")
        state = spark.createDataFrame(miner.state(), STATE)
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch_id}")
        batch.unpersist()
        for old in [n for n in self._versions(spark, "state") if n <= batch_id][:-VERSIONS]:
            system, where = path_of(spark, f"{self.folder}/state/batch={old}")
            system.delete(where, True)

    def _lines_before(self, spark: SparkSession, batch_id: int) -> int:
        earlier = [n for n in self._versions(spark, "lines") if n < batch_id]
        paths = [f"{self.folder}/lines/batch={n}" for n in earlier]
        return spark.read.parquet(*paths).count() if paths else 0

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def lines(self, spark) -> DataFrame:
        """All lines so far; each batch's lines have the template that held then."""
        return spark.read.parquet(f"{self.folder}/lines")


def windowed_counts(events: DataFrame, template: str = "EventTemplate", time: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, template, Occurrences over event time; works on batches and on streams."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    counts = rows.groupBy(F.window(time, width).alias("w"), template).agg(F.count("*").alias("Occurrences"))
    return counts.select(F.col("w.start").alias("window_start"), template, "Occurrences")
