"""Traces as they arrive: each micro-batch goes through the batch transforms, and a batch that runs again replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lociflow.operators.calls import call_bases
from lociflow.sources.abif import decode_traces

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_calls(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*.ab1", files_a_batch: int = 1_000) -> StreamingQuery:
    """Calls below out/calls and failed traces below out/errors, in a folder for each batch; ends when the folder is read."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).load(folder)

    def each(batch: DataFrame, number: int) -> None:
        traces = decode_traces(batch).persist()
        call_bases(traces).write.mode("overwrite").parquet(f"{out}/calls/batch={number}")
        traces.where("error_class IS NOT NULL").select("input_name", "error_class", "error_message").write.mode("overwrite").parquet(f"{out}/errors/batch={number}")
        traces.unpersist()

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
