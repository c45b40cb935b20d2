"""New source files as a stream: each micro-batch is chunked, chunks and drops go to their tables once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgraph.operators.curate import chunks
from kgraph.sources.documents import write_stage


def chunk_stream(spark: SparkSession, folder: str, out: str, state: str, once: bool = True) -> StreamingQuery:
    """Chunks to out/chunks and drops to out/dropped, from *.md files as they arrive; state is the stream's checkpoint folder.

    Every micro-batch has a folder of its own in both (a column `batch` when read), which it replaces: a batch that is delivered again
    after a failure adds nothing, and no batch reads what came before it. The stream itself takes each file once.
    """
    src = spark.readStream.schema("value string").option("pathGlobFilter", "*.md").option("wholetext", True).text(folder)
    texts = src.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))

    def batch(df, n):
        good, drops = chunks(df)
        write_stage(good, f"{out}/chunks/batch={n}")
        write_stage(drops, f"{out}/dropped/batch={n}")

    w = texts.writeStream.foreachBatch(batch).option("checkpointLocation", state)
    return (w.trigger(availableNow=True) if once else w).start()
