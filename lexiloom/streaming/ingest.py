"""Incremental ingestion: files that keep arriving in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.statistics import document_statistics
from ..sources import files
from ..sources.files import with_file_name


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str | None = None) -> StreamingQuery:
    """Process all files not seen before, then stop; run it again for later files.

    Ingestion and statistics are row-local, so each micro-batch runs the batch
    operators unchanged. A batch writes to folders named after its id: if it is
    repeated after a failure, it overwrites its own output. Files of length 0
    never reach a stream; ``files.read_files`` reports those a manifest lists.
    """
    arrived = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True)
        .load(folder)
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        received = with_file_name(batch).select("path", "file_name", "content").persist()
        documents = files.ingest_documents(received)
        outputs = {
            "documents": documents,
            "ingest_errors": files.ingest_errors(received),
            "document_statistics": document_statistics(documents, text="raw_text"),
        }
        for name, table in outputs.items():
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        received.unpersist()

    return (
        arrived.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint or f"{out}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
