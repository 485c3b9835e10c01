"""Incremental ingestion of landed search responses (Structured Streaming).

New response files in a landing folder are read as a stream, flattened to
canonical articles (S1/S2, stateless) and de-duplicated on the namespaced id
(D1/D2: the first arrival of an id is kept; state lives in the checkpoint).
The per-query cap of the batch reader needs a global order over pages, so the
stream keeps every result and leaves capping to the batch job. The dedup state
is bounded: an id is remembered for ``remember`` after it was last read, so a
copy that arrives later passes, and the batch job removes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperlens.functions.coerce import dedup_key
from paperlens.schemas import SEARCH_RESPONSE_SCHEMA
from paperlens.sources.landed import extract_metadata


def stream_articles(spark: SparkSession, landing_dir: str, max_files_per_trigger: int = 1000,
                    dedup: bool = True, remember: str = "7 days") -> DataFrame:
    """Streaming DataFrame of canonical articles from landed response pages; ``read_at`` is
    when a page was read."""
    pages = (spark.readStream.schema(SEARCH_RESPONSE_SCHEMA)
             .option("maxFilesPerTrigger", max_files_per_trigger).json(landing_dir))
    rows = pages.select("query", "page", F.posexplode("resultList.result").alias("pos", "raw"))
    arts = rows.select("query", "page", "pos", *extract_metadata("raw"))
    arts = arts.withColumn("uid", dedup_key()).withColumn("read_at", F.current_timestamp())
    return arts.withWatermark("read_at", remember).dropDuplicatesWithinWatermark(["uid"]) if dedup else arts


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """A folder under the cluster's ``spark.checkpoint.dir`` (set one only if unset)."""
    from paperlens.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def write_articles(stream: DataFrame, out_path: str, name: str = "articles",
                   checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Append the stream to a Parquet table; exactly-once through the checkpoint."""
    w = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", out_path)
         .option("checkpointLocation", checkpoint or checkpoint_location(stream.sparkSession, name)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
