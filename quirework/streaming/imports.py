"""A stream of pastes into a table of items. The reference has no streams; this wraps the batch functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirework.functions.detect import chunks, items
from quirework.functions.text import doi_lookup


def stream_items(pastes: DataFrame) -> DataFrame:
    """Items of streamed pastes (paste_id, text, at): stateless, so any output mode will do."""
    each = pastes.select("paste_id", "at", F.explode(chunks(F.col("text"))).alias("chunk"))
    return each.select("paste_id", "at", F.explode(items(F.col("chunk"))).alias("item")).select("paste_id", "at", "item.*")


def first_dois(found: DataFrame, late: str = "1 hour") -> DataFrame:
    """Items whose DOI did not come before within the watermark of a paste; other items pass."""
    keyed = found.withColumn("key", F.when(F.col("format") == "doi", doi_lookup(F.col("value"))).otherwise(F.sha2("raw", 256)))
    return keyed.withWatermark("at", late).dropDuplicatesWithinWatermark(["paste_id", "key"]).drop("key")


def write_items(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append items to a Parquet table until the input that is there has been read."""
    return found.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
