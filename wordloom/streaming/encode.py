"""Tokenization of streams. All stages on Columns are row-wise, so a stream needs no state for them; counts by window
are kept with a watermark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tokenizer import EncodeOptions, Tokenizer


def encode_stream(stream: DataFrame, tokenizer: Tokenizer, text: str = "text", options: EncodeOptions = EncodeOptions()) -> DataFrame:
    """The stream with a column ``encoding``."""
    return stream.withColumn("encoding", tokenizer.encode_as_encoding(F.col(text), options))


def windowed_tokens(stream: DataFrame, tokenizer: Tokenizer, time: str, text: str = "text", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tokens by window of event time; a window closes once the watermark has passed it."""
    counted = stream.withColumn("n_tokens", F.size(tokenizer.tokenize(F.col(text), False)).cast("long"))
    return counted.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens"))


def work_dir(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share; a local one only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="wordloom-stream-")
    return f"{base.rstrip('/')}/wordloom-{uuid.uuid4().hex}/{name}"


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Processes all that a stream holds now and returns the result as a table."""
    spark = stream.sparkSession
    path = work_dir(spark, "result")
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", work_dir(spark, "checkpoint")).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
