"""The row functions on unbounded input: each needs its own row only, so a stream takes them unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lipika.functions import text as T


def read(spark: SparkSession, folder: str, schema: StructType | str, per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def scored(stream: DataFrame, text: str = "text") -> DataFrame:
    """Each row with its words, syllables and bytes; stateless."""
    t = T.normalize(F.col(text))
    return stream.select("*", F.size(T.words(t)).alias("n_words"), F.size(F.filter(T.chunks(t), T.is_akshara)).alias("n_aksharas"), T.bytes_of(t).alias("n_bytes"))


def running_fertility(stream: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Syllables per word so far, for each value of ``by``; state is two sums a value."""
    rows = scored(stream, text)
    sums = rows.groupBy(by).agg(F.sum("n_words").alias("n_words"), F.sum("n_aksharas").alias("n_aksharas"))
    return sums.select("*", (F.col("n_aksharas") / F.col("n_words")).alias("fertility"))


def windowed_counts(stream: DataFrame, at: str, late: str = "10 minutes", width: str = "1 hour", text: str = "text") -> DataFrame:
    """Words for each window of event time; rows later than the watermark are dropped."""
    return scored(stream.withWatermark(at, late), text).groupBy(F.window(at, width)).agg(F.sum("n_words").alias("n_words"), F.count("*").alias("n_rows"))
