"""Plans made of the column functions: what a corpus's octets weigh, and cheap filters before dear decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs


def intact_by(docs: DataFrame, key: str, text: str, codec: str = "gzip", **options) -> DataFrame:
    """By key: rows, octets, and rows that come back unchanged through a codec. Combined before the shuffle."""
    octets = F.encode(F.col(text), "UTF-8")
    d = docs.select(key, octets.alias("octets"))
    d = d.withColumn("back", codecs.decode(codecs.encode(F.col("octets"), codec, **options), codec))
    return d.groupBy(key).agg(
        F.count("*").alias("n_docs"), F.sum(F.octet_length("octets")).cast("bigint").alias("octets"),
        F.sum((F.col("back") == F.col("octets")).cast("int")).cast("bigint").alias("intact"),
    )


def decode_where_marked(df: DataFrame, coded: str, codec: str, max_output_len: int | None = None) -> DataFrame:
    """Rows whose first octets could be of the codec, with their verdict `v`; the filter is built in and runs first."""
    return df.where(codecs.has_magic(F.col(coded), codec)).withColumn("v", codecs.try_decode(F.col(coded), codec, max_output_len))
