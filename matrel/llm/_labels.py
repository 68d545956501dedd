"""The labelled rows that models learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows a model learns from, at most: those with the least hashes of their ids. Bounds the fit, not the scoring.
SAMPLE = 20_000


def held_out(key: Column) -> Column:
    """Rows whose crc32 of the key as text leaves no rest modulo 5: never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", key: str = "doc_id", most: int = SAMPLE) -> DataFrame:
    """Rows ``text, y`` to learn ``label`` from: labelled 0 or 1, not held out, at most ``most`` labelled keys.

    Null keys and labels, and other labels, count for nothing. A key labelled twice or both ways gives a row for each label, and one for each
    of its texts; a null text counts as empty. Empty tables give an empty one.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
    chosen = usable.select(F.col(key).alias("id"), F.col(label).cast("double").alias("y"), F.xxhash64(F.lit(label), key).alias("h")).orderBy("h", "y").limit(most).drop("h")
    # `most` short rows: a bounded broadcast
    return docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("text", "y")
