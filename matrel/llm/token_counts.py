"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that come back as
their own single token are proven. A text falls into pre-tokens; one that is in that table counts
one without any merging, only the others are merged. What a part between spaces counts
is remembered while the worker lives, within a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.llm import _chunks, _words
from matrel.llm._io import table


def proven_tokens(path: str | None = None) -> dict[str, int]:
    """Vocabulary strings that encode alone as one token, with their ids."""
    return dict(_chunks.proven(path or _chunks.default_path()))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``key, n_bytes, n_tokens, over_limit``, one for each row of ``docs``.

    Counts are those of the tokenizers library for the byte-level BPE file at
    ``path``, without added special tokens; special strings inside a text count as
    the library's default has it (one token). A null text counts as empty (0 bytes,
    0 tokens, not over the limit); a null key stays null; repeated rows give
    repeated rows; an empty table gives an empty one; other columns are ignored,
    whatever their names. Texts are counted whole, whatever their length.
    """
    path = path or _chunks.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _chunks.encoder(path)
        for batch in (part for whole in batches for part in _words.slices(whole, "text")):
            n = [encoder.count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2)], names=["key", "n_tokens", "n_bytes"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(_words.tidy(run), f"key {kind}, n_tokens long, n_bytes long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))
