"""Cutting texts into overlapping word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_text(text: Column) -> Column:
    """White space made single, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def chunk_words(docs: DataFrame, key: str, text: str = "text", size: int = 256, overlap: int = 32, most_words: int | None = 2000, least_words: int = 0) -> DataFrame:
    """(key, pos, chunk, n_words): windows of `size` words every `size - overlap`, the last one ending with the text.

    `most_words` bounds a text as the retrieval it feeds does (None: whole texts);
    windows below `least_words` are dropped, an only one too. Null and blank texts give
    no row. A chunk's id is (key, pos), whatever the partitions.
    """
    words = F.filter(F.split(clean_text(F.col(text)), " "), lambda w: w != "")
    if most_words is not None:
        words = F.slice(words, 1, most_words)
    step = size - overlap
    rows = docs.select(key, words.alias("_w")).filter(F.size("_w") > 0).withColumn("_n", F.size("_w"))
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / step)).cast("int")
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), last)))
    chunk = F.slice("_w", F.col("pos") * step + 1, F.lit(size))
    out = rows.select(key, "pos", F.array_join(chunk, " ").alias("chunk"), F.size(chunk).alias("n_words"))
    return out.filter(F.col("n_words") >= least_words) if least_words else out


def whole_notes(chunks: DataFrame, key: str, most: int) -> DataFrame:
    """Chunks of whole texts, in order of key, until `most` is reached (the text that reaches it is kept whole)."""
    per = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At most `most` texts can be kept, and each has a chunk, so the first `most` of them suffice.
    kept = per.orderBy(key).limit(most).withColumn("_before", before).filter(F.col("_before") < most).select(key)
    return chunks.join(kept, key, "left_semi")
