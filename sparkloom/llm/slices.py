"""Tables cut into slices of doc_ids: range partitions, streamed through, so that their number is bounded and their size is not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import with_columns

MOST_SLICES = 50_000


def sliced(docs: DataFrame, slice_chars: int, descending: bool = False, most: int = MOST_SLICES) -> DataFrame:
    """doc_id and text, a slice in each partition, partitions and rows in order of doc_id, nulls last; equal doc_ids by a hash of the text.

    A doc_id with many rows (a null one, too) is parted by that hash, and equal rows by their place in the input. Beyond ``most`` slices they grow longer
    than ``slice_chars``; whoever reads a partition holds a bounded part of it at a time.
    """
    docs = with_columns(docs, "doc_id", "text")
    size = docs.agg(F.sum(F.length("text"))).head()[0] or 0
    place = F.monotonically_increasing_id().alias("_place")
    order = [F.desc_nulls_last("doc_id") if descending else F.asc_nulls_last("doc_id"), F.xxhash64("text"), F.col("_place")]
    cut = docs.select("doc_id", "text", place).repartitionByRange(min(most, int(size // slice_chars) + 1), *order)
    return cut.sortWithinPartitions(*order).select("doc_id", "text")
