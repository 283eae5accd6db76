"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.session import cut, shared_folder, table

__all__ = ["HELD_OUT_REMAINDER", "cut", "held_out", "keeping", "shared_folder", "spread", "table"]

#: The rows that a classifier may learn labels from have another remainder than this.
HELD_OUT_REMAINDER = 2


def spread(scan: DataFrame) -> DataFrame:
    """A scan of files, dealt to all cores where it has fewer parts than there are (a few files of one row group each).

    For work that is much dearer than moving the rows; a scan of many parts, as a large table's, is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the rows whose labels nothing learns from; a null id counts as held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(True))


def keeping(docs: DataFrame, keep: tuple[str, ...]) -> tuple[list[Column], list[str], str]:
    """Columns to carry through a function under names of their own, whatever they are called: columns, names, schema."""
    names = [f"_keep_{k}" for k in range(len(keep))]
    columns = [F.col(f"`{c}`").alias(n) for n, c in zip(names, keep)]
    return columns, names, "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep))
