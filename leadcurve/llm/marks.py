"""Finding again the documents that few or many ids name, without shuffling texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOT_BITS = 23


def _slot(column: str) -> str:
    return f"((coalesce({column}, -1) ^ shiftright(coalesce({column}, -1), {SLOT_BITS})) & {(1 << SLOT_BITS) - 1})"


def marked_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with a column marked: true for those named by ``ids`` (doc_id), and perhaps for a few more.

    The ids mark bits of a table of fixed size (2 ** 17 words of 64 bits at
    most), so that alone is broadcast however many ids there are, and no text
    is shuffled.
    """
    marks = ids.selectExpr(f"{_slot('doc_id')} as slot").groupBy(F.expr("shiftright(slot, 6) as word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int))) as bits"))
    found = docs.withColumn("slot", F.expr(_slot("doc_id"))).join(F.broadcast(marks), F.expr("shiftright(slot, 6) = word"), "left")
    return found.withColumn("marked", F.expr("coalesce(bit_get(bits, cast(slot & 63 as int)) = 1, false)")).drop("slot", "word", "bits")
