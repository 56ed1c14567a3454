"""What a word is, for all operators of this package: a run of anything but space, tab, LF, VT, FF and CR."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bytes_of(text: Column) -> Column:
    """UTF-8 bytes of a text as long; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; 0 for null and empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus``; null ids count as the empty text."""
    return (crc32_of(doc_id.cast("string")) % modulus).cast("int")
