"""Word columns shared by the text operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.staging import stage

#: The ASCII white space that separates words.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    An array inside a lambda would otherwise be computed again for each element.
    """
    return F.transform(F.array(value), body)[0]


def full_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; other alphabets stay as they are."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of other characters than ASCII white space; none for null."""
    bare = F.btrim(full_text(text), F.lit(SPACE_CHARS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def byte_size(text: Column) -> Column:
    return F.octet_length(full_text(text)).cast("long")


def crc(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes."""
    return F.crc32(full_text(text).cast("binary"))


def is_held_out(doc_id: Column) -> Column:
    """Rows from which no label is learned: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(crc(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def packed_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets a computed column's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def located(df: DataFrame) -> DataFrame:
    """(row, _file, _at): each row as a struct, and where it is stored; frames that are not read from files are staged."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    try:
        return df.select(packed_row(df), *place)
    except AnalysisException:
        written = stage(df.select(packed_row(df)), "rows")
        return written.select("row", *place)
