"""Byte-wise string functions, digests, paths and times as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Nucleotide codes of a canonical sequence, and ASCII white space.
ALPHABET = "ACGTRYSWKMBDHVN"
WHITE = r"[ \t\r\n\f\x0b]"


def ascii_upper(text: Column) -> Column:
    """Upper case of ASCII letters only: others, such as a sharp s, must not become two letters."""
    return F.translate(text, LOWER, UPPER)


def digest(data: Column) -> Column:
    """sha256 with its prefix, of bytes or of a text's UTF-8 bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(data.cast("binary"), 256))


def canonical_bases(text: Column) -> Column:
    """A sequence in upper case without white space."""
    return F.regexp_replace(ascii_upper(text), WHITE, "")


def is_canonical(bases: Column) -> Column:
    return F.coalesce(bases.rlike(f"^[{ALPHABET}]+$") & ~bases.contains("\n"), F.lit(False))


def is_safe_path(path: Column) -> Column:
    """Relative, without .. parts and backslashes, not empty and not a dot."""
    safe = ~path.startswith("/") & ~path.contains("\\") & ~path.isin("", ".") & ~path.rlike(r"(^|/)\.\.(/|$)")
    return F.coalesce(safe, F.lit(False))


def entity_of(accession: Column) -> Column:
    """An accession without its last dot and what follows it."""
    return F.regexp_replace(accession, r"\.[^.]*$", "")


def utc(text: Column) -> Column:
    """An ISO time with offset as the same time with Z; null if it has no offset or is no time."""
    offset = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    time = F.try_to_timestamp(text)
    fraction = F.when(F.date_format(time, "SSSSSS") == "000000", F.lit("")).otherwise(F.concat(F.lit("."), F.date_format(time, "SSSSSS")))
    return F.when(offset, F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z")))
