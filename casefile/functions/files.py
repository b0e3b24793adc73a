"""Uploaded-file expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted extensions and the size limit of the upload form.
ALLOWED_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".txt", ".log")
MAX_BYTES = 20 * 1024 * 1024

KIB = 1024
MIB = 1024 * 1024


def extension(filename: Column) -> Column:
    """STR-3: a dot and the lower-cased text after the last dot."""
    return F.concat(F.lit("."), F.lower(F.substring_index(filename, ".", -1)))


def upload_error(filename: Column) -> Column:
    """FIL-8, FIL-9, STR-8: why a file is refused, or null."""
    # The three messages.
    return (
        F.when(
            F.coalesce(filename, F.lit("")) == "",
            F.lit("A file does not have a valid filename."),
        )
        .when(
            F.instr(filename, ".") == 0,
            F.concat(F.lit("File extension missing for "), filename, F.lit(".")),
        )
        .when(
            ~extension(filename).isin(*ALLOWED_EXTENSIONS),
            F.concat(F.lit("Unsupported file type: "), extension(filename)),
        )
    )


def fits_size_limit(size: Column) -> Column:
    """FIL-10: a file of exactly 20 MiB passes."""
    return F.coalesce(size, F.lit(0)) <= MAX_BYTES


def _fixed_point(scaled: Column, digits: int) -> Column:
    """Integer ``scaled`` = value * 10^digits, as decimal text."""
    unit = 10**digits
    whole = F.call_function("div", scaled, F.lit(unit))
    fraction = F.lpad((scaled % unit).cast("string"), digits, "0")
    return F.concat(whole.cast("string"), F.lit("."), fraction)


def size_text(size: Column) -> Column:
    """STR-5: bytes as B, KB (1 decimal) or MB (2 decimals), rounded half up.

    The rounding is done on integers: engines disagree on halves otherwise.
    """
    bytes_ = size.cast("bigint")
    tenths = F.shiftright(bytes_ * 10 + KIB // 2, 10)
    hundredths = F.shiftright(bytes_ * 100 + MIB // 2, 20)
    return (
        F.when(bytes_ < KIB, F.concat(bytes_.cast("string"), F.lit(" B")))
        .when(bytes_ < MIB, F.concat(_fixed_point(tenths, 1), F.lit(" KB")))
        .when(bytes_ >= MIB, F.concat(_fixed_point(hundredths, 2), F.lit(" MB")))
    )
