"""Text to candidate lines: explode, clean, split, gate and deduplicate."""

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlode.functions.regex import LINE_BREAK
from offerlode.functions.text import (
    clean_lines, fits_line_length, is_noise_line, is_packed, keep_rows, split_packed,
)
from offerlode.operators.signals import may_have_signal, with_folded

PASS_TEXT = 1 << 40
PART_BITS = 31


def explode_text(pages: DataFrame, text: str = "text", line_no: str = "line_no") -> DataFrame:
    """One row per line of ``text``; a text cell is the unit, so no row is unbounded."""
    keep = [name for name in pages.columns if name != text]
    return pages.select(
        *keep, F.posexplode(F.split(F.col(text), LINE_BREAK)).alias(line_no, "line"))


def text_position(line_no: str, part_no: str = "part_no", part_bits: int = PART_BITS) -> Column:
    """Order of a part among all parts of its page, as one bigint.

    A text cell is shorter than 2^31, so line and part numbers both fit 31 bits; callers
    with larger line numbers and few parts pass a smaller ``part_bits``.
    """
    line = F.col(line_no).cast("bigint")
    return F.shiftleft(line, part_bits) + F.col(part_no).cast("bigint")


def explode_parts(lines: DataFrame, line: str = "line") -> DataFrame:
    """Clean each line, split packed ones, clean the pieces; adds ``part_no``, ``part``.

    A part may be empty; ``offer_lines`` drops those.
    """
    keep = [name for name in lines.columns if name != line]
    cleaned = clean_lines(lines, line)
    pieces = cleaned.select(
        *keep, is_packed(F.col(line)).alias("_packed"),
        F.posexplode(split_packed(F.col(line))).alias("part_no", "part"))
    return clean_lines(pieces, "part", only="_packed").drop("_packed")


@lru_cache(maxsize=1)
def _wanted() -> Column:
    return (
        fits_line_length(F.col("part")) & may_have_signal(F.col("fold"))
        & ~is_noise_line(F.col("offer"), F.col("low"), F.col("fold")))


def offer_lines(parts: DataFrame, always: Column | None = None) -> DataFrame:
    """Parts that may be offers: right length, maybe a signal, not noise; cheap tests first.

    Returns the columns of ``parts`` with ``part`` replaced by ``offer`` and ``fold``.  Rows
    for which ``always`` holds stay whatever their text.
    """
    keep = tuple(name for name in parts.columns if name != "part")
    cleaned = clean_lines(
        parts.select("*", F.col("part").alias("offer")), "offer", only_if_left=True,
        also=("_left", "_left_fold"))
    ready = with_folded(cleaned, same=("_left", "_left_fold"))
    wanted = _wanted() if always is None else always | _wanted()
    return keep_rows(ready, wanted, keep, ("offer", "fold"))


def first_positions(lines: DataFrame, position: Column, keys: tuple[str, ...]) -> DataFrame:
    """One row per page and exact text, at its first position.

    Grouping by text as well as page spreads a hot page over all tasks, and the partial
    aggregate removes repeats before the shuffle.
    """
    return lines.groupBy(*keys, "offer").agg(F.min(position).alias("ord_lo"))
