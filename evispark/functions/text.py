"""String expressions with the exact edge cases the operators rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense.
SPACE_CHARS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(x: Column) -> Column:
    """Without white space (Unicode) at either end; ``trim`` alone would take blanks only."""
    return F.trim(x, F.lit(SPACE_CHARS))


def blank(x: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(x) == "", F.lit(True))


def first_filled(*xs: Column) -> Column:
    """The first that is neither null nor empty, then stripped; '' if none is.

    White space only counts as filled: it wins and becomes ''.
    """
    return strip(F.coalesce(*(F.nullif(x.cast("string"), F.lit("")) for x in xs), F.lit("")))


def humanise(x: Column) -> Column:
    """``snake_case`` as ``Title Case``."""
    return F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))


def slugify(x: Column) -> Column:
    kept = F.regexp_replace(F.lower(strip(x)), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(kept, r"(?U)[\s_-]+", "_")


def unix_lines(x: Column) -> Column:
    return F.regexp_replace(x, r"\r\n?", "\n")


def markdown_cell(x: Column) -> Column:
    """A table cell: pipes escaped, line ends as blanks, stripped; null is ''."""
    return strip(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def markdown_row(cells: Column, width: Column) -> Column:
    """``| a | b |`` with exactly ``width`` cells."""
    padded = F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), F.lit(1), width)
    return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))


def markdown_table(rows: Column) -> Column:
    """Array of rows (arrays of strings), the first being the header, as a markdown table; '' without header cells."""
    clean = F.transform(rows, lambda r: F.transform(r, markdown_cell))
    width = F.size(F.get(clean, F.lit(0)))
    lines = F.transform(clean, lambda r: markdown_row(r, width))
    rule = F.array(markdown_row(F.array_repeat(F.lit("---"), width), width))
    table = F.array_join(F.concat(F.slice(lines, 1, 1), rule, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
    return F.when((F.size(rows) > 0) & (width > 0), table).otherwise("")


def is_iso_date(x: Column) -> Column:
    """``dddd-dd-dd``; the calendar isn't checked. Null is null."""
    return F.rlike(x, F.lit(r"^\d{4}-\d{2}-\d{2}$"))


def is_web_address(x: Column) -> Column:
    """Scheme http or https, and a host; false for null."""
    scheme = F.lower(F.call_function("try_parse_url", x, F.lit("PROTOCOL")))
    return F.coalesce(scheme.isin("http", "https") & (F.call_function("try_parse_url", x, F.lit("HOST")) != ""), F.lit(False))


#: Where Windows-1252 has other characters than Latin-1.
_LATIN = "".join(map(chr, range(128, 160)))
_WINDOWS = "".join(bytes([b]).decode("cp1252", "replace").replace("\ufffd", chr(b)) for b in range(128, 160))


def read_text(content: Column) -> Column:
    """Bytes as text: UTF-8, else Windows-1252."""
    as_is = content.cast("string")
    return F.when(F.is_valid_utf8(as_is), as_is).otherwise(F.translate(F.decode(content, "ISO-8859-1"), _LATIN, _WINDOWS))
