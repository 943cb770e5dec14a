"""Text rules. White space is the Unicode class that a document strips, not only ASCII."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points of Unicode white space, as a regular expression class.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Characters that speak for a decoding, twice and once, and against it.
HANGUL, PRINTABLE = r"[\uAC00-\uD7A3]", r"[\x20-\x7e]"
BAD = r"[\uFFFD\uE000-\uF8FF\x00-\x08\x0b\x0c\x0e-\x1f]"
# The ranges of East Asian scripts.
CJK = r"[\x{1100}-\x{11FF}\x{2E80}-\x{9FFF}\x{A960}-\x{A97F}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
SHEET_NAME_MAX, DEFAULT_SHEET = 31, "Sheet"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{SPACE}]")


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def normal_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def html_escape(text: Column, quote: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("'", "&#x27;")] if quote else [])]
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def visual_length(text: Column) -> Column:
    """Code points, those from U+1101 on counted twice."""
    return (F.length(text) + F.regexp_count(text, F.lit(r"[\x{1101}-\x{10FFFF}]"))).cast("long")


def display_width(text: Column) -> Column:
    """The visual length of the first line."""
    return visual_length(F.split(text, "\n", 2)[0])


def sheet_name(name: Column) -> Column:
    """A name that a workbook takes: no ``[ ] : * ? / \\``, no quote at the ends, 31 characters."""
    flat = F.translate(F.translate(name, "[]:*?/\\", "_______"), "\n\r", "  ")
    bare = F.regexp_replace(strip(flat), "^'+|'+$", "")
    return F.substring(F.when(bare == "", DEFAULT_SHEET).otherwise(bare), 1, SHEET_NAME_MAX)


def default_sheet_name(name: Column, number: Column) -> Column:
    bare = strip(F.coalesce(name, F.lit("")))
    return sheet_name(F.when(bare == "", F.concat(F.lit("표"), number.cast("string"))).otherwise(bare))


def file_stem(name: Column) -> Column:
    return F.translate(name, '\\/:*?"<>|', "_________")


def human_size(size: Column) -> Column:
    """B without decimals; KB, MB and GB with one."""
    n = size.cast("double")
    one = lambda x, unit: F.concat(F.format_string("%.1f", x), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1024**2, one(n / 1024, " KB")).when(n < 1024**3, one(n / 1024**2, " MB")).otherwise(one(n / 1024**3, " GB"))


def text_score(text: Column) -> Column:
    """How well text was decoded: Hangul counts twice, printable ASCII once, signs of bad decoding against."""
    hangul, printable, bad = (F.regexp_count(text, F.lit(c)) for c in (HANGUL, PRINTABLE, BAD))
    n = F.length(text).cast("double")
    return F.when(F.length(text) == 0, 0.0).otherwise((hangul * 2 + printable).cast("double") / n * 100 - bad.cast("double") / n * 400)


def delimiter_by_count(text: Column, lines: int = 40) -> Column:
    """The most frequent of comma, semicolon, tab and bar in the first lines, in this order on ties."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
    counts = [(F.length(head) - F.length(F.replace(head, F.lit(d), F.lit(""))), d) for d in (",", ";", "\t", "|")]
    best = F.greatest(*(c for c, _ in counts))
    choice = F.lit("|")
    for c, d in reversed(counts):
        choice = F.when(c == best, d).otherwise(choice)
    return F.when(best == 0, ",").otherwise(choice)


def unescape_delimiter(text: Column) -> Column:
    return F.when(text.isin("\\t", "tab"), "\t").when(text == "\\;", ";").otherwise(text)


def html_unescape(text: Column) -> Column:
    """Character references as characters: all names of HTML with their semicolon, the old ones also without, numbers.

    Unknown names stay as they are; numbers that are no character become U+FFFD, those of the C1
    range are read in the Western code page, as browsers do.
    """
    # numbers 128 to 159 by the code page's own rule, which leaves five as they are
    western = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
    names = F.from_json(F.lit(json.dumps(html5 | {f"#{n}": ch for n, ch in western.items()})), "map<string,string>")

    def one(piece: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(piece, "^&#[xX]?0*|;$", ""), "^$", "0")
        base = F.rlike(piece, F.lit("^&#[xX]"))
        short = F.when(F.length(digits) <= 7, digits).otherwise(F.lit("0"))
        n = F.when(base, F.conv(short, 16, 10)).otherwise(F.conv(short, 10, 10)).cast("long")
        n = F.when((n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), 0xFFFD).otherwise(n)
        numbered = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        number = F.coalesce(F.try_element_at(names, F.concat(F.lit("#"), n.cast("string"))), numbered)
        usual = F.when(piece == "&amp;", "&").when(piece == "&lt;", "<").when(piece == "&gt;", ">").when(piece == "&quot;", '"').when(piece == "&nbsp;", "\u00a0")  # the map is looked through from its beginning
        name = F.coalesce(usual, F.try_element_at(names, F.substring(piece, 2, 64)), piece)
        return F.when(F.rlike(piece, F.lit("^&#[0-9]|^&#[xX][0-9A-Fa-f]")), number).when(F.rlike(piece, F.lit("^&[A-Za-z]")), name).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit("&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;?)?|[^&]+"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(text)
