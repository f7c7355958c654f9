"""Whitespace trimming and character-reference decoding as JVM expressions."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import fixed_map

# Python's str.strip() set: Unicode White_Space plus the four ASCII separators.
_SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Remove Unicode whitespace at both ends; inner whitespace stays."""
    head = F.regexp_replace(c, rf"^{_SPACE}++", "")
    return F.regexp_replace(head, rf"(?<!{_SPACE}){_SPACE}++\z", "")


# The windows-1252 meaning of 0x80-0x9f (0x81, 0x8d, 0x8f, 0x90, 0x9d undefined).
_CP1252 = {
    code: bytes([code]).decode("cp1252")
    for code in range(0x80, 0xA0)
    if code not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
}

_NAMED = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
_LEGACY = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=len, reverse=True)
_COMMON = ["amp", "lt", "gt", "quot", "nbsp", "copy", "middot", "apos"]

# One reference, or a run without '&', or a lone '&'.
_PIECES = (
    r"&#(?:[xX][0-9a-fA-F]++|[0-9]++)(?![0-9a-fA-F]);?"
    r"|&[a-zA-Z][-.a-zA-Z0-9]*+;?"
    r"|[^&]++|&"
)
# The same where the text ends the document: a reference must be followed by something.
_PIECES_AT_END = (
    r"&#(?:[xX][0-9a-fA-F]++|[0-9]++)(?:;|(?=[^0-9a-fA-F]))"
    r"|&[a-zA-Z][-.a-zA-Z0-9]*+(?:;|(?=[\s\S]))"
    r"|[^&]++|&"
)
_ATTR_PIECES = r"&#(?:[xX][0-9a-fA-F]++|[0-9]++);?|&[^\t\n\f <&#;]{1,32}+;?|[^&]++|&"


def _named_map() -> Column:
    return fixed_map(_NAMED, "map<string,string>")


def _from_code_point(code: Column) -> Column:
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    as_utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
    return F.when(valid, F.decode(as_utf32, "UTF-32")).otherwise(F.lit("�"))


def _numeric(piece: Column) -> Column:
    digits = F.regexp_extract(piece, r"^&#[xX]?([0-9a-fA-F]+)", 1)
    hexa = piece.rlike("^&#[xX]")
    # longer digit strings are out of range anyway
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    code = F.when(F.length(short) > 8, F.lit(0x110000)).otherwise(
        F.when(hexa, F.conv(short, 16, 10)).otherwise(short).cast("bigint")
    )
    fixed = F.try_element_at(fixed_map(_CP1252, "map<string,string>"), code.cast("string"))
    return F.coalesce(fixed, _from_code_point(code))


def _bare_name(piece: Column) -> Column:
    return F.regexp_extract(piece, "^&([^;]*)", 1)


def _text_piece(piece: Column) -> Column:
    out = F.when(~piece.startswith("&") | (piece == "&"), piece)
    for name in _COMMON:
        out = out.when(piece.isin(f"&{name};", f"&{name}"), F.lit(_NAMED[name]))
    return out.when(piece.startswith("&#"), _numeric(piece)).otherwise(
        # an unknown name keeps its ampersand and loses its semicolon
        F.coalesce(
            F.try_element_at(_named_map(), _bare_name(piece)),
            F.concat(F.lit("&"), _bare_name(piece)),
        )
    )


def _attr_piece(piece: Column) -> Column:
    out = F.when(~piece.startswith("&") | (piece == "&"), piece)
    for name in _COMMON:
        out = out.when(piece == f"&{name};", F.lit(_NAMED[name]))
    legacy = F.regexp_extract(piece, "^&(" + "|".join(_LEGACY) + ")", 1)
    by_prefix = F.concat(
        F.try_element_at(_named_map(), legacy), F.substr(piece, F.length(legacy) + 2)
    )
    exact = F.when(piece.endswith(";"), F.try_element_at(_named_map(), _bare_name(piece)))
    return out.when(piece.startswith("&#"), _numeric(piece)).otherwise(
        F.coalesce(exact, by_prefix, piece)
    )


def _decode(c: Column, pieces: Column, one: object) -> Column:
    return F.when(c.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def _pieces(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def decode_text(c: Column, at_end: Column | None = None) -> Column:
    """Character references in element text; ``at_end`` marks text that ends the document."""
    pieces = _pieces(c, _PIECES)
    if at_end is not None:
        pieces = F.when(at_end, _pieces(c, _PIECES_AT_END)).otherwise(pieces)
    return _decode(c, pieces, _text_piece)


def decode_attribute(c: Column) -> Column:
    """Character references in an attribute value (legacy names may lack ';')."""
    return _decode(c, _pieces(c, _ATTR_PIECES), _attr_piece)


def escape_markup(c: Column) -> Column:
    """The three replacements needed to write text back as HTML."""
    return F.replace(
        F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
        F.lit(">"),
        F.lit("&gt;"),
    )
