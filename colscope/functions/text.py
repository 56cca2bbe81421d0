"""Text helpers: blanks, lengths and cuts counted in UTF-16 units.

The helpers of this package take and return SQL expression text. A profile of a wide table needs
thousands of expression nodes; text reaches the parser in one call per column, where building the
same nodes from Python takes a call per node.
"""

from __future__ import annotations

# The blanks removed by trimming, the cut lengths and the cut marker.
BLANKS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
MAX_CELL_UNITS = 100_000
MAX_DISPLAY_UNITS = 512
CUT_MARKER = "… [truncated]"


def literal(text: str) -> str:
    """SQL string literal."""
    escaped = "".join(
        f"\\u{ord(c):04x}" if ord(c) < 32 or c in BLANKS and c != " " else c
        for c in text.replace("\\", "\\\\").replace("'", "\\'")
    )
    return f"'{escaped}'"


def quoted(name: str) -> str:
    """SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


BLANKS_SQL = literal(BLANKS)


def trim_blanks(text: str) -> str:
    """Strip every Unicode blank and the byte-order mark from both ends."""
    return f"trim(BOTH {BLANKS_SQL} FROM {text})"


def utf16_units(text: str) -> str:
    """Length in UTF-16 units. ASCII text, the common case, is measured without re-encoding."""
    return (
        f"IF(octet_length({text}) = length({text}), length({text}), "
        f"CAST(octet_length(encode({text}, 'UTF-16LE')) / 2 AS INT))"
    )


def rarely(condition: str, value: str, rare: str, common: str) -> str:
    """``rare`` (an expression over ``t``, bound to ``value``) where the condition holds.

    The rare branch sits in a lambda: it is evaluated for the rows that need it and stays out of
    the generated code of the common path, which would otherwise outgrow the JIT compiler.
    """
    return f"IF({condition}, transform(array({value}), t -> {rare})[0], {common})"


def exceeds_units(text: str, limit: int) -> str:
    """Whether a text has more than ``limit`` units; code points alone decide for most."""
    return f"(length({text}) > {limit} OR {utf16_units(text)} > {limit})"


def cut_text(text: str, limit: int) -> str:
    """Shorten text of more than ``limit`` units to exactly ``limit``, marker included.

    A text of at most ``limit`` bytes cannot exceed the limit, so the exact count is only taken
    for longer ones. A surrogate pair split by the cut leaves one replacement character.
    """
    keep = limit - len(CUT_MARKER)
    units = f"encode(substring(t, 1, {keep}), 'UTF-16LE')"
    high_byte = f"CAST(conv(hex(substring({units}, {2 * keep}, 1)), 16, 10) AS INT)"
    head = (
        f"CASE WHEN octet_length(substring(t, 1, {keep})) = {keep} THEN substring(t, 1, {keep}) "
        f"WHEN {high_byte} BETWEEN 216 AND 219 "
        f"THEN concat(decode(substring({units}, 1, {2 * keep - 2}), 'UTF-16LE'), '\\ufffd') "
        f"ELSE decode(substring({units}, 1, {2 * keep}), 'UTF-16LE') END"
    )
    rare = f"IF({exceeds_units('t', limit)}, concat({head}, {literal(CUT_MARKER)}), t)"
    return rarely(f"octet_length({text}) > {limit}", text, rare, text)


def long_text_digest(text: str, limit: int) -> str:
    """SHA-256 of a text longer than ``limit`` units, else null."""
    rare = f"IF({exceeds_units('t', limit)}, sha2(t, 256), NULL)"
    return rarely(f"octet_length({text}) > {limit}", text, rare, "CAST(NULL AS STRING)")


def is_cut(text: str, limit: int = MAX_CELL_UNITS) -> str:
    """True for a text that ``cut_text`` shortened (or one that looks exactly like it)."""
    return f"(endswith({text}, {literal(CUT_MARKER)}) AND {utf16_units(text)} = {limit})"


def display_value(text: str) -> str:
    """The short form of a value shown in frequency tables."""
    return cut_text(text, MAX_DISPLAY_UNITS)
