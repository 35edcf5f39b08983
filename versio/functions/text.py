"""Text column expressions shared by every stage.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen (or at least in the JVM, for the higher-order array functions).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (they must equal the reference's for equal results) -------
# Page marker written after every extracted page, and the text between pages.
PAGE_MARKER = "<<<PAGE_BREAK>>>"
PAGE_SUFFIX = "\n<<<PAGE_BREAK>>>\n"
# Text put in place of a chunk whose translation failed.
FAILED_MARKER = "[CHUNK FAILED]"
# Separator between chunks of a page and between pages in the reassembled text.
JOIN_SEPARATOR = "\n\n"
# Default chunk limit in estimated tokens, and characters per estimated token.
DEFAULT_CHUNK_TOKENS = 2000
CHARS_PER_TOKEN = 4
# -----------------------------------------------------------------------------

# The code points Python's str.isspace() accepts (checked over the whole BMP).
# Spark's trim() only removes U+0020, so strip/split use this class instead.
_WS_RANGES = (
    ("\\t", "\\r"),
    ("\\x1c", "\\x20"),
    ("\\u0085", None),
    ("\\u00a0", None),
    ("\\u1680", None),
    ("\\u2000", "\\u200a"),
    ("\\u2028", None),
    ("\\u2029", None),
    ("\\u202f", None),
    ("\\u205f", None),
    ("\\u3000", None),
)


def _class(esc) -> str:
    parts = [a if b is None else f"{a}-{b}" for a, b in _WS_RANGES]
    return "[" + "".join(esc(p) for p in parts) + "]"


# Java regex syntax (Spark).
WS_CLASS = _class(lambda p: p)


def _re2(p: str) -> str:
    # RE2 (DuckDB) has no \uXXXX escape; it writes \x{XXXX}.
    out = []
    for piece in p.split("-"):
        if piece.startswith("\\u"):
            piece = "\\x{" + piece[2:] + "}"
        out.append(piece)
    return "-".join(out)


# RE2 syntax of the same class, for the DuckDB oracle queries.
WS_CLASS_RE2 = _class(_re2)


def _chars_of_ranges() -> str:
    out = []
    for a, b in _WS_RANGES:
        lo = int(a[2:], 16) if a[1] in "xu" else {"\\t": 9, "\\r": 13}[a]
        hi = lo if b is None else (int(b[2:], 16) if b[1] in "xu" else {"\\t": 9, "\\r": 13}[b])
        out.extend(chr(c) for c in range(lo, hi + 1))
    return "".join(out)


# The same 29 code points as a plain set, for trim(BOTH set FROM s): no regex.
WS_CHARS = _chars_of_ranges()


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace.

    ``trim`` with an explicit character set (plain ``trim`` only removes
    U+0020); equal to ``str.strip()`` on every BMP code point."""
    return F.trim(col_of(c), F.lit(WS_CHARS))


def words(c) -> Column:
    """Python ``str.split()``: whitespace-separated words, empties dropped."""
    return F.filter(F.split(col_of(c), WS_CLASS + "+", -1), lambda w: w != F.lit(""))


def is_blank(c) -> Column:
    """True when the text has no non-whitespace character."""
    return ~col_of(c).rlike("[^" + WS_CLASS[1:-1] + "]")


def approx_tokens(c) -> Column:
    """Token estimate: ceil(characters / 4), as BIGINT."""
    return F.ceil(F.length(col_of(c)) / F.lit(CHARS_PER_TOKEN)).cast("bigint")


def split_lines(c) -> Column:
    """Split on ``\\n`` only; trailing empty lines are kept."""
    return F.split(col_of(c), "\n", -1)


def split_on_marker(c) -> Column:
    """Split an extracted text on the page marker (marker has no regex metacharacters)."""
    return F.split(col_of(c), PAGE_MARKER, -1)


# --- plain-Python twins, used by Arrow UDF helpers and tests ----------------

def py_approx_tokens(s: str) -> int:
    return -(-len(s) // CHARS_PER_TOKEN)
