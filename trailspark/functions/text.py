"""Column-level text functions (JVM-side expressions only).

Python's ``str.strip()`` / ``str.split()`` use every Unicode whitespace
character; Spark's ``trim`` strips only the space character, so these
helpers list the characters (``btrim``, ``translate``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's behaviour):
# a token for the term vectoriser is a run of two or more word characters.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
# whitespace as understood by Python's str.split()/str.strip(): one
# character class that reads the same in Java regex and RE2.
WS_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WS = WS_CLASS + "+"
# the same characters as a plain string, for btrim/translate (no regex)
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Strip leading/trailing Unicode whitespace (Python ``str.strip``)."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def blank_to_null(c) -> Column:
    """Strip, and turn an empty result into null (``strip().replace('', None)``)."""
    s = ustrip(c)
    return F.when(F.length(s) > 0, s)


def tokens(c) -> Column:
    """Whitespace tokens (Python ``str.split()``): no empty tokens.

    Every whitespace character is mapped to a space (``translate``), the
    text is split on the single space (no regex) and empty pieces dropped.
    """
    spaced = F.translate(_col(c), WS_CHARS, " " * len(WS_CHARS))
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def word_terms(c) -> Column:
    """Lower-cased vectoriser terms: runs of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_PATTERN), 0)
