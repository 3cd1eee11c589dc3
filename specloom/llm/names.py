"""Names of makers and machines as comparable keys; Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specloom.functions.text import col

#: full-width forms U+FF01..U+FF5E and their plain ones, by rule; then dashes, quotes and blanks of any kind
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "‐‑‒–—―−" + "“”„‟«»" + "‘’" + "  　\t\n\r"
_PLAIN = "".join(chr(0x21 + i) for i in range(94)) + "-------" + '""""""' + "''" + "      "
_LEGAL = r"\b(?:CO|LTD|CORP|CORPORATION|INC|GMBH|AG|S\.?A|N\.?V|B\.?V|PLC|LLC|COMPANY|ELECTRONICS?|COMPUTERS?|INDUSTRIES|INDUSTRY|BRAND)\b\.?"


def plain(c: Column | str) -> Column:
    """Upper case, without full-width letters, odd dashes, quotes and blanks. Null stays null."""
    return F.upper(F.translate(col(c).cast("string"), _WIDE, _PLAIN))


def signature(c: Column | str, fold: bool = True) -> Column:
    """The mark of one model name: letters, digits and suffix without notes, nicknames, maker and separators.

    'Zenvequist HME_5O4 Mk.2 "Perlix" (v1)' -> 'HME504MK11'. Letters that look like digits are folded into them on either
    side of a comparison. Words of five and more letters are nicknames or makers, never part of a mark. '' if nothing is left.
    """
    s = F.regexp_replace(plain(c), r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " ")
    s = F.regexp_replace(s, r"(?:MARK|MK)[ ._-]*(?:II|2)(?![A-Z0-9])", "MKII")
    s = F.regexp_replace(s, r"[ ._-]*PLUS(?![A-Z0-9])", "+")
    s = F.regexp_replace(s, r"(?<![A-Z0-9+])[A-Z]{5,}(?![A-Z0-9+])", " ")
    s = F.regexp_replace(s, r"[^A-Z0-9+]", "")
    return F.translate(s, "OIL", "011") if fold else s


def variants(c: Column | str) -> Column:
    """The models one name lists: split at a slash with blanks on both sides."""
    return F.filter(F.split(plain(c), r"\s+/\s+"), lambda x: F.length(F.trim(x)) > 0)


def maker_key(c: Column | str) -> Column:
    """'Kastudox Co., Ltd.' -> 'KASTUDOX', 'O S T S E R I' -> 'OSTSERI'; '' for null."""
    s = F.regexp_replace(F.coalesce(plain(c), F.lit("")), r"\([^)]*\)", " ")
    return F.regexp_replace(F.regexp_replace(s, _LEGAL, " "), r"[^\p{L}\p{N}]", "")


def maker_keys(c: Column | str) -> Column:
    """All makers one field names: 'Salvelin (Manufacturer: Kaskiquist)' -> both."""
    noted = F.regexp_extract(F.coalesce(plain(c), F.lit("")), r"\(\s*(?:MANUFACTURER|MADE BY|MAKER|BY)\s*:?\s*([^)]*)\)", 1)
    return F.filter(F.array_distinct(F.array(maker_key(c), maker_key(noted))), lambda x: x != "")
