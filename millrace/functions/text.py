"""Text functions on columns, with the white-space, word-boundary and case rules decided once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a character class body: Java's own \\s is ASCII only.
SPACE = r"\s   -     　﻿"
#: A word boundary between ASCII word characters, which Java's \\b is not.
B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: Accented Latin letters and what they are without their accents.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
UNACCENTED = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"


#: The characters of ``SPACE`` one by one.
SPACES = "".join(chr(c) for c in (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))


#: A white-space character, told from letters by a bit set and one range (a plain list of all is asked one by one for every letter), and runs of them that are not one plain space.
ONE_SPACE = r"[\t\n\x0B\f\r \xA0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]]"
RUNS = rf"{ONE_SPACE}{{2,}}|{ONE_SPACE.replace(' ', '')}"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return trim(F.regexp_replace(c, RUNS, " "))


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.lower(F.translate(c, ACCENTED, UNACCENTED))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def share(part: Column, whole: Column, default: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(default))


def host_of(url: Column) -> Column:
    """Lower-case host without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1)), r"^www\.", "")


def dedup_normalised(c: Column, digits: bool = True) -> Column:
    """Letters and digits in lower case with single spaces; digits all 0 unless kept."""
    plain = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(plain, r"\p{N}", "0") if digits else plain, r"\s+", " "))


def slug(c: Column, longest: int = 64) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(fold(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, longest), r"-+$", "")


def fnv1a32(c: Column) -> Column:
    """FNV-1a over the code units of a text of the basic plane, as an unsigned number."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: h.bitwiseXOR(x) * 16777619 % 4294967296)
