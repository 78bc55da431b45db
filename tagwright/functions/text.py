"""Text expressions on tags, terminals and I/O types: columns in, columns out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain: spellings of I/O types, safety classes and locations, and the order of the normal ones.
IO_NORMAL = {
    "AI": "AI", "A.I": "AI", "A I": "AI", "AO": "AO", "A.O": "AO", "A O": "AO", "AIR": "AIR", "A.I.R": "AIR", "A I R": "AIR", "AOR": "AOR", "A.O.R": "AOR", "A O R": "AOR",
    "DI": "DI", "D.I": "DI", "D I": "DI", "DO": "DO", "D.O": "DO", "D O": "DO", "DIR": "DIR", "DI-R": "DIR", "DOR": "DOR", "DO-R": "DOR",
}
SAFETY_NORMAL = {"IS": "IS", "I.S": "IS", "NIS": "NIS", "N.I.S": "NIS"}
LOCATION_NORMAL = {"FIELD": "FIELD", "FIELD-AREA": "FIELD", "MCC": "MCC", "MCC ROOM": "MCC", "LCP": "LCP", "LOCAL": "LCP", "UCP": "UCP"}
RANK_IO = {"AI": 1, "AIR": 2, "AOR": 3, "AO": 4, "DI": 5, "DIR": 6, "DO": 7, "DOR": 8}
RANK_SAFETY = {"IS": 1, "NIS": 2}
RANK_LOCATION = {"FIELD": 1, "MCC": 2, "LCP": 3, "UCP": 4}
INVALID_JB = ["-", "N/A", "0", "UNKNOWN", "NAN", ""]


def lookup(key: Column, table: dict) -> Column:
    """The table's value, null where there is none: a literal map, no join."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def upper_trim(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def cleaned(c: Column) -> Column:
    """Upper case without outer spaces; NAN, NONE and ? are blank."""
    u = upper_trim(c)
    return F.when(u.isin("NAN", "NONE", "?"), "").otherwise(u)


def io_key(c: Column) -> Column:
    """Spelling of an I/O type by which it is looked up: separators become single spaces; the two relay forms keep a dash."""
    u = upper_trim(c)
    k = F.trim(F.regexp_replace(F.translate(u, "_-.", "   "), r"\s+", " "))
    return F.when(u.isin("", "NAN", "NONE", "NULL", "-"), "").when(k.isin("DI R", "D I R"), "DI-R").when(k.isin("DO R", "D O R"), "DO-R").otherwise(k)


def separator_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), r"[\s_-]+", "")


def code_token(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.upper(c), "[^A-Z0-9._-]", ""), F.lit("._-"))


def canonical_tag(c: Column) -> Column:
    return F.btrim(F.translate(F.regexp_replace(F.upper(c), r"\s+", ""), "_", "-"), F.lit("-."))


def alphanumeric(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def terminal_parts(c: Column) -> Column:
    """struct(prefix, number, width) of a terminal that ends in digits; null otherwise."""
    t, pattern = F.trim(c), "^(.*?)([0-9]+)$"
    digits = F.regexp_extract(t, pattern, 2)
    return F.when(digits != "", F.struct(F.regexp_extract(t, pattern, 1).alias("prefix"), digits.cast("bigint").alias("number"), F.length(digits).alias("width")))


def terminal(prefix: Column, number: Column, width: Column) -> Column:
    """Zero-padded to the width; longer numbers are not cut."""
    n = number.cast("string")
    return F.concat(prefix, F.when(F.length(n) >= width, n).otherwise(F.lpad(n, width, F.lit("0"))))


def multi_pattern(c: Column) -> Column:
    return F.filter(F.split(F.upper(c), r"[,\s]+"), lambda x: x != "")


def cable_unit(c: Column) -> Column:
    """'12P', '12 PAIR' or '12 x 1.5' cables as '12 pair'; triples and cores likewise."""
    u = F.upper(c)
    found = lambda unit: F.regexp_extract(u, rf"([0-9]+)\s*(?:{unit})(?:[^A-Z]|$)", 1)
    units = (("P|PR|PAIRS?", "pair"), ("T|TRIPLES?", "triple"), ("C|CORES?", "core"))
    return F.coalesce(*(F.when(found(p) != "", F.concat(found(p).cast("int").cast("string"), F.lit(f" {n}"))) for p, n in units))


def pair_number(c: Column) -> Column:
    """The first number that a pair, core or cable text gives, by the first pattern that fits."""
    u = F.upper(c)
    patterns = (r"([0-9]+)\s*PAIR", r"([0-9]+)\s*P(?:[^A-Z]|$)", r"([0-9]+)\s*PX", r"([0-9]+)\s*PR", r"([0-9]+)\s*CORE", r"([0-9]+)\s*X")
    return F.coalesce(*(F.nullif(F.regexp_extract(u, p, 1), F.lit("")).cast("int") for p in patterns))


def char_sum(c: Column, modulus: int, by_position: bool = False) -> Column:
    """Sum of the character codes, times their places from 1 if by_position, modulo."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    codes = F.transform(chars, (lambda x, i: F.ascii(x) * (i + 1)) if by_position else (lambda x: F.ascii(x)))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: a + x) % modulus


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def truncated(c: Column, n: int) -> Column:
    return F.left(F.trim(c), F.lit(n))


def file_safe(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")


def strip_all(c: Column, tokens: list[str]) -> Column:
    return reduce(lambda x, t: F.replace(x, F.lit(t), F.lit("")), tokens, c)
