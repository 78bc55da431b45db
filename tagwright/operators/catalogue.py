"""A project's own examples of names, compiled to Java patterns by which the spans of its drawings are told apart.

Each of the four lists (boxes, motor cables, spares, cables) is unset, and then the default pattern holds; or empty, and then nothing is of
that kind; or holds examples. An example of a box or motor cable names the letters and numbers that its identifiers begin with, an example
of a cable shows the unit that cables are counted in.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import drawing

# Formats of identifiers. What may stand between the pieces of a name, the forms of a serial number, what may follow it, the
# forms of cable units with their names, cross sections, and texts that are no tags.
BETWEEN, AREA = r"[\s._-]*", r"[0-9]{1,4}"
SERIALS = [r"[._-]*[0-9]{1,6}", r"\s+[0-9]{1,6}", r"(?:[._-]+[A-Z0-9]{1,8})+[._-]*[0-9]{1,6}(?:[A-Z]{1,2})?"]
LETTERS, SEGMENTS = "(?:[A-Z]{1,2})?", "(?:[._-]+[A-Z0-9]{1,8})*"
UNITS = {"pair": ("P(?:AIR|R)?", ["P", "PR", "PAIR"]), "triple": ("T(?:RIPLE|R)?", ["T", "TR", "TRIPLE"]), "core": ("C(?:ORE|R)?", ["C", "CR", "CORE"])}
CABLE_NAME, CROSS_SECTION = "(?:[A-Z]{2,8}[-_ ]*)?", r"(?:\s*(?:X|×)\s*[0-9]+(?:\.[0-9]+)?\s*(?:MM\s*\^?\s*2?)?)?"
MONTH = "(?:JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUNE?|JULY?|AUG(?:UST)?|SEP(?:T(?:EMBER)?)?|OCT(?:OBER)?|NOV(?:EMBER)?|DEC(?:EMBER)?)"
NO_TAGS = [
    rf"[0-9]{{1,2}}[-_./ ]{MONTH}[-_./ ][0-9]{{2,4}}", rf"{MONTH}[-_./ ][0-9]{{1,2}}(?:,?[-_./ ][0-9]{{2,4}})?", "[0-9]{1,4}[-_./][0-9]{1,2}[-_./][0-9]{1,4}",
    "IP[-_./ ]?[0-9]{2,3}", "[0-9]{1,3}(?:BK|WH|RD|BL|GN|YL|OR|GY|VI|BN|PK)", "SCR[-_]?[0-9]*", "[0-9]{1,4}",
]
NEVER = "(?!)"

Examples = str | Iterable[str] | None


def example_list(value: Examples) -> list[str] | None:
    """Upper-case examples of a list or of a text with commas and white space between them; None stays None."""
    if value is None:
        return None
    return [x for part in ([value] if isinstance(value, str) else value) for x in re.split(r"[,\s]+", str(part).upper()) if x]


def pieces(example: str) -> list[str]:
    return re.findall("[A-Z]+|[0-9]+", example)


def area_and_letters(example: str) -> tuple[str, str] | None:
    """The two pieces of an example that is an area number and letters."""
    found = pieces(example)
    return (found[0], found[1]) if len(found) == 2 and found[0].isdigit() and found[1].isalpha() else None


def identifier(examples: list[str]) -> str:
    """Pattern of identifiers that begin as one of the examples does: its pieces with free separators, an area number optional, then a serial
    number, whose letters and further segments are set off by punctuation. Examples without letters or digits give nothing."""
    heads = []
    for example in examples:
        split = area_and_letters(example)
        if split:
            heads.append(f"(?:{split[0]}{BETWEEN})?{split[1]}")
        elif pieces(example):
            heads.append((f"(?:{AREA}{BETWEEN})?" if example.isalpha() else "") + BETWEEN.join(pieces(example)))
    if not heads:
        return NEVER
    return f"(?i)(?<![A-Z0-9])((?:{'|'.join(heads)})(?:{'|'.join(SERIALS)}){LETTERS}{SEGMENTS})(?![A-Z0-9])"


def label(examples: list[str]) -> str:
    """Pattern of the words themselves; SPARE has a plural."""
    words = [re.sub(r"([^A-Z0-9])", r"\\\1", e) + ("S?" if e == "SPARE" else "") for e in examples]
    return rf"(?i)\b({'|'.join(words)})\b" if words else NEVER


def cable_units(examples: str) -> list[str]:
    """The units that the examples of cables are counted in."""
    of = {spelling: unit for unit, (_, spellings) in UNITS.items() for spelling in spellings}
    longest = "|".join(sorted(of, key=len, reverse=True))
    found = [re.search(rf"[0-9]+\s*({longest})\b", e) for e in re.split("[,;]", examples.upper())]
    return [u for u in UNITS if any(m and of[m[1]] == u for m in found)]


@dataclass(frozen=True)
class Catalogue:
    """boxes, motors, spares, cables: examples, or none (an empty list: nothing is of that kind), or None (the default pattern). wire_rule and
    scr_rule: texts whose leading letters mark wires and screens, which are no tags."""

    boxes: Examples = None
    motors: Examples = None
    spares: Examples = None
    cables: Examples = None
    wire_rule: str = ""
    scr_rule: str = ""
    box: str = field(init=False)
    motor: str = field(init=False)
    spare: str = field(init=False)
    cable: str = field(init=False)
    units: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        for name, examples, compiled, default in (("box", self.boxes, identifier, drawing.JB), ("motor", self.motors, identifier, drawing.MC), ("spare", self.spares, label, drawing.SPARE)):
            given = example_list(examples)
            put(name, default if given is None else compiled(given))
        shown = None if self.cables is None else (self.cables if isinstance(self.cables, str) else ", ".join(self.cables)).strip()
        put("units", tuple(cable_units(shown or "")))
        counted = "|".join(sorted((UNITS[u][0] for u in self.units), key=len, reverse=True))
        with_units = f"(?i)(?<![A-Z0-9]){CABLE_NAME}([0-9]{{1,3}})\\s*({counted}){CROSS_SECTION}(?![A-Z0-9])"
        put("cable", NEVER if shown == "" else with_units if self.units else drawing.CABLE)

    @property
    def areas(self) -> list[str]:
        """Examples of boxes that are an area number and letters."""
        return [e for e in example_list(self.boxes) or [] if area_and_letters(e)]


def whole(c: Column, pattern: str) -> Column:
    """Whether the pattern fits the whole text, but for spaces around it."""
    flags, bare = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    return F.trim(c).rlike(f"{flags}^(?:{bare})$")


def is_box(c: Column, catalogue: Catalogue) -> Column:
    return whole(c, catalogue.box)


def is_motor(c: Column, catalogue: Catalogue) -> Column:
    return whole(c, catalogue.motor)


def is_spare(c: Column, catalogue: Catalogue) -> Column:
    return F.upper(F.trim(c)).rlike(catalogue.spare)


def is_cable(c: Column, catalogue: Catalogue) -> Column:
    return F.upper(F.trim(c)).rlike(catalogue.cable)


def no_tag(c: Column, catalogue: Catalogue) -> Column:
    """Texts that are no tag under a catalogue: its own boxes, motor cables, spares and cables, dates, ratings, stop words, wires, screens,
    bare numbers, and anything with fewer than four characters besides separators."""
    u = F.upper(F.trim(c))
    out = u.rlike("^(?:" + "|".join(NO_TAGS) + ")$") | u.isin(drawing.STOP_WORDS) | is_box(c, catalogue) | is_motor(c, catalogue) | is_spare(c, catalogue) | is_cable(c, catalogue) | u.rlike(drawing.WIRE)
    for part in re.split(r"[,;\s]+", f"{catalogue.wire_rule} {catalogue.scr_rule}"):
        letters = re.match("[A-Za-z]{2,}", part)
        if letters:
            out = out | (u.startswith(letters[0].upper()) & u.rlike("[0-9]"))
    return F.coalesce(out | (F.length(F.regexp_replace(u, r"[\s_-]+", "")) < 4), F.lit(True))


def cable_description(c: Column, catalogue: Catalogue) -> Column:
    """The first cable in a text: its count and unit if the catalogue shows units, else the text that fits; null without one."""
    found = F.upper(F.trim(F.regexp_extract(c, catalogue.cable, 0)))
    if catalogue.units:
        first = F.left(F.upper(F.regexp_extract(c, catalogue.cable, 2)), F.lit(1))
        unit = F.when(first == "P", "pair").when(first == "T", "triple").otherwise("core")
        found = F.concat(F.regexp_extract(c, catalogue.cable, 1).try_cast("int").cast("string"), F.lit(" "), unit)
    return F.when(c.rlike(catalogue.cable), found)


def classified(spans: DataFrame, catalogue: Catalogue) -> DataFrame:
    """spans with kind and token. A box comes first, unless a motor cable begins the text, ends no earlier and holds the box further on;
    then motor cables, spares, tags, cables. A box gets the area number that its example has and its text lacks."""
    # In steps, each a column, so that no pattern is in the plan twice.
    t, tag, box, motor, spelled = (F.col(f"__{c}") for c in ("t", "tag", "box", "motor", "spelled"))
    out = spans.withColumn("__t", F.trim(F.coalesce("text", F.lit(""))))
    out = out.withColumns({
        "__box": F.regexp_extract(t, catalogue.box, 0), "__box_at": F.regexp_instr(t, F.lit(catalogue.box)), "__motor": F.regexp_extract(t, catalogue.motor, 0), "__motor_at": F.regexp_instr(t, F.lit(catalogue.motor)),
        "__spare": F.upper(F.regexp_extract(t, catalogue.spare, 0)), "__cable": cable_description(t, catalogue), "__tag": F.upper(F.regexp_extract(t, drawing.TAG, 1)),
    })
    owns = (F.col("__motor_at") == 1) & (F.length(motor) >= F.col("__box_at") - 1 + F.length(box)) & (F.col("__box_at") > 1)
    first = F.when((F.col("__box_at") > 0) & ~owns, "JB").when(F.col("__motor_at") > 0, "MC").when(F.col("__spare") != "", "SPARE")
    out = out.withColumns({"__first": first, "__spelled": drawing.with_spaced_suffix(t, tag), "__box": X.code_token(box), "__motor": X.code_token(motor)})
    is_tag = (tag != "") & ~no_tag(t, catalogue) & ~no_tag(tag, catalogue)
    kind = F.coalesce("__first", F.when(is_tag, "Tag").when(F.col("__cable").isNotNull(), "Cable").otherwise("Unknown"))
    # What fits the pattern of tags is spelled with dashes, whatever was read for them.
    tokens = {
        "JB": drawing.with_area_prefix(box, catalogue.areas), "MC": motor, "SPARE": F.when(F.col("__spare") == "SPARES", "SPARE").otherwise(F.col("__spare")),
        "Tag": F.translate(spelled, "._", "--"), "Cable": F.col("__cable"),
    }
    out = out.withColumn("kind", kind)
    token = F.upper(t)
    for name, made in tokens.items():
        token = F.when(F.col("kind") == name, made).otherwise(token)
    out = out.withColumn("token", token)
    return out.drop(*(c for c in out.columns if c.startswith("__") and c not in spans.columns))
