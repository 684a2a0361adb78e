"""Keys, clocks, names and codes as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from turfline.functions.constants import UUID_NAMESPACE_URL
from turfline.functions.measures import col, literal_map


def name_uuid(name: Column, namespace_hex: str = UUID_NAMESPACE_URL) -> Column:
    """UUID version 5 of a name, from native SHA-1."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.conv(
        (F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F)).bitwiseOR(0x80),
        10,
        16,
    )
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        F.lower(variant), F.substring(digest, 19, 2), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def entity_key(provider, entity, provider_id, prefix: str = "fri") -> Column:
    """B1: deterministic key of a provider entity."""
    parts = [F.lit(prefix), *[c if isinstance(c, Column) else F.lit(c) for c in (provider, entity)]]
    return name_uuid(F.concat_ws(":", *parts, col(provider_id).cast("string")))


def short_identifier(kind: str, *parts: Column, prefix: str = "openfootball") -> Column:
    """First 20 hex digits of SHA-256 over NUL-joined parts."""
    digest = F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 20)
    return F.concat(F.lit(f"{prefix}-{kind}-"), digest)


def clock_seconds(text) -> Column:
    """B2: HH:MM:SS.mmm to seconds."""
    part = F.split(col(text), ":")
    return (
        part.getItem(0).cast("double") * 3600
        + part.getItem(1).cast("double") * 60
        + part.getItem(2).cast("double")
    )


# Part of a position's name -> group, in order of precedence. A part that
# starts with "=" is the whole name.
POSITION_PARTS = [
    ("goalkeeper", "GK"), ("center back", "CB"), ("central defender", "CB"), ("back", "FB/WB"), ("defensive midfield", "DM"),
    ("attacking midfield", "AM"), ("wing", "W"), ("=left midfield", "W"), ("=right midfield", "W"), ("midfield", "CM"),
    ("forward", "ST"), ("striker", "ST"),
]


def position_group(name) -> Column:
    """Position name to one of eight groups; the first part of the table that fits decides."""
    plain = F.replace(F.lower(col(name)), F.lit("centre"), F.lit("center"))

    def step(part: str, group: str, otherwise: Column) -> Column:
        fits = plain == part[1:] if part.startswith("=") else plain.contains(part)
        return F.when(fits, group).otherwise(otherwise)

    return reduce(lambda rest, rule: step(*rule, rest), reversed(POSITION_PARTS), F.lit(None).cast("string"))


# Group or provider code -> broad family.
ROLE_FAMILY = {
    "CB": "DEF", "FB/WB": "DEF", "DM": "MID", "CM": "MID", "AM": "MID", "W": "FWD", "ST": "FWD",
    "GK": "GK", "DEF": "DEF", "MID": "MID", "FWD": "FWD",
}


def role_family(role) -> Column:
    """Broad family of a role, null when unknown."""
    return F.try_element_at(literal_map(ROLE_FAMILY), col(role))


def roster_role(code3) -> tuple[Column, Column]:
    """(role, family) from a three-letter roster code."""
    code = col(code3)
    role = F.when(code == "GKP", "GK")
    return role, F.when(code == "GKP", "GK").when(code.isin("DEF", "MID", "FWD"), code)


def decode_escapes(name) -> Column:
    r"""Repair ``\uXXXX`` escapes kept as text."""
    return F.coalesce(
        F.from_json(F.concat(F.lit('{"a":"'), col(name), F.lit('"}')), "a string").getField("a"),
        col(name),
    )


HANGUL = range(0xAC00, 0xD7A4)
#: Ranges whose characters all fold to themselves: ideographs, surrogates and private use, and
#: the planes behind them; they are not asked one by one.
UNCHANGED = [range(0x3400, 0xA000), range(0xD800, 0xF900), range(0x17000, 0x1B000), range(0x20000, 0x2F800), range(0x30000, 0x110000)]


def _fold_exact(text: str) -> str:
    kept = (c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return "".join(kept).casefold()


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """What folding does to single characters of all scripts, by Unicode rule: characters and
    their one-character forms, followed by the characters that vanish; and longer forms.
    Hangul syllables, which fold by arithmetic, are left out."""
    plain, folded, gone, longer = [], [], [], {}
    asked, skipped = [], sorted([HANGUL, *UNCHANGED], key=lambda r: r.start)
    for start, stop in zip([0x80, *(r.stop for r in skipped)], [r.start for r in skipped], strict=False):
        asked.extend(range(start, stop))
    for point in asked:
        char = chr(point)
        base = _fold_exact(char)
        if base == char:
            continue
        if not base:
            gone.append(char)
        elif len(base) == 1:
            plain.append(char)
            folded.append(base)
        else:
            longer[char] = base
    capitals = [chr(c) for c in range(65, 91)]
    return "".join([*capitals, *plain, *gone]), "".join([*(c.lower() for c in capitals), *folded]), longer


def _jamo(char: Column) -> Column:
    """The two or three letters of a Hangul syllable."""
    at = F.ascii(char) - HANGUL.start
    part = lambda first, n, i: F.substring(F.lit("".join(chr(first + k) for k in range(n))), F.floor(i).cast("int") + 1, F.lit(1))
    tail = at % 28
    return F.concat(
        part(0x1100, 19, at / 588), part(0x1161, 21, at % 588 / 28), F.when(tail > 0, part(0x11A8, 27, tail - 1)).otherwise("")
    )


def normalise_name(name) -> Column:
    """NFKD without combining marks, case-folded, punctuation to space, single spaces, in
    every script. ASCII names only need small letters; characters with longer forms are rare,
    and only texts that hold one are split."""
    plain, folded, longer = _folds()
    raw = col(name)
    syllable = f"[{chr(HANGUL.start)}-{chr(HANGUL.stop - 1)}]"
    several = "[" + "".join(re.escape(c) for c in longer) + "]"
    # One literal: a map built entry by entry costs more than the names.
    forms = F.str_to_map(F.lit("\x02".join(f"{c}\x01{x}" for c, x in longer.items())), F.lit("\x02"), F.lit("\x01"))
    each = F.transform(
        F.split(raw, ""),
        lambda c: F.when(c.rlike(syllable), _jamo(c)).when(c.rlike(several), F.element_at(forms, c)).otherwise(c),
    )
    text = F.when(raw.rlike(syllable) | raw.rlike(several), F.array_join(each, "")).otherwise(raw)
    text = F.when(raw.rlike(r"[^\x00-\x7F]"), F.translate(text, plain, folded)).otherwise(F.lower(raw))
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def season_years(label) -> tuple[Column, Column]:
    """B18: '2015/2016' or '2018' to (start, end) year."""
    part = F.split(col(label), "/")
    start = F.try_element_at(part, F.lit(1)).cast("int")
    return start, F.coalesce(F.try_element_at(part, F.lit(2)).cast("int"), start)


def timestamp_date(text) -> Column:
    """B18: 'yyyy-MM-dd HH:mm:ss' to date."""
    return F.to_date(F.try_to_timestamp(col(text), F.lit("yyyy-MM-dd HH:mm:ss")))


def folder_country(folder, names: dict[str, str]) -> Column:
    """Looked-up country, else the title-cased folder name."""
    folder = col(folder)
    fallback = F.initcap(F.replace(folder, F.lit("-"), F.lit(" ")))
    known = F.try_element_at(literal_map(names), folder) if names else F.lit(None).cast("string")
    return F.coalesce(known, fallback)


def assembled_name(first, last, short) -> Column:
    """B20: 'first last', falling back to the short name."""
    joined = F.trim(F.concat_ws(" ", col(first), col(last)))
    return F.coalesce(F.nullif(joined, F.lit("")), col(short))
