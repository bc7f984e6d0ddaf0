"""Text, number and key cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean "no value" (compared after trim, case-insensitively).
NA_TOKENS = ("", "na", "nan", "none")
# Tokens of survey extracts (compared after trim, as written).
SURVEY_NA_TOKENS = ("", "NA", "N/A", "na", "null", "NULL", ".")
# Cells that stand for an unknown key.
BLANK_KEYS = ("", "-")


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def to_double(text: Column, tokens: tuple[str, ...] = NA_TOKENS, fold_case: bool = True) -> Column:
    """Text to double; NA tokens, unparsable text and NaN all become null."""
    bare = F.trim(text.cast("string"))
    probe = F.lower(bare) if fold_case else bare
    return nan_to_null(F.when(~probe.isin(*tokens), bare.try_cast("double")))


def to_year(text: Column) -> Column:
    """Text such as ``2021`` or ``2021.0`` to an integer year, else null."""
    return F.floor(to_double(text)).cast("int")


def usable_key(key: Column) -> Column:
    """Key with blanks and the dash sentinel turned to null."""
    bare = F.trim(key)
    return F.when(~bare.isin(*BLANK_KEYS), bare)


def folded(name: Column) -> Column:
    """Lookup form of a name: trimmed, lower case."""
    return F.lower(F.trim(name))


def padded_code(code: Column, width: int) -> Column:
    """Digits of a code, zero-padded; a code without digits is null, a longer one is kept."""
    digits = F.regexp_replace(code, r"\D", "")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.when(digits != "", padded)


def unit_id(raw: Column, width: int = 6) -> Column:
    """Polygon id: the part before the first dot, zero-padded."""
    head = F.split(raw.cast("string"), r"\.")[0]
    return F.when(F.length(head) < width, F.lpad(head, width, "0")).otherwise(head)


def last_part(text: Column, separator: str = "-") -> Column:
    return F.element_at(F.split(text, separator), -1)


def is_clean_key(key: Column, pattern: str = "^[A-Z]{3}$") -> Column:
    return F.coalesce(key.rlike(pattern), F.lit(False))


def require_clean_key(key: Column, pattern: str = "^[A-Z]{3}$") -> Column:
    """The key, or a failed job where it does not match."""
    message = F.concat(F.lit("key does not match the pattern: "), F.coalesce(key, F.lit("null")))
    return F.when(is_clean_key(key, pattern), key).otherwise(F.raise_error(message))


def repaired_key(key: Column, alternative: Column, sentinel: str = "-99") -> Column:
    return F.when(key == sentinel, alternative).otherwise(key)


def lacks_pattern(text: Column, pattern: str) -> Column:
    """True unless the pattern occurs, any case; null text lacks it."""
    return ~F.coalesce(text.rlike("(?i)" + pattern), F.lit(False))


def blank_marker_to_null(text: Column) -> Column:
    """Blank cells and cells that start with ``n/a`` are null."""
    bare = F.trim(text)
    return F.when((bare != "") & ~F.lower(bare).startswith("n/a"), bare)


def joined_flags(*flags: Column) -> Column:
    """Non-empty flags joined by ``; ``."""
    return F.concat_ws("; ", *[F.when(F.trim(flag) != "", flag) for flag in flags])


def sanitised(text: Column, substitutions: list[tuple[str, str]]) -> Column:
    """Ordered regular-expression substitutions, then tidy spacing; idempotent for idempotent rules."""
    for pattern, replacement in substitutions:
        text = F.regexp_replace(text, pattern, replacement)
    text = F.regexp_replace(text, r"\s+([.;,)])", "$1")
    text = F.regexp_replace(text, r"\(\s*[.;,]?\s*\)", "")
    return F.trim(F.regexp_replace(text, r"\s{2,}", " "))


def staleness(year_max: Column, today: Column | None = None) -> Column:
    """Years between the newest observation and ``today``; null when the year is unknown."""
    return F.year(F.current_date() if today is None else today) - year_max
