"""Scalar functions on text, numbers, units and boxes, as Column expressions.

Compatibility folding and sequence similarity have no built-in form and are Arrow UDFs; the rest stays in code
that Spark generates.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: State names and their codes, country aliases, millilitres of the units.
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "district of columbia": "dc",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me",
    "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv",
    "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or",
    "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va",
    "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}
COUNTRIES = {"u s": "united states", "u s a": "united states", "usa": "united states", "united states of america": "united states", "uk": "united kingdom", "u k": "united kingdom"}
_APOSTROPHES = dict.fromkeys(map(ord, "’‘`´"), "'")
ML_OF = {"liter": "1000", "pint": "473.176473", "ounce": "29.5735295625", "ml": "1"}


def _fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).translate(_APOSTROPHES).casefold()


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC, one apostrophe, case folding."""
    return text.map(_fold, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def all_folded(texts: pd.Series) -> pd.Series:
    """As ``folded``, for several texts of a row in one call."""
    return texts.map(lambda row: [None if t is None else _fold(t) for t in row], na_action="ignore")


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """The larger ratio of matching blocks, of the texts and of their sorted words, to three places."""

    def ratio(a: str, b: str) -> float:
        words = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        return max(difflib.SequenceMatcher(None, a, b).ratio(), difflib.SequenceMatcher(None, *words).ratio())

    return pd.Series([None if a is None or b is None else ratio(a, b) for a, b in zip(left, right)], dtype="float64")


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is found once, however often ``of`` asks for it; inside functions of arrays nothing else is shared."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def key_of_folded(text: Column) -> Column:
    """Key of text that is folded already: apostrophes go, & @ + stand alone, other punctuation is a space."""
    text = F.regexp_replace(F.replace(text, F.lit("'"), F.lit("")), "([&@+])", " $1 ")
    return _collapse(F.regexp_replace(text, r"[^\p{L}\p{N}&@+]+", " "))


def text_key(text: Column) -> Column:
    return key_of_folded(folded(text))


def _map(pairs: dict[str, str]) -> Column:
    """One constant, which is folded once."""
    return F.str_to_map(F.lit(";".join(f"{k}:{v}" for k, v in pairs.items())), F.lit(";"), F.lit(":"))


def state_codes(key: Column) -> Column:
    """A key with state names as codes: as words are read, the longest name that they end with becomes its code."""
    codes = _map(STATES)

    def read(done: Column, word: Column) -> Column:
        def named(n: int) -> tuple[Column, Column]:
            code = F.try_element_at(codes, F.array_join(F.concat(F.slice(done, 1 - n, n - 1), F.array(word)) if n > 1 else F.array(word), " "))
            return (F.size(done) >= n - 1) & code.isNotNull(), F.array_append(F.slice(done, 1, F.greatest(F.size(done) - n + 1, F.lit(0))), code)

        return F.when(*named(3)).when(*named(2)).when(*named(1)).otherwise(F.array_append(done, word))

    return F.array_join(F.aggregate(F.split(key, " "), F.array().cast("array<string>"), read), " ")


def address_key(text: Column) -> Column:
    """Text key with state names as codes."""
    return state_codes(text_key(text))


def country_of_key(key: Column) -> Column:
    names = _map(COUNTRIES)
    return F.coalesce(F.try_element_at(names, key), key)


def country_key(text: Column) -> Column:
    return country_of_key(text_key(text))


def address_state(key: Column) -> Column:
    """Code of the last word that is no number, if it is a state's."""
    words = F.filter(F.split(key, " "), lambda w: ~w.rlike(r"\A\d+\z"))
    last = F.try_element_at(words, F.lit(-1))
    return F.when(last.isin(*STATES.values()), last)


def abv(text: Column) -> Column:
    value = F.regexp_replace(F.trim(text), r"\s*%\z", "").try_cast("double")
    return F.when((value > 0) & (value <= 100), value)


#: Fixed value: an application's volume.
VOLUME = r"(?iU)\A\s*(\d+(?:\.\d+)?)\s*(ml|millilit(?:er|re)s?|l|lit(?:er|re)s?|pints?|pt|fl\.?\s*oz\.?|fluid\s+ounces?)\s*\z"


def millilitres(amount: Column, unit: Column) -> Column:
    """Both label and application volumes convert in decimals, so equal text is equal volume."""
    unit = F.lower(unit)
    factor = (
        F.when(unit.rlike(r"\Am"), ML_OF["ml"]).when(unit.rlike(r"\Al"), ML_OF["liter"]).when(unit.rlike(r"\Ap"), ML_OF["pint"]).when(unit.rlike(r"\Af"), ML_OF["ounce"])
    )
    return (amount.try_cast("decimal(20,10)") * factor.cast("decimal(14,10)")).cast("double")


def volume(text: Column) -> Column:
    """Millilitres over 0 of an application's volume, or null."""
    text = folded(text)
    value = millilitres(F.regexp_extract(text, VOLUME, 1), F.regexp_extract(text, VOLUME, 2))
    return F.when(value > 0, value)


def label_volume(text: Column) -> Column:
    """As ``volume``; else the millilitres or litres that stand in parentheses."""
    metric = r"(?iU)\(\s*(\d+(?:\.\d+)?)\s*(ml|millilit(?:er|re)s?|l|lit(?:er|re)s?)\s*\)"
    return F.coalesce(volume(text), millilitres(F.regexp_extract(text, metric, 1), F.regexp_extract(text, metric, 2)))


def filename_key(name: Column) -> Column:
    return F.lower(F.trim(F.element_at(F.split(F.translate(composed(name), "\\", "/"), "/"), -1)))


def without_trailing_mark(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+[oO0]?[©®™]+\s*\z", "")


def warning_key(text: Column) -> Column:
    return F.regexp_replace(_collapse(F.translate(folded(text), "–—", "--")), r" +([,:;.])", "$1")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def phrase_index(words: Column, phrase: list[str]) -> Column:
    """First place (from 0) of the phrase in an array of words, or null."""
    wanted, n = F.array(*map(F.lit, phrase)), len(phrase)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: (F.get(words, i - 1) == phrase[0]) & (F.slice(words, i, n) == wanted))
    return F.get(places, F.lit(0)) - 1


def has_phrase(words: Column, phrase: list[str]) -> Column:
    """Whether the phrase is in an array of words without spaces; the array is read once, so it may be an expression inside a function of an array."""
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(phrase)} "))


def approximate_phrase_index(words: Column, phrase: list[str]) -> Column:
    """As phrase_index, else the first window in which one word differs."""
    wanted, n = F.array(*map(F.lit, phrase)), len(phrase)

    def differing(i):
        return F.size(F.filter(F.zip_with(F.slice(words, i, n), wanted, lambda a, b: ~a.eqNullSafe(b)), lambda d: d)) == 1

    near = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), differing)
    return F.coalesce(phrase_index(words, phrase), F.get(near, F.lit(0)) - 1)


def physical_tier(ml: Column) -> Column:
    """Least letter height (mm) and most characters per inch for a container's volume."""
    def tier(mm, cpi):
        return F.struct(F.lit(mm).alias("min_mm"), F.lit(cpi).alias("max_cpi"))

    return F.when(ml <= 237, tier(1, 40)).when(ml <= 3000, tier(2, 25)).when(ml.isNotNull(), tier(3, 12))


def number_label(value: Column) -> Column:
    """Six significant digits without trailing zeros; an exponent below -4 or above 5 is written."""
    scientific = F.format_string("%.5e", value)
    power = F.regexp_extract(scientific, r"e([+-]\d+)\z", 1).try_cast("int")
    fixed = F.when(power == 5, F.format_string("%.0f", value))
    for k in range(4, -5, -1):
        fixed = fixed.when(power == k, F.format_string(f"%.{5 - k}f", value))
    short = F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+\z", "")).otherwise(fixed)
    return F.when(value == 0, "0").when(value.isNotNull(), F.coalesce(short, F.regexp_replace(scientific, r"\.?0*e", "e")))


def box_distance(a: Column, b: Column) -> Column:
    """Gap between two boxes (left, top, width, height), 0 on an axis where they overlap."""
    dx = F.greatest(a.left - (b.left + b.width), b.left - (a.left + a.width), F.lit(0))
    dy = F.greatest(a.top - (b.top + b.height), b.top - (a.top + a.height), F.lit(0))
    return F.hypot(dx, dy)


def overlaps(a: Column, b: Column, share: float = 0.35) -> Column:
    """Whether a's centre lies in b, or b covers a share of a."""
    across = F.greatest(F.least(a.left + a.width, b.left + b.width) - F.greatest(a.left, b.left), F.lit(0))
    down = F.greatest(F.least(a.top + a.height, b.top + b.height) - F.greatest(a.top, b.top), F.lit(0))
    x, y = a.left + a.width / 2, a.top + a.height / 2
    inside = (x >= b.left) & (x <= b.left + b.width) & (y >= b.top) & (y <= b.top + b.height)
    return inside | (across * down >= share * a.width * a.height)


def expanded(box: Column, across: Column, down: Column, width: Column, height: Column) -> Column:
    """The box with a margin on each side, within an image."""
    left, top = F.greatest(box.left - across, F.lit(0)), F.greatest(box.top - down, F.lit(0))
    right, bottom = F.least(box.left + box.width + across, width), F.least(box.top + box.height + down, height)
    return F.struct(left.alias("left"), top.alias("top"), (right - left).alias("width"), (bottom - top).alias("height"))


def corners(box: Column) -> Column:
    return F.struct(box.left.alias("left"), box.top.alias("top"), (box.left + box.width).alias("right"), (box.top + box.height).alias("bottom"))


def same_region(a: Column, b: Column) -> Column:
    """Whether two boxes (left, top, width, height, panel_id) are shown together: one panel, centres within 1.5 heights."""
    return a.panel_id.eqNullSafe(b.panel_id) & (F.abs((a.top + a.height / 2) - (b.top + b.height / 2)) <= 1.5 * F.greatest(a.height, b.height))


def ocr_word(word: Column) -> Column:
    """A word as it is without two usual misreadings."""
    return F.translate(word, "0|", "ol")


def escaped_cell(text: Column) -> Column:
    """A spreadsheet must not read a cell as a formula."""
    return F.when(text.rlike(r"\A[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
