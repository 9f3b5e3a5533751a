"""String functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slice_ends(c: Column, left: int = 1, right: int = 1) -> Column:
    """Without the first ``left`` and last ``right`` characters."""
    return F.substring(c, F.lit(left + 1), F.greatest(F.lit(0), F.length(c) - left - right))


def strip_suffix(c: Column, n: int) -> Column:
    return F.substring(c, F.lit(1), F.greatest(F.lit(0), F.length(c) - n))


def has_length(c: Column, n: int) -> Column:
    return F.length(c) == n


def words(c: Column) -> Column:
    """White-space separated tokens; none of an empty text."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def first_token(c: Column) -> Column:
    return F.try_element_at(words(c), F.lit(1))


def token_count(c: Column) -> Column:
    return F.size(words(c))


def pixels(c: Column, default: int = 800 * 600) -> Column:
    """``"W x H"`` as a product; null gives the default screen."""
    parts = F.split(c, " x ")
    return F.coalesce(F.try_element_at(parts, F.lit(1)).try_cast("long") * F.try_element_at(parts, F.lit(2)).try_cast("long"), F.lit(default).cast("long"))


def strip_money(c: Column) -> Column:
    """``"$72,200.00"`` as a number; what isn't one gives null."""
    return F.regexp_replace(c, "[$,]", "").try_cast("double")


def decimal_comma(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match's group; no match gives the empty string."""
    return F.regexp_extract(c, pattern, group)


def title_of(name: Column) -> Column:
    """The first word that a blank precedes and a full stop ends."""
    return extract(name, r" ([A-Za-z]+)\.")


def is_digits(c: Column) -> Column:
    return c.cast("string").rlike("^[0-9]+$")


def all_caps_words(c: Column) -> Column:
    """Words that are upper case and hold a cased letter."""
    return F.size(F.filter(words(c), lambda w: (w == F.upper(w)) & (w != F.lower(w))))


def ellipsis(c: Column, most: int, keep: int | None = None) -> Column:
    """Texts above ``most`` characters cut to ``keep`` and three dots."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(keep if keep is not None else most)), F.lit("...")))


def suffixed_amount(c: Column) -> Column:
    """A currency sign, a number and perhaps K or M."""
    body, last = F.substring(c, 2, 1_000), F.right(c, F.lit(1))
    scale = F.when(last == "M", 1e6).when(last == "K", 1e3).otherwise(1.0)
    return F.when(last.isin("M", "K"), strip_suffix(body, 1)).otherwise(body).try_cast("double") * scale


def split_ints(c: Column, sep: str = "-") -> Column:
    return F.transform(F.split(c, sep), lambda x: x.try_cast("int"))


def joined_name(columns: list[str], suffix: str = "") -> str:
    return "_".join(columns) + suffix


def fixed_format(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))
