"""Text functions with the string semantics the rules are written for."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character Python's str.strip() treats as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Leading characters a spreadsheet would run as a formula.
FORMULA_TRIGGERS = ("=", "+", "-", "@", "\t", "\r")


def strip(column: Column) -> Column:
    """Trim white space of any script from both ends; only the ends are looked at."""
    return F.btrim(column, F.lit(WHITESPACE))


def is_blank(column: Column) -> Column:
    return strip(column) == F.lit("")


def collapse_spaces(column: Column) -> Column:
    """Replace each inner run of white space with one space."""
    return F.regexp_replace(column, r"(?U)[\s\x1c-\x1f]+", " ")


def capitalize(column: Column) -> Column:
    return F.concat(F.upper(F.substring(column, 1, 1)), F.lower(F.substring(column, 2, 2147483647)))


def title_case(column: Column) -> Column:
    """Upper-case every cased letter that follows an uncased character, lower-case the others.

    ``initcap`` only starts words at spaces; here ``o'neil`` becomes ``O'Neil`` and ``3rd``
    becomes ``3Rd``. The text is cut into runs of cased and uncased characters.
    """
    runs = F.regexp_extract_all(column, F.lit(r"([\p{IsUppercase}\p{IsLowercase}\p{Lt}]+|[^\p{IsUppercase}\p{IsLowercase}\p{Lt}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, capitalize), "")


CASINGS = {"lower": F.lower, "upper": F.upper, "title": title_case, "capitalize": capitalize}


def starts_formula(column: Column) -> Column:
    return F.substring(column, 1, 1).isin(*FORMULA_TRIGGERS)


def guard_formula(column: Column) -> Column:
    """Prefix a quote to text a spreadsheet would evaluate."""
    return F.when(starts_formula(column), F.concat(F.lit("'"), column)).otherwise(column)


def base_name(path: Column) -> Column:
    """File name without folders or control characters; ``dataset.csv`` if nothing is left."""
    name = strip(F.regexp_extract(F.regexp_replace(path, r"/+$", ""), r"([^/]*)$", 1))
    return F.coalesce(F.nullif(F.regexp_replace(name, r"[\r\n\t\x00]", ""), F.lit("")), F.lit("dataset.csv"))


def extension(name: Column) -> Column:
    """Lower-case suffix with its dot, empty when there is none (a leading dot is no suffix)."""
    return F.lower(F.regexp_extract(name, r"(?s)[^.].*?(\.[^.]+)$", 1))


def display_name(name: Column) -> Column:
    """``sales_2024.csv`` -> ``Sales 2024``."""
    stem = F.regexp_replace(name, r"(?s)(?<=[^.])\.[^.]+$", "")
    return title_case(F.replace(stem, F.lit("_"), F.lit(" ")))
