"""Clean-up of text produced by a generative reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelake.functions.iso6346 import BLANK, fix_size_code

# The code shape looked for in generated text, and the confidence of each kind of text.
GENERATED_CODE = rf"(?U)([A-Z]{{3,4}}{BLANK}*[0-9]{{6,7}})"
CONFIDENCE_LETTERS_AND_DIGITS, CONFIDENCE_DIGITS, CONFIDENCE_OTHER = 0.95, 0.85, 0.70
LETTER = r"\p{L}"
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def generated_text(text: Column) -> Column:
    """Code found in the text, else the whole text; size codes repaired. Empty input stays empty."""
    flat = F.translate(text, "\n-", "  ")
    code = F.regexp_extract(F.upper(flat), GENERATED_CODE, 1)
    return F.when(stripped(F.coalesce(text, F.lit(""))) == "", F.lit("")).otherwise(
        fix_size_code(F.when(code != "", code).otherwise(stripped(flat))))


def generated_confidence(text: Column, cleaned: Column) -> Column:
    return (
        F.when(stripped(F.coalesce(text, F.lit(""))) == "", F.lit(0.0))
        .when(cleaned.rlike(LETTER) & cleaned.rlike(DIGIT), F.lit(CONFIDENCE_LETTERS_AND_DIGITS))
        .when(cleaned.rlike(DIGIT), F.lit(CONFIDENCE_DIGITS))
        .otherwise(F.lit(CONFIDENCE_OTHER))
    )
