"""ISO 6346 numbers and size codes as Catalyst expressions.

Everything here stays inside the JVM. Functions that need several passes over a text take and return
DataFrames, because separate projections let Spark compute each pass once instead of inlining it at
every use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------------
# Position in this text is the numeric value of a character; multiples of 11 are not used.
VALUE_TABLE = "0123456789A?BCDEFGHIJK?LMNOPQRSTU?VWXYZ"
BLANK = r"[\s\x1c-\x1f]"  # together with (?U): the blanks of Unicode
GAP = r"[\s\x1c-\x1f-]*"
OWNER = rf"[A-Z]{GAP}[A-Z]{GAP}[A-Z]{GAP}[UJZ]"
FULL_NUMBER = rf"(?U)(?<![A-Z0-9])({OWNER}(?:{GAP}[0-9]){{7}})(?![A-Z0-9])"
SIX_DIGIT_NUMBER = rf"(?U)(?<![A-Z0-9])({OWNER}(?:{GAP}[0-9]){{6}})(?![A-Z0-9])"
SIZE_CODE = rf"(?U)(?<![A-Z0-9])([1-4LMN][0-9]){BLANK}*([GVRHBUTP]){BLANK}*([0-9A-Z])(?![A-Z0-9])"
SIZE_CODE_STRICT = r"(?<![A-Z0-9])([1-4LMN][0-9][GVRHBUTP][0-9A-Z])(?![A-Z0-9])"
SIZE_CODE_WITH_C = (rf"(?iU)(?<![A-Z0-9])([1-4LMN][0-9]){BLANK}*C{BLANK}*([0-9A-Z]?)(?![A-Z0-9])")
FEET_TEXT = rf"(?U)(10|20|30|40|45|48|53){BLANK}*(?:FT|FEET)"
PREFIX = r"^[A-Z]{3}[UJZ][0-9]{6}\z"
NUMBER = r"^[A-Z]{3}[UJZ][0-9]{7}\z"
LENGTHS = {"1": "10 FT", "2": "20 FT", "3": "30 FT", "4": "40 FT", "L": "45 FT", "M": "48 FT", "N": "53 FT"}
# --------------------------------------------------------------------------------------------------

_OPEN, _CLOSE = "\ue000", "\ue001"  # private-use marks around a repaired code


def normalized(text: Column) -> Column:
    """Upper case with everything but A-Z and 0-9 removed."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


# Character values modulo 11, written as digits: at most ten, so any base above that can hold them.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RESIDUES = "".join("0123456789A"[VALUE_TABLE.index(letter) % 11] for letter in _LETTERS)


def weighted_rest(prefix: Column) -> Column:
    """Sum of character value times 2^position over the first ten characters, modulo 11.

    Only for texts of A-Z and 0-9. 13 is 2 modulo 11, so the digits read as one number of base 13, the first one last,
    have the same rest as the sum.
    """
    digits = F.translate(F.left(prefix, F.lit(10)), _LETTERS, _RESIDUES)
    return (F.conv(F.reverse(digits), 13, 10).cast("bigint") % 11).cast("int")


def check_digit(prefix: Column) -> Column:
    """Check digit of owner letters, category letter and six serial digits; null for anything else."""
    return F.when(prefix.rlike(PREFIX), weighted_rest(prefix) % 10)


def fix_size_code(text: Column) -> Column:
    """Read a C in the type position of a size code as G; other text keeps its case."""
    marked = F.regexp_replace(text, SIZE_CODE_WITH_C, f"{_OPEN}$1G$2{_CLOSE}")

    def repaired(piece: Column) -> Column:
        code = F.upper(F.substring_index(piece, _CLOSE, 1))
        tail = F.substring(piece, F.length(code) + F.lit(2), F.length(piece))
        return F.when(piece.contains(_CLOSE), F.concat(
            F.when(F.length(code) == 3, F.concat(code, F.lit("1"))).otherwise(code), tail)).otherwise(piece)

    rebuilt = F.array_join(F.transform(F.split(marked, _OPEN), repaired), "")
    return F.when(text.rlike(SIZE_CODE_WITH_C), rebuilt).otherwise(F.coalesce(text, F.lit("")))


def feet_size(text: Column) -> Column:
    """'40 FT' style size of a text that names feet or is a size code as a whole; null otherwise."""
    feet = F.regexp_extract(F.upper(text), FEET_TEXT, 1)
    code = normalized(fix_size_code(text))
    lengths = F.create_map(*[F.lit(v) for pair in LENGTHS.items() for v in pair])
    base = F.element_at(lengths, F.substring(code, 1, 1))
    return (
        F.when(feet != "", F.concat(feet, F.lit(" FT")))
        .when(code.rlike(r"^[1-4LMN][0-9][GVRHBUTP][0-9A-Z]\z"),
              F.when(F.substring(code, 2, 1) == "5", F.concat(base, F.lit(" HC"))).otherwise(base))
    )


def stand_alone_size_code(text: Column) -> Column:
    """First size code that is not part of a longer word; null when there is none."""
    return F.nullif(F.regexp_extract(F.upper(text), SIZE_CODE_STRICT, 1), F.lit(""))


def bound(value: Column, use) -> Column:
    """``use`` applied to ``value`` computed once.

    A lambda variable is never replaced by its definition, so neither the optimizer nor a filter pushed below
    the projection multiplies the work of a long chain of steps.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _only_alnum(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Z0-9]", "")


def _reading(upper: Column) -> Column:
    """What the text shows, as a kind letter and its characters: N a full number, M several different ones,
    S a number without check digit, C a size code, T any other text."""
    full = F.array_distinct(F.transform(F.regexp_extract_all(upper, F.lit(FULL_NUMBER), F.lit(1)), _only_alnum))

    def tagged(tag: str, text: Column) -> Column:
        return F.when(text != "", F.concat(F.lit(tag), text))

    return F.coalesce(
        F.when(upper.rlike(NUMBER), F.concat(F.lit("N"), upper)),  # nothing but a number: no search needed
        bound(full, lambda f: F.when(F.size(f) > 1, F.lit("M")).when(
            F.size(f) == 1, F.concat(F.lit("N"), F.get(f, F.lit(0))))),
        tagged("S", _only_alnum(F.regexp_extract(upper, SIX_DIGIT_NUMBER, 1))),
        tagged("C", _only_alnum(F.regexp_extract(upper, SIZE_CODE, 0))),
        F.concat(F.lit("T"), _only_alnum(upper)))


def _once(rows: DataFrame, values: dict[str, Column], ordered: bool) -> DataFrame:
    """Append columns. A filter on them stays above, so what they take is never repeated inside it; not so if ``ordered``."""
    if ordered:
        return rows.withColumns(values)
    return rows.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in values.items()]))))


def _judged(rows: DataFrame, ordered: bool) -> DataFrame:
    """Append the result columns from ``_corrected``, ``_kind`` and ``_body``, the two parts of the reading."""
    kind, text, rest, digit = (F.col(c) for c in ("_kind", "_body", "_rest", "_digit"))
    derived = kind == "S"
    shaped = F.when(derived | text.rlike(NUMBER), weighted_rest(text))
    summed = _once(rows, {"_rest": shaped}, ordered)
    last = F.when(rest.isNotNull(), F.when(derived, rest % 10).otherwise(F.substring(text, 11, 1).cast("int")))
    # Reading C as G at owner position i raises the weighted sum by (17 - 13) * 2^i.
    repair = F.when(rest % 10 == digit, F.lit(-1))
    for i in range(3):
        repair = repair.when((F.substring(text, i + 1, 1) == "C") & ((rest + 4 * 2**i) % 11 % 10 == digit), F.lit(i))
    placed = summed.withColumn("_digit", last).withColumn("_position", repair)
    number = F.when(derived, F.concat(text, digit.cast("string"))).otherwise(text)
    position = F.col("_position")
    good = position.isNotNull()
    return placed.select(
        "*", F.col("_corrected").alias("corrected_text"),
        F.when(position >= 0, F.concat(F.left(number, position), F.lit("G"), F.substring(number, position + 2, F.lit(11))))
        .otherwise(number).alias("normalized_text"),
        ((kind == "C") | rest.isNotNull()).alias("valid_format"),
        good.alias("valid_check_digit"),
        F.when(kind == "M", "AMBIGUOUS").when(kind == "C", "VALID_SIZE_CODE").when(good, "VALID")
        .when(rest.isNotNull(), "INVALID_CHECK_DIGIT").otherwise("INVALID_FORMAT").alias("validation_status"),
        derived.alias("check_digit_derived"))


VALIDATION = ["corrected_text", "normalized_text", "valid_format", "valid_check_digit", "validation_status", "check_digit_derived"]


def with_validation(reads: DataFrame, text: str = "raw_text", text_limit: int | None = None,
                    ordered: bool = False) -> DataFrame:
    """Append the validation columns of ``text`` to every row; the text as read stays in its own column.

    The corrected text is what was judged. A check digit that was computed because only six digits were legible is
    flagged by ``check_digit_derived``.

    With ``text_limit`` only so many characters are judged, and ``truncated`` marks the rows that have more. ``ordered=True``
    is for rows in an order that the next step needs: Spark still knows of it afterwards and sorts nothing again, but a filter
    on the result would judge every row twice.
    """
    judged = F.col(text) if text_limit is None else F.substring(text, 1, text_limit)
    added = [] if text_limit is None else [(F.length(text) > text_limit).alias("truncated")]
    # Columns of their own are compiled, lambda variables are not; none is repeated, as each is used more than once.
    corrected = reads.withColumn("_fixed", fix_size_code(judged)).withColumn("_upper", F.upper("_fixed"))
    seen = corrected.withColumn("_reading", _reading(F.col("_upper")))
    parts = _once(seen, {"_corrected": F.col("_fixed"), "_kind": F.substring("_reading", 1, 1),
                         "_body": F.substring("_reading", 2, 2**31 - 1)}, ordered)
    return _judged(parts, ordered).select(*reads.columns, *VALIDATION, *added)
