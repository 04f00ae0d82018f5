"""Text operators over tables of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.functions import iso6346
from gatelake.functions.ocr_text import generated_confidence, generated_text
from gatelake.operators.ordered import join_null_safe

LINE_HEIGHT = 30  # fixed value: fragments whose tops share a multiple of this are on one line


def normalize_text(reads: DataFrame) -> DataFrame:
    return reads.withColumn("normalized", iso6346.normalized(F.col("raw_text")))


def iso6346_check_digit(reads: DataFrame) -> DataFrame:
    """Check digit of the first ten characters of the normalised text; null when they have the wrong form."""
    prefixed = normalize_text(reads).withColumn("prefix", F.substring("normalized", 1, 10))
    return prefixed.withColumn("check_digit", iso6346.check_digit(F.col("prefix"))).drop("normalized")


def fix_size_code(reads: DataFrame) -> DataFrame:
    return reads.withColumn("corrected_text", iso6346.fix_size_code(F.col("raw_text")))


def validate_reads(reads: DataFrame, ordered: bool = False) -> DataFrame:
    return iso6346.with_validation(reads, ordered=ordered)


def container_feet_size(reads: DataFrame) -> DataFrame:
    return reads.withColumn("container_size", iso6346.feet_size(F.col("raw_text")))


def extract_size_code(reads: DataFrame) -> DataFrame:
    return reads.withColumn("size_code", iso6346.stand_alone_size_code(F.col("raw_text")))


def clean_generated_text(texts: DataFrame) -> DataFrame:
    cleaned = texts.withColumn("cleaned", generated_text(F.col("generated")))
    return cleaned.withColumn("text_confidence", generated_confidence(F.col("generated"), F.col("cleaned")))


def assemble_fragments(fragments: DataFrame, crops: DataFrame | None = None, text_limit: int | None = None) -> DataFrame:
    """Text of a crop from its fragments in reading order, the least confidence among them, and their number.

    With ``crops`` every crop has a row; one without fragments has an empty text at confidence 0. With ``text_limit``
    the text is cut there and ``truncated`` says whether something was cut. One aggregate for crops of all sizes.
    """
    keys = ["site_id", "crop_id"]
    vertical = F.col("crop_h") > F.col("crop_w") * 1.5
    part = F.struct(
        F.when(vertical, F.col("top_y")).otherwise(F.floor(F.col("top_y") / LINE_HEIGHT).cast("double")).alias("row"),
        F.when(vertical, F.lit(0.0)).otherwise(F.col("left_x")).alias("column"), "ordinal",
        F.coalesce("text", F.lit("")).alias("text"))
    gathered = fragments.select(*keys, "confidence", part.alias("_part")).groupBy(*keys).agg(
        F.sort_array(F.collect_list("_part")).alias("_parts"), F.min("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("fragments"))
    joined = gathered.withColumn("_text", F.array_join(F.transform("_parts", lambda f: f["text"]), " "))
    cut = F.col("_text") if text_limit is None else F.substring("_text", 1, text_limit)
    added = [] if text_limit is None else [(F.length("_text") > text_limit).alias("truncated")]
    result = joined.select(*keys, iso6346.fix_size_code(cut).alias("text"), "confidence", "fragments", *added)
    if crops is None:
        return result
    defaults = {"text": F.lit(""), "confidence": F.lit(0.0), "fragments": F.lit(0), "truncated": F.lit(False)}
    every = join_null_safe(crops.select(*keys).distinct(), result, keys, "left")
    return every.withColumns({c: F.coalesce(c, defaults[c]) for c in result.columns if c not in keys})
