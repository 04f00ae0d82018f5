"""Literal vectors of the validation rules."""

import random

import pytest
from pyspark.sql import functions as F

from gatelake.functions import iso6346
from gatelake.operators import text


def column(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, raw_text string")
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_check_digit(spark):
    got = column(spark, ["CSQU305438", "MSCU663987", "GXYU509070", "INVALID", "CSQA305438", None],
                 iso6346.check_digit(F.col("raw_text")))
    assert got == [3, 0, 4, None, None, None]


def test_check_digit_equals_weighted_sum(spark):
    values = {c: v for v, c in enumerate(iso6346.VALUE_TABLE) if c != "?"}
    rng = random.Random(3)
    texts = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(3)) + rng.choice("UJZ") + f"{rng.randrange(10**6):06d}"
             for _ in range(2000)]
    assert column(spark, texts, iso6346.check_digit(F.col("raw_text"))) == [
        sum(values[c] << i for i, c in enumerate(t)) % 11 % 10 for t in texts]


VALIDATION = [
    ("CSQU3054383", "CSQU3054383", "VALID"), ("csqu 305438 3", "CSQU3054383", "VALID"),
    ("CSQU-305438-3", "CSQU3054383", "VALID"), ("ID: CSQU\n305438\n3", "CSQU3054383", "VALID"),
    ("GXYU 509070", "GXYU5090704", "VALID"), ("CSQU3054384", "CSQU3054384", "INVALID_CHECK_DIGIT"),
    ("CSQA3054383", "CSQA3054383", "INVALID_FORMAT"), ("CSQU3O54383", "CSQU3O54383", "INVALID_FORMAT"),
    ("CSQU30543833", "CSQU30543833", "INVALID_FORMAT"), ("No number visible", "NONUMBERVISIBLE", "INVALID_FORMAT"),
    ("", "", "INVALID_FORMAT"), ("CSQU3054383 MSCU6639870", "", "AMBIGUOUS"), ("45C1", "45G1", "VALID_SIZE_CODE"),
    ("CSQU3054383 csqu-305438-3", "CSQU3054383", "VALID"), ("CS:QU3054383", "CSQU3054383", "VALID"),
    ("CSQU 3054383", "CSQU3054383", "VALID"), ("CXYU5090704", "GXYU5090704", "VALID"),
    ("x" * 5000, "X" * 5000, "INVALID_FORMAT"),
]


def test_validation(spark):
    df = spark.createDataFrame([(i, t, 0.9) for i, (t, _, _) in enumerate(VALIDATION)], "i int, raw_text string, confidence double")
    rows = text.validate_reads(df).orderBy("i").collect()
    assert [(r.raw_text, r.normalized_text, r.validation_status) for r in rows] == VALIDATION
    assert [r.check_digit_derived for r in rows].count(True) == 1
    assert all(r.valid_check_digit == (r.validation_status == "VALID") for r in rows)


def test_text_limit_is_optional_and_marked(spark):
    df = spark.createDataFrame([("CSQU3054383 MSCU6639870",), ("CSQU3054383",)], "raw_text string")
    rows = iso6346.with_validation(df, text_limit=11).collect()
    assert [(r.validation_status, r.truncated) for r in rows] == [("VALID", True), ("VALID", False)]


def test_filter_on_validation_stays_small(spark):
    df = spark.createDataFrame([("CSQU3054383",), ("none",)], "raw_text string")
    assert text.validate_reads(df).where("valid_check_digit and validation_status = 'VALID'").count() == 1


def test_size_code_repair(spark):
    given = ["45C1", "22C1", "42C1", "L5C1", "45C", "42 C 1", "a l5c1 45c Bc", "145C1", "no code"]
    want = ["45G1", "22G1", "42G1", "L5G1", "45G1", "42G1", "a L5G1 45G1 Bc", "145C1", "no code"]
    assert column(spark, given, iso6346.fix_size_code(F.col("raw_text"))) == want


def test_feet_size(spark):
    given = ["45C1", "45G1", "42G1", "22G1", "L5G1", "40 FT", "20FEET", "45G1 45G1", ""]
    want = ["40 FT HC", "40 FT HC", "40 FT", "20 FT", "45 FT HC", "40 FT", "20 FT", None, None]
    assert column(spark, given, iso6346.feet_size(F.col("raw_text"))) == want


@pytest.mark.parametrize("h,expected", [(80, "A B C"), (400, "B A C")])
def test_fragments_follow_the_reading_direction(spark, h, expected):
    rows = [("S", 1, 0, "C", 0.9, 5.0, 70.0), ("S", 1, 1, "A", 0.8, 1.0, 25.0), ("S", 1, 2, "B", 0.7, 9.0, 2.0)]
    df = spark.createDataFrame(rows, "site_id string, crop_id long, ordinal long, text string, confidence double, "
                                     "left_x double, top_y double").withColumns({"crop_w": F.lit(100), "crop_h": F.lit(h)})
    row = text.assemble_fragments(df).first()
    assert (row.text, row.confidence) == (expected, 0.7)


def test_crowded_crop_is_cut_like_its_whole_text(spark):
    df = spark.range(500).selectExpr("'S' as site_id", "1L as crop_id", "100 as crop_w", "80 as crop_h", "id as ordinal",
                                     "cast(id as double) as left_x", "0D as top_y", "'Q' as text", "0.5D as confidence")
    whole = " ".join("Q" * 500)
    cut = text.assemble_fragments(df, text_limit=40).first()
    assert cut.text == whole[:40] and cut.truncated
    crops = spark.createDataFrame([("S", 1), ("S", 2), (None, 3)], "site_id string, crop_id long")
    rows = {r.crop_id: (r.text, r.confidence, r.fragments) for r in text.assemble_fragments(df, crops).collect()}
    assert rows == {1: (whole, 0.5, 500), 2: ("", 0.0, 0), 3: ("", 0.0, 0)}


def test_generated_text(spark):
    df = spark.createDataFrame([("The number is GXYU 509070 4",), ("nothing-here",), ("12 34",), (" \n",), ("45c1",)],
                               "generated string")
    rows = text.clean_generated_text(df).collect()
    assert [(r.cleaned, r.text_confidence) for r in rows] == [
        ("GXYU 509070", 0.95), ("nothing here", 0.7), ("12 34", 0.85), ("", 0.0), ("45G1", 0.95)]


def test_judgement_is_compiled(spark):
    """Lambda variables are interpreted for every row; only the searches that give arrays are left to them."""
    df = spark.createDataFrame([("CSQU3054383",)], "raw_text string")
    plan = text.validate_reads(df)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    judging = [line for line in plan if "INVALID_CHECK_DIGIT" in line]
    assert judging and not any("lambda" in line for line in judging)
