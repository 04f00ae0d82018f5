"""Loads of the event store, its manifest, and paging by cursor."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gatelake.operators import confirm, text
from gatelake.sources import driver_tables, store
from tests.test_streams import READS, random_reads

EVENT = "site_id string, id string, gate_id string, timestamp timestamp_ntz, container_number string, event_type string, status string"
DETECTION = ("site_id string, id string, event_id string, camera_id string, origin_key string, track_id long, class_name string, "
             "confidence double, bbox array<double>, timestamp timestamp_ntz")
OCR = ("site_id string, id string, detection_id string, raw_text string, corrected_text string, normalized_text string, "
       "confidence double, valid_format boolean, valid_check_digit boolean, validation_status string, timestamp timestamp_ntz")
SNAPSHOT = "site_id string, id string, event_id string, camera_id string, image_path string, timestamp timestamp_ntz"


def at(minutes):
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minutes)


def tables(spark, rows):
    """Events (site, id, minutes, number) with one row of evidence each."""
    return (
        spark.createDataFrame([(s, i, "in", at(m), n, "ENTRY", "CONFIRMED" if n else "NEEDS_REVIEW") for s, i, m, n in rows], EVENT),
        spark.createDataFrame([(s, f"d{i}", i, "c1", f"o{i}", 1, "container", 0.9, [1.0], at(m + 2)) for s, i, m, n in rows], DETECTION),
        spark.createDataFrame([(s, f"r{i}", f"d{i}", "45G1", "45G1", "45G1", 0.9, True, True, "VALID_SIZE_CODE", at(m)) for s, i, m, n in rows], OCR),
        spark.createDataFrame([(s, f"s{i}", i, "c1", f"{i}.jpg", at(m)) for s, i, m, n in rows], SNAPSHOT))


def seen(spark, path, name="events"):
    return sorted(tuple(r) for r in getattr(store.read_events(spark, path), name).select("site_id", "id").collect())


def test_loads_of_sites_of_one_day_are_merged_and_repeated_ones_add_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    one, other = tables(spark, [("A", "a1", 5, None), ("A", "a2", 6, "N2")]), tables(spark, [("B", "b1", 7, "N3"), ("A", "a3", 1439, "N4")])
    for load in (one, other, one, other):
        store.write_events(*load, path)
    assert seen(spark, path) == [("A", "a1"), ("A", "a2"), ("A", "a3"), ("B", "b1")]
    for name in ("detections", "ocr", "snapshots"):
        assert len(seen(spark, path, name)) == 4
    # Evidence past midnight is filed with its event, and later evidence finds its stored event.
    assert store.read_events(spark, path).detections.where("id = 'da3'").first().day == dt.date(2026, 1, 1)
    late = tables(spark, [("A", "a1", 5, None)])
    more = late[1].withColumn("id", F.lit("late"))
    store.write_events(late[0].limit(0), more, late[2].limit(0), late[3].limit(0), path)
    assert len(seen(spark, path, "detections")) == 5 and len(seen(spark, path)) == 4


def test_only_rows_whose_id_repeats_in_a_first_load_are_grouped(spark, tmp_path, monkeypatch):
    grouped, merged = [], store._merged

    def counted(new, old, rank):
        grouped.append(new.count())
        return merged(new, old, rank)
    monkeypatch.setattr(store, "_merged", counted)
    once = [("A", "a1", 5, "N1"), ("A", "a2", 6, None), ("B", "a1", 7, None)]
    store.write_events(*tables(spark, once), str(tmp_path / "plain"))
    assert grouped == []
    # An event given twice, first open, then confirmed on the next day; its evidence is given twice as well.
    path = str(tmp_path / "twice")
    store.write_events(*tables(spark, [*once, ("A", "a2", 1441, "N2")]), path)
    assert sorted(set(grouped)) == [2]
    assert seen(spark, path) == [("A", "a1"), ("A", "a2"), ("B", "a1")]
    for name in ("detections", "ocr", "snapshots"):
        assert len(seen(spark, path, name)) == 3
    kept = store.read_events(spark, path).events.where("id = 'a2'").first()
    assert (kept.status, kept.container_number, kept.day) == ("CONFIRMED", "N2", dt.date(2026, 1, 2))


def test_reads_are_sorted_once_before_their_shuffle_and_once_after(spark, sf_dir):
    reads = driver_tables.reads(spark, sf_dir)
    observed = confirm.confirm_reads(text.validate_reads(confirm.first_attempts(reads), ordered=True), decisive=True)
    plan = observed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Sort [") == 2


def test_a_promoted_event_replaces_the_open_one_and_is_not_undone(spark, tmp_path):
    path = str(tmp_path / "store")
    opened, promoted = tables(spark, [("A", "a1", 5, None)]), tables(spark, [("A", "a1", 5, "N1")])
    for load in (opened, promoted, opened):
        store.write_events(*load, path)
        row = store.read_events(spark, path).events.first()
    assert (row.container_number, row.status) == ("N1", "CONFIRMED")
    assert store.manifest(spark, path, 1).count() == 4  # what readers of the first manifest see is still there


def test_readers_see_nothing_of_a_load_that_is_not_published(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store.write_events(*tables(spark, [("A", "a1", 5, "N1")]), path)

    def lost(*args):
        raise RuntimeError("driver lost")
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lost)
        with pytest.raises(RuntimeError):
            store.write_events(*tables(spark, [("A", "a2", 6, "N2")]), path)
    assert seen(spark, path) == [("A", "a1")]
    with pytest.raises(Exception):
        store._publish(spark, path, 1, "other")  # the number is taken


def test_pages_by_cursor_equal_one_sorted_list_and_read_few_days(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("AB"[i % 2], f"e{i:03d}", (i // 3) * 200, f"N{i % 4}") for i in range(90)]  # equal times, six and a half days
    store.write_events(*tables(spark, rows), path)
    want = [(i, s) for s, i, m, n in sorted(sorted(rows, key=lambda r: (r[1], r[0])), key=lambda r: -r[2])]
    got, cursor, pages = [], None, 0
    while pages == 0 or cursor:
        page, cursor = store.search_page(spark, path, 20, cursor)
        found = page.orderBy(F.desc("timestamp"), "id", "site_id").collect()
        assert all(r.size_code == "45G1" for r in found)
        got += [(r.id, r.site_id) for r in found]
        pages += 1
    assert got == want and pages == 5
    page, _ = store.search_page(spark, path, 5, sites=["B"], container="n1", sizes=False)
    assert [r.id for r in page.collect()] == [i for i, s in want if s == "B" and int(i[1:]) % 4 == 1][:5]


def test_days_and_sites_prune_folders(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_events(*tables(spark, [("A", f"e{i}", i * 1440, "N") for i in range(5)]), path)
    found = store.read_events(spark, path, since="2026-01-02", until="2026-01-03", sites=["A"]).events.where("container_number = 'N'")
    assert found.count() == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(container_number,N)" in plan


def test_reads_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    lines = spark.range(4000).selectExpr("id as l_orderkey", "id % 7 as l_partkey", "id % 5 as l_suppkey", "1 as l_linenumber",
                                         "0.05D as l_discount")
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(driver_tables, "READS_PER_TASK", 100)
    dealt = driver_tables.reads(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 20 and max(r["count"] for r in dealt) < 300  # AQE put all into one or two parts before


def test_attempts_are_dealt_out_and_gathered_in_one_shuffle(spark):
    df = spark.createDataFrame(random_reads(9, 40), READS)
    observed = confirm.confirm_reads(text.validate_reads(confirm.first_attempts(df)), decisive=True)
    assert observed.count() > 0
    plan = observed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1  # three before
