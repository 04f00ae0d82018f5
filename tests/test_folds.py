"""Ordered operators against plain loops on random input, and their invariants."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gatelake.operators import associate, confirm, detect, text
from gatelake.operators.ordered import mark_chain, newest_per_group, numbered
from gatelake.params import GateParams
from gatelake.plans import pipeline
from gatelake.sources import driver_tables

T0 = dt.datetime(2026, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


OBS = ("site_id string, gate_id string, direction string, origin_key string, frame_timestamp timestamp_ntz, "
       "confirmed boolean, container_number string")


def random_observations(seed, n=300):
    rng, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += rng.choice([0, 1, 5, 12, 29, 31, 70])
        number = rng.choice([None, None, "A", "B", "C"])
        rows.append(("S0", rng.choice(["in", "out"]), rng.choice(["ENTRY", "EXIT"]), f"o{i:04d}", at(t), number is not None, number))
    return rows


def loop_associate(rows, delta=30):
    """Search all events of the lane for every observation, without any pruning."""
    events, out = [], {}
    for site, gate, direction, origin, ts, _, number in sorted(rows, key=lambda r: (r[4], r[3])):
        near = [e for e in events if e["lane"] == (gate, direction) and abs((e["ts"] - ts).total_seconds()) <= delta]
        if number:
            pool = [e for e in near if e["number"] == number] or [e for e in near if e["number"] is None]
        else:
            pool = near
        if pool:
            event = max(enumerate(pool), key=lambda p: (p[1]["ts"], p[0]))[1]
            promoted = bool(number) and event["number"] is None
            if promoted:
                event["number"] = number
            out[origin] = (event["first"], False, promoted)
        else:
            events.append({"lane": (gate, direction), "ts": ts, "number": number, "first": origin})
            out[origin] = (origin, True, False)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_association_equals_loop(spark, seed):
    rows = random_observations(seed)
    want = loop_associate(rows)
    ids = dict(spark.createDataFrame([(o,) for o in want], "o string").select(
        associate.stable_id("event", F.col("o")), "o").collect())
    random.Random(seed).shuffle(rows)
    for parts, windows in ((1, 64), (5, 2)):  # whole segments, and blocks of a minute
        got = associate.associate_events(spark.createDataFrame(rows, OBS).repartition(parts), block_windows=windows).collect()
        assert {r.origin_key: (ids[r.event_id], r.created, r.promoted) for r in got} == want


def test_a_lane_without_a_pause_is_folded_in_blocks(spark):
    """Unread observations every few seconds: the phase of the events depends on the very first one, block after block."""
    rng, t, rows = random.Random(7), 0, []
    for i in range(400):
        t += rng.choice([3, 4, 9])
        number = rng.choice([None, None, None, "A", "B"])
        rows.append(("S0", "in", "ENTRY", f"o{i:04d}", at(t), number is not None, number))
    want = loop_associate(rows)
    ids = dict(spark.createDataFrame([(o,) for o in want], "o string").select(
        associate.stable_id("event", F.col("o")), "o").collect())
    got = associate.associate_events(spark.createDataFrame(rows, OBS).repartition(4), block_windows=16).collect()
    assert {r.origin_key: (ids[r.event_id], r.created, r.promoted) for r in got} == want


def test_two_views_one_visit_and_a_later_one(spark):
    rows = [("S", "in", "ENTRY", "a", at(0), True, "N1"), ("S", "in", "ENTRY", "b", at(5), True, "N1"),
            ("S", "in", "ENTRY", "c", at(6), True, "N2"), ("S", "in", "EXIT", "d", at(7), True, "N1"),
            ("S", "in", "ENTRY", "e", at(60), True, "N1")]
    events = associate.gate_events(associate.associate_events(spark.createDataFrame(rows, OBS)))
    assert events.count() == 4
    assert events.where("container_number = 'N1' and event_type = 'ENTRY'").count() == 2


@pytest.mark.parametrize("seed", [4, 5])
def test_visits_equal_loop(spark, seed):
    rows = [r for r in random_observations(seed) if r[5]]
    anchors, want = {}, set()
    for r in sorted(rows, key=lambda r: (r[4], r[3])):
        key = (r[1], r[2], r[6])
        if key not in anchors or (r[4] - anchors[key]).total_seconds() > 30:
            anchors[key] = r[4]
        want.add((*key, anchors[key]))
    got = associate.dedup_visits(spark.createDataFrame(rows, OBS)).collect()
    assert {(r.gate_id, r.direction, r.container_number, r.first_seen) for r in got} == want
    assert sum(r.observations for r in got) == len(rows)


def test_hot_key_is_spread_and_exact(spark):
    """One key with all rows and no pause: one chain over many buckets."""
    df = spark.range(20000).selectExpr("'k' as k", "id * 7 as us").repartition(7)
    anchors, last = [], None
    for us in range(0, 140000, 7):
        if last is None or us - last >= 1000:
            anchors.append(us)
            last = us
    got = mark_chain(df, ["k"], ["us"], 1000).where("taken").select("us").collect()
    assert sorted(r.us for r in got) == anchors


def test_numbering_and_salted_limit(spark):
    df = spark.range(5000).selectExpr("id % 3 as k", "id as us")
    assert numbered(df, ["k"], ["us"], 100, "n").where("n <> us div 3 + 1").count() == 0
    top = newest_per_group(df, ["k"], [F.desc("us")], 5, salt=F.col("us"))
    assert {(r.k, r.us) for r in top.collect()} == {(u % 3, u) for u in range(4985, 5000)}


READS = ("site_id string, origin_key string, sequence long, arrival long, raw_text string, corrected_text string, "
         "normalized_text string, confidence double, valid_format boolean, valid_check_digit boolean, "
         "validation_status string, check_digit_derived boolean")


def read(origin, sequence, number, confidence=0.9, valid=True):
    return ("S", origin, sequence, sequence, number, number, number, confidence, True, valid, "-", False)


def loop_confirm(reads, p=GateParams()):
    seen, taken = set(), []
    for r in sorted(reads, key=lambda r: (r[2], r[3])):
        if r[2] in seen:
            continue
        seen.add(r[2])
        taken.append(r)
        votes = {}
        for t in taken:
            if t[9] and t[7] >= p.ocr_min_confidence:
                votes.setdefault(t[6], []).append(t[7])
        ordered = sorted(votes.items(), key=lambda v: -len(v[1]))
        if ordered and len(ordered[0][1]) >= 2 and (len(ordered) == 1 or len(ordered[1][1]) < len(ordered[0][1])):
            return ordered[0][0], max(ordered[0][1]), len(taken)
        if len(taken) == p.ocr_max_attempts:
            return None, r[7], len(taken)
    return None


def test_confirmation_equals_loop(spark):
    rng, by_origin = random.Random(9), {}
    for i in range(300):
        origin = f"o{i}"
        by_origin[origin] = [read(origin, rng.randint(1, 7), rng.choice("AAB"), rng.choice([0.5, 0.6, 0.8, 0.95]),
                                  rng.random() < 0.8) for _ in range(rng.randint(1, 8))]
    for reads in by_origin.values():  # the arrival order of equal sequences must be unique
        reads[:] = [(*r[:3], n, *r[4:]) for n, r in enumerate(reads)]
    got = confirm.confirm_reads(spark.createDataFrame([r for v in by_origin.values() for r in v], READS)).collect()
    want = {o: loop_confirm(v) for o, v in by_origin.items()}
    assert {r.origin_key: (r.container_number, r.confidence, r.attempts) for r in got} == {
        o: w for o, w in want.items() if w}


@pytest.mark.parametrize("confirmations, attempts", [(1, 3), (2, 4), (2, 7), (3, 7)])
def test_confirmation_equals_loop_for_other_limits(spark, confirmations, attempts):
    """Three numbers that tie, take turns and are overtaken; some sequences come twice."""
    rng, p = random.Random(confirmations * 10 + attempts), GateParams(ocr_confirmations=confirmations, ocr_max_attempts=attempts)
    by_origin = {}
    for o in range(150):
        reads = []
        for i in range(rng.randint(1, 8)):
            number = rng.choice(["A", "B", "B", "C", None])
            read = ("S", f"o{o}", i, i, f"r{i}", "x", number, rng.choice([0.5, 0.7, 0.9]), True, number is not None, "VALID", False)
            reads += [read, (*read[:3], i + 50, "again", *read[5:])] if rng.random() < 0.3 else [read]
        by_origin[f"o{o}"] = reads
    schema = ("site_id string, origin_key string, sequence long, arrival long, raw_text string, corrected_text string, "
              "normalized_text string, confidence double, valid_format boolean, valid_check_digit boolean, "
              "validation_status string, check_digit_derived boolean")
    got = confirm.confirm_reads(spark.createDataFrame([r for v in by_origin.values() for r in v], schema).repartition(3), p)
    want = {}
    for o, reads in by_origin.items():
        votes, first = {}, {r[2]: r for r in sorted(reads, key=lambda r: (r[2], r[3]), reverse=True)}
        for k, r in enumerate([first[s] for s in sorted(first)][:attempts], 1):
            if r[9] and r[7] >= p.ocr_min_confidence:
                votes[r[6]] = votes.get(r[6], 0) + 1
            top = max(votes.values(), default=0)
            leaders = [n for n, v in votes.items() if v == top]
            if top >= confirmations and len(leaders) == 1 or k == attempts:
                number = leaders[0] if top >= confirmations and len(leaders) == 1 else None
                want[o] = (number, k)
                break
    assert {r.origin_key: (r.container_number, r.attempts) for r in got.collect()} == want
    assert got.where("raw_text = 'again'").count() == 0


def test_confirmation_scenarios(spark):
    rows = [read("two", 1, "N", 0.94), read("two", 2, "N", 0.94)] + [read("two", s, "M") for s in range(3, 103)]
    rows += [read("wrong", s, "X", 0.9, False) for s in range(1, 5)]
    rows += [read("same", 1, "N") for _ in range(10)]
    df = spark.createDataFrame(rows, READS)
    got = {r.origin_key: (r.confirmed, r.container_number, r.attempts) for r in confirm.confirm_reads(df).collect()}
    assert got == {"two": (True, "N", 2), "wrong": (False, None, 4)}
    assert [r.origin_key for r in confirm.confirm_reads(df, pending=True).collect()] == ["same"]


DETS = ("site_id string, camera_id string, source_id string, sequence long, frame_timestamp timestamp_ntz, width int, "
        "height int, det_index int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double")


def random_detections(seed, frames=250):
    rng, t, rows = random.Random(seed), 0.0, []
    for n in range(frames):
        t += rng.choice([0.2, 0.2, 0.5, 3, 5, 6])
        for i in range(rng.randint(0, 4)):
            x, y = rng.randint(0, 12) * 10, rng.randint(0, 3) * 10
            rows.append(("S", "c", "s" if n < frames // 2 else "t", n, at(t), 640, 360, i, rng.choice(["container", "truck"]),
                         0.9, float(x), float(y), float(x + 40), float(y + 30)))
    return rows


def loop_track(rows, ttl=5, least=0.25):
    def share(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(0, w) * max(0, h)
        return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)

    out, tracks, source, ids = {}, {}, None, 0
    for n in sorted({r[3] for r in rows}):
        frame = sorted((r for r in rows if r[3] == n), key=lambda r: r[7])
        if frame[0][2] != source:
            source, tracks, ids = frame[0][2], {}, 0
        now = frame[0][4]
        tracks = {k: v for k, v in tracks.items() if (now - v["seen"]).total_seconds() <= ttl}
        free_tracks, free = set(tracks), set(range(len(frame)))
        while True:
            best = max(((share(tracks[k]["box"], frame[d][10:14]), k, d) for k in free_tracks for d in free
                        if tracks[k]["cls"] == frame[d][8]), default=None)
            if best is None or best[0] < least:
                break
            _, k, d = best
            tracks[k].update(box=frame[d][10:14], seen=now, hits=tracks[k]["hits"] + 1)
            out[n, frame[d][7]] = (k, tracks[k]["hits"])
            free_tracks.discard(k)
            free.discard(d)
        for d in sorted(free):
            ids += 1
            tracks[ids] = {"box": frame[d][10:14], "cls": frame[d][8], "seen": now, "hits": 1}
            out[n, frame[d][7]] = (ids, 1)
    return out


@pytest.mark.parametrize("seed", [11, 12])
def test_tracking_equals_loop(spark, seed):
    rows = random_detections(seed)
    want = loop_track(rows)
    random.Random(seed).shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # frames straddle batches
    try:
        got = detect.track_objects(spark.createDataFrame(rows, DETS).repartition(3), block_expiries=4 if seed == 11 else 256).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.sequence, r.det_index): (r.track_id, r.hits) for r in got} == want


def test_line_crossing(spark):
    boxes = [(5.0, 35.0), (35.0, 65.0), (65.0, 95.0), (5.0, 35.0)]
    rows = [("S", "c", "s", n, at(n), 100, 100, 0, "container", 0.9, a, 0.0, b, 10.0, 1) for n, (a, b) in enumerate(boxes)]
    tracked = spark.createDataFrame(rows, DETS + ", track_id long")
    cams = spark.createDataFrame([("S", "c", "UNKNOWN", "x", 0.5, 0.05, "ENTRY")],
                                 "site_id string, camera_id string, direction string, line_axis string, "
                                 "line_position double, line_deadband double, positive_crossing string")
    got = detect.line_crossing_direction(tracked, cams).orderBy("sequence").collect()
    assert [r.track_direction for r in got] == ["UNKNOWN", "UNKNOWN", "ENTRY", "ENTRY"]


def test_dropped_frames(spark):
    frames = spark.createDataFrame([("S", "c", "s", 100)], "site_id string, camera_id string, source_id string, sequence long")
    assert detect.dropped_frames(frames, first_sequence=1).first().dropped == 99
    assert detect.dropped_frames(frames).first().dropped == 0


def test_skipped_frames_are_never_tracked(spark):
    rows = [("S", "c", "s", n, at(n), 640, 360, 0, "container", 0.9, 10.0, 10.0, 90.0, 90.0) for n in range(8)]
    cams = spark.createDataFrame([("S", "c", 1)], "site_id string, camera_id string, frame_skip int")
    seen = detect.considered_frames(spark.createDataFrame(rows, DETS), cams)
    tracked = {r.sequence: r.hits for r in detect.track_objects(seen.union(seen)).collect()}
    assert tracked == {0: 1, 2: 2, 4: 3, 6: 4}


def test_unknown_keys_are_kept(spark):
    rows = [("S", None, "s", n, at(n), 640, 360, 0, "container", 0.9, 10.0, 10.0, 90.0, 90.0) for n in range(3)]
    tracked = detect.track_objects(spark.createDataFrame(rows, DETS)).collect()
    assert sorted(r.hits for r in tracked) == [1, 2, 3]


def test_late_observation_does_not_join_a_later_event():
    from gatelake.operators.kernels import OpenEvents
    events = OpenEvents(30_000_000)
    assert events.assign(200_000_000, None, "a")[1]
    assert events.assign(10_000_000, None, "b") == ("b", True, False, 10_000_000)


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_use_all_samples(spark, seed):


    from gatelake.operators.metrics import latency_quantiles
    rng = random.Random(seed)
    rows = [("S", rng.choice(["a", None]), at(0), i, rng.choice([0.0, 1.5, rng.random() * 10 ** rng.randint(-4, 4), -rng.random()]))
            for i in range(3000)] + [("S", "one", at(0), 0, 2.0), ("S", "a", at(0), 1, None)]
    df = spark.createDataFrame(rows, "site_id string, key string, ts timestamp_ntz, sample_id long, seconds double")
    got = {r.key: (r.samples, r.p50_ms, r.p95_ms) for r in latency_quantiles(df).collect()}
    for key in ("a", None, "one"):
        values = sorted(r[4] * 1000 for r in rows if r[1] == key and r[4] is not None)
        assert got[key] == (len(values), values[int((len(values) - 1) * 0.5)], values[int((len(values) - 1) * 0.95)])
    assert {r.key: r.samples for r in latency_quantiles(df, keep=10).collect()}[None] == 10


def test_cleaning_and_region(spark):
    raw = spark.createDataFrame([
        ("S", "c", "s", 1, at(0), 150, 100, 0, "Cointainer", 0.9, -10.0, -20.0, 200.0, 200.0),
        ("S", "c", "s", 1, at(0), 150, 100, 1, "truck", float("nan"), 0.0, 0.0, 9.0, 9.0),
        ("S", "c", "s", 1, at(0), 150, 100, 2, "truck", 0.9, 160.0, 0.0, 190.0, 9.0),
        ("S", "c", "s", 1, at(0), 150, 100, 3, "person", 0.9, 0.0, 0.0, 9.0, 9.0),
    ], DETS.replace("class_name", "label"))
    got = detect.clean_detections(raw).collect()
    assert [(r.class_name, r.x1, r.y1, r.x2, r.y2) for r in got] == [("container", 0.0, 0.0, 150.0, 100.0)]
    boxes = spark.createDataFrame([("S", "c", 200, 100, -30.0, -10.0, 250.0, 150.0), ("S", "c", 200, 100, 210.0, 0.0, 250.0, 50.0)],
                                  "site_id string, camera_id string, width int, height int, x1 double, y1 double, x2 double, y2 double")
    cams = spark.createDataFrame([("S", "c", [0.5, 0.5, 1.0, 1.0])], "site_id string, camera_id string, ocr_roi array<double>")
    got = {r.x1: r for r in detect.ocr_region(boxes, cams).collect()}
    assert (got[-30.0].right_px - got[-30.0].left_px, got[-30.0].bottom_px - got[-30.0].top_px) == (100, 50)
    assert (got[-30.0].status, got[210.0].status) == ("OK", "REJECTED")


def test_boxes_are_not_carried_through_the_fold(spark, sf_dir):
    """They follow from the track, so they are written beside the assignments only."""
    reads = driver_tables.reads(spark, sf_dir).where("track_id < 400")
    assert "all_detections" not in pipeline.observations(reads).columns
    assigned = pipeline.assignments(reads)
    assert {"event_id", "bbox", "all_detections"} <= set(assigned.columns)
    assert assigned.where("all_detections is null or event_id is null").count() == 0


def test_spool_documents_are_parsed_once(spark):
    reads = [("S", "c", "in", "ENTRY", f"o{i}", i, s, dt.datetime(2026, 1, 1, 0, i, s), dt.datetime(2026, 1, 1, 0, i), i * 10 + s,
              "CSQU3054383", 0.9) for i in range(20) for s in range(1, 4)]
    df = spark.createDataFrame(reads, "site_id string, camera_id string, gate_id string, direction string, origin_key string, "
                               "track_id long, sequence long, frame_timestamp timestamp_ntz, started_at timestamp_ntz, arrival long, "
                               "raw_text string, confidence double")
    texts = df.selectExpr("site_id", "origin_key as origin", "sequence", "raw_text", "confidence")
    found = confirm.replay_spool(driver_tables.spool_jobs(text.validate_reads(df)), texts)
    assert {r.container_number for r in found.collect()} == {"CSQU3054383"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "to_json" not in plan  # parsed for each of three branches before
