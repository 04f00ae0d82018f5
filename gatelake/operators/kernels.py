"""Ordered folds that run inside tasks on Arrow batches.

Each fold receives the rows of a partition sorted by group and by order inside the group, keeps only the
open state of the current group, and passes every row on with its result columns appended. A group is
therefore never held as a whole, however long it is. The module is pickled by value, so executors need
no installed copy of the package.
"""

from __future__ import annotations

import bisect
import json
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle


def _columns(batch, names):
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def _keys(batch, by):
    return zip(*_columns(batch, by))


def _append(batch, **arrays):
    names = list(batch.schema.names) + list(arrays)
    return pa.RecordBatch.from_arrays(list(batch.columns) + list(arrays.values()), names=names)


def _groups(batches, by):
    """(key, row index arrays by batch) of the groups of sorted batches; only the open group is held."""
    open_key, held = None, []
    for batch in batches:
        for at, key in enumerate(_keys(batch, by)):
            if key != open_key:
                if held:
                    yield open_key, held
                open_key, held = key, []
            held.append((batch, at))
    if held:
        yield open_key, held


def chain_map(by, ts, block_steps):
    """For every block of a key: where a chain that enters at one of its first rows leaves it.

    ``by`` ends with the step of the key and the block, which is ``block_steps`` steps wide. A chain enters at a row of the
    first step of the block or at the first one behind; the last row it takes in the block follows from each by jumps of a
    step. A block is bounded in time and has every time once.
    """
    def run(batches):
        for key, held in _groups(batches, by):
            step_us, width_us = key[-2], key[-2] * block_steps
            times = np.array([batch.column(batch.schema.get_field_index(ts))[at].as_py() for batch, at in held], np.int64)
            jump = np.minimum(np.searchsorted(times, times + step_us), len(times))
            first = min(int(np.searchsorted(times, key[-1] * width_us + step_us)) + 1, len(times))
            last = np.where(jump < len(times), jump, np.arange(len(times)))
            while True:  # pointer doubling: a row that jumps out of the block points at itself
                further = last[last]
                if (further == last).all():
                    break
                last = further
            source, at = held[0]
            keys = [source.column(source.schema.get_field_index(n)).slice(at, 1) for n in by]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array([times[:first].tolist()], pa.list_(pa.int64())),
                 pa.array([times[last[:first]].tolist()], pa.list_(pa.int64()))], names=[*by, "entries", "exits"])

    return run


def chain_starts(by):
    """Append ``start_us``, the last taken row before each block, from the maps of a key's blocks in order.

    ``by`` ends with the step of the key.
    """
    def run(batches):
        group, anchor = None, None
        for batch in batches:
            starts = []
            for key, entries, exits in zip(_keys(batch, by), *_columns(batch, ["entries", "exits"])):
                if key != group:
                    group, anchor = key, None
                starts.append(anchor)
                at = 0 if anchor is None else bisect.bisect_left(entries, anchor + key[-1])
                if at < len(entries):
                    anchor = exits[at]
            yield _append(batch, start_us=pa.array(starts, pa.int64()))

    return run


def chain_fold(by, ts):
    """Mark rows that lie at least a step after the last marked row of their group, or after its ``start_us``.

    ``by`` ends with the step of the key and the block.
    """

    def run(batches):
        group, anchor = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            taken, anchors = [], []
            for key, us, start in zip(_keys(batch, by), *_columns(batch, [ts, "start_us"])):
                if key != group:
                    group, anchor = key, start
                fresh = anchor is None or us - anchor >= key[-2]
                if fresh:
                    anchor = us
                taken.append(fresh)
                anchors.append(anchor)
            yield _append(batch, taken=pa.array(taken, pa.bool_()), anchor_us=pa.array(anchors, pa.int64()))

    return run


class OpenEvents:
    """Events of one lane and direction that are still inside the window.

    Observations arrive in time order, so events are created in time order and the latest one that
    qualifies is the most recent entry of each kind.
    """

    def __init__(self, window_us):
        self.window_us = window_us
        self.events = []  # [event_us, number, event_id], oldest first

    def assign(self, us, number, new_id):
        """Event of the observation: (event_id, created, promoted, event_us)."""
        floor, ceiling = us - self.window_us, us + self.window_us
        if number is None:
            match = self._latest(lambda e: floor <= e[0] <= ceiling)
        else:
            match = (self._latest(lambda e: e[1] == number and floor <= e[0] <= ceiling)
                     or self._latest(lambda e: e[1] is None and floor <= e[0] <= ceiling))
        if self.events and self.events[0][0] < floor - self.window_us:
            self.events = [e for e in self.events if e[0] >= floor - self.window_us]
        if match is None:
            self.events.append([us, number, new_id])
            return new_id, True, False, us
        promoted = number is not None and match[1] is None
        if promoted:
            match[1] = number
        return match[2], False, promoted, match[0]

    def _latest(self, fits):
        return next((e for e in reversed(self.events) if fits(e)), None)


    @classmethod
    def entered(cls, window_us, start):
        """The events handed over as text at the start of a block, or none."""
        state = cls(window_us)
        state.events = json.loads(start) if start else []
        return state

    def handed_over(self, at_us):
        """What rows from a time on can still meet, as text; None if it is nothing."""
        events = [e for e in self.events if e[0] >= at_us - self.window_us]
        return json.dumps(events) if events else None


def association_fold(by, window_us):
    """Assign each observation to an open event of its group, at first those in ``start``, or start a new one."""

    def run(batches):
        group, state = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            results = []
            for key, us, number, new_id, start in zip(
                    _keys(batch, by), *_columns(batch, ["_us", "container_number", "observation_id", "start"])):
                if key != group:
                    group, state = key, OpenEvents.entered(window_us, start)
                results.append(state.assign(us, number, new_id))
            ids, created, promoted, event_us = zip(*results)
            yield _append(batch, event_id=pa.array(ids, pa.string()), created=pa.array(created, pa.bool_()),
                          promoted=pa.array(promoted, pa.bool_()), event_us=pa.array(event_us, pa.int64()))

    return run


def _block_exits(batches, by, width_us, open_block, take):
    """(by, start, exit) of every block: the state that ``take`` leaves after the rows of a block, in order.

    ``by`` ends with the start of the segment and the number of the block in it.
    """
    def closed(key, start, state):
        arrays = [pa.array([v], batch_schema.field(n).type) for n, v in zip(by, key)]
        leaves = state.handed_over(key[-2] + (key[-1] + 1) * width_us)
        return pa.RecordBatch.from_arrays([*arrays, pa.array([start], pa.string()), pa.array([leaves], pa.string())],
                                          names=[*by, "start", "exit"])

    group = start = state = batch_schema = None
    for batch in batches:
        batch_schema = batch.schema
        for key, given, row in zip(_keys(batch, by), *_columns(batch, ["start"]), batch.to_pylist()):
            if key != group:
                if group is not None:
                    yield closed(group, start, state)
                group, start, state = key, given, open_block(given)
            take(state, row)
    if group is not None:
        yield closed(group, start, state)


def association_exits(by, window_us, width_us):
    """The events that are open at the end of every block."""
    def run(batches):
        yield from _block_exits(batches, by, width_us, lambda start: OpenEvents.entered(window_us, start),
                                lambda state, row: state.assign(row["_us"], row["container_number"], row["observation_id"]))
    return run


def overlap(a, b):
    width = min(a[2], b[2]) - max(a[0], b[0])
    height = min(a[3], b[3]) - max(a[1], b[1])
    shared = max(0.0, width) * max(0.0, height)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / union if union > 0 else 0.0


class OpenTracks:
    """Tracks of one class that may still be continued. A track is named by its first detection."""

    def __init__(self, ttl_us, match_iou):
        self.ttl_us, self.match_iou = ttl_us, match_iou
        self.tracks = []  # [start, box, last_us, hits], in order of their start

    def frame(self, us, sequence, indexes, boxes):
        """One (start, hits) per detection of the frame."""
        self.tracks = [t for t in self.tracks if us - t[2] <= self.ttl_us]
        scored = ((overlap(track[1], box), t, d)
                  for t, track in enumerate(self.tracks) for d, box in enumerate(boxes))
        owner, busy = {}, set()
        for score, t, d in sorted((s for s in scored if s[0] >= self.match_iou), reverse=True):
            if t not in busy and d not in owner:
                owner[d] = t
                busy.add(t)
        found = []
        known = list(self.tracks)
        for d, box in enumerate(boxes):
            if d in owner:
                track = known[owner[d]]
                track[1], track[2], track[3] = box, us, track[3] + 1
            else:
                track = [(us, sequence, indexes[d]), box, us, 1]
                self.tracks.append(track)
            found.append((track[0], track[3]))
        return found


    @classmethod
    def entered(cls, ttl_us, match_iou, start):
        """The tracks handed over as text at the start of a block, or none."""
        state = cls(ttl_us, match_iou)
        state.tracks = [[tuple(first), tuple(box), last, hits] for first, box, last, hits in json.loads(start or "[]")]
        state.waiting = []
        return state

    def take(self, row):
        """Like ``frame`` row by row: a frame is taken when the next one starts."""
        if self.waiting and (self.waiting[0]["_us"], self.waiting[0]["sequence"]) != (row["_us"], row["sequence"]):
            self.flush()
        self.waiting.append(row)

    def flush(self):
        if self.waiting:
            self.frame(self.waiting[0]["_us"], self.waiting[0]["sequence"], [r["det_index"] for r in self.waiting],
                       [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in self.waiting])
        self.waiting = []

    def handed_over(self, at_us):
        """What detections from a time on can still continue, as text; None if it is nothing."""
        self.flush()
        tracks = [t for t in self.tracks if at_us - t[2] <= self.ttl_us]
        return json.dumps(tracks) if tracks else None


def tracking_exits(by, ttl_us, match_iou, width_us):
    """The tracks that are open at the end of every block."""
    def run(batches):
        yield from _block_exits(batches, by, width_us, lambda start: OpenTracks.entered(ttl_us, match_iou, start), OpenTracks.take)
    return run


def tracking_fold(by, ttl_us, match_iou):
    """Continue or start a track for every detection, at first those in ``start``; rows are sorted by frame inside a group."""
    frame_columns = ["_us", "sequence", "det_index", "x1", "y1", "x2", "y2"]

    def run(batches):
        group, state, held = None, None, None

        def finished(table):
            nonlocal group, state
            keys = list(_keys(table, by))
            us, sequence, index, *box = _columns(table, frame_columns)
            boxes, starts = list(zip(*box)), _columns(table, ["start"])[0]
            found, at = [], 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at] and us[end] == us[at] and sequence[end] == sequence[at]:
                    end += 1
                if keys[at] != group:
                    group, state = keys[at], OpenTracks.entered(ttl_us, match_iou, starts[at])
                found += state.frame(us[at], sequence[at], index[at:end], boxes[at:end])
                at = end
            begun, hits = zip(*found)
            start_us, start_sequence, start_index = zip(*begun)
            return _append(table, hits=pa.array(hits, pa.int64()), start_us=pa.array(start_us, pa.int64()),
                           start_sequence=pa.array(start_sequence, pa.int64()),
                           start_index=pa.array(start_index, pa.int32()))

        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            # The last frame may go on in the next batch, so it waits.
            frames = list(zip(_keys(batch, by), *_columns(batch, ["_us", "sequence"])))
            cut = len(frames)
            while cut > 0 and frames[cut - 1] == frames[-1]:
                cut -= 1
            if cut > 0:
                yield finished(batch.slice(0, cut))
            held = batch.slice(cut) if frames else None
        if held is not None and held.num_rows:
            yield finished(held)

    return run


cloudpickle.register_pickle_by_value(sys.modules[__name__])
