"""Stateful operators that take the rows of a key in event-time order, whatever order they arrive in.

Rows wait in runs, each stored once and read once: what a call gathers is sorted by time and cut into runs of neighbouring
time slots. One timer a key, at its earliest waiting row, fires when the watermark has passed that; then the runs that have
begun are merged and the rows that are complete are folded in order, so a call holds a run of each gathering at a time and
never the whole key. The runs of a key are listed once a firing. The module is pickled by value.
"""

from __future__ import annotations

import json
import sys
from bisect import bisect_left

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor

from gatelake.operators.kernels import OpenEvents, OpenTracks


#: Rows that a call gathers before it stores them, rows up to which whole slots are stored together, and output rows that it
#: hands over at once.
GATHERED = 100_000
PACKED = 1_000
HANDED = 10_000


def plain(column):
    """Plain Python values of a column, None for what is missing, so that they can be stored as JSON."""
    values = column.tolist()
    return [None if v is None or v != v else v for v in values] if column.hasnans else values


class InOrder(StatefulProcessor):
    """Buffers rows by slots of ``width_us`` and folds what is complete. Subclasses give ``fold``."""

    columns: list[str]  # of the buffered rows; the first is the event time in microseconds
    output: list[str]

    def __init__(self, width_us):
        self.width_us = width_us

    def init(self, handle):
        self.handle = handle
        # Runs by their first slot. A run is never added to, so runs with the same first slot differ in their part.
        self.waiting = handle.getMapState("waiting", "slot bigint, part bigint", "held string")
        self.kept = handle.getValueState("kept", "state string")
        self.due = handle.getValueState("due", "us bigint, part bigint")  # no waiting row is older, no part as high

    def close(self):
        pass

    def _put(self, rows, part):
        """Store rows in runs of whole slots, numbered from ``part``; the number of the next one."""
        rows.sort(key=lambda row: row[0])
        times, start = [row[0] for row in rows], 0
        while start < len(rows):
            end = start + PACKED
            if end < len(rows):
                slot = times[end] // self.width_us
                end = bisect_left(times, slot * self.width_us)
                if end <= start:  # more rows in one slot
                    end = bisect_left(times, (slot + 1) * self.width_us)
            self.waiting.updateValue((times[start] // self.width_us, part), (json.dumps(rows[start:end]),))
            start, part = end, part + 1
        return part

    def _wait(self, us, part):
        self.due.update((us, part))
        self.handle.registerTimer(us // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues):
        due = self.due.get() if self.due.exists() else None
        gathered, first, part = [], None, 0 if due is None else due[1]
        for pdf in rows:
            if len(pdf):
                gathered += zip(*(plain(pdf[c]) for c in self.columns))
                low = int(pdf[self.columns[0]].min())
                first = low if first is None else min(low, first)
            if len(gathered) >= GATHERED:
                part, gathered = self._put(gathered, part), []
        part = self._put(gathered, part)
        if first is not None and (due is None or first < due[0]):
            self._wait(first, part)
        elif first is not None:
            self.due.update((due[0], part))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # The watermark is a millisecond behind the time up to which the input is complete.
        complete_us = (timerValues.getCurrentWatermarkInMs() + 1) * 1000
        if not self.due.exists() or self.due.get()[0] >= complete_us:
            return
        parts = self.due.get()[1]
        runs = sorted(tuple(run) for run in self.waiting.keys())
        begun = bisect_left(runs, complete_us, key=lambda run: run[0] * self.width_us)
        due = runs[begun][0] * self.width_us if begun < len(runs) else None
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else None
        open_rows, results = [], []
        for i, run in enumerate(runs[:begun]):
            rows = json.loads(self.waiting.getValue(run)[0])
            self.waiting.removeKey(run)
            ready = bisect_left(rows, complete_us, key=lambda row: row[0])
            if ready < len(rows):
                left = rows[ready][0]
                self.waiting.updateValue((left // self.width_us, run[1]), (json.dumps(rows[ready:]),))
                due = left if due is None else min(left, due)
            # Of rows that are equal in order the part that came first goes first.
            open_rows += [(self.order(row), run[1], n, row) for n, row in enumerate(rows[:ready])]
            # No run that follows has an older row.
            until = runs[i + 1][0] * self.width_us if i + 1 < begun else complete_us
            if until > run[0] * self.width_us:
                open_rows.sort()
                ready = bisect_left(open_rows, until, key=lambda entry: entry[3][0])
                if ready:
                    state, out = self.fold(key, state, [entry[3] for entry in open_rows[:ready]])
                    results += out
                    del open_rows[:ready]
            if len(results) >= HANDED:
                yield self._rows(results)
                results = []
        if results:
            yield self._rows(results)
        self.kept.update((json.dumps(state),))
        if due is None:
            self.due.clear()
        else:
            self._wait(due, parts)

    def _rows(self, results):
        return pd.DataFrame(dict(zip(self.output, map(list, zip(*results)))))

    def order(self, row):
        raise NotImplementedError

    def fold(self, key, state, rows):
        """(state, output rows) after ordered rows; rows of one time come in one call."""
        raise NotImplementedError


class Tracks(InOrder):
    """Tracks of a source; ids count the starts in frame order."""

    columns = ["us", "sequence", "det_index", "class_name", "x1", "y1", "x2", "y2"]
    output = ["site_id", "camera_id", "source_id", "sequence", "det_index", "class_name", "track_id", "hits", "first_us"]

    def __init__(self, width_us, ttl_us, match_iou):
        super().__init__(width_us)
        self.ttl_us, self.match_iou = ttl_us, match_iou

    def order(self, row):
        return row[:3]

    def fold(self, key, state, rows):
        state = state or {"next": 1, "open": {}}
        classes, ids = {}, {}
        for name, tracks in state["open"].items():
            classes[name] = OpenTracks(self.ttl_us, self.match_iou)
            for track_id, start, box, seen, hits in tracks:
                classes[name].tracks.append([tuple(start), tuple(box), seen, hits])
                ids[name, tuple(start)] = track_id
        out, at = [], 0
        while at < len(rows):
            us, sequence = rows[at][:2]
            end = next((i for i in range(at, len(rows)) if rows[i][:2] != [us, sequence]), len(rows))
            found = {}
            for name in sorted({r[3] for r in rows[at:end]}):
                boxes = {r[2]: tuple(r[4:]) for r in reversed(rows[at:end]) if r[3] == name}  # a repeated one counts once
                indexes = sorted(boxes)
                tracks = classes.setdefault(name, OpenTracks(self.ttl_us, self.match_iou))
                for index, result in zip(indexes, tracks.frame(us, sequence, indexes, [boxes[i] for i in indexes])):
                    found[index] = (name, *result)
            for index in sorted(found):
                name, start, hits = found[index]
                if (name, start) not in ids:
                    ids[name, start] = state["next"]
                    state["next"] += 1
                out.append((*key, sequence, index, name, ids[name, start], hits, start[0]))
            at = end
        last = rows[-1][0]
        state["open"] = {name: [[ids[name, t[0]], t[0], t[1], t[2], t[3]] for t in tracks.tracks if last - t[2] <= self.ttl_us]
                         for name, tracks in classes.items()}
        return state, out


class Events(InOrder):
    """Events of a lane, with a version for every change of an event: 1 when it starts, 2 when it gets its number."""

    columns = ["us", "origin_key", "confirmed", "container_number", "observation_id"]
    output = ["site_id", "gate_id", "direction", "origin_key", "us", "confirmed", "container_number", "event_id", "created",
              "promoted", "event_us", "version"]

    def __init__(self, width_us, window_us):
        super().__init__(width_us)
        self.window_us = window_us

    def order(self, row):
        return row[0], row[1] or ""

    def fold(self, key, state, rows):
        events = OpenEvents(self.window_us)
        events.events = state or []
        out = []
        for us, origin, confirmed, number, new_id in rows:
            event_id, created, promoted, event_us = events.assign(us, number, new_id)
            version = 1 if created else 2 if promoted else None
            out.append((*key, origin, us, confirmed, number or "", event_id, created, promoted, event_us, version or 0))
        return events.events, out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
