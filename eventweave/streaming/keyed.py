"""Keyed state of the streams, in Spark's state store.

A processor holds the state of one key (a publication, a reader, a session). A micro-batch touches the
keys that occur in it and nothing else, and timers take back what is past its horizon, so neither the
work of a batch nor the state grows with the history. Rows of a key within one micro-batch are put in
order before they are judged; the trigger bounds them.

Timers go by the stream's clock (the column its watermark is on), not by the times inside the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import suppress

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


class FirstPayloads(StatefulProcessor):
    """Rows of a publication whose payload hash is new to it: the first by (created_at, raw_id)."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "payload_hash string", "raw_id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, ["created_at", "raw_id"]).drop_duplicates("payload_hash")
        new = [not self.seen.containsKey((h,)) for h in batch["payload_hash"]]
        batch = batch[new]
        for payload, raw in zip(batch["payload_hash"], batch["raw_id"]):
            self.seen.updateValue((payload,), (int(raw),))
        if len(batch):
            yield batch[self.columns]

    def close(self) -> None:
        pass


class Acceptance(StatefulProcessor):
    """Impressions of one reader, in order of receipt, batch and place.

    An accepted event holds its event key and its (session, story) until `retention_ms` after it was
    taken. Requests with an event out of time or too many events are refused whole. Rows carry
    known (the story exists), timely, body (what copies must share) and taken_ms (the clock).
    """

    def __init__(self, columns: list[str], max_events: int, retention_ms: int):
        self.columns, self.max_events, self.retention_ms = columns, max_events, retention_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "event_key string", "body string, session_id string, story_id bigint, taken_ms bigint")
        self.slots = handle.getMapState("slots", "session_id string, story_id bigint", "taken_ms bigint")

    def _judge(self, row) -> tuple[str, str]:
        if not row.whole:
            return "invalid", "invalid_batch"
        name = (row.event_key or "",)
        if self.events.containsKey(name):
            same = self.events.getValue(name)[0] == row.body
            return ("duplicate", "") if same else ("rejected", "event_conflict")
        if not row.known:
            return "rejected", "story_not_found"
        slot = (row.session_id or "", int(row.story_id))
        if self.slots.containsKey(slot):
            return "rejected", "event_conflict"
        self.events.updateValue(name, (row.body, *slot, int(row.taken_ms)))
        self.slots.updateValue(slot, (int(row.taken_ms),))
        self.taken = True
        return "accepted", ""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, ["received_at", "batch_id", "seq"])
        request = batch.groupby("batch_id", dropna=False)["timely"]
        batch["whole"] = request.transform("all") & (request.transform("size") <= self.max_events)
        self.taken = False
        judged = [self._judge(row) for row in batch.itertuples(index=False)]
        batch["outcome"], batch["code"] = zip(*judged)
        if self.taken and not list(self.handle.listTimers()):
            self.handle.registerTimer(int(batch["taken_ms"].min()) + self.retention_ms)
        yield batch[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Let go of what is past retention and come back for the oldest of the rest."""
        due, left = expiredTimerInfo.getExpiryTimeInMs() - self.retention_ms, []
        for name, (_, session, story, taken) in list(self.events.iterator()):
            if taken <= due:
                self.events.removeKey(name)
                with suppress(KeyError):
                    self.slots.removeKey((session, story))
            else:
                left.append(taken)
        if left:
            self.handle.registerTimer(min(left) + self.retention_ms)
        return iter(())

    def close(self) -> None:
        pass


class Runs:
    """Open runs and qualified cards of one session; reports come in time order."""

    def __init__(self, dwell_ms: int, saved: str | None = None):
        self.dwell_ms = dwell_ms
        kept = json.loads(saved) if saved else {"runs": {}, "seen": [], "last": None}
        self.runs = {int(story): run for story, run in kept["runs"].items()}
        self.seen, self.last = set(kept["seen"]), kept["last"]

    def saved(self) -> str:
        return json.dumps({"runs": self.runs, "seen": sorted(self.seen), "last": self.last})

    def due(self, until_ms: int) -> list[tuple[int, int, int]]:
        """(story, position, time) of the runs that reach the dwell time by `until_ms`."""
        out = []
        for story, (since, position) in list(self.runs.items()):
            if since + self.dwell_ms <= until_ms:
                out.append((story, position, since + self.dwell_ms))
                self.seen.add(story)
                del self.runs[story]
        return out

    def report(self, t_ms: int, stories, positions) -> list[tuple[int, int, int]]:
        """What a report settles. Eligible cards go on or start; the others' runs are broken."""
        out = self.due(t_ms)
        open_now = {int(s): int(p) for s, p in zip(stories, positions) if int(s) not in self.seen}
        self.runs = {story: (self.runs[story][0] if story in self.runs else t_ms, position)
                     for story, position in open_now.items()}
        self.last = t_ms
        return out + (self.due(t_ms) if self.dwell_ms == 0 else [])

    def next_due(self) -> int | None:
        return min((since for since, _ in self.runs.values()), default=None)


class Session:
    """The runs of one session, its clock and the time (`at`) when it is to be looked at again."""

    def __init__(self, dwell_ms: int, idle_ms: int, saved: str | None = None, clock: int = 0):
        self.idle_ms, self.runs, self.clock = idle_ms, Runs(dwell_ms, saved), clock
        self.at = self._wait() if saved else None

    def _wait(self) -> int:
        """On the clock, a run is due as long after the last report as its dwell time lasts from there."""
        first = self.runs.next_due()
        rest = self.idle_ms if first is None else min(self.idle_ms, first + self.runs.dwell_ms - self.runs.last)
        return self.clock + rest

    def report(self, t_ms: int, clock_ms: int, stories, positions) -> list[tuple[int, int, int]]:
        self.clock = max(self.clock, clock_ms)
        return self.runs.report(t_ms, stories, positions)

    def settle(self) -> None:
        self.at = self._wait()

    def expire(self, until_ms: int) -> list[tuple[int, int, int]]:
        """What is due by the clock time `until_ms`; `at` is None when the session is to be forgotten."""
        found = []
        while self.at is not None and self.at <= until_ms:
            passed = self.at - self.clock
            found += self.runs.due(self.runs.last + passed)
            self.at = None if passed >= self.idle_ms else self._wait()
        return found


class Exposures(StatefulProcessor):
    """Qualified exposures of one reader, once per session and card.

    A reader has one state row with the sessions that are not forgotten yet, and one timer for the first of
    them: a session mostly has a few reports, and calls of the state store for each cost more than its work.
    A session's time comes when its earliest open run reaches the dwell time without another report, and at
    the end after `idle_ms` without reports, when it is forgotten. Rows carry session_id, t_ms, seq, the
    eligible cards as stories and positions, and clock_ms.
    """

    def __init__(self, dwell_ms: int, idle_ms: int):
        self.dwell_ms, self.idle_ms = dwell_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("reader", "sessions string, timer bigint")

    def _load(self) -> tuple[dict[str | None, Session], int | None]:
        held = self.state.get() if self.state.exists() else None
        if held is None:
            return {}, None
        return {name: Session(self.dwell_ms, self.idle_ms, runs, clock) for name, runs, clock in json.loads(held[0])}, held[1]

    def _save(self, sessions: dict[str | None, Session], timer: int | None) -> None:
        """Keep the sessions; `timer` is the one that is set now."""
        first = min((s.at for s in sessions.values()), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if sessions:
            self.state.update((json.dumps([(name, s.runs.saved(), s.clock) for name, s in sessions.items()]), first))
        else:
            self.state.clear()

    def _rows(self, key, found) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame([(*key, session, story, position, at) for session, cards in found for story, position, at in cards],
                               columns=["user_id", "session_id", "story_id", "position", "occurred_ms"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sessions, timer = self._load()
        out, met = [], {}
        names = ["session_id", "t_ms", "seq", "clock_ms", "stories", "positions"]
        batch = [row for part in rows for row in zip(*(part[name].tolist() for name in names))]
        for name, t_ms, _, clock_ms, stories, positions in sorted(batch, key=lambda row: row[1:3]):
            name = name if isinstance(name, str) else None
            if name not in sessions:
                sessions[name] = Session(self.dwell_ms, self.idle_ms)
            met[name] = sessions[name]
            cards = met[name].report(int(t_ms), int(clock_ms), stories, positions)
            if cards:
                out.append((name, cards))
        for session in met.values():
            session.settle()
        self._save(sessions, timer)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All sessions whose time has come by the watermark."""
        sessions, _ = self._load()
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        found = [(name, session.expire(until)) for name, session in sessions.items()]
        self._save({name: session for name, session in sessions.items() if session.at is not None}, None)
        yield from self._rows(key, [(name, cards) for name, cards in found if cards])

    def close(self) -> None:
        pass
