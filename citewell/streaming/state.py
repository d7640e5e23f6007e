"""Keyed state machines for transformWithState.

Rows of a key arrive unordered inside a micro-batch, so each batch is put in event order first; its size
is what admission control lets in. Times come and go as microseconds. State that no later row can need
is dropped by an event-time timer.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class AlertRule:
    """Holds where the part exceeds ``threshold`` of all, or so many a second; fires once it has held ``hold_seconds``."""

    name: str
    width_seconds: int
    threshold: float
    hold_seconds: int
    per_second: bool = False

    def over(self, total: int, part: int) -> bool:
        return part / (self.width_seconds if self.per_second else total) > self.threshold


MAX_CITATIONS = 50
MAX_DOCUMENTS = 20


class _Expiring(StatefulProcessor):
    """State whose last field is the time in milliseconds at which it may be dropped.

    A key has one timer, set when its state begins. Later batches only move the field; when the timer
    fires early it is set again. So a batch of a known key costs one read and one write of the state.
    """

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def keep(self, was: tuple | None, now: tuple) -> None:
        self.state.update(now)
        if was is None:
            self.handle.registerTimer(now[-1])

    def expired(self, key) -> Iterator[Row]:
        """Rows to emit when the state is dropped."""
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        if held is not None and held[-1] > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(held[-1])
            return
        self.state.clear()
        yield from self.expired(key)

    def close(self) -> None:
        pass


class RetryCounter(StatefulProcessor):
    """State: attempts since the last success or routing and the times of the last three; either ends it, nothing else."""

    schema = "attempts bigint, times array<bigint>"
    output = "source_url string, failure_reason string, attempts bigint, micros bigint"

    def __init__(self, max_attempts: int = 3, min_gap_seconds: int = 60):
        self.max_attempts, self.gap = max_attempts, min_gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        was = self.state.get()
        count, times = (was[0], list(was[1])) if was is not None else (0, [])
        out = []
        for row in sorted(rows, key=lambda r: (r.micros, r.attempt_id)):
            micros = row.micros
            if row.ok:
                count, times = 0, []
                continue
            count, times = count + 1, [*times, micros][-self.max_attempts :]
            spaced = all(b - a >= self.gap for a, b in zip(times, times[1:]))
            if count >= self.max_attempts and spaced:
                out.append(Row(source_url=key[0], failure_reason=row.error, attempts=count, micros=micros))
                count, times = 0, []
        if count:
            self.state.update((count, times))
        else:
            self.state.clear()
        yield from out

    def close(self) -> None:
        pass


class Versions(StatefulProcessor):
    """State: version and hash of a URL's latest content."""

    output = (
        "source_url string, micros bigint, content_hash string, version bigint, is_new boolean, "
        "version_incremented boolean, last_seen_only boolean"
    )

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "version bigint, content_hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        version, known = self.latest.get() or (0, None)
        out = []
        for row in sorted(rows, key=lambda r: (r.micros, r.content_hash)):
            same = row.content_hash == known
            out.append(
                Row(source_url=key[0], micros=row.micros, content_hash=row.content_hash, version=version + (not same),
                    is_new=version == 0, version_incremented=version > 0 and not same, last_seen_only=same)
            )
            version, known = version + (not same), row.content_hash
        self.latest.update((version, known))
        yield from out

    def close(self) -> None:
        pass


class Alerts(StatefulProcessor):
    """State: a key's panes of the widest window, the last evaluated tick, and since when each rule holds.

    Each pane is counted once, whatever number of rules and widths look at it. Rules are evaluated at every tick that the
    watermark has passed, also when nothing arrives. A key is forgotten once the watermark has passed a tick at which all
    its panes are too old; until then a new pane at that tick may carry on what has held.
    """

    schema = "ticks array<bigint>, totals array<bigint>, parts array<bigint>, done bigint, since array<bigint>, timer bigint"
    output = "key string, rule string, micros bigint, total bigint, part bigint, over boolean, firing boolean"

    def __init__(self, rules: tuple[AlertRule, ...], step_seconds: int):
        self.rules, self.step = rules, step_seconds * 1_000_000
        self.widest = max(r.width_seconds for r in rules) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        panes = sorted((r.tick, r.total, r.part) for r in rows)
        was = self.state.get()
        if was is None:
            held = ([], [], [], panes[0][0] - self.step, [-1] * len(self.rules), 0)
        else:
            held = was
        ticks, totals, parts = (list(column) + [p[i] for p in panes] for i, column in enumerate(held[:3]))
        yield from self.advance(key, ticks, totals, parts, *held[3:], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        if held is None:
            return
        ticks, totals, parts, done, since, timer = held
        # Only the timer that the state knows of is followed by another one.
        timer = timer if timer > expiredTimerInfo.getExpiryTimeInMs() else 0
        yield from self.advance(key, list(ticks), list(totals), list(parts), done, since, timer, timerValues.getCurrentWatermarkInMs() * 1000)

    def advance(self, key, ticks, totals, parts, done, since, timer, upto) -> Iterator[Row]:
        since = list(since)
        # Where each rule's window begins, where all end, and the sums between.
        first, end = [0] * len(self.rules), 0
        total, part = [0] * len(self.rules), [0] * len(self.rules)
        while done + self.step <= upto:
            if end == len(ticks) and (not ticks or ticks[-1] <= done + self.step - self.widest):
                since = [-1] * len(self.rules)
                break
            done += self.step
            began = end
            while end < len(ticks) and ticks[end] <= done:
                end += 1
            for i, rule in enumerate(self.rules):
                total[i] += sum(totals[began:end])
                part[i] += sum(parts[began:end])
                while first[i] < end and ticks[first[i]] <= done - rule.width_seconds * 1_000_000:
                    total[i] -= totals[first[i]]
                    part[i] -= parts[first[i]]
                    first[i] += 1
                over = total[i] > 0 and rule.over(total[i], part[i])
                since[i] = -1 if not over else done if since[i] < 0 else since[i]
                if total[i] > 0:
                    firing = over and done - since[i] >= rule.hold_seconds * 1_000_000
                    yield Row(key=key[0], rule=rule.name, micros=done, total=total[i], part=part[i], over=over, firing=firing)
        old = bisect_right(ticks, done - self.widest + self.step)
        ticks, totals, parts = ticks[old:], totals[old:], parts[old:]
        if not ticks and max(since) < 0:
            self.state.clear()
            return
        if not timer:
            timer = (done + self.step) // 1000
            self.handle.registerTimer(timer)
        self.state.update((ticks, totals, parts, done, since, timer))

    def close(self) -> None:
        pass


class SessionMemory(_Expiring):
    """State: the latest 50 citations and 20 distinct documents of a session, until it expires."""

    schema = "citations array<string>, doc_ids array<string>, expires bigint"
    output = "session_id bigint, pos bigint, kind string, citations array<string>, doc_ids array<string>"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        was = self.state.get()
        citations, docs = (list(was[0]), list(was[1])) if was is not None else ([], [])
        expires, pos = was[2] if was is not None else None, -1
        for row in sorted(rows, key=lambda r: (r.micros, r.pos)):
            if expires is None:
                expires = row.created_micros // 1000 + row.retention_days * 86_400_000
            pos = row.pos
            citations = [*citations, row.document_id][-MAX_CITATIONS:]
            docs = [*[d for d in docs if d != row.document_id], row.document_id][-MAX_DOCUMENTS:]
        self.keep(was, (citations, docs, expires))
        yield Row(session_id=key[0], pos=pos, kind="updated", citations=citations, doc_ids=docs)

    def expired(self, key) -> Iterator[Row]:
        yield Row(session_id=key[0], pos=-1, kind="expired", citations=[], doc_ids=[])


class OrderGuard(StatefulProcessor):
    """State: highest event id of a job. Flags events that do not go beyond it."""

    output = "job_id bigint, event_id bigint, arrival bigint, in_order boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.highest = handle.getValueState("highest", "event_id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.highest.get()
        top = held[0] if held is not None else None
        out = []
        for row in sorted(rows, key=lambda r: r.arrival):
            fine = top is None or row.event_id > top
            top = row.event_id if fine else top
            out.append(Row(job_id=key[0], event_id=row.event_id, arrival=row.arrival, in_order=fine))
        self.highest.update((top,))
        yield from out

    def close(self) -> None:
        pass
