"""The life of alerts on a stream, one state row per fingerprint."""

from __future__ import annotations

from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.scalar import alert_message
from pulsegrid.streaming.ordered import Step, in_order

#: What goes in: fires and commands in one stream.
EVENT_COLUMNS = ["fingerprint", "ts", "seq", "kind", "metric_name", "severity", "value", "score", "minutes"]
KINDS = ("fire", "acknowledge", "resolve", "silence")

_STATE = ("open boolean, id string, metric_name string, first bigint, last bigint, count bigint, severity int, "
          "state string, value double, score double, muted_until bigint, raised bigint")
# times travel as microseconds, which no session time zone can shift
_CHANGE = ("fingerprint string, ts bigint, seq bigint, change string, id string, metric_name string, "
           "severity int, state string, first_seen bigint, last_seen bigint, count bigint, "
           "value double, score double")
_CHANGED = [c.split()[0] for c in _CHANGE.split(", ")]


@dataclass(frozen=True)
class AlertRules:
    dedup_seconds: float = 300.0
    escalation_minutes: float = 30.0
    #: Repeat an escalation this often; None raises an alert once.
    escalate_every_minutes: float | None = None
    #: Forget a fingerprint this long after its last fire.
    idle_hours: float = 24.0
    #: Never forget an open alert, as the batch operators do; its state then stays until it is resolved.
    keep_open: bool = True


@dataclass
class _Alert:
    open: bool = False
    id: str = ""
    metric_name: str = ""
    first: int = 0
    last: int = 0
    count: int = 0
    severity: int = 0
    state: str = ""
    value: float = 0.0
    score: float = 0.0
    muted_until: int = 0
    raised: int = 0

    def change(self, fingerprint: str, at: int, seq: int, what: str) -> tuple:
        return (fingerprint, at, seq, what, self.id, self.metric_name, self.severity, self.state,
                self.first, self.last, self.count, self.value, self.score)


def _apply(a: _Alert, e, fp: str, rules: AlertRules) -> str | None:
    """Apply one event; the name of the change, or None if nothing happened."""
    at = e.us
    if e.kind == "silence":
        a.muted_until = at + int(e.minutes * 60e6)
        return None
    if e.kind == "fire":
        if at < a.muted_until:
            if not a.open:
                return None
            a.state = "silenced"
            return "silenced"
        if a.open and at - a.last < rules.dedup_seconds * 1e6:
            a.last, a.count, a.value, a.score = at, a.count + 1, e.value, e.score
            a.severity = max(a.severity, int(e.severity))
            return "merged"
        a.open, a.id, a.metric_name = True, f"alert-{fp}-{at // 1_000_000}", e.metric_name
        a.first = a.last = at
        a.count, a.severity, a.state, a.value, a.score, a.raised = 1, int(e.severity), "firing", e.value, e.score, 0
        return "fired"
    if not a.open:
        return None
    if e.kind == "resolve":
        a.open, a.state, a.last = False, "resolved", at
        return "resolved"
    a.state = "acknowledged"
    return "acknowledged"


class _Alerts(Step):
    state, out = _STATE, _CHANGE

    def __init__(self, rules: AlertRules):
        self.rules = rules
        self.after = int(rules.escalation_minutes * 60e6)
        self.every = int(rules.escalate_every_minutes * 60e6) if rules.escalate_every_minutes else None
        self.idle = int(rules.idle_hours * 3600e6)

    def begin(self) -> tuple:
        return astuple(_Alert())

    def forgotten(self, a: _Alert) -> int | None:
        """When the fingerprint is forgotten; None for never."""
        return None if a.open and self.rules.keep_open else max(a.last + self.idle, a.muted_until)

    def over(self, a: _Alert, at: int) -> bool:
        end = self.forgotten(a)
        return end is not None and at >= end

    def due(self, a: _Alert) -> int | None:
        """When the next escalation of the alert is due."""
        if not a.open or a.state != "firing" or a.severity >= 4 or (a.raised and self.every is None):
            return None
        return a.first + self.after + (a.raised * self.every if self.every else 0) + 1

    def raise_until(self, a: _Alert, now: int, fp: str, out: list) -> None:
        at = self.due(a)
        while at is not None and at <= now and not self.over(a, at):
            a.severity, a.raised = a.severity + 1, a.raised + 1
            out.append(a.change(fp, at, -1, "escalated"))
            at = self.due(a)

    def rows(self, key: tuple, state: tuple, frame: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        a, fp, out = _Alert(*state), key[0], []
        for e in frame.itertuples(index=False):
            self.raise_until(a, e.us, fp, out)
            if self.over(a, e.us):
                a = _Alert()
            what = _apply(a, e, fp, self.rules)
            if what:
                out.append(a.change(fp, e.us, e.seq, what))
        return astuple(a), pd.DataFrame(out, columns=_CHANGED)

    def until(self, key: tuple, state: tuple, now: int) -> tuple[tuple | None, pd.DataFrame]:
        a, out = _Alert(*state), []
        self.raise_until(a, now, key[0], out)
        return None if self.over(a, now) else astuple(a), pd.DataFrame(out, columns=_CHANGED)

    def wake(self, state: tuple) -> int | None:
        a = _Alert(*state)
        return min([x for x in (self.due(a), self.forgotten(a)) if x is not None], default=None)


def alert_stream(events: DataFrame, watermark: str = "10 minutes", rules: AlertRules = AlertRules()) -> DataFrame:
    """Changes of alerts, in event-time order per fingerprint.

    Events go in when the watermark has passed them, in the order (ts, seq).  Escalation and forgetting follow event
    time too: they happen when the watermark passes, even if the fingerprint is quiet.
    """
    out = in_order(events.select(*EVENT_COLUMNS), "fingerprint", _Alerts(rules), watermark)
    return out.withColumns({c: F.timestamp_micros(c) for c in ("ts", "first_seen", "last_seen")})


def latest_alerts(changes: DataFrame) -> DataFrame:
    """The last known shape of every alert, from the changes written so far."""
    order = F.struct("last_seen", "ts", "seq")
    cols = ["metric_name", "severity", "state", "first_seen", "last_seen", "count", "value", "score"]
    newest = changes.groupBy("id", "fingerprint").agg(F.max_by(F.struct(*cols), order).alias("a"))
    out = newest.select("id", "fingerprint", "a.*")
    first_value = changes.filter("change = 'fired'").select("id", F.col("value").alias("v"), F.col("score").alias("s"))
    return (out.join(first_value, "id", "left")
            .withColumn("message", alert_message(F.col("metric_name"), F.col("v"), F.col("s"))).drop("v", "s"))
