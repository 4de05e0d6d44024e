"""Incremental text with a holdback window, as a keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import scan
from ..sources.payloads import members, rewrite

HOLDBACK = 512


class TextState:
    """Pending text of one field: released up to the holdback, never inside a span; a block ends it."""

    def __init__(self, act, holdback: int = HOLDBACK, pending: str = "", halted: bool = False):
        self.act, self.holdback, self.pending, self.halted = act, holdback, pending, halted

    def append(self, delta: str, last: bool = False) -> tuple[str, bool]:
        """(released text, whether this call blocked)."""
        if self.halted:
            return "", False
        self.pending += delta
        spans = sorted(scan(self.pending, surface="output.stream_chunk"), key=lambda s: s["start"])
        acts = [(s, self.act(s)) for s in spans]
        if any(a == "block" for _, a in acts):
            self.halted, self.pending = True, ""
            return "", True
        cut = len(self.pending) if last else max(0, len(self.pending) - self.holdback)
        for s, a in sorted(acts, key=lambda x: -x[0]["start"]):
            if a != "allow" and s["start"] < cut < s["end"]:
                cut = s["start"]
        out, at = [], 0
        for s, a in acts:
            if s["end"] <= cut and s["start"] >= at and a == "redact":
                out += [self.pending[at : s["start"]], f"<{s['entity']}:REDACTED>"]
                at = s["end"]
        out.append(self.pending[at:cut])
        self.pending = self.pending[cut:]
        return "".join(out), False


#: Fields whose name begins so hold arguments of a tool call: they are withheld to the end and judged as JSON.
ARGUMENTS = "arguments:"
_ID = "\0id"


def flushed_arguments(value: str, act) -> tuple[str, str | None]:
    """(arguments to release, why not): keys cannot be rewritten, so a finding on one blocks."""
    if not value:
        return "", None
    try:
        parts = list(members(json.loads(value)))
    except ValueError:
        return "", "malformed_tool_call_arguments"
    edits = []
    for is_key, place, _, text in parts:
        found = [(s, act(s)) for s in sorted(scan(text, surface="output.tool_calls.arguments"), key=lambda s: s["start"])]
        if any(a == "block" or is_key and a != "allow" for _, a in found):
            return "", "blocked"
        out, at = [], 0
        for s, a in found:
            if a == "redact" and s["start"] >= at:
                out += [text[at : s["start"]], f"<{s['entity']}:REDACTED>"]
                at = s["end"]
        if at:
            edits.append({"pointer": '["a"]', "json_pointer": json.dumps(place), "value": "".join(out) + text[at:]})
    return (json.loads(rewrite(json.dumps({"a": value}), edits))["a"] if edits else value), None


def _one_stream(rows: list, act, holdback: int, held: dict[str, str]) -> tuple[list[tuple[str, str]], bool]:
    """(what comes out, whether the stream has ended) for rows in order; `held` takes what is withheld, by field."""
    out: list[tuple[str, str]] = []

    def over(kind: str, text: str = "") -> tuple[list[tuple[str, str]], bool]:
        held.clear()
        return [*out, (kind, text)], True

    for r in rows:
        told = getattr(r, "response_id", None)
        if told is not None and held.setdefault(_ID, told) != told:
            return over("error", "response_id_mismatch")
        if r.field.startswith(ARGUMENTS):
            held[r.field] = held.get(r.field, "") + (r.delta or "")
        else:
            field = TextState(act, holdback, held.get(r.field, ""))
            text, blocked = field.append(r.delta or "")
            held[r.field] = field.pending
            if blocked:
                return over("blocked")
            if text:
                out.append(("chunk", text))
        if r.terminal:
            flushed = []
            for name, pending in sorted(held.items()):  # all are judged before any is released
                if name.startswith(ARGUMENTS):
                    text, why = flushed_arguments(pending, act)
                elif name != _ID:
                    text, stopped = TextState(act, holdback, pending).append("", True)
                    why = "blocked" if stopped else None
                else:
                    continue
                if why:
                    return over("blocked") if why == "blocked" else over("error", why)
                flushed.append(("arguments" if name.startswith(ARGUMENTS) else "chunk", text))
            out += [f for f in flushed if f[1]]
            return over("terminal")
    return out, False


def stream(deltas: DataFrame, act, holdback: int = HOLDBACK, idle_seconds: int = 300) -> DataFrame:
    """(stream_id, kind, text) from rows (stream_id, seq, field, delta, terminal, and perhaps response_id).

    Kinds are chunk, arguments, terminal, blocked, error and timeout; a stream whose
    response id changes ends with an error.  All fields of a stream share one key: at the end either all are released or,
    if one blocks, none.  `act` maps a span to allow, redact or block.  Withheld
    text goes when a stream ends or blocks; a mark that it has ended stays until no
    row has come for `idle_seconds`, and a stream that has not ended by then is
    told as `timeout`, its withheld text dropped.  So the state holds recent streams only.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        ended = held.pop("", None) is not None
        if state.hasTimedOut:
            state.remove()
            out = [] if ended else [("timeout", "")]
        else:
            rows = sorted((r for batch in batches for r in batch.itertuples()), key=lambda r: r.seq)
            out, now_ended = ([], True) if ended else _one_stream(rows, act, holdback, held)
            kept = {"": "ended"} if now_ended else held
            state.update((list(kept), list(kept.values())))
            state.setTimeoutDuration(idle_seconds * 1000)
        yield pd.DataFrame([(key[0], kind, text) for kind, text in out], columns=["stream_id", "kind", "text"])

    return deltas.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, kind string, text string", "fields array<string>, pending array<string>", "append", "ProcessingTimeTimeout")


def telemetry(events: DataFrame) -> DataFrame:
    """(stream_id, n_chunks, n_chars, state): how each stream went, from what stream() gives; the state is done, blocked, timeout, open or the error."""
    last = F.when(F.count_if(F.col("kind") == "blocked") > 0, "blocked").when(F.count_if(F.col("kind") == "terminal") > 0, "done").when(F.count_if(F.col("kind") == "error") > 0, F.max(F.when(F.col("kind") == "error", F.col("text")))).when(F.count_if(F.col("kind") == "timeout") > 0, "timeout").otherwise("open")
    return events.groupBy("stream_id").agg(F.count_if(F.col("kind") == "chunk").alias("n_chunks"), F.sum(F.when(F.col("kind") != "error", F.length("text"))).cast("long").alias("n_chars"), last.alias("state"))
