"""Streams of answers, frame by frame: what may go out, how a stream ends, and what was decided.

`frames` takes the events of many streams and gives the frames that a client sees.
A narrow stage first judges what is no text (the fields around an event, an
answer's metadata); then `transformWithState` keeps one stream's withheld texts,
identities and decisions as typed state.  Texts are held back and arguments
withheld to the end; at an end all fields concerned are judged before any is
released.

Events are numbered by stream.  One that comes before its turn waits in state, one
that was seen already is left out, so a replayed batch changes nothing.  A timer
laid at a stream's first event ends it as `stream_timeout`; another removes the
mark of an ended stream, so the state holds recent streams only.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.detect import PLAIN, Settings
from ..operators.inspect import PRIORITY, USUAL_PRIORITY
from ..operators.payloads import scanned
from ..plans.judge import Decision, Halted, Judge
from ..plans.policy import Policy, applies, blocks, decide
from ..sources.payloads import members, rewrite
from .holdback import HOLDBACK

#: How a stream may end.
STATES = (
    "done", "blocked", "inspection_failed", "upstream_eof", "malformed_sse_json", "malformed_sse_payload", "malformed_sse_bytes", "upstream_transport_error",
    "invalid_response_id", "response_id_mismatch", "invalid_tool_identity", "fragmented_tool_identity", "malformed_tool_call_arguments", "stream_timeout",
)
#: Faults of the source, told by its last row, and the state in which they end a stream.
FAULTS = {"bytes": "malformed_sse_bytes", "transport": "upstream_transport_error", "eof": "upstream_eof"}
#: Text fields of a delta and the surface of each.
TEXTS = {"content": "output.stream_chunk", "reasoning": "output.reasoning", "reasoning_content": "output.reasoning", "reasoning_details": "output.reasoning"}
ARGUMENTS, ARGUMENTS_SURFACE = "arguments", "output.tool_calls.arguments"
#: Keys of a frame that say nothing on their own.
BARE = {"id", "object", "created", "model", "system_fingerprint", "choices"}
EVENT = "stream_id string, seq long, data string, event string, id string, retry string, comments array<string>, fault string"
FRAME = "stream_id string, seq long, part int, kind string, frame string, state string, blocked boolean, decision_count long, surfaces array<string>, n_late long"


class Ended(Exception):
    """The stream is over; `flush`: what is withheld is judged and released first."""

    def __init__(self, state: str, flush: bool = False):
        super().__init__(state)
        self.state, self.flush = state, flush


@dataclass
class Held:
    """What is withheld of one field: text, its place in order, and the frame and fields to send it in."""

    text: str
    order: int
    frame: str
    envelope: str


def sse(data: str, envelope: dict) -> str:
    """An event written out, with the fields around it."""
    lines = [f": {c}" for c in envelope.get("comments") or []]
    lines += [f"{name}: {envelope[name]}" for name in ("id", "retry", "event") if envelope.get(name) is not None]
    return "\n".join(lines + [f"data: {line}" for line in data.split("\n")]) + "\n\n"


def _number(node: dict, place: int) -> int:
    """The index that a choice or a call gives itself, else its place."""
    at = node.get("index")
    return at if isinstance(at, int) and not isinstance(at, bool) else place


def _empty(node: dict, inner: str) -> bool:
    """Whether a choice or a call has nothing but its index, nulls and an empty part."""
    return all(v is None or k == "index" or k == inner and v == {} for k, v in node.items())


def pruned(frame: dict) -> dict | None:
    """A frame without empty calls, deltas and choices; None if nothing worth sending is left."""
    choices = []
    for choice in frame["choices"]:
        if isinstance(choice, dict) and isinstance(choice.get("delta"), dict):
            delta = dict(choice["delta"])
            if isinstance(delta.get("tool_calls"), list):
                calls = [{k: v for k, v in c.items() if k != "function" or v != {}} if isinstance(c, dict) else c for c in delta["tool_calls"]]
                delta["tool_calls"] = [c for c in calls if not isinstance(c, dict) or not _empty(c, "function")]
                if not delta["tool_calls"]:
                    del delta["tool_calls"]
            choice = {k: delta if k == "delta" else v for k, v in choice.items() if k != "delta" or delta}
        if not isinstance(choice, dict) or not _empty(choice, "delta"):
            choices.append(choice)
    told = any(v is not None for k, v in frame.items() if k not in BARE)
    return {**frame, "choices": choices} if choices or told else None


def _calls(choice: dict) -> list[tuple[int, dict]]:
    delta = choice.get("delta")
    calls = delta.get("tool_calls") if isinstance(delta, dict) else None
    return [(k, c) for k, c in enumerate(calls) if isinstance(c, dict)] if isinstance(calls, list) else []


def identities(payload: dict) -> Iterator[tuple[str, object]]:
    """(which, value) of the ids and names of tool calls in a frame, by the numbers of choice and call."""
    choices = payload.get("choices")
    for i, choice in enumerate(choices if isinstance(choices, list) else []):
        if isinstance(choice, dict):
            for k, call in _calls(choice):
                at = f"{_number(choice, i)}.{_number(call, k)}"
                if "id" in call:
                    yield f"id:{at}", call["id"]
                if isinstance(call.get("function"), dict) and "name" in call["function"]:
                    yield f"name:{at}", call["function"]["name"]


class Stream:
    """One stream while a batch of its events is worked off; its fields are the typed state."""

    def __init__(self, judge: Judge, holdback: int = HOLDBACK):
        self.judge, self.holdback = judge, holdback
        self.held: dict[str, Held] = {}
        self.seen: dict[str, str] = {}
        self.told: set[str] = set()
        self.surfaces: set[str] = set()
        self.order = 0

    # -- judging ----------------------------------------------------------

    def _decisions(self, text: str, surface: str, pointer: str = "") -> list[Decision]:
        self.surfaces.add(surface)
        try:
            found = self.judge.decisions(text, surface) if text else []
        except Halted:
            raise Ended("inspection_failed") from None
        self.told |= {d.signature(surface, pointer) for d in found}
        return found

    def _written(self, text: str, found: list[Decision]) -> str:
        return self.judge.written(text, found, PRIORITY, USUAL_PRIORITY)

    def _judged(self, text: str, surface: str) -> list[Decision]:
        found = self._decisions(text, surface)
        if any(d.blocks for d in found):
            raise Ended("blocked")
        return found

    def _grow(self, held: Held, surface: str) -> str:
        """Takes from a field what may go: all before the holdback, but no part of a span."""
        found = self._judged(held.text, surface)
        cut = max(0, len(held.text) - self.holdback)
        cut = min([cut, *(d.start for d in found if d.start < cut < d.end)])
        out, held.text = self._written(held.text[:cut], [d for d in found if d.end <= cut]), held.text[cut:]
        return out

    def _arguments(self, text: str) -> str:
        """Arguments as they may go out.  A key cannot be written anew, so what applies to one blocks."""
        if not text:
            return ""
        try:
            parts = list(members(json.loads(text)))
        except ValueError:
            raise Ended("malformed_tool_call_arguments") from None
        edits = []
        for is_key, place, safe, value in parts:
            found = self._decisions(value, ARGUMENTS_SURFACE, json.dumps(safe))
            if any(d.blocks or is_key and d.applies for d in found):
                raise Ended("blocked")
            if any(d.applies for d in found):
                edits.append({"pointer": '["a"]', "json_pointer": json.dumps(place), "value": self._written(value, found)})
        return json.loads(rewrite(json.dumps({"a": text}), edits))["a"] if edits else text

    def flush(self, choices: set[int] | None = None) -> list[str]:
        """Frames of all that is withheld of some choices; nothing comes out if one of them may not."""
        mine = sorted(((k, h) for k, h in self.held.items() if choices is None or int(k.split(".")[0]) in choices), key=lambda x: x[1].order)
        texts = []
        for slot, h in mine:
            field = slot.split(".")[1]
            texts.append(self._arguments(h.text) if field == ARGUMENTS else self._written(h.text, self._judged(h.text, TEXTS[field])))
        out = []
        for (slot, h), text in zip(mine, texts, strict=True):
            del self.held[slot]
            if text:
                field, call = slot.split(".")[1:]
                frame = json.loads(h.frame)
                frame["choices"][0]["delta"] = {"tool_calls": [{"index": int(call), "function": {"arguments": text}}]} if field == ARGUMENTS else {field: text}
                out.append(sse(json.dumps(frame, ensure_ascii=False), json.loads(h.envelope)))
        return out

    # -- events -----------------------------------------------------------

    def _hold(self, slot: str, text: str, payload: dict, choice: dict, envelope: dict) -> Held:
        old = self.held.get(slot)
        self.order += 1
        frame = {**payload, "choices": [{k: v for k, v in choice.items() if k not in ("delta", "finish_reason")}]}
        self.held[slot] = Held((old.text if old else "") + text, old.order if old else self.order, json.dumps(frame), json.dumps(envelope))
        return self.held[slot]

    def _identify(self, payload: dict) -> None:
        if "id" in payload:
            if not isinstance(payload["id"], str):
                raise Ended("invalid_response_id")
            if self.seen.setdefault("response", payload["id"]) != payload["id"]:
                raise Ended("response_id_mismatch")
        for which, value in identities(payload):
            if value is not None and not isinstance(value, str):
                raise Ended("invalid_tool_identity")
            if value and which in self.seen:
                raise Ended("fragmented_tool_identity")
            if value:
                self.seen[which] = value

    def _frame(self, payload: dict, envelope: dict) -> list[str]:
        if not isinstance(payload.get("choices"), list):
            return [sse(json.dumps(payload, ensure_ascii=False), envelope)]
        out, withheld, ending = copy.deepcopy(payload), False, set()
        for i, choice in enumerate(payload["choices"]):
            if not isinstance(choice, dict):
                continue
            number, left = _number(choice, i), out["choices"][i]
            if choice.get("finish_reason") is not None:
                ending.add(number)
            if not isinstance(choice.get("delta"), dict):
                continue
            for k, call in _calls(choice):
                function = call.get("function")
                if isinstance(function, dict) and isinstance(function.get("arguments"), str):
                    self.surfaces.add(ARGUMENTS_SURFACE)
                    self._hold(f"{number}.{ARGUMENTS}.{_number(call, k)}", function["arguments"], payload, choice, envelope)
                    del left["delta"]["tool_calls"][k]["function"]["arguments"]
                    withheld = True
            for field in TEXTS:
                if isinstance(choice["delta"].get(field), str):
                    withheld = True
                    held = self._hold(f"{number}.{field}.0", choice["delta"][field], payload, choice, envelope)
                    free = "" if number in ending else self._grow(held, TEXTS[field])
                    if free:
                        left["delta"][field] = free
                    else:
                        del left["delta"][field]
        frames = self.flush(ending) if ending else []
        kept = pruned(out)
        if kept is not None:
            frames.append(sse(json.dumps(kept, ensure_ascii=False), envelope))
        elif not withheld and not frames:
            frames.append(sse(json.dumps(payload, ensure_ascii=False), envelope))
        return frames

    def event(self, row) -> list[str]:
        """Frames that go out after one event; raises Ended."""
        self.told |= set(row.told)
        self.surfaces |= set(row.surfaces)
        if row.fault is not None:
            state = FAULTS[row.fault]
            raise Ended("" if state == "upstream_eof" and not self.held else state, flush=True)
        if row.stop == "envelope":
            raise Ended(row.stop_state)
        if not row.data:
            return []
        if row.data == "[DONE]":
            raise Ended("done", flush=True)
        try:
            payload = json.loads(row.data)
        except (ValueError, RecursionError):
            raise Ended("malformed_sse_json", flush=True) from None
        if row.stop == "metadata":
            raise Ended(row.stop_state)
        if not isinstance(payload, dict):
            raise Ended("malformed_sse_payload", flush=True)
        self._identify(payload)
        return self._frame(payload, row.envelope)


@dataclass
class Row:
    """An event with the verdict on what is no text of it."""

    seq: int
    data: str | None
    envelope: dict
    fault: str | None = None
    stop: str | None = None
    stop_state: str | None = None
    told: tuple = ()
    surfaces: tuple = ()


def _row(r) -> Row:
    text = lambda v: v if isinstance(v, str) else None  # noqa: E731  pandas has NaN for null
    return Row(int(r.seq), text(r.data), json.loads(r.envelope), text(r.fault), text(r.stop), text(r.stop_state), tuple(r.told), tuple(r.surfaces))


def work(stream: Stream, row: Row) -> tuple[list[str], str | None]:
    """(frames, state in which the stream ended or None) after one event; an ended stream's last frame says so, unless it ends in silence ("")."""
    try:
        return stream.event(row), None
    except Ended as over:
        state, frames = over.state, []
        if over.flush:
            try:
                frames = stream.flush()
            except Ended as worse:
                state, frames = worse.state, []
        return frames + ([] if state == "" else [last_frame(stream, state, row.envelope)]), state


def last_frame(stream: Stream, state: str, envelope: dict) -> str:
    if state == "done":
        return sse("[DONE]", envelope)
    kind = "sensitive_data_blocked" if state == "blocked" else "upstream_transport_error" if state == "upstream_transport_error" else "stream_error"
    told = {"error": {"message": f"stream ended: {state}", "type": kind}, "summary": {"stream_state": state, "decision_count": len(stream.told), "surfaces_inspected": sorted(stream.surfaces)}}
    return sse(json.dumps(told), {"event": "error"})


# -- Spark ------------------------------------------------------------------


def judged_events(events: DataFrame, policy: Policy, settings: Settings = PLAIN) -> DataFrame:
    """`events` with stop, stop_state, told and surfaces: the verdict on the fields around an event and on an answer's metadata.  These are never written anew: what applies blocks."""
    for name, kind in (("event", "string"), ("id", "string"), ("retry", "string"), ("comments", "array<string>"), ("fault", "string")):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    around = F.to_json(F.struct("id", "event", "retry", F.coalesce("comments", F.array().cast("array<string>")).alias("comments")), {"ignoreNullFields": "false"})
    bare = F.col("id").isNull() & F.col("event").isNull() & F.col("retry").isNull() & (F.coalesce(F.size("comments"), F.lit(0)) <= 0)
    seen = events.withColumn("_envelope", scanned(F.when(~bare, around), policy, "sse", settings)).withColumn("_metadata", scanned(F.when(F.col("data") != "[DONE]", F.col("data")), policy, "stream_metadata", settings))

    def found(part: str):
        of = F.transform(f"{part}.rows", lambda s: F.transform(s["spans"], lambda x: F.struct(x.alias("span"), s["name"].alias("surface"), s["pointer"].alias("pointer"), decide(policy, x["entity"], s["name"], x["confidence"]).alias("decision"))))
        return F.filter(F.flatten(of), lambda f: f["decision"]["action"] != "allow")

    seen = seen.withColumn("_around", found("_envelope")).withColumn("_within", found("_metadata"))
    wrong = lambda c: F.exists(c, lambda f: blocks(policy.mode, f["decision"]["action"], f["decision"]["on_fail"]) | applies(policy.mode, f["decision"]["action"], f["decision"]["on_fail"]))
    halts = lambda c: F.exists(c, lambda f: F.coalesce(f["decision"]["on_fail"] == "exception", F.lit(False)))
    stop = F.when(wrong("_around") | halts("_around"), "envelope").when(wrong("_within") | halts("_within"), "metadata")
    state = F.when(halts("_around") | ~wrong("_around") & halts("_within"), "inspection_failed").otherwise("blocked")
    told = F.transform(F.concat("_around", "_within"), lambda f: F.concat_ws("|", f["surface"], f["pointer"], f["span"]["start"].cast("string"), f["span"]["end"].cast("string"), f["span"]["entity"], f["span"]["detector_id"], f["decision"]["action"], f["decision"]["rule_id"]))
    return seen.select(
        "stream_id", F.col("seq").cast("long").alias("seq"), "data", around.alias("envelope"), "fault", stop.alias("stop"), F.when(stop.isNotNull(), state).alias("stop_state"),
        told.alias("told"), F.array_distinct(F.concat("_envelope.rows.name", "_metadata.rows.name")).alias("surfaces"),
    )


class Processor(StatefulProcessor):
    """Keeps what is withheld (by field), identities, decisions, events that wait for their turn, and a mark (next number, late ones, order, end)."""

    def __init__(self, judge: Judge, holdback: int, limit_ms: int, first: int, dense: bool):
        self.judge, self.holdback, self.limit_ms, self.first, self.dense = judge, holdback, limit_ms, first, dense

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "slot string", "text string, place long, frame string, envelope string")
        self.seen = handle.getMapState("seen", "which string", "value string")
        self.told = handle.getMapState("told", "kind string, name string", "n int")
        self.waiting = handle.getMapState("waiting", "seq long", "row string")
        self.mark = handle.getValueState("mark", "next long, late long, place long, ended string")

    def _load(self) -> Stream:
        s = Stream(self.judge, self.holdback)
        s.held = {k[0]: Held(*v) for k, v in self.held.iterator()}
        s.seen = {k[0]: v[0] for k, v in self.seen.iterator()}
        for (kind, name), _ in self.told.iterator():
            (s.told if kind == "decision" else s.surfaces).add(name)
        return s

    def _clear(self, mark: bool) -> None:
        for state in (self.held, self.seen, self.told, self.waiting, *([self.mark] if mark else [])):
            state.clear()

    def _save(self, s: Stream, before: Stream) -> None:
        """Writes what has changed."""
        for slot in before.held.keys() - s.held.keys():
            self.held.removeKey((slot,))
        for slot, h in s.held.items():
            if before.held.get(slot) != h:
                self.held.updateValue((slot,), (h.text, h.order, h.frame, h.envelope))
        for which, value in s.seen.items():
            if which not in before.seen:
                self.seen.updateValue((which,), (value,))
        for kind, now, then in (("decision", s.told, before.told), ("surface", s.surfaces, before.surfaces)):
            for name in now - then:
                self.told.updateValue((kind, name), (1,))

    def _out(self, key: str, rows: list[tuple[int, int, str, str, str | None]], s: Stream, late: int) -> pd.DataFrame:
        n, surfaces = len(s.told), sorted(s.surfaces)
        return pd.DataFrame([(key, seq, part, kind, frame, state, state == "blocked" if state is not None else None, n, surfaces, late) for seq, part, kind, frame, state in rows], columns=[c.split(" ")[0] for c in FRAME.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark.get() if self.mark.exists() else None
        at, late, place, ended = mark if mark is not None else (self.first, 0, 0, None)
        ended = ended if isinstance(ended, str) else None
        if mark is None and self.limit_ms:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.limit_ms)
        if ended is not None:
            n = sum(len(batch) for batch in rows)
            self.mark.update((at, late + n, place, ended))
            return
        stream = self._load()
        stream.order, before = place, copy.deepcopy(stream)
        parked = {k[0] for k in self.waiting.keys()}
        now: dict[int, Row] = {}
        for batch in rows:
            for r in batch.itertuples():
                seq = int(r.seq)
                if seq < at or seq in now or seq in parked:
                    late += 1
                else:
                    now[seq] = _row(r)
        out: list[tuple[int, int, str, str, str | None]] = []
        while at in now or at in parked or not self.dense and now:
            at = at if self.dense else min(now)
            if at in now:
                row = now.pop(at)
            else:
                row = Row(**json.loads(self.waiting.getValue((at,))[0]))
                self.waiting.removeKey((at,))
                parked.discard(at)
            frames, ended = work(stream, row)
            out += [(at, k, "frame", f, None) for k, f in enumerate(frames)]
            at += 1
            if ended is not None:
                break
        if ended is not None:
            late += len(now) + len(parked)
            if ended:
                out[-1] = (*out[-1][:2], "terminal", out[-1][3], ended)
            self._clear(mark=False)
        else:
            for seq, row in now.items():
                self.waiting.updateValue((seq,), (json.dumps(row.__dict__),))
            self._save(stream, before)
        self.mark.update((at, late, stream.order, ended))
        if out:
            yield self._out(key[0], out, stream, late)

    def table(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The same for rows of a table in order of stream and number: only the stream at hand is held, whatever its length."""
        key, stream, at, late, ended = None, None, 0, 0, None
        for batch in batches:
            for same, rows in batch.groupby("stream_id", sort=False, dropna=False):
                if stream is None or same != key:
                    key, stream, at, late, ended = same, Stream(self.judge, self.holdback), self.first, 0, None
                out = []
                for r in rows.itertuples():
                    at = at if self.dense else max(at, int(r.seq))
                    if ended is not None or r.seq != at:
                        late += ended is not None or r.seq < at  # a gap is never closed: what follows waits for ever
                        continue
                    frames, ended = work(stream, _row(r))
                    out += [(at, k, "frame", f, None) for k, f in enumerate(frames)]
                    at += 1
                    if ended:
                        out[-1] = (*out[-1][:2], "terminal", out[-1][3], ended)
                if out:
                    yield self._out(key, out, stream, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.mark.exists():
            return
        at, late, _, ended = self.mark.get()
        if isinstance(ended, str):
            self._clear(mark=True)
            return
        stream = self._load()
        self._clear(mark=False)
        self.mark.update((at, late, 0, "stream_timeout"))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.limit_ms)
        yield self._out(key[0], [(at, 0, "terminal", last_frame(stream, "stream_timeout", {}), "stream_timeout")], stream, late)

    def close(self) -> None:
        pass


def frames(events: DataFrame, policy: Policy, holdback: int = HOLDBACK, limit_seconds: int = 300, first: int = 0, dense: bool = True, settings: Settings = PLAIN, key: bytes | None = None) -> DataFrame:
    """Frames of all streams, from rows (stream_id, seq, data and perhaps event, id, retry, comments, fault).

    Each output row is a frame; a `terminal` one ends its stream and has its state,
    whether it is blocked, the number of distinct decisions, the surfaces seen and
    how many events came late or twice.  `fault` (bytes, transport, eof) is told by a
    row of its own after the last event.  A stream that ends without `[DONE]` and has
    nothing withheld ends in silence.  The first event of a stream has the number
    `first`; with `dense` the numbers follow without gaps, else events come in order
    and their numbers only rise (as those of `sources.sse_stream`).  Works on streams and on tables; on a table a stream's events are all there, and no time passes.
    """
    if holdback < 0:
        raise ValueError("a holdback is not negative")
    processor = Processor(Judge(policy, settings, key), holdback, limit_seconds * 1000, first, dense)
    judged = judged_events(events, policy, settings)
    if events.isStreaming:
        return judged.groupBy("stream_id").transformWithStateInPandas(processor, FRAME, "Append", "ProcessingTime")
    return judged.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInPandas(processor.table, FRAME)


def telemetry(out: DataFrame) -> DataFrame:
    """(state, blocked, n_streams, n_decisions): how streams ended, from what frames() gives."""
    return out.where("kind = 'terminal'").groupBy("state", "blocked").agg(F.count("*").alias("n_streams"), F.sum("decision_count").alias("n_decisions"))
