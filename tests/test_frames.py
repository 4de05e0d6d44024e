"""Frames of streams: how they end, what is withheld and pruned, and the keyed state under batches, repeats and time."""

from __future__ import annotations

import json
from dataclasses import replace

import pytest

from veilspan.functions.detect import DETECTORS
from veilspan.operators import inspect
from veilspan.plans.judge import Judge
from veilspan.plans.policy import Policy, Rule
from veilspan.plans.profiles import PROFILES
from veilspan.sources.payloads import sse_events
from veilspan.streaming import frames as S

CARD = "4111 1111 1111 1111"
POLICY = Policy("p", (Rule("mail", "redact", ("EMAIL",), priority=1), Rule("card", "block", ("CREDIT_CARD",), priority=2), Rule("ssn", "mask", ("US_SSN",), on_fail="mask")), detectors=("regex",))


def chunk(delta, finish=None, index=0, **more):
    choice = {"index": index, "delta": delta} | ({"finish_reason": finish} if finish else {})
    return json.dumps({"id": "r1", "object": "chat.completion.chunk", "choices": [choice]} | more)


def run(*data, policy=POLICY, holdback=24, fault=None):
    """(frames as payloads or texts, final state) of one stream."""
    stream, out, state = S.Stream(Judge(policy), holdback), [], None
    rows = [S.Row(k, d if isinstance(d, str) else json.dumps(d), {}) for k, d in enumerate(data)]
    for row in rows + ([S.Row(len(rows), None, {}, fault)] if fault else []):
        got, state = S.work(stream, row)
        out += got
        if state is not None:
            break
    events = [e["data"] for e in sse_events("".join(out))]
    return [json.loads(d) if d != "[DONE]" else d for d in events], state


def said(out, field="content", index=0):
    return "".join(c["delta"].get(field, "") for p in out if isinstance(p, dict) for c in p.get("choices", []) if c.get("index", 0) == index and "delta" in c)


def test_texts_are_held_back_and_flushed_before_the_last_frame():
    out, state = run(chunk({"content": "write to ann"}), chunk({"content": "@x.org and so on"}), chunk({}, "stop"), "[DONE]")
    assert said(out) == "write to <EMAIL:REDACTED> and so on" and state == "done" and out[-1] == "[DONE]"
    ends = [k for k, p in enumerate(out) if isinstance(p, dict) and p["choices"][0].get("finish_reason")]
    assert ends == [len(out) - 2] and "delta" not in out[-2]["choices"][0]


def test_an_ending_choice_takes_its_own_last_text():
    out, state = run(chunk({"content": "mail ann@x."}), chunk({"content": "org"}, "stop"))
    assert said(out) == "mail <EMAIL:REDACTED>" and state is None


@pytest.mark.parametrize(
    ("data", "fault", "state", "text"),
    [
        (["[DONE]"], None, "done", ""),
        ([chunk({"content": f"pay {CARD} now"}), "[DONE]"], None, "blocked", ""),
        ([chunk({"content": "ok then"})], "eof", "upstream_eof", "ok then"),
        ([chunk({"content": "ok"}, "stop")], "eof", "", "ok"),
        ([], "eof", "", ""),
        ([chunk({"content": "ok then"}), "{no"], None, "malformed_sse_json", "ok then"),
        ([chunk({"content": "ok then"}), "[1]"], None, "malformed_sse_payload", "ok then"),
        ([chunk({"content": "ok then"})], "bytes", "malformed_sse_bytes", "ok then"),
        ([chunk({"content": "ok then"})], "transport", "upstream_transport_error", "ok then"),
        ([chunk({"content": f"{CARD[:12]}"}), chunk({"content": CARD[12:]})], "transport", "blocked", ""),
        ([chunk({"content": "ok then"}, id=7)], None, "invalid_response_id", ""),
        ([chunk({"content": "ok then"}), chunk({"content": "more"}, id="r2")], None, "response_id_mismatch", ""),
        ([chunk({"tool_calls": [{"index": 0, "id": 5}]})], None, "invalid_tool_identity", ""),
        ([chunk({"tool_calls": [{"index": 0, "id": "a"}]}), chunk({"tool_calls": [{"index": 0, "id": "a"}]})], None, "fragmented_tool_identity", ""),
        ([chunk({"tool_calls": [{"index": 0, "id": "a"}]}), chunk({"tool_calls": [{"index": 0, "id": None}]}), chunk({"tool_calls": [{"index": 1, "id": "a"}]}), "[DONE]"], None, "done", ""),
        ([chunk({"tool_calls": [{"index": 0, "function": {"name": "f", "arguments": '{"a": '}}]}), "[DONE]"], None, "malformed_tool_call_arguments", ""),
    ],
)
def test_states(data, fault, state, text):
    out, ended = run(*data, fault=fault)
    assert (ended, said(out)) == (state, text) and (ended in S.STATES or not ended)
    if state not in ("", "done"):
        assert out[-1]["summary"]["stream_state"] == state and out[-1]["error"]["type"]


def test_exceptions_end_a_stream_without_its_texts():
    halting = Policy("h", (Rule("mail", "redact", ("EMAIL",), on_fail="exception"),), detectors=("regex",))
    out, state = run(chunk({"content": "ann@x.org"}), "[DONE]", policy=halting)
    assert state == "inspection_failed" and said(out) == "" and len(out) == 1


def test_arguments_are_judged_whole_and_sent_after_names():
    call = lambda **f: {"tool_calls": [{"index": 2, "function": f}]}
    out, state = run(chunk(call(name="send", arguments='{"to": "ann')), chunk(call(arguments='@x.org"}')), chunk({}, "tool_calls"), "[DONE]")
    assert state == "done" and [p["choices"][0].get("delta", {}).get("tool_calls") for p in out[:3]] == [[{"index": 2, "function": {"name": "send"}}], [{"index": 2, "function": {"arguments": '{"to":"<EMAIL:REDACTED>"}'}}], None]
    out, state = run(chunk(call(arguments='{"ann@x.org": 1}')), chunk({"content": "by the way"}), "[DONE]")
    assert state == "blocked" and said(out) == ""  # a key cannot be written anew, and nothing else of the stream comes out


def test_one_choice_that_blocks_withholds_the_other():
    both = lambda a, b: json.dumps({"choices": [{"index": 0, "delta": {"content": a}}, {"index": 1, "delta": {"content": b}}]})
    out, state = run(both("fine", "4111 1111"), both("", " 1111 1111"), "[DONE]")
    assert state == "blocked" and said(out, index=0) == said(out, index=1) == ""
    out, state = run(both("fine", "also fine"), json.dumps({"choices": [{"index": 1, "finish_reason": "stop"}]}), fault="eof")
    assert state == "upstream_eof" and (said(out, index=0), said(out, index=1)) == ("fine", "also fine")


@pytest.mark.parametrize(
    ("payload", "kept"),
    [
        ({"choices": [{"index": 0, "delta": {}}]}, None),
        ({"id": "a", "model": "m", "choices": [{"index": 0, "delta": {"tool_calls": [{"index": 0, "function": {}}]}}]}, None),
        ({"choices": [{"index": 0, "delta": {"role": "assistant"}}, {"index": 1}]}, {"choices": [{"index": 0, "delta": {"role": "assistant"}}]}),
        ({"usage": {"n": 1}, "choices": []}, {"usage": {"n": 1}, "choices": []}),
        ({"choices": [{"index": 0, "delta": {"tool_calls": [{"index": 0, "id": "x", "function": {}}, {"index": 1}]}, "finish_reason": "stop"}]}, {"choices": [{"index": 0, "delta": {"tool_calls": [{"index": 0, "id": "x"}]}, "finish_reason": "stop"}]}),
    ],
)
def test_pruning(payload, kept):
    assert S.pruned(payload) == kept


def test_frames_without_choices_go_through():
    out, state = run({"id": "r1", "object": "ping"}, {"id": "r1", "choices": [{"index": 0}]}, "[DONE]")
    assert out == [{"id": "r1", "object": "ping"}, {"id": "r1", "choices": [{"index": 0}]}, "[DONE]"] and state == "done"


def test_all_ways_of_cutting_give_the_same_text():
    text = f"a ssn 123-45-6789 and ann@x.org, bob@y.org; {'word ' * 20}end"
    want = "a ssn 12*******89 and <EMAIL:REDACTED>, <EMAIL:REDACTED>; " + "word " * 20 + "end"
    for n in (1, 2, 7, 30, 500):
        out, _ = run(*[chunk({"content": text[k : k + n]}) for k in range(0, len(text), n)], "[DONE]", holdback=24)
        assert said(out) == want


def test_judge_says_what_the_columns_say(spark):
    texts = [f"mail ann@x.org card {CARD} ssn 123-45-6789 call 212-555-0199 or 212-555-0100", "MRN: 12345678 passphrase = " + "zx81" * 4, "nothing"]
    own = Policy("own", (Rule("h", "hash", ("EMAIL",), hash_algo="sha512", priority=3), Rule("t", "tokenize", ("PHONE",)), Rule("r", "replace", ("US_SSN",), replacement="-"), Rule("m", "mask", ("CREDIT_CARD",), on_fail="mask"), Rule("o", "redact", ("MRN",), on_fail="observe")), detectors=("regex",))
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for policy in (own, *(replace(p, detectors=tuple(f for f in p.detectors if f in DETECTORS)) for p in PROFILES.values() if not any(r.action == "encrypt" for r in p.rules))):
        judge = Judge(policy, key=b"k")
        for r in inspect.inspect(docs, "text", policy, surface="output.content", key=b"k").collect():
            if r.halted:
                continue
            found = judge.decisions(r.text, "output.content")
            assert sorted((d.start, d.end, d.rule.id) for d in found) == sorted((f.span.start, f.span.end, f.decision.rule_id) for f in r.findings)
            assert any(d.blocks for d in found) == r.blocked
            if not any(x.scope == "surface" for x in policy.rules):
                assert judge.written(r.text, found, inspect.PRIORITY, inspect.USUAL_PRIORITY) == r.transformed


EVENTS = "stream_id string, seq long, data string, event string, id string, retry string, comments array<string>, fault string"


def row(stream, seq, data, fault=None, event=None):
    return (stream, seq, data, event, None, None, None, fault)


def test_streams_in_batches(spark, tmp_path):
    """Repeats, gaps and lower numbers in later batches; envelopes and metadata; state goes with time."""
    batches = [
        [row("a", 0, chunk({"content": "write to ann"})), row("b", 1, chunk({"content": " two"})), row("c", 0, chunk({"content": "x"}), event="mail bob@y.org"), row("d", 0, chunk({"content": "left"})), row("e", 0, chunk({"content": "z"}, note="ann@x.org"))],
        [row("a", 0, chunk({"content": "write to ann"})), row("a", 1, chunk({"content": "@x.org and on"})), row("b", 0, chunk({"content": "one"})), row("b", 2, "[DONE]")],
        [row("a", 1, chunk({"content": "@x.org and on"})), row("a", 2, "[DONE]"), row("b", 3, chunk({"content": "after"}))],
    ]
    source = f"{tmp_path}/in"

    def step(rows, seconds):
        if rows:
            spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(EVENTS).parquet(source)
        query = S.frames(events, POLICY, 8, seconds).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(once=True).start()
        query.awaitTermination()

    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in batches:
            step(rows, 600)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old) if old else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.parquet(f"{tmp_path}/out").orderBy("stream_id", "seq", "part").collect()
    got = {s: said([json.loads(e["data"]) for r in out if r.stream_id == s for e in sse_events(r.frame) if e["data"] != "[DONE]"]) for s in "abcde"}
    assert got == {"a": "write to <EMAIL:REDACTED> and on", "b": "one two", "c": "", "d": "", "e": ""}
    assert {r.stream_id: (r.state, r.blocked) for r in out if r.kind == "terminal"} == {"a": ("done", False), "b": ("done", False), "c": ("blocked", True), "e": ("blocked", True)}
    assert next(r.n_late for r in out if r.stream_id == "a" and r.kind == "terminal") == 2
    assert {r.state: r.n_streams for r in S.telemetry(spark.read.parquet(f"{tmp_path}/out")).collect()} == {"done": 2, "blocked": 2}


def test_timer(monkeypatch):
    """The limit runs from the first event; a second timer takes the mark away."""

    class Value:
        def __init__(self):
            self.v = None

        exists, get, clear = (lambda self: self.v is not None), (lambda self: self.v), (lambda self: setattr(self, "v", None))

        def update(self, v):
            self.v = v

    class Map(dict):
        def iterator(self):
            return iter(list(self.items()))

        updateValue, removeKey, getValue = dict.__setitem__, dict.__delitem__, dict.__getitem__

    class Handle:
        timers = []

        getMapState = lambda self, *a: Map()
        getValueState = lambda self, *a: Value()

        def registerTimer(self, at):
            self.timers.append(at)

    class Clock:
        getCurrentProcessingTimeInMs = lambda self: 1000

    import pandas as pd

    p = S.Processor(Judge(POLICY), 8, 300_000, 0, True)
    p.init(Handle())
    rows = pd.DataFrame([{"stream_id": "a", "seq": 0, "data": chunk({"content": "pending text that is long"}), "envelope": "{}", "fault": None, "stop": None, "stop_state": None, "told": [], "surfaces": []}])
    (first,) = p.handleInputRows(("a",), iter([rows]), Clock())
    assert list(first["kind"]) == ["frame"] and Handle.timers == [301_000] and p.held
    (over,) = p.handleExpiredTimer(("a",), Clock(), None)
    assert list(over["state"]) == ["stream_timeout"] and not p.held and Handle.timers == [301_000, 301_000]
    assert list(p.handleInputRows(("a",), iter([rows]), Clock())) == [] and p.mark.get()[1] == 1
    assert list(p.handleExpiredTimer(("a",), Clock(), None)) == [] and not p.mark.exists()


def test_tables_and_empty_tables(spark):
    rows = [row("a", 0, chunk({"content": "to ann@x.org"})), row("a", 1, "[DONE]"), row("z", 5, "[DONE]"), row("q", 0, None), row("q", 1, None, "eof")]
    out = {(r.stream_id, r.kind): r for r in S.frames(spark.createDataFrame(rows, EVENTS), POLICY).collect()}
    assert {k for k in out} == {("a", "frame"), ("a", "terminal")} and out["a", "terminal"].decision_count == 1 and out["a", "terminal"].surfaces == ["output.content", "output.stream_chunk"]
    assert S.frames(spark.createDataFrame([], EVENTS), POLICY).collect() == []
    with pytest.raises(ValueError):
        S.frames(spark.createDataFrame([], EVENTS), POLICY, holdback=-1)


# -- byte files that grow -----------------------------------------------------


def test_pieces_of_a_file_give_each_event_once(tmp_path):
    from veilspan.sources import sse_stream as B

    data = ('data: {"a": "é漢"}\n\n: note\nid: 1\ndata: x\ndata: y\n\n\n' + "data: long " + "w" * 200_000 + "\r\n\r\n\n\n\nevent: e\ndata: z\r\n\r\ndata: tail").encode()
    (tmp_path / "s").write_bytes(data)
    want = [e for e in sse_events(data.decode())]
    rng = __import__("random").Random(3)
    for cuts in [[], list(range(1, 60)), sorted(rng.sample(range(len(data)), 9)), [len(data) - k for k in range(30, 0, -1)]]:
        at, got = [0, *cuts, len(data)], []
        for a, b in zip(at, at[1:], strict=False):
            with open(tmp_path / "s", "rb") as f:
                got += list(B.piece_events(f, a, b, "eof" if b == len(data) else None))
        assert [e for _, e, fault in got if fault is None] == want and got[-1][2] == "eof"
        assert [n for n, _, _ in got] == sorted({n for n, _, _ in got})
    (tmp_path / "bad").write_bytes(b"data: ok\n\ndata: \xff\n\ndata: more\n\n")
    with open(tmp_path / "bad", "rb") as f:
        assert [(e and e["data"], fault) for _, e, fault in B.piece_events(f, 0, 34, "eof")] == [("ok", None), (None, "bytes")]


def test_growing_files_restart_from_a_checkpoint(spark, tmp_path):
    """Files grow between runs, blocks and characters lie across them; each run starts anew from the checkpoint."""
    from veilspan.sources import sse_stream as B

    B.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    whole = {"a": [f"data: {chunk({'content': t})}\n\n" for t in ("né à ann", "@x.org et ", "puis")] + ["data: [DONE]\n\n"], "b": [f"data: {chunk({'content': 'left here'})}\n\n"]}
    streams = {k: "".join(v).encode() for k, v in whole.items()}
    size = len(streams["a"])
    for step, upto in enumerate((size // 3, size // 3 + 1, size)):
        for name, data in streams.items():
            (folder / name).write_bytes(data[: upto if name == "a" else upto * len(data) // size])
        if step == 2:
            (folder / "b.failed").touch()
        events = spark.readStream.format("veilspan_sse").load(str(folder))
        query = events.writeStream.format("parquet").option("path", f"{tmp_path}/events").option("checkpointLocation", f"{tmp_path}/c1").trigger(once=True).start()
        query.awaitTermination()
    rows = spark.read.schema(B.SCHEMA).parquet(f"{tmp_path}/events").orderBy("stream_id", "seq").collect()
    assert [(r.stream_id, r.data, r.fault) for r in rows] == [*[("a", b[6:-2], None) for b in whole["a"]], *[("b", b[6:-2], None) for b in whole["b"]], ("b", None, "transport")]
    out = S.frames(spark.read.schema(B.SCHEMA).parquet(f"{tmp_path}/events"), POLICY, dense=False).orderBy("stream_id", "seq", "part").collect()
    got = {s: said([json.loads(e["data"]) for r in out if r.stream_id == s for e in sse_events(r.frame) if e["data"] != "[DONE]"]) for s in "ab"}
    assert got == {"a": "né à <EMAIL:REDACTED> et puis", "b": "left here"}
    assert {r.stream_id: r.state for r in out if r.kind == "terminal"} == {"a": "done", "b": "upstream_transport_error"}


def test_a_judge_looks_for_what_its_policy_decides_on():
    from veilspan.functions.detect import scan

    judge = Judge(POLICY)
    named = {e for r in POLICY.rules for e in r.members()}
    assert judge.wanted == named
    for text in ("to ann@x.org, ssn 123-45-6789", "card 4111 1111 1111 1111", "First Name: Ann Lee, 12 May 1980", "user: bob@x.org 212-555-0199", "", "nothing"):
        every = [(s["entity"], s["start"], s["end"]) for s in scan(text, POLICY.detectors, surface="output.stream_chunk") if judge.rule_for(s["entity"], "output.stream_chunk", s["confidence"])]
        assert [(d.entity, d.start, d.end) for d in judge.decisions(text, "output.stream_chunk")] == every
    assert Judge(Policy("open", (Rule("all", "redact"),), detectors=("regex",))).wanted is None
