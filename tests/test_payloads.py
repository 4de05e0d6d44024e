"""Payloads end to end, evaluation, policies as YAML, encryption, native spans, joins by place."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from veilspan.functions import transforms as T
from veilspan.functions.detect import Settings, scan, spans
from veilspan.functions.native import ENTITIES, native_spans
from veilspan.functions.secrets import REFUSAL, credential, secret_tokens
from veilspan.operators import evaluation, inspect, ranges, reports
from veilspan.operators.payloads import inspect_payloads, outcomes, unsupported
from veilspan.plans.policy import Policy, Rule, changes, explained, validate, warnings
from veilspan.plans.profiles import PACKS, PROFILES, effective
from veilspan.sources.payloads import SseDecoder, sse_events, sse_text, surfaces
from veilspan.sources.policies import Wrong, as_yaml, digest, parse, parse_pack, verified, without_origin

CARD = "4111 1111 1111 1111"


def chat(*messages, **more):
    return json.dumps({"model": "m-1", "messages": [{"role": r, "content": c} for r, c in messages]} | more)


def answer(content=None, arguments=None, **more):
    message = {"role": "assistant", "content": content}
    if arguments is not None:
        message["tool_calls"] = [{"id": "chatcmpl-tool-0123456789abcdef", "type": "function", "function": {"name": "f", "arguments": arguments}}]
    return json.dumps({"id": "chatcmpl-" + "a1B2" * 4, "object": "chat.completion", "model": "m-1", "choices": [{"index": 0, "message": message}]} | more)


def run(spark, bodies, policy, **more):
    rows = spark.createDataFrame(list(enumerate(bodies)), "k int, payload string")
    return {r.k: r for r in inspect_payloads(rows, "payload", policy, **more).collect()}


def test_requests_and_answers(spark):
    p = PROFILES["balanced"]
    bodies = [chat(("user", f"my card {CARD} and ann@x.org")), answer(f"card {CARD}, mail ann@x.org"), answer(None, json.dumps({"to": "ann@x.org", "n": 1})), answer(None, json.dumps({"ann@x.org": 1})), "not json", None, answer("fine")]
    got = run(spark, bodies, p)
    assert json.loads(got[0].transformed)["messages"][0]["content"] == "my card <CREDIT_CARD:TOKEN> and ann@x.org" and not got[0].blocked  # tokens are for numbers, mail is observed
    assert json.loads(got[1].transformed)["choices"][0]["message"]["content"] == "card <CREDIT_CARD:REDACTED>, mail <EMAIL:REDACTED>"
    assert json.loads(got[2].transformed)["choices"][0]["message"]["tool_calls"][0]["function"]["arguments"] == '{"to":"<EMAIL:REDACTED>","n":1}'
    assert got[3].rejected and got[3].blocked and got[3].transformed is None  # a key cannot be rewritten
    assert got[4].fault == "invalid_json" and got[4].blocked and got[4].transformed is None
    assert got[5].transformed is None and not got[5].blocked
    assert json.loads(got[6].transformed) == json.loads(bodies[6])  # identifiers of the answer are no secrets
    assert all("ann" not in f.pointer for f in got[3].findings)
    rows = spark.createDataFrame(list(enumerate(bodies)), "k int, payload string")
    said = {r.k: (r.status, r.error) for r in outcomes(inspect_payloads(rows, "payload", p)).collect()}
    assert said[3] == (403, "metadata_rejected") and said[4] == (400, "invalid_json") and said[6] == (200, None)
    kinds = spark.createDataFrame([("[]",), ("{}",), (chat(("user", "x")),), ('{"messages":[{"content":[{"type":"image_url"}]}]}',), ("{",)], "p string").select(unsupported(F.col("p")).alias("u")).collect()
    assert [r.u for r in kinds] == ["not_an_object", "no_messages", None, "unsupported_content", "invalid_json"]


def test_metadata_surfaces():
    body = answer("hello", extra={"my key": "v"}, trace={"a": 1})
    rows = surfaces(body, "metadata")
    assert "hello" not in [r["value"] for r in rows] and {"my key", "v", "extra"} <= {r["value"] for r in rows}
    assert {r["flags"] for r in rows if r["value"].startswith("chatcmpl-a")} == {"response_id"} and {r["flags"] for r in rows if r["value"] in ("m-1", "chat.completion")} == {"routing"}
    assert [r["name"] for r in rows if r["value"] == "1"] == ["logs.traces"] and all("key" not in r["pointer"] for r in rows)
    assert [r["value"] for r in surfaces(body, "content")] == ["hello"]
    rows = surfaces(json.dumps({"event": "completion.chunk", "id": "x", "comments": ["c"]}), "sse")
    assert {(r["value"], r["flags"]) for r in rows} == {("completion.chunk", "routing"), ("x", ""), ("c", "")}


def test_argument_keys_come_before_their_values():
    body = answer(None, json.dumps({"a": {"b": 1}, "c": [True, "x"]}))
    rows = [r for r in surfaces(body) if r["name"] == "output.tool_calls.arguments"]
    assert [(r["value"], r["is_key"], json.loads(r["safe_pointer"])) for r in rows] == [
        ("a", True, ["argument", "key", 0]), ("b", True, ["argument", "key", 0, 0]), ("1", False, ["argument", "value", 0, 0]),
        ("c", True, ["argument", "key", 1]), ("True", False, ["argument", "value", 1, 0]), ("x", False, ["argument", "value", 1, 1]),
    ]
    structured = json.dumps({"choices": [{"message": {"tool_calls": [{"function": {"arguments": {"k": "v"}}}]}}]})
    assert [(r["name"], r["value"]) for r in surfaces(structured)] == [("output.tool_calls.arguments", "v")]


def test_scope_halt_hash_and_encryption(spark):
    key = "A" * 43 + "="
    docs = spark.createDataFrame([(1, f"ann@x.org {CARD}"), (2, "none"), (3, None)], "doc_id long, text string")
    make = lambda *rules: Policy("p", rules, detectors=("regex",))
    one = lambda p, **m: {r.doc_id: r for r in inspect.inspect(docs, "text", p, **m).collect()}
    whole = one(make(Rule("s", "redact", ("EMAIL", "CREDIT_CARD"), surfaces=("output.content",), scope="surface")))
    assert whole[1].transformed == "<CREDIT_CARD:REDACTED>" and whole[2].transformed == "none"  # the entity of the higher priority
    halted = one(make(Rule("x", "redact", ("EMAIL",), on_fail="exception")))
    assert halted[1].halted and halted[1].blocked and halted[1].transformed is None and not halted[2].halted
    with pytest.raises(Exception, match="halts the inspection"):
        inspect.halt(inspect.inspect(docs, "text", make(Rule("x", "redact", ("EMAIL",), on_fail="exception")))).collect()
    import hashlib

    for algo in ("sha256", "sha512", "blake2b"):
        assert one(make(Rule("h", "hash", ("EMAIL",), hash_algo=algo)))[1].transformed.startswith(f"<EMAIL:HASH:{algo}={hashlib.new(algo, b'ann@x.org').hexdigest()[:16]}>")
    sealed = make(Rule("e", "encrypt", ("EMAIL",), encrypt_key_env="K"))
    token = one(sealed, environment={"K": key})[1].transformed.split(":ENC:")[1].split(">")[0]
    row = spark.createDataFrame([(token, token[:-6] + "AAAAA=")], "a string, b string").select(T.unsealed(F.col("a"), key).alias("a"), T.unsealed(F.col("b"), key).alias("b")).first()
    assert (row.a, row.b) == ("ann@x.org", None)
    with pytest.raises(ValueError, match="no key"):
        inspect.inspect(docs, "text", sealed, environment={})
    with pytest.raises(ValueError, match="32 bytes"):
        inspect.inspect(docs, "text", sealed, environment={"K": "short"})
    assert one(make(Rule("r", "redact", ("EMAIL",))), reject=F.col("doc_id") == 1)[1].transformed is None


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("token zx81!Kd93 here", ["zx81!Kd93"]),
        ("see https://x.org/a1!b2c3 and a/b1!", ["a/b1!x9z"][:0]),
        ("path /var/lib1/thing and C:\\a1!b2c3", []),
        ("OpenAI-compatible-local-model-network", []),
        ("AK47_CONSTANT_NAME_LONG", []),
        ("`file_path:line_number` `src/a/module_name_long.py:123:4`", []),
        ("call getUserProfileFromCache() now", []),
        ("rename oldName -> getUserProfileFromCache", []),
        ("getUserProfileFromCache", ["getUserProfileFromCache"]),
        ("the model id is qwen2.5-coder:0.5b-instruct", []),
        ("deploy qwen2.5-coder:0.5b-instruct", ["qwen2.5-coder:0.5b-instruct"]),
        ("src/**/*.tsx and lib/secret*/x1.py", []),
        ("aZ3kQ9xW7mN2pL5v", ["aZ3kQ9xW7mN2pL5v"]),
    ],
)
def test_secret_tokens(text, found):
    assert [text[a:b] for a, b in secret_tokens(text)] == found


def test_exempt_fields():
    version = "vllm-0.9.1+cu128-tp2-0a1b2c3d"
    assert list(secret_tokens(version, flags=frozenset({"provider_version"}))) == []
    number = "chatcmpl-" + "a1B2c3D4" * 3
    assert list(secret_tokens(number)) and not list(secret_tokens(number, flags=frozenset({"response_id"})))
    assert list(secret_tokens("inner zx81!Kd93", deny=("kd93",))) == []
    rules = json.dumps([{"permission": "external_directory", "pattern": "/home/ann/cache/opencode/tool-output/*", "action": "allow"}])
    assert list(secret_tokens(REFUSAL + rules, "input.tool_results")) == [] and credential("/home/ann/cache/opencode/tool-output/*")
    assert list(secret_tokens(REFUSAL + rules, "input.messages")) and list(secret_tokens(REFUSAL + rules.replace("/*", "/*x1!z"), "input.tool_results"))


def test_settings(spark):
    mine = lambda text, order: [{"entity": "TICKET", "start": i, "end": i + 3} for i in range(len(text) - 2) if text[i : i + 3] == "T-1"]
    s = Settings(public_figures=("Jane Q Public",), role_accounts=("desk",), custom=(("tickets", 60, mine),))
    assert [x["entity"] for x in scan("see T-1", ("tickets",), settings=s)] == ["TICKET"]
    assert scan("desk@x.org", settings=s) == [] and scan("desk@x.org") != []
    assert scan("Name: Jane Q Public", settings=s) == [] and scan("Name: Jane Q Public") != []
    got = spark.createDataFrame([("x T-1",)], "t string").select(F.inline(spans(F.col("t"), ("tickets",), settings=s))).collect()  # custom families travel to the workers
    assert [(r.entity, r.specificity) for r in got] == [("TICKET", 60)]
    with pytest.raises(ValueError):
        scan("x", ("nowhere",))


def test_native_spans_equal_python(spark):
    rng = random.Random(5)
    parts = ["ann@x.org", "info@x.org", CARD, "4111 1111 1111 1112", "212-555-0199", "+1 (212) 555-0199", "(11) 91234-5678", "123-45-6789", "MRN: 12345678", "DE00123456789012345678", "é", "e\u0301x@y.org", "😀", "\u0001", "word", "\n"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for i in range(300)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "k int, t string")
    native = df.select("k", F.inline(native_spans(F.col("t"), ENTITIES))).select("k", "entity", "start", "end", "value", "detector_id")
    slow = df.select("k", F.inline(spans(F.col("t"), ("regex",), resolved=False, wanted=ENTITIES))).select("k", "entity", "start", "end", "value", "detector_id")
    assert sorted(map(tuple, native.collect())) == [(k, e, a, b, v.replace("\u0001", "\u0002") if "\u0001" in v else v, d) for k, e, a, b, v, d in sorted(map(tuple, slow.collect()))]
    with pytest.raises(ValueError):
        native_spans(F.col("t"), ("PERSON",))


def test_joins_by_place(spark):
    rng = random.Random(2)
    make = lambda n: [(rng.randrange(4), a := rng.randrange(3000), a + rng.randrange(40)) for _ in range(n)]
    a, b = make(120) + [(None, 1, 2)], make(120)
    frame = lambda x: spark.createDataFrame(x, "k int, start int, end int")
    got = sorted(tuple(r) for r in ranges.near(frame(a), frame(b), "k", 50).select("k", "a_start", "a_end", "c_start", "c_end").collect())
    assert got == sorted((k, s, e, s2, e2) for k, s, e in a if k is not None for k2, s2, e2 in b if k == k2 and s2 - e <= 50 and s - e2 <= 50)
    assert ranges.near(frame(a), frame([]), "k", 50).count() == 0


def test_policies_as_yaml():
    for p in PROFILES.values():
        assert parse(as_yaml(p)) == p
    both = effective("broad-pii", ("healthcare", "financial"))
    assert both.name == "broad-pii+healthcare+financial" and validate(both) == [] and parse(as_yaml(both)) == without_origin(both)
    with pytest.raises(ValueError):
        effective("healthcare", ("healthcare",))
    with pytest.raises(ValueError):
        effective("nope")
    with pytest.raises(Wrong, match="lacks"):
        parse("name: x")
    body = "version: 1\nname: x\ndetection: {entities: [EMAIL], adapters: prompt-injection, exclude_engines: [entropy]}\naction:\n  mode: redact\n  rules:\n    - {id: a, action: %s}\n"
    made = parse(body % "redact, match: {entity: EMAIL, surface: any, surface_any_of: [logs.traces]}")
    assert made.detectors == ("regex", "medical-regex", "contextual-anchored", "xpia") and made.rules[0].surfaces == ()
    for wrong in ("dance", "replace", "redact, hash_algo: md5", "hash, hash_algo: md5", "encrypt", "redact, on_fail: shout", "redact, scope: surface", "redact, match: {entity: US_SSNS}", "redact, match: {entity_except: [MRN]}", "redact, match: {surface: moon}"):
        with pytest.raises(Wrong):
            parse(body % wrong)
    with pytest.raises(Wrong, match="raw"):
        parse(body % "redact" + "audit: {store_raw_values: true}")
    with pytest.raises(Wrong, match="between"):
        parse(body % "redact" + "gate_promise: {corpora: [a], recall_floor: 2, specificity_floor: 0}")
    assert [x for x in validate(Policy("p", (Rule("a", "redact", ("PHI",)),))) if "PHI is a category" in x]
    assert any("OAUTH_TOKEN" in w for w in warnings(Policy("p", (Rule("a", "redact", ("OAUTH_TOKEN",)),))))
    assert parse_pack("name: n\nrules: [{id: a, action: block}]").rules[0].pack
    text = as_yaml(PACKS["financial"])
    assert verified(text, digest(text)) and not verified(text + " ", digest(text))


def test_policy_reports(spark):
    old, new = PROFILES["default"], PROFILES["balanced"]
    assert changes(old, new) == {"added_rules": ["redact-generic-identity-outbound"], "removed_rules": [], "changed_rules": ["log-generic-identity-low-noise"], "added_entities": []}
    rows = explained(spark, new).orderBy("rank").collect()
    assert rows[0].priority == 100 and len(rows) == len(new.rules)
    lines = reports.prometheus(spark.createDataFrame([("a.b{x=1,y=z}", 3), ("n{}", 1)], "key string, n long")).collect()
    assert [r.line for r in lines] == ['veilspan_a_b{x="1",y="z"} 3', "veilspan_n 1"]


def test_streams_of_events(spark):
    text = ": hi\nid: 1\nevent: e\ndata: a\ndata: é\n\ndata: b\r\n\r\nretry: 5"
    want = sse_events(text)
    assert [e["data"] for e in want] == ["a\né", "b", None] and want[0]["comments"] == ["hi"] and want[2]["retry"] == "5"
    raw = text.encode()
    for n in (1, 2, 3, 7):
        d, got = SseDecoder(), []
        for i in range(0, len(raw), n):
            got += d.feed(raw[i : i + n], i + n >= len(raw))
        assert got == want
    kind = "struct<data:string,event:string,id:string,retry:string,comments:array<string>>"
    rows = spark.createDataFrame([(e,) for e in want], f"e {kind}").select(sse_text(F.col("e")).alias("t")).collect()
    assert sse_events("".join(r.t for r in rows)) == want


def test_evaluation(spark):
    cases = [
        {"id": "leak", "category": "a", "payload": chat(("user", "zip 12345-6789 secretvalue")), "expected_absent": ["secretvalue"]},
        {"id": "kept", "category": "a", "payload": answer(f"card {CARD}"), "expected_absent": [CARD], "expected_entities": ["CREDIT_CARD"], "expected_actions": ["redact"], "expected_surfaces": ["output.content"], "expected_blocked": False},
        {"id": "clean", "category": "b", "payload": chat(("user", "hello")), "expected_unchanged": True, "expected_no_findings": True, "expected_no_decisions": True},
        {"id": "gap", "category": "b", "payload": chat(("user", "odd thing")), "expected_absent": ["odd"], "known_gap": True},
        {"id": "bad", "category": "b", "payload": "{", "known_gap": True},
        {"id": "block", "category": "c", "payload": chat(("user", "AK" + "IA" + "A1B2C3D4E5F6G7H8")), "expected_blocked": True, "expected_detector_families": ["regex", "nope"]},
        {"id": "args", "category": "c", "payload": answer(None, '{"to":"ann@x.org","n":2}'), "expected_valid_json_pointers": ['["choices",0,"message","tool_calls",0,"function","arguments"]', '["choices",0,"message","content"]'], "expected_json_semantics": [{"pointer": '["choices",0,"message","tool_calls",0,"function","arguments"]', "values": '{"n": 2, "m": 1}'}]},
    ]
    names = ["id", "category", "payload", *(c for c in evaluation.CASE if c not in ("category", "surface"))]
    schema = "id string, category string, payload string, " + ", ".join(f"{c} {evaluation.CASE[c]}" for c in names[3:])
    df = spark.createDataFrame([tuple(c.get(n) for n in names) for c in cases], schema)
    results = evaluation.evaluate(df, PROFILES["balanced"])
    got = {r.id: r for r in results.collect()}
    assert not got["leak"].passed and got["leak"].miss and got["leak"].failures == ["leaks"] and got["leak"].leaked == ["secretvalue"]
    assert got["kept"].passed and got["kept"].mutated and (got["kept"].leaks_before, got["kept"].leaks_after) == (1, 0)
    assert got["clean"].passed and not got["clean"].mutated
    assert got["gap"].passed and got["gap"].would_fail == ["leaks"] and got["gap"].known_gap_miss and not got["gap"].miss
    assert not got["bad"].passed and got["bad"].error == "invalid_json"
    assert got["block"].blocked and got["block"].failures == ["missing_detector_families"]
    assert sorted(got["args"].failures) == ["invalid_json", "json_changed"]
    total = evaluation.summary(results).first()
    assert (total.cases, total.passed, total.errors, total.known_gap, total.miss) == (7, 3, 1, 2, 1)
    assert {r.category: r.cases for r in evaluation.summary(results, ["category"]).collect()} == {"a": 2, "b": 3, "c": 2}
    assert ("actions", "redact") in {(r.dimension, r.value) for r in evaluation.summary_of_sets(results).collect()}
    assert [(r.id, r.leaked) for r in evaluation.misses(results).collect()] == [("leak", "secretvalue")]
    both = {r.detectors: r for r in evaluation.compare(df, PROFILES["balanced"], {"some": ("regex",), "none": ("entropy",), "gone": ("gliner",)}).collect()}
    assert both["gone"].unavailable == "gliner" and both["gone"].cases is None and both["some"].passed > both["none"].passed
    swept = {r.threshold: r.passed for r in evaluation.threshold_sweep(df, PROFILES["balanced"], [0.0, 0.99]).collect()}
    assert swept[0.0] > swept[0.99]


def test_wanted_entities_change_nothing(spark):
    """Looking for some entities only gives what looking for all and filtering gives."""
    rng = random.Random(8)
    parts = ["ann@x.org", CARD, "Name: Ann Lee", "key_" + "a1b2" * 5 + "@x.org", "patient has asthma", "12 Main Street", "BSN: 123456782", "dob: 1990-01-02", "the"]
    for _ in range(200):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))
        for wanted in ({"EMAIL"}, {"CREDIT_CARD", "PERSON"}, {"ADDRESS"}):
            assert scan(text, ("regex",), wanted=frozenset(wanted)) == [s for s in scan(text, ("regex",)) if s["entity"] in wanted]


def test_stream_over_files(spark, tmp_path):
    """Streams that end, block or stay open, read as files in two batches; nothing withheld leaks from a stream that blocks."""
    from veilspan.streaming.holdback import stream, telemetry

    act = lambda s: "block" if s["entity"] == "AWS_KEY" else "redact" if s["entity"] == "EMAIL" else "allow"
    key = "AK" + "IA" + "A1B2C3D4E5F6G7H8"
    first = [("a", 0, "content", "write ann@x", False), ("b", 0, "content", "the key is " + key[:9], False), ("b", 1, "reasoning", "held back", False), ("c", 0, "content", "open", False)]
    second = [("a", 1, "content", ".org now", False), ("a", 2, "content", "", True), ("b", 2, "content", key[9:] + " !", False), ("b", 3, "content", "more", True), ("a", 3, "content", "after the end", False)]
    schema = "stream_id string, seq int, field string, delta string, terminal boolean"
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in{k}")
    (tmp_path / "in").mkdir()
    for k in (0, 1):
        for f in (tmp_path / f"in{k}").glob("part-*"):
            f.rename(tmp_path / "in" / f"{k}-{f.name}")
        deltas = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        query = stream(deltas, act).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start()
        assert query.awaitTermination(60)
    out = spark.read.parquet(f"{tmp_path}/out")
    text = {i: "".join(r.text for r in out.where(F.col("stream_id") == i).collect()) for i in "abc"}
    assert text == {"a": "write <EMAIL:REDACTED> now", "b": "", "c": ""}
    assert {r.stream_id: r.state for r in telemetry(out).collect()} == {"a": "done", "b": "blocked"}


def test_percentiles_and_sweeps(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), float(rng.randrange(12))) for _ in range(200)] + [("a", None), (None, 1.0)]
    got = {r.name: r for r in reports.durations(spark.createDataFrame(rows, "n string, v double"), "n", "v").collect()}
    for name in "ab":
        values = sorted(v for n, v in rows if n == name and v is not None)
        assert (got[name].p50, got[name].p95) == tuple(values[round((len(values) - 1) * p)] for p in (0.5, 0.95))
        assert (got[name].n, got[name].min, got[name].max) == (len(values), values[0], values[-1])
    found = spark.createDataFrame([("x", 0.1), ("x", 0.5), ("y", 0.49)], "entity string, confidence double")
    assert {(r.threshold, r.entity): r.n for r in reports.sweep(found, [0.5, 0.2], ["entity"]).collect()} == {(0.2, "x"): 1, (0.2, "y"): 1, (0.5, "x"): 1}
