"""Answer-trace and document-corpus jobs on literal rows."""

import json

from fixtures import T
from gridkit.operators import corpus as C
from gridkit.operators import trace as K

RESP = [
    {"type": "function_call", "name": K.SPACE_TOOL_PREFIX + "abc", "call_id": "c1",
     "arguments": "{\"q\": 1}"},
    {"type": "function_call", "name": "knowledge-assistant", "call_id": "c2", "arguments": "{}"},
    {"type": "message", "call_id": "c1", "content": [{"type": "output_text", "text": "late c1"}]},
    {"type": "message", "call_id": "c2", "content": [{"type": "output_text", "text": "docs"}]},
    {"type": "message", "content": [{"type": "output_text", "text": "<name>supervisor-agent</name>"}]},
    {"type": "message", "content": [{"type": "output_text",
                                     "text": "<NAME>" + K.SPACE_TOOL_PREFIX + "xyz</NAME>"}]},
    {"type": "message", "content": [{"type": "output_text", "text": ""}]},
    {"type": "message", "content": [{"type": "output_text", "text": "Final answer."}]},
]


def _responses(spark):
    return spark.createDataFrame([("r1", json.dumps(RESP)), ("r2", "[]"), ("r3", "not json")],
                                 "response_id string, output string")


def test_trace_parsing(spark):
    resp = _responses(spark)
    items = K.flatten_trace(resp)
    assert items.filter("response_id = 'r1'").count() == len(RESP)
    m = {r.pos: r.is_tool_result for r in K.match_results(items).collect()}
    assert m[3] is True and m[2] is False        # c1 was replaced by c2 before its result
    ans = {r.response_id: r.answer for r in K.final_answer(items, resp).collect()}
    assert ans == {"r1": "Final answer.", "r2": "(no response)", "r3": "(no response)"}
    src = [(r.kind, r.source_id) for r in K.sources(items).orderBy("rank").collect()]
    assert src == [("genie", "abc"), ("rag", "knowledge-assistant")]
    assert [r.agent for r in K.handoffs(items).collect()] == ["supervisor-agent"]


def test_text_deltas_and_cache(spark):
    d = spark.createDataFrame([("i1", 2, "world"), ("i1", 1, "hello ")],
                              "item_id string, seq int, delta string")
    assert K.text_deltas(d).first().text == "hello world"
    ev = spark.createDataFrame(
        [("A", T(2024, 1, 1, 0, 0), 1), ("A", T(2024, 1, 1, 0, 59), 2),
         ("A", T(2024, 1, 1, 1, 1), 3), ("A", T(2024, 1, 1, 3, 20), 4),
         ("B", T(2024, 1, 1, 0, 30), 5)],
        "key string, ts timestamp_ntz, event_id long")
    hits = {r.event_id: r.hit for r in K.cache_hits(ev).collect()}
    assert hits == {1: False, 2: True, 3: False, 4: False, 5: False}
    assert K.hit_rate(K.cache_hits(ev)).first().hits == 1


def test_cache_key_excludes_assistant_turns(spark):
    conv = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "  again  "),
         (2, 0, "user", "again")], "conv_id long, turn long, role string, text string")
    k = {(r.conv_id, r.turn): r.cache_key for r in K.cache_keys(conv).collect()}
    import hashlib
    assert k[(1, 2)] == hashlib.sha256(b'["hi", "again"]').hexdigest()
    assert k[(2, 0)] != k[(1, 2)]


def test_cache_key_is_the_hash_of_the_json_text(spark):
    import hashlib
    texts = ["été", None, "日本 🎉\t\"q\"", " \u00a0x\n", "a/b\\c"]
    conv = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)],
                                 "conv_id long, turn long, role string, text string")
    got = {r.turn: r.cache_key for r in K.cache_keys(conv).collect()}
    for i in range(len(texts)):
        said = [t or "" for t in texts[:i + 1]]
        blob = json.dumps([*said[:-1], said[-1].strip()])
        assert got[i] == hashlib.sha256(blob.encode()).hexdigest()


def test_content_forms_and_missing_call_ids(spark):
    out = [{"type": "function_call", "name": "a", "arguments": "not json"},
           {"type": "message", "content": "plain [text]"},
           {"type": "message", "content": "second"},
           {"type": "message", "content": [{"type": "x", "text": "p"}, "loose", {"type": "output_text"}]},
           {"type": "message", "content": None}]
    items = K.flatten_trace(spark.createDataFrame([("r", json.dumps(out))], "response_id string, output string"))
    rows = {r.pos: r for r in K.match_results(items).collect()}
    assert [rows[i].text for i in range(5)] == ["", "plain [text]", "second", "p", ""]
    assert rows[0].args.toPython() == {"raw": "not json"}
    assert [rows[i].is_tool_result for i in range(5)] == [False, True, False, False, False]


def test_cache_hits_in_long_sessions_match_the_rule(spark):
    import datetime as dt
    import random
    rnd = random.Random(4)
    rows, n = [], 0
    for key, span, many in (("hot", 40_000, 600), ("thin", 400_000, 40), ("tie", 5000, 30)):
        for _ in range(many):
            n += 1
            at = rnd.randrange(0, span) // (500 if key == "tie" else 1) * (500 if key == "tie" else 1)
            rows.append((key, T(2024, 1, 1) + dt.timedelta(seconds=at), n))
    got = {r.event_id: r.hit for r in K.cache_hits(
        spark.createDataFrame(rows, "key string, ts timestamp_ntz, event_id long")).collect()}
    stored = {}
    for key, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        hit = key in stored and (ts - stored[key]).total_seconds() <= 3600
        if not hit:
            stored[key] = ts
        assert got[i] == hit


DOC = """# Outage Investigation Report
| Field | Value |
|---|---|
| Document ID | OIR-2025-001 |
| **Date** | 2025-03-14 |
**Author:** Reliability Engineering
## 1. Summary
Gearbox vibration reached 3.8 mm/s against the 3.5 mm/s RMS limit on WIN-10130 (OUT-2025-0042).
See CAR-2025-004 and CAR-2024-118 and OIR-2025-001.
## 2. Costs
| Item | Amount |
|---|---|
| Emergency crew | $51,240.00 |
| **Total** | $51,240.00 |"""


def test_corpus_parsing(spark):
    docs = spark.createDataFrame([("OIR-2025-001", DOC), ("CAR-2025-004", "No refs. leverage")],
                                 "doc_id string, text string")
    hf = {(r.field, r.value) for r in C.header_fields(docs).collect()}
    assert {("Document ID", "OIR-2025-001"), ("Date", "2025-03-14"),
            ("Author", "Reliability Engineering")} <= hf
    assert ("Item", "Amount") not in hf
    assert {(r.doc_type, r.n_docs) for r in C.doc_types(docs).collect()} == {("OIR", 1), ("CAR", 1)}
    sec = C.section_chunks(docs).filter("doc_id = 'OIR-2025-001'").orderBy("section_no").collect()
    assert [s.heading for s in sec] == [None, "1. Summary", "2. Costs"]
    refs = {r.target for r in C.doc_references(docs).collect()}
    assert refs == {"CAR-2025-004", "CAR-2024-118"}
    rule = {r.doc_id: (r.n_refs, r.n_dangling, r.below_min_refs)
            for r in C.doc_reference_rule(docs).collect()}
    assert rule == {"OIR-2025-001": (2, 1, False), "CAR-2025-004": (0, 0, True)}
    tags = {r.tag for r in C.entity_mentions(docs).collect()}
    assert tags == {"WIN-10130", "OUT-2025-0042"}
    inv = C.invoice_check(C.invoice_lines(docs)).first()
    assert inv.line_sum == 51240.0 and inv.stated_total == 51240.0 and inv.difference == 0.0
    bp = [(r.doc_id, r.phrase, r.occurrences) for r in C.banned_phrases(docs).collect()]
    assert bp == [("CAR-2025-004", "leverage", 1)]


MANUAL = """# Substation Manual
## Section 6.4

**Document Reference:** VTM-X-1
**Revision:** 3.0

## 6.4.1 Cycles
**Note:** body
MS-2025-03 sets the vibration limit at 6.5 mm/s, SUB-10641 and TRA-10561 and INV-10360 differ.
## Document Control

| Field | Value |
|---|---|
| Document Number | X-3.0 |
| Approved By | Director |"""


def test_manual_layout_tags_and_conflicts(spark):
    docs = spark.createDataFrame([
        ("VTM-X-1", MANUAL),
        ("OIR-2025-010", "Standard MS-2025-03 sets the threshold at 8.0 mm/s; OEM Manual Rev. 4.2 threshold 10.0 mm/s."),
        ("OIR-2025-011", "Oil at 60 ppm (ISO 4406 limit 60 ppm). Repair by Apex Emergency Grid Solutions at NW-Pool-WIND-024."),
    ], "doc_id string, text string")
    got = {(r.field, r.value) for r in C.header_fields(docs).collect()}
    assert got == {("Document Reference", "VTM-X-1"), ("Revision", "3.0"), ("Document Number", "X-3.0"),
                   ("Approved By", "Director")}
    assert {r.tag for r in C.entity_mentions(docs).collect()} == {"SUB-10641", "TRA-10561", "INV-10360"}
    claims = {tuple(r) for r in C.threshold_claims(docs).collect()}
    assert claims == {("VTM-X-1", "MS-2025-03", 6.5, "mm/s"), ("OIR-2025-010", "MS-2025-03", 8.0, "mm/s"),
                      ("OIR-2025-010", "OEM Manual Rev. 4.2", 10.0, "mm/s"), ("OIR-2025-011", "ISO 4406", 60.0, "ppm")}
    assert {r.standard: r.conflict for r in C.threshold_conflicts(C.threshold_claims(docs)).collect()} == {
        "MS-2025-03": True, "OEM Manual Rev. 4.2": False, "ISO 4406": False}
    names = {(r.kind, r.name) for r in C.named_things(docs).collect()}
    assert names == {("site", "NW-Pool-WIND-024"), ("region", "NW-Pool"), ("vendor", "Apex Emergency Grid Solutions")}


def test_bands_and_rate_cards(spark):
    readings = spark.createDataFrame([(1, "siemens_gamesa", 3.49), (2, "siemens_gamesa", 3.5),
                                      (3, "vestas", 7.5)],
                                     "id long, band_set string, running_mean double")
    b = {r.id: r.level for r in C.threshold_bands(readings, C.bands_frame(spark)).collect()}
    assert b == {1: "Alert", 2: "Replacement criterion", 3: "Replacement evaluation"}
    wo = spark.createDataFrame(
        [(1, "emergency", T(2024, 1, 6, 10), 1.0, 1000.0),     # Saturday, 2 h minimum
         (2, "preventive", T(2024, 1, 3, 23), 10.0, 100.0)],   # scheduled vendor, no premium
        "work_order_id long, work_order_type string, created_ts timestamp_ntz, "
        "labor_hours double, parts_cost_usd double")
    c = {r.work_order_id: r.billed_usd for r in C.rate_card_cost(wo, C.rate_cards_frame(spark)).collect()}
    assert c[1] == round(2 * 420 * 1.5 + 1000 * 1.35 + 35000, 2)
    assert c[2] == round(10 * 185 + 100 * 1.08, 2)


def test_doc_vs_table_recon(spark):
    docs = spark.createDataFrame(
        [("OIR-1", "WIN-10130 lost 20,494 MWh in March. TRF-00011 lost 12.5 MWh.")],
        "doc_id string, text string")
    per_asset = spark.createDataFrame([("WIN-10130", 20494.0), ("TRF-00011", 10.0)],
                                      "asset_tag string, total_lost_mwh double")
    r = {x.asset_tag: x.difference for x in C.doc_vs_table(docs, per_asset).collect()}
    assert r == {"WIN-10130": 0.0, "TRF-00011": 2.5}


def test_cache_hits_match_sequential_rule(spark):
    import datetime as dt
    import random
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows, eid = [], 0
    for key, n, span in (("hot", 300, 40 * 3600), ("k1", 20, 10 * 3600), ("k2", 3, 7200)):
        for _ in range(n):
            eid += 1
            sec = rnd.randrange(0, span)
            if rnd.random() < 0.05 and rows and rows[-1][0] == key:
                sec = int((rows[-1][1] - t0).total_seconds())          # equal timestamps
            rows.append((key, t0 + dt.timedelta(seconds=sec), eid))
    ev = spark.createDataFrame(rows, "key string, ts timestamp_ntz, event_id long")
    got = {r.event_id: r.hit for r in K.cache_hits(ev, 3600).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        stored = None
        for _, ts, i in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            t = ts.timestamp()
            if stored is not None and t - stored <= 3600:
                want[i] = True
            else:
                want[i], stored = False, t
    assert got == want


def test_arguments_keep_their_parsed_value(spark):
    import json

    from gridkit.operators import trace as K
    given = ['[1, "x"]', '"x"', "3", '{"a": {"b": [1]}}', "not json", None, "true", ""]
    items = [{"type": "function_call", "name": "t", "call_id": str(i), "arguments": a} for i, a in enumerate(given)]
    df = spark.createDataFrame([(1, json.dumps(items))], "response_id long, output string")
    got = [r.args.toPython() for r in K.flatten_trace(df).orderBy("pos").collect()]
    assert got == [[1, "x"], "x", 3, {"a": {"b": [1]}}, {"raw": "not json"}, {}, True, {"raw": ""}]
