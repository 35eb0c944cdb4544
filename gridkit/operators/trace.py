"""Question/answer trace analysis (k01-k10) as DataFrame jobs.

Input shapes: agent responses ``(response_id, output)`` where ``output`` is
the JSON array of output items; chat history ``(conv_id, turn, role, text)``;
cache events ``(key, ts)``.  Everything is partitioned by response /
conversation / key; per-row work is built-in expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import trailing_on

# Fixed values of the trace rules (labels, prefix, hints, texts, seconds).
HANDOFF_PATTERN = r"(?i)<name>([^<]+)</name>"
RAG_HINTS = ("knowledge", "rag", "doc", "retriev", "vector")
SPACE_TOOL_PREFIX = "genie-"    # tool-name prefix of metric-space tools
SPACE_TOOL_KIND = "genie"
NO_RESPONSE = "(no response)"
CACHE_TTL_SECONDS = 3600

OUTPUT_SCHEMA = ("array<struct<type:string, name:string, call_id:string, arguments:string, "
                 "content:variant>>")


def content_text(content: Column) -> Column:
    """Plain text of an item's content: a list gives its parts that are
    ``output_text`` or carry a ``text``, any other value is the text itself."""
    field = lambda c, name: F.try_variant_get(c, f"$.{name}", "string")
    parts = F.filter(F.try_variant_get(content, "$", "array<variant>"),
                     lambda c: (field(c, "type") == "output_text") | field(c, "text").isNotNull())
    listed = F.array_join(F.transform(parts, lambda c: F.coalesce(field(c, "text"), F.lit(""))), "")
    plain = F.try_variant_get(content, "$", "string")
    return F.coalesce(F.when(F.schema_of_variant(content).startswith("ARRAY"), listed)
                       .otherwise(plain), F.lit(""))


def flatten_trace(responses: DataFrame, col: str = "output") -> DataFrame:
    """k01: one row per output item with its position and plain text.
    Unparseable JSON yields no items (PERMISSIVE parse -> NULL)."""
    items = responses.select("response_id", F.posexplode_outer(
        F.from_json(F.col(col), OUTPUT_SCHEMA)).alias("pos", "item")).filter(F.col("item").isNotNull())
    raw_args = F.coalesce(F.col("item.arguments"), F.lit("{}"))
    # f20: arguments parsed as JSON of any kind, falling back to {"raw": <text>}
    args = F.coalesce(F.try_parse_json(raw_args), F.parse_json(F.to_json(F.create_map(F.lit("raw"), raw_args))))
    return items.select("response_id", "pos", F.col("item.type").alias("type"),
                        F.col("item.name").alias("name"), F.col("item.call_id").alias("call_id"),
                        F.col("item.arguments").alias("arguments"), args.alias("args"),
                        content_text(F.col("item.content")).alias("text"))


def tool_kind(name) -> Column:
    """k02: metric-space tools by name prefix, 'rag' for retrieval-like
    names, else 'tool'."""
    n = F.col(name) if isinstance(name, str) else name
    low = F.lower(n)
    rag = None
    for h in RAG_HINTS:
        c = low.contains(h)
        rag = c if rag is None else (rag | c)
    return (F.when(n.isNull() | (n == ""), "tool")
             .when(n.startswith(SPACE_TOOL_PREFIX), SPACE_TOOL_KIND)
             .when(rag, "rag").otherwise("tool"))


def tool_id(name) -> Column:
    """Source id of a tool: the space id after the prefix, else the name."""
    n = F.col(name) if isinstance(name, str) else name
    return (F.when(n.isNull() | (n == ""), F.lit(None).cast("string"))
             .when(n.startswith(SPACE_TOOL_PREFIX), F.substring(n, len(SPACE_TOOL_PREFIX) + 1, 1 << 30))
             .otherwise(n))


def match_results(items: DataFrame) -> DataFrame:
    """k03: mark messages that are the result of the latest pending call.

    A function call becomes the pending call; the first later message with
    the same call_id (before another call replaces it) is its result; a call
    and a message that both lack a call_id belong together.
    """
    w = Window.partitionBy("response_id").orderBy("pos")
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    is_call = F.col("type") == "function_call"
    call = F.when(is_call, F.struct("pos", "call_id"))
    x = items.withColumn("_pend", F.last(call, True).over(prev))
    cand = ((F.col("type") == "message") & F.col("_pend").isNotNull()
            & F.col("call_id").eqNullSafe(F.col("_pend.call_id")))
    first = F.min(F.when(cand, F.col("pos"))).over(
        Window.partitionBy("response_id", F.col("_pend.pos")))
    return x.withColumn("is_tool_result", F.coalesce(cand & (F.col("pos") == first),
                                                     F.lit(False))).drop("_pend")


def _stripped(text: Column) -> Column:
    """Message text without hand-off tags, surrounding whitespace removed."""
    return strip_ws(F.regexp_replace(text, HANDOFF_PATTERN, ""))


def final_answer(items: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """k04: last non-empty assistant text per response, default '(no response)'.

    Pass ``responses`` so that responses without any output item are kept.
    """
    m = match_results(items)
    s = _stripped(F.col("text"))
    cand = m.filter((F.col("type") == "message") & ~F.col("is_tool_result") & (s != ""))
    last = cand.groupBy("response_id").agg(F.max_by(s, F.col("pos")).alias("answer"))
    ids = (responses if responses is not None else items).select("response_id").distinct()
    return ids.join(last, "response_id", "left").select(
        "response_id", F.coalesce("answer", F.lit(NO_RESPONSE)).alias("answer"))


def sources(items: DataFrame) -> DataFrame:
    """k05: distinct sources ``kind:id`` per response in first-seen order."""
    calls = items.filter(F.col("type") == "function_call").select(
        "response_id", "pos", tool_kind("name").alias("kind"),
        F.coalesce(tool_id("name"), F.lit("Tool")).alias("source_id"))
    first = calls.groupBy("response_id", "kind", "source_id").agg(F.min("pos").alias("first_pos"))
    return first.withColumn("rank", F.row_number().over(
        Window.partitionBy("response_id").orderBy("first_pos")))


def handoffs(items: DataFrame) -> DataFrame:
    """k06: agent hand-off names from non-result messages; hand-offs to
    metric-space tools are dropped (they are already tool calls)."""
    m = match_results(items).filter((F.col("type") == "message") & ~F.col("is_tool_result"))
    agent = F.regexp_extract("text", HANDOFF_PATTERN, 1)
    return (m.select("response_id", "pos", agent.alias("agent"))
             .filter((F.col("agent") != "") & ~F.col("agent").startswith(SPACE_TOOL_PREFIX)))


def text_deltas(deltas: DataFrame) -> DataFrame:
    """k07: concatenate streamed text deltas per item in sequence order.

    The per-item list is bounded by the item's own text length.
    """
    g = deltas.groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("_d"))
    return g.select("item_id", F.array_join(F.transform("_d", lambda x: x["delta"]), "")
                    .alias("text"))


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _keys_of_turns(batches):
    """Rows sorted by conversation and turn: a running hash of each conversation's
    user turns; a turn's key closes a copy of it."""
    import hashlib
    import json

    import pyarrow as pa
    here, state, lead = object(), None, b""
    for batch in batches:
        out = []
        for conv, turn, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "text"))):
            if conv != here:
                here, state, lead = conv, hashlib.sha256(b"["), b""
            message = state.copy()
            message.update(lead + json.dumps(text.strip()).encode() + b"]")
            state.update(lead + json.dumps(text).encode())
            lead = b", "
            out.append((conv, turn, message.hexdigest()))
        conv, turn, key = zip(*out) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(conv, batch.schema.field("conv_id").type), pa.array(turn, batch.schema.field("turn").type),
             pa.array(key, pa.string())], names=["conv_id", "turn", "cache_key"])


def cache_keys(conversations: DataFrame) -> DataFrame:
    """k08: cache key of every user turn = SHA-256 of the JSON text of the list
    of the earlier user turns followed by this (whitespace-stripped) message;
    assistant turns are excluded from the key, a missing text counts as "".

    The hash of a conversation runs on from turn to turn, so the work is linear
    in its text and no list of turns is gathered; a conversation is one sorted
    stretch of a partition.
    """
    users = conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    schema = users.select("conv_id", "turn", F.lit("").alias("cache_key")).schema
    return (users.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
            .mapInArrow(_keys_of_turns, schema))


def conversation_items(conversations: DataFrame) -> DataFrame:
    """Chat history as trace items: assistant turns are output messages."""
    return conversations.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("response_id"), F.col("turn").alias("pos"),
        F.lit("message").alias("type"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("call_id"), F.coalesce("text", F.lit("")).alias("text"))


ITEMS_PER_RESPONSE = 50


def conversation_responses(conversations: DataFrame) -> DataFrame:
    """Chat history in the shape of agent responses ``(response_id, output)``:
    stretches of ``ITEMS_PER_RESPONSE`` turns; user turns are tool calls, other
    turns messages.  The turn number decides on names, missing and foreign call
    ids, hand-off tags, and whether content is a list of parts or plain text."""
    n = F.col("turn") % 8
    text = F.coalesce("text", F.lit(""))
    call = F.struct(
        F.lit("function_call").alias("type"),
        F.when(n < 2, "genie-sales").when(n < 4, "Vector-Search").when(n < 6, "calculator").alias("name"),
        F.when(n != 4, F.concat(F.lit("c"), F.col("turn").cast("string"))).alias("call_id"),
        F.when(n == 2, text).otherwise(F.to_json(F.struct(text.alias("q")))).alias("arguments"))
    said = F.concat(F.when(n == 3, "<name>agent-a</name>").when(n == 7, "<NAME>genie-x</NAME>")
                    .otherwise(""), text)
    call_id = F.when(n.isin(1, 3), F.concat(F.lit("c"), (F.col("turn") - F.when(n == 1, 1).otherwise(0))
                                            .cast("string")))
    head = [F.lit("message").alias("type"), call_id.alias("call_id")]
    part = F.struct(F.lit("output_text").alias("type"), said.alias("text"))
    note = F.struct(F.lit("note").alias("type"), F.lit(None).cast("string").alias("text"))
    listed = F.to_json(F.struct(*head, F.array(part, note).alias("content")))
    plain = F.to_json(F.struct(*head, said.alias("content")))
    item = F.when(F.col("role") == "user", F.to_json(call)).when(F.col("conv_id") % 2 == 0, listed).otherwise(plain)
    rows = conversations.select(
        F.concat_ws("-", F.col("conv_id").cast("string"),
                    F.floor(F.col("turn") / ITEMS_PER_RESPONSE).cast("string")).alias("response_id"),
        "turn", item.alias("item"))
    # at most ITEMS_PER_RESPONSE items each
    listed = F.array_sort(F.collect_list(F.struct("turn", "item")))
    return rows.groupBy("response_id").agg(
        F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["item"]), ","), F.lit("]"))
        .alias("output"))


def answer_deltas(conversations: DataFrame) -> DataFrame:
    """Answers as streamed text deltas ``(item_id, seq, delta)``, a word each."""
    words = F.split(F.coalesce("text", F.lit("")), " ", -1)
    x = conversations.filter(F.col("role") == "assistant").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id"),
        F.posexplode(words).alias("seq", "word"))
    return x.select("item_id", "seq", F.concat(F.when(F.col("seq") > 0, " ").otherwise(""), F.col("word"))
                    .alias("delta"))


def history_filter(conversations: DataFrame) -> DataFrame:
    """k09: keep user / assistant turns that have content."""
    return conversations.filter(F.col("role").isin("user", "assistant")
                                & F.col("text").isNotNull() & (F.col("text") != "")) \
                        .select("conv_id", "turn", "role", "text")


def _steps(ev: DataFrame, ttl_s: int) -> DataFrame:
    """``(key, event_id, t, root, nxt)``: whether the event opens a session (no
    earlier event of its key within the TTL), and the first event of the same
    session later than ``t + ttl_s``.  Inside a session neighbours are at most
    the TTL apart, so that event lies within two TTLs: both are trailing
    windows, one exchange each, and a hot key is cut into chunks of time."""
    own = F.struct("t", "event_id")
    flagged = trailing_on(ev, "key", F.col("t"), ttl_s, {"_first": ("min", own)})
    flagged = flagged.select("key", "event_id", "t", (F.col("_first") == own).alias("root"))
    rows = flagged.withColumn("_at", -F.col("t")).withColumn("_probe", F.lit(False))
    probes = flagged.withColumn("_at", -F.col("t") - (ttl_s + 1)).withColumn("_probe", F.lit(True))
    seen = trailing_on(rows.unionByName(probes), "key", F.col("_at"), max(1, ttl_s - 1),
                       {"_nxt": ("min", F.when(~F.col("_probe"), F.struct("t", "event_id", "root")))})
    return seen.filter("_probe").select("key", "event_id", "t", "root",
                                        F.when(~F.col("_nxt.root"), F.col("_nxt.event_id")).alias("nxt"))


def cache_hits(events: DataFrame, ttl_s: int = CACHE_TTL_SECONDS) -> DataFrame:
    """k10: an event is a hit when its key was stored at most ``ttl_s``
    earlier; a miss stores the key, hits do not refresh the stored time.

    An event more than the TTL after its predecessor is always a store: it
    opens a session.  Inside a session the stores are the path ``first,
    nxt(first), ...`` with ``nxt(e)`` = first event later than ``e + ttl_s``;
    only sessions longer than the TTL have a second one.  The path is found by
    pointer doubling on the events that have a successor (one inner self-join
    per level, until no pointer is left) and expanded from the roots level by
    level.  Every step is a join on event ids; no key's events are ever
    gathered into one task.  Each level is checkpointed into the shared
    checkpoint folder to cut the lineage.  ``events``: (key, ts, event_id)
    with unique ``event_id``.
    """
    from ..session import checkpoint_dir
    checkpoint_dir(events.sparkSession)
    ev = events.select("key", F.unix_timestamp("ts").alias("t"), "event_id")
    steps = _steps(ev, ttl_s).checkpoint()
    level = steps.filter(F.col("nxt").isNotNull()).select("event_id", "nxt")
    jumps = []
    while not level.isEmpty():
        jumps.append(level)
        a, b = level.alias("a"), level.alias("b")
        level = (a.join(b, F.col("a.nxt") == F.col("b.event_id"))
                  .select(F.col("a.event_id").alias("event_id"), F.col("b.nxt").alias("nxt")).checkpoint())
    roots = steps.filter("root").select("event_id")
    path = roots.join(jumps[0].select("event_id"), "event_id", "left_semi") if jumps else roots.limit(0)
    more = []
    for jump in reversed(jumps):
        step = path.join(jump, "event_id").select(F.col("nxt").alias("event_id")).checkpoint()
        more.append(step)
        path = path.unionByName(step)
    if not more:
        return steps.select("key", "event_id", (~F.col("root")).alias("hit"))
    stores = reduce(DataFrame.unionByName, more).withColumn("_store", F.lit(True))
    flagged = steps.join(stores, "event_id", "left")
    return flagged.select("key", "event_id",
                          (~F.col("root") & F.col("_store").isNull()).alias("hit"))


def hit_rate(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("events"), F.count_if("hit").alias("hits"),
                    (F.count_if("hit") / F.count(F.lit(1))).alias("hit_rate"))
