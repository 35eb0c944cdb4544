"""Registered trace jobs over the supplied conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trace as K
from .registry import register


def _conversations(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


def _items(spark, d):
    return K.flatten_trace(K.conversation_responses(_conversations(spark, d)))


# The items of each response, stated on the conversation turns.
_ITEMS = """items AS (
  SELECT conv_id || '-' || (turn // 50) AS response_id, turn, turn % 8 AS n, role,
         CAST(row_number() OVER (PARTITION BY conv_id, turn // 50 ORDER BY turn) - 1 AS INTEGER) AS pos,
         CASE WHEN role = 'user' THEN 'function_call' ELSE 'message' END AS type,
         CASE WHEN role = 'user' THEN CASE WHEN turn % 8 < 2 THEN 'genie-sales' WHEN turn % 8 < 4 THEN 'Vector-Search'
              WHEN turn % 8 < 6 THEN 'calculator' END END AS name,
         CASE WHEN role = 'user' THEN CASE WHEN turn % 8 <> 4 THEN 'c' || turn END
              WHEN turn % 8 = 1 THEN 'c' || (turn - 1) WHEN turn % 8 = 3 THEN 'c' || turn END AS call_id,
         CASE WHEN role = 'user' THEN '' ELSE CASE turn % 8 WHEN 3 THEN '<name>agent-a</name>'
              WHEN 7 THEN '<NAME>genie-x</NAME>' ELSE '' END || coalesce(text, '') END AS text
  FROM conversations),
judged AS (
  SELECT i.*, i.type = 'message' AND EXISTS (
      SELECT 1 FROM items c WHERE c.response_id = i.response_id AND c.type = 'function_call' AND c.pos < i.pos
        AND c.call_id IS NOT DISTINCT FROM i.call_id
        AND NOT EXISTS (SELECT 1 FROM items m WHERE m.response_id = i.response_id AND m.pos > c.pos AND m.pos < i.pos
                          AND (m.type = 'function_call' OR m.call_id IS NOT DISTINCT FROM c.call_id)))
    AS is_tool_result
  FROM items i),
calls AS (
  SELECT response_id, pos, name,
         CASE WHEN name IS NULL THEN 'tool' WHEN starts_with(name, 'genie-') THEN 'genie'
              WHEN regexp_matches(name, 'knowledge|rag|doc|retriev|vector', 'i') THEN 'rag' ELSE 'tool' END AS kind,
         CASE WHEN starts_with(name, 'genie-') THEN substr(name, 7) ELSE name END AS source_id
  FROM items WHERE type = 'function_call')"""


@register("k01_flatten_trace", f"WITH {_ITEMS} SELECT response_id, pos, type, name, call_id, text FROM items")
def k01(spark, d):
    return _items(spark, d).select("response_id", "pos", "type", "name", "call_id", "text")


@register("k02_tool_kind", f"WITH {_ITEMS} SELECT * FROM calls")
def k02(spark, d):
    calls = _items(spark, d).filter(F.col("type") == "function_call")
    return calls.select("response_id", "pos", "name", K.tool_kind("name").alias("kind"),
                        K.tool_id("name").alias("source_id"))


@register("k03_tool_results", f"""WITH {_ITEMS}
SELECT response_id, pos, is_tool_result FROM judged""")
def k03(spark, d):
    return K.match_results(_items(spark, d)).select("response_id", "pos", "is_tool_result")


@register("k05_sources", f"""WITH {_ITEMS}
SELECT *, CAST(row_number() OVER (PARTITION BY response_id ORDER BY first_pos) AS INTEGER) AS rank
FROM (SELECT response_id, kind, coalesce(source_id, 'Tool') AS source_id, min(pos) AS first_pos
      FROM calls GROUP BY ALL)""")
def k05(spark, d):
    return K.sources(_items(spark, d))


@register("k06_handoffs", f"""WITH {_ITEMS}
SELECT response_id, pos, regexp_extract(text, '(?i)<name>([^<]+)</name>', 1) AS agent FROM judged
WHERE type = 'message' AND NOT is_tool_result AND regexp_matches(text, '(?i)<name>[^<]+</name>')
  AND NOT starts_with(regexp_extract(text, '(?i)<name>([^<]+)</name>', 1), 'genie-')""")
def k06(spark, d):
    return K.handoffs(_items(spark, d))


@register("k07_text_deltas", """
SELECT conv_id || '-' || turn AS item_id, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'""")
def k07(spark, d):
    return K.text_deltas(K.answer_deltas(_conversations(spark, d)))


# The JSON text of a string with ASCII escapes, as the original's key has it.
_JSON_TEXT = """list_aggregate(list_transform(string_split(json_quote({}), ''), lambda c:
  CASE WHEN unicode(c) < 128 THEN c
       WHEN unicode(c) < 65536 THEN printf('\\u%04x', unicode(c))
       ELSE printf('\\u%04x\\u%04x', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) END),
  'string_agg', '')"""


@register("k08_cache_key", f"""
SELECT conv_id, turn, sha256('[' || CASE WHEN prior IS NULL THEN '' ELSE prior || ', ' END || own || ']') AS cache_key
FROM (SELECT conv_id, turn, own, string_agg(raw, ', ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
      FROM (SELECT conv_id, turn, {_JSON_TEXT.format("coalesce(text, '')")} AS raw,
                   {_JSON_TEXT.format("regexp_replace(coalesce(text, ''), '^[[:space:]]+|[[:space:]]+$', '', 'g')")} AS own
            FROM conversations WHERE role = 'user'))""")
def k08(spark, d):
    return K.cache_keys(_conversations(spark, d))


@register("k09_history_filter", """
SELECT conv_id, turn, role, text FROM conversations
WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND text <> ''""")
def k09(spark, d):
    return K.history_filter(spark.read.parquet(f"{d}/conversations.parquet"))


@register("k10_cache_hits", """
WITH RECURSIVE ev AS (
  SELECT CAST(user_id AS VARCHAR) || '|' || event_type AS key, event_id,
         CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
firsts AS (
  SELECT key, arg_min(event_id, t * 1000000000 + event_id) AS event_id,
         MIN(t) AS t FROM ev GROUP BY key),
stores(key, event_id, t) AS (
  SELECT key, event_id, t FROM firsts
  UNION ALL
  SELECT s.key, n.event_id, n.t FROM stores s,
    LATERAL (SELECT e.event_id, e.t FROM ev e WHERE e.key = s.key AND e.t > s.t + 3600
             ORDER BY e.t, e.event_id LIMIT 1) n)
SELECT ev.key, ev.event_id, s.event_id IS NULL AS hit
FROM ev LEFT JOIN stores s ON ev.event_id = s.event_id""")
def k10(spark, d):
    """Repeat of a (user, event type) key within an hour of its last store."""
    from pyspark.sql import functions as F
    ev = spark.read.parquet(f"{d}/events.parquet").select(
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"),
        "ts", "event_id")
    return K.cache_hits(ev, K.CACHE_TTL_SECONDS)


@register("k04_final_answer", """
SELECT c.conv_id AS response_id, COALESCE(a.answer, '(no response)') AS answer
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN (
  SELECT conv_id, arg_max(s, turn) AS answer FROM (
    SELECT conv_id, turn,
           regexp_replace(regexp_replace(COALESCE(text, ''), '(?i)<name>([^<]+)</name>', '', 'g'),
                          '^\\s+|\\s+$', '', 'g') AS s
    FROM conversations WHERE role = 'assistant')
  WHERE s <> '' GROUP BY conv_id) a ON c.conv_id = a.conv_id""")
def k04(spark, d):
    """Final answer of each conversation (last non-empty assistant text)."""
    conv = spark.read.parquet(f"{d}/conversations.parquet")
    ids = conv.select(F.col("conv_id").alias("response_id")).distinct()
    return K.final_answer(K.conversation_items(conv), ids)
