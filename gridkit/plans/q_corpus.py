"""Registered corpus jobs over the supplied documents, pages, embeddings
and the operations tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import asset_tag, exact_sum, rnd
from ..operators import corpus as C
from ..operators import windows as W
from ..operators.dictionary import occurrences
from ..operators.vector_index import VectorIndex
from ..session import scratch_path
from ..sources.bindings import load
from .oracle_sql import with_bindings
from .registry import register

# Binding of the supplied manufacturers to the two OEM band sets.
BOUND_BAND_SET = (("OEM-0", "siemens_gamesa"), ("OEM-1", "vestas"),
                  ("OEM-2", "siemens_gamesa"), ("OEM-3", "vestas"))
TOPK = 5


@register("c03_section_chunks", """
WITH ln AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
s AS (
  SELECT *, starts_with(line, '## ') AS h,
         SUM(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_no
  FROM ln)
SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, MAX(CASE WHEN h THEN substr(line, 4) END) AS heading,
       COUNT(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS body
FROM s GROUP BY doc_id, section_no""")
def c03(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return C.section_chunks(docs)


_LINKS = """SELECT DISTINCT page_id, target FROM (
  SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
WHERE target <> '' AND target <> url
  AND (CASE WHEN regexp_matches(target, '^[A-Za-z]+://') THEN regexp_extract(target, '^[A-Za-z]+://[^/]+(/[^?#]*)?', 1)
            ELSE regexp_replace(target, '[?#].*$', '') END) <> regexp_extract(url, '^[A-Za-z]+://[^/]+(/[^?#]*)?', 1)"""


@register("c04_reference_edges", _LINKS)
def c04(spark, d):
    return C.page_links(spark.read.parquet(f"{d}/pages.parquet"))


@register("c05_reference_rule", f"""
WITH links AS ({_LINKS}),
lk AS (SELECT l.page_id, CASE WHEN regexp_matches(target, '^[A-Za-z]+://')
                  THEN regexp_extract(target, '^[A-Za-z]+://[^/]+(/[^?#]*)?', 1)
                  ELSE regexp_replace(target, '[?#].*$', '') END AS tpath FROM links l),
known AS (SELECT DISTINCT regexp_extract(url, '^[A-Za-z]+://[^/]+(/[^?#]*)?', 1) AS tpath FROM pages),
per AS (SELECT lk.page_id, COUNT(*) AS n_refs, COUNT(*) FILTER (WHERE k.tpath IS NULL) AS n_dangling
        FROM lk LEFT JOIN known k ON lk.tpath = k.tpath GROUP BY lk.page_id)
SELECT p.page_id, COALESCE(per.n_refs, 0) AS n_refs, COALESCE(per.n_dangling, 0) AS n_dangling,
       COALESCE(per.n_refs, 0) < 2 AS below_min_refs
FROM pages p LEFT JOIN per ON p.page_id = per.page_id""")
def c05(spark, d):
    return C.link_rule(spark.read.parquet(f"{d}/pages.parquet"))


_PHRASES = " UNION ALL ".join(f"SELECT '{p}' AS phrase" for p in C.BANNED_PHRASES)


@register("c07_banned_phrases", f"""
SELECT doc_id, phrase, occurrences FROM (
  SELECT d.doc_id, p.phrase,
         CAST((octet_length(encode(lower(d.text))) - octet_length(encode(replace(lower(d.text), p.phrase, ''))))
              / octet_length(encode(p.phrase)) AS BIGINT) AS occurrences
  FROM documents d, ({_PHRASES}) p) WHERE occurrences > 0""")
def c07(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return C.banned_phrases(docs)


def _band_rows():
    return " UNION ALL ".join(
        f"SELECT '{s}' AS band_set, '{lv}' AS level, CAST({lo} AS DOUBLE) AS lo, "
        f"{'CAST(NULL AS DOUBLE)' if hi is None else f'CAST({hi} AS DOUBLE)'} AS hi, '{act}' AS action"
        for s, lv, lo, hi, act in C.VIBRATION_BANDS)


_BANDMAP = " ".join(f"WHEN '{m}' THEN '{b}'" for m, b in BOUND_BAND_SET)


@register("c12_threshold_bands", with_bindings(f"""
SELECT r.telemetry_id, r.asset_id, r.timestamp, r.running_mean, r.band_set, b.level, b.action
FROM (SELECT w.telemetry_id, w.asset_id, w.timestamp, w.running_mean,
             CASE a.manufacturer {_BANDMAP} END AS band_set
      FROM (SELECT telemetry_id, asset_id, timestamp, ROUND(AVG(vibration) OVER w, 9) AS running_mean
            FROM (SELECT *, floor(epoch(timestamp)) AS ep FROM telemetry)
            WINDOW w AS (PARTITION BY asset_id ORDER BY ep RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)) w
      JOIN assets a ON w.asset_id = a.asset_id) r
LEFT JOIN ({_band_rows()}) b
  ON r.band_set = b.band_set AND r.running_mean >= b.lo AND (b.hi IS NULL OR r.running_mean < b.hi)"""))
def c12(spark, d):
    t = load(spark, d)
    # band edges are compared at 1e-9 resolution, so the summation order of
    # the mean cannot move a reading across an edge
    rm = W.running_mean(t).select("telemetry_id", "asset_id", "timestamp",
                                  rnd("running_mean", 9).alias("running_mean"))
    m = F.col("manufacturer")
    band_set = None
    for k, v in BOUND_BAND_SET:
        band_set = F.when(m == k, v) if band_set is None else band_set.when(m == k, v)
    a = t.assets.select("asset_id", band_set.alias("band_set"))
    return C.threshold_bands(rm.join(a, "asset_id"), C.bands_frame(spark))


def _rate_sql():
    rows = " UNION ALL ".join(
        f"SELECT '{k}' AS vendor_kind, CAST({r} AS DOUBLE) AS hourly_rate, CAST({mh} AS DOUBLE) AS min_hours, "
        f"CAST({we} AS DOUBLE) AS weekend_mult, CAST({on} AS DOUBLE) AS overnight_mult, "
        f"CAST({mk} AS DOUBLE) AS parts_markup, CAST({mob} AS DOUBLE) AS mobilization"
        for k, r, mh, we, on, mk, mob in C.RATE_CARDS)
    return f"""SELECT work_order_id, vendor_kind, ROUND(labor, 2) AS labor_cost_usd,
  ROUND(parts, 2) AS parts_billed_usd, ROUND(labor + parts + mobilization, 2) AS billed_usd
FROM (SELECT w.work_order_id, c.vendor_kind, c.mobilization,
        GREATEST(w.labor_hours, c.min_hours) * c.hourly_rate *
          CASE WHEN dayofweek(w.created_ts) IN (0, 6) THEN c.weekend_mult
               WHEN hour(w.created_ts) >= 22 OR hour(w.created_ts) < 6 THEN c.overnight_mult
               ELSE CAST(1 AS DOUBLE) END AS labor,
        w.parts_cost_usd * (1 + c.parts_markup) AS parts
      FROM work_orders w JOIN ({rows}) c
        ON c.vendor_kind = CASE WHEN w.work_order_type = 'emergency' THEN 'emergency' ELSE 'scheduled' END)"""


@register("c13_rate_card_cost", with_bindings(_rate_sql()))
def c13(spark, d):
    return C.rate_card_cost(load(spark, d).work_orders, C.rate_cards_frame(spark))


@register("c14_approval_tier", with_bindings(f"""
SELECT work_order_id, billed_usd,
       CASE WHEN billed_usd > 250000 THEN 'VP, Asset Management'
            WHEN billed_usd > 75000 THEN 'Regional Director of Operations'
            ELSE 'Regional Maintenance Planner' END AS approver
FROM ({_rate_sql()})"""))
def c14(spark, d):
    cost = C.rate_card_cost(load(spark, d).work_orders, C.rate_cards_frame(spark))
    return cost.select("work_order_id", "billed_usd", C.approval_tier("billed_usd").alias("approver"))


@register("c16_deferred_to_failure", with_bindings("""
SELECT o.outage_id, o.asset_id, o.outage_start_ts,
       (SELECT COUNT(*) FROM maintenance_schedule m WHERE m.asset_id = o.asset_id AND m.overdue_flag
          AND CAST(m.planned_date AS TIMESTAMP) <= o.outage_start_ts)
         AS deferred_items
FROM outages o WHERE o.forced_outage_flag"""))
def c16(spark, d):
    return C.deferred_before_failure(load(spark, d))


@register("c17_topk_retrieval", f"""
WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x,
                  generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label AS q, i, AVG(x) AS cx FROM e GROUP BY label, i),
dots AS (SELECT e.vec_id, c.q, SUM(e.x * c.cx) AS dot FROM e JOIN c ON e.i = c.i GROUP BY e.vec_id, c.q),
en AS (SELECT vec_id, sqrt(SUM(x * x)) AS n FROM e GROUP BY vec_id),
cn AS (SELECT q, sqrt(SUM(cx * cx)) AS n FROM c GROUP BY q),
s AS (SELECT d.q AS query, d.vec_id, d.dot / (en.n * cn.n) AS score
      FROM dots d JOIN en ON d.vec_id = en.vec_id JOIN cn ON d.q = cn.q)
SELECT query, rank, vec_id, ROUND(score, 6) AS score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= {TOPK}""")
def c17(spark, d):
    emb = spark.read.parquet(f"{d}/embeddings.parquet")
    return C.topk_by_cosine(emb, C.centroid_queries(emb), TOPK,
                            query_type=emb.schema["label"].dataType.simpleString())


def _vector_index(spark, d):
    import uuid
    emb = spark.read.parquet(f"{d}/embeddings.parquet")
    return emb, VectorIndex.build(emb, scratch_path(spark, f"vectors-{uuid.uuid4().hex[:10]}"))


@register("c17_indexed_topk", f"""
WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x,
                  generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label AS q, i, AVG(x) AS cx FROM e GROUP BY label, i),
pair AS (SELECT e.vec_id, c.q, SUM(e.x * c.cx) / (sqrt(SUM(e.x * e.x)) * sqrt(SUM(c.cx * c.cx))) AS score
         FROM e JOIN c USING (i) GROUP BY e.vec_id, c.q)
SELECT q AS query, rank, vec_id, ROUND(score, 6) AS score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY q ORDER BY ROUND(score, 9) DESC, vec_id) AS rank FROM pair)
WHERE rank <= {TOPK}""")
def c17_indexed(spark, d):
    """The vectors nearest to each label's centroid, through the inverted lists."""
    emb, index = _vector_index(spark, d)
    found = index.search(C.centroid_queries(emb), TOPK, emb.schema["label"].dataType.simpleString())
    return found.rows.withColumn("score", rnd("score", 6))


@register("c17_indexed_neighbours", """
WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pair AS (SELECT q.vec_id AS query, n.vec_id,
                list_inner_product(q.v, n.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(n.v, n.v)) AS score
         FROM n AS q JOIN n ON q.vec_id % 50 = 0)
SELECT query, rank, vec_id, ROUND(score, 6) AS score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY ROUND(score, 9) DESC, vec_id) AS rank FROM pair)
WHERE rank <= 10""")
def c17_neighbours(spark, d):
    """The ten vectors nearest to every fiftieth one (the stated query set), among all."""
    emb, index = _vector_index(spark, d)
    asked = emb.where("vec_id % 50 = 0").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    queries = [(r["vec_id"], r["v"]) for r in asked.toLocalIterator()]
    return index.search(queries, 10).rows.withColumn("score", rnd("score", 6))


# ---------------------------------------------- documents made of table rows
# Each document is written from the columns of one row, parsed back by the
# corpus job, and the oracle states the result on the columns.
def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _tag():
    return asset_tag("asset_type", "asset_id")


def _site_name():
    """The site's label with letters only before its type."""
    return F.format_string("%s-%s-%03d", F.replace("region_name", F.lit(" "), F.lit("-")),
                           F.upper("generation_type"), F.col("site_id").cast("long"))


_TAG_SQL = "printf('%s-%05d', upper(substr(a.asset_type, 1, 3)), a.asset_id)"
_SITE_SQL = "printf('%s-%s-%03d', replace(r.region_name, ' ', '-'), upper(s.generation_type), s.site_id)"


@register("c01_header_fields", with_bindings("""
SELECT 'OIR-' || outage_id AS doc_id, f.field, f.value
FROM outages, LATERAL (VALUES ('Document ID', 'OIR-' || outage_id), ('Asset', '' || asset_id),
                              ('Reason', outage_reason), ('Control', '' || site_id)) AS f(field, value)"""))
def c01(spark, d):
    o = load(spark, d).outages
    n = F.col("outage_id")
    table = _text("| Field | Value |\n|---|---|\n| Document ID | OIR-", _s(n), " |\n| **Asset** | ", _s("asset_id"), " |\n")
    bold = _text("**Reason:** ", F.col("outage_reason"), "\n")
    # every other document opens with a heading, as manuals do
    text = _text(F.when(n % 2 == 0, "# Report\n").otherwise("# Manual\n## Section 6.4\n\n"),
                 F.when(n % 3 == 0, _text(table, bold)).otherwise(_text(bold, "\n", table)),
                 "\n## 1. Findings\n**Note:** not a header\n| Item | Amount |\n|---|---|\n| crew | $5 |\n",
                 "## Document Control\n\n| Field | Value |\n|:---|---|\n| Control | ", _s("site_id"), " |")
    return C.header_fields(o.select(_text("OIR-", _s(n)).alias("doc_id"), text.alias("text")))


@register("c02_doc_types", with_bindings("""
SELECT CASE work_order_type WHEN 'emergency' THEN 'EMR' WHEN 'reactive' THEN 'CAR' ELSE 'FMS' END AS doc_type,
       count(*) AS n_docs FROM work_orders GROUP BY 1"""))
def c02(spark, d):
    t = F.col("work_order_type")
    kind = F.when(t == "emergency", "EMR-").when(t == "reactive", "CAR-").otherwise("FMS-")
    return C.doc_types(load(spark, d).work_orders.select(_text(kind, "2024-", _s("work_order_id")).alias("doc_id")))


@register("c06_entity_mentions", with_bindings(f"""
SELECT o.outage_id AS doc_id, m.tag, m.asset_id
FROM outages o JOIN assets a ON a.asset_id = o.asset_id,
LATERAL (VALUES ({_TAG_SQL}, a.asset_id), ('OUT-2024-' || o.outage_id, NULL)) AS m(tag, asset_id)"""))
def c06(spark, d):
    t = load(spark, d)
    tagged = t.assets.select("asset_id", _tag().alias("asset_tag"))
    docs = t.outages.select("outage_id", "asset_id").join(tagged, "asset_id").select(
        F.col("outage_id").alias("doc_id"),
        _text("See CAR-2024-118: ", F.col("asset_tag"), " (", F.col("asset_tag"), ") tripped in OUT-2024-",
              _s("outage_id"), ".").alias("text"))
    return C.entity_mentions(docs, tagged).select("doc_id", "tag", "asset_id")


@register("c06_dictionary_mentions", with_bindings(f"""
SELECT o.outage_id AS doc_id, {_TAG_SQL} AS tag, a.asset_id, CAST(2 AS BIGINT) AS occurrences
FROM outages o JOIN assets a ON a.asset_id = o.asset_id"""))
def c06_dictionary(spark, d):
    """Asset tags mentioned, looked up in the whole asset table by its automaton."""
    t = load(spark, d)
    tagged = t.assets.select("asset_id", _tag().alias("tag"))
    docs = t.outages.select("outage_id", "asset_id").join(tagged, "asset_id").select(
        F.col("outage_id").alias("doc_id"),
        _text("See ", F.col("tag"), "9 and CAR-2024-118: ", F.col("tag"), " (", F.col("tag"), ") tripped.").alias("text"))
    found = occurrences(docs, tagged, "tag", whole=True).withColumnRenamed("entry", "tag")
    # the first mention carries one digit more and may be another asset's tag
    own = t.outages.select(F.col("outage_id").alias("doc_id"), "asset_id").join(tagged, "asset_id")
    return found.join(own, ["doc_id", "tag"]).select("doc_id", "tag", "asset_id", "occurrences")


@register("c07_dictionary_phrases", """
WITH phrases AS (
  SELECT DISTINCT lower(string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2]) AS phrase
  FROM benchmark WHERE len(string_split(text, ' ')) > 1)
SELECT doc_id, phrase, occurrences FROM (
  SELECT d.doc_id, p.phrase,
         CAST((octet_length(encode(lower(d.text))) - octet_length(encode(replace(lower(d.text), p.phrase, ''))))
              / octet_length(encode(p.phrase)) AS BIGINT) AS occurrences
  FROM documents d, phrases p) WHERE occurrences > 0""")
def c07_dictionary(spark, d):
    """Occurrences of the phrases that open a benchmark item, from the table, in every document."""
    words = F.split("text", " ")
    opening = F.lower(F.concat(words[0], F.lit(" "), words[1]))
    phrases = (spark.read.parquet(f"{d}/benchmark.parquet").where(F.size(words) > 1).select(opening.alias("phrase")))
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return occurrences(docs, phrases, "phrase", fold_case=True).withColumnRenamed("entry", "phrase")


@register("c08_dictionary_names", with_bindings(f"""
SELECT o.outage_id AS doc_id, m.name, CAST(m.n AS BIGINT) AS occurrences
FROM outages o JOIN sites s ON s.site_id = o.site_id JOIN regions r ON r.region_id = s.region_id,
LATERAL (VALUES ({_SITE_SQL}, 2), (replace(r.region_name, ' ', '-'), 1), ('Alpha Grid Partners', 1)) AS m(name, n)
WHERE m.name <> 'Alpha Grid Partners' OR o.outage_id % 2 = 1"""))
def c08_dictionary(spark, d):
    """Glossary names in a text: the longest name counts, a region inside a site's name does not."""
    t = load(spark, d)
    named = t.sites.join(t.regions, "region_id").select(
        "site_id", _site_name().alias("site"), F.replace("region_name", F.lit(" "), F.lit("-")).alias("region"))
    docs = t.outages.select("outage_id", "site_id").join(named, "site_id").select(
        F.col("outage_id").alias("doc_id"),
        _text("Crew of ", F.when(F.col("outage_id") % 2 == 0, "Nordlicht Wind SE").otherwise("Alpha Grid Partners"),
              " in ", F.col("region"), " at ", F.col("site"), ", again ", F.col("site"), ".").alias("text"))
    glossary = (named.select(F.col("site").alias("name")).unionByName(named.select(F.col("region").alias("name")))
                .unionByName(spark.createDataFrame([("Alpha Grid Partners",), ("Alpha Grid",)], "name string")))
    return (occurrences(docs, glossary, "name", mode="longest", whole=True)
            .withColumnRenamed("entry", "name"))


@register("c08_glossary_check", with_bindings(f"""
SELECT o.outage_id AS doc_id, m.kind, m.name
FROM outages o JOIN sites s ON s.site_id = o.site_id JOIN regions r ON r.region_id = s.region_id,
LATERAL (VALUES ('site', {_SITE_SQL}, s.site_id % 2 = 1),
                ('region', replace(r.region_name, ' ', '-'), true),
                ('vendor', CASE o.outage_id % 2 WHEN 0 THEN 'Nordlicht Wind SE' ELSE 'Alpha Grid Partners' END,
                 o.outage_id % 2 = 0)) AS m(kind, name, known)
WHERE NOT m.known"""))
def c08(spark, d):
    """Names that the glossary lacks: every other site, and one of two vendors."""
    t = load(spark, d)
    named = t.sites.join(t.regions, "region_id").select(
        "site_id", _site_name().alias("site"), F.replace("region_name", F.lit(" "), F.lit("-")).alias("region"))
    docs = t.outages.select("outage_id", "site_id").join(named, "site_id").select(
        F.col("outage_id").alias("doc_id"),
        _text("Crew of ", F.when(F.col("outage_id") % 2 == 0, "Nordlicht Wind SE").otherwise("Alpha Grid Partners"),
              " at ", F.col("site"), ", again ", F.col("site"), ".").alias("text"))
    one = spark.createDataFrame([("Nordlicht Wind SE",)], "name string")
    glossary = (named.filter("site_id % 2 = 1").select(F.col("site").alias("name"))
                .unionByName(named.select(F.col("region").alias("name")).distinct()).unionByName(one))
    return C.glossary_check(C.named_things(docs), glossary)


@register("c09_invoice_check", with_bindings("""
SELECT work_order_id AS doc_id, round(labor + parts, 2) AS line_sum, round(labor + parts + off, 2) AS stated_total,
       round(off, 2) AS difference
FROM (SELECT work_order_id, round(labor_hours * 420, 2) AS labor, round(parts_cost_usd, 2) AS parts,
             (work_order_id % 3) * 10000000000 AS off FROM work_orders)"""))
def c09(spark, d):
    """Invoices of the work orders; some totals are off, by more than any field width."""
    w = load(spark, d).work_orders.select(
        F.col("work_order_id").alias("doc_id"), rnd(F.col("labor_hours") * 420, 2).alias("labor"),
        rnd("parts_cost_usd", 2).alias("parts"))
    off = (F.col("doc_id") % 3) * F.lit(10_000_000_000)
    usd = lambda c: _text("$", F.format_number(c, 2))
    text = _text("## Invoice\n| Item | Qty | Amount |\n|---|---|---|\n| Labor | 1 | ", usd(F.col("labor")),
                 " |\n| Parts | 2 | ", usd(F.col("parts")), " |\n| **Total** | | **",
                 usd(rnd(F.col("labor") + F.col("parts") + off, 2)), "** |")
    check = C.invoice_check(C.invoice_lines(w.select("doc_id", text.alias("text"))))
    return check.select("doc_id", *[rnd(c, 2).alias(c) for c in ("line_sum", "stated_total", "difference")])


@register("c10_vendor_cost_ratio", with_bindings(f"""
SELECT asset_type AS "group", round(e, 6) AS avg_emergency, round(c, 6) AS avg_comparable, round(e / c, 6) AS ratio
FROM (SELECT a.asset_type, eavg(CASE WHEN b.vendor_kind = 'emergency' THEN b.billed_usd END) AS e,
             eavg(CASE WHEN b.vendor_kind <> 'emergency' THEN b.billed_usd END) AS c
      FROM ({_rate_sql()}) b JOIN work_orders w ON w.work_order_id = b.work_order_id
      JOIN assets a ON a.asset_id = w.asset_id GROUP BY a.asset_type)"""))
def c10(spark, d):
    t = load(spark, d)
    cost = C.rate_card_cost(t.work_orders, C.rate_cards_frame(spark))
    owner = t.work_orders.select("work_order_id", "asset_id").join(
        t.assets.select("asset_id", "asset_type"), "asset_id")
    costs = cost.join(owner, "work_order_id").select(
        F.col("asset_type").alias("group"), F.col("vendor_kind").alias("kind"), F.col("billed_usd").alias("amount"))
    return C.vendor_cost_ratio(costs).select(
        "group", *[rnd(c, 6).alias(c) for c in ("avg_emergency", "avg_comparable", "ratio")])


@register("c11_threshold_conflicts", with_bindings("""
SELECT standard, unit, count(DISTINCT v) AS distinct_values, min(v) AS lowest, max(v) AS highest,
       count(DISTINCT v) > 1 AS conflict
FROM (SELECT printf('MS-2025-%02d', m.standard) AS standard, 'mm/s' AS unit, m.v
      FROM outages, LATERAL (VALUES (outage_id % 4, 3.5::DOUBLE + CASE WHEN outage_id % 4 < 2 THEN 0 ELSE outage_id % 3 END))
           AS m(standard, v)
      UNION ALL SELECT 'OEM Manual Rev. 4.2', '°C', 70 + outage_id % 2 FROM outages) GROUP BY 1, 2"""))
def c11(spark, d):
    n = F.col("outage_id")
    value = F.when(n % 4 < 2, F.lit(3.5)).otherwise(F.lit(3.5) + n % 3)
    text = _text("Vibration RMS was 9.9 mm/s (", F.format_string("MS-2025-%02d", n % 4), " limit ",
                 value.cast("double").cast("string"), " mm/s); the OEM Manual Rev. 4.2 sets the alert threshold at ",
                 _s(70 + n % 2), " °C.")
    docs = load(spark, d).outages.select(n.alias("doc_id"), text.alias("text"))
    return C.threshold_conflicts(C.threshold_claims(docs))


@register("c15_doc_vs_table", with_bindings(f"""
SELECT a.asset_id AS doc_id, {_TAG_SQL} AS asset_tag, round(x.lost, 1) + a.asset_id % 2 AS stated,
       round(x.lost, 1) AS from_tables, (a.asset_id % 2)::DOUBLE AS difference
FROM (SELECT asset_id, esum(lost_generation_mwh) AS lost FROM outages GROUP BY asset_id) x
JOIN assets a ON a.asset_id = x.asset_id"""))
def c15(spark, d):
    """Reports that state each asset's lost MWh, every other one off by 1."""
    t = load(spark, d)
    per = t.outages.groupBy("asset_id").agg(rnd(exact_sum("lost_generation_mwh"), 1).alias("total_lost_mwh"))
    per = per.join(t.assets.select("asset_id", _tag().alias("asset_tag")), "asset_id")
    stated = F.format_number(F.col("total_lost_mwh") + F.col("asset_id") % 2, 1)
    docs = per.select(F.col("asset_id").alias("doc_id"),
                      _text("Asset ", F.col("asset_tag"), " lost ", stated, " MWh.").alias("text"))
    out = C.doc_vs_table(docs, per)
    return out.select("doc_id", "asset_tag", *[rnd(c, 1).alias(c) for c in ("stated", "from_tables", "difference")])
