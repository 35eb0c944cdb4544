"""Document-corpus jobs (c01-c17): per-document parsing with built-in string
functions, cross-document rules as joins / aggregates.

A document is one row ``(doc_id, text)`` and is always processed whole;
per-document work (line explode + running section number) stays inside the
document's own rows, cross-document work is shuffled by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import dbl, exact_avg, rnd
from .windows import cumulative_sum

# ------------------------------------------------------------------ fixed values
BANNED_PHRASES = ("delve into", "leverage", "in conclusion", "this analysis shows",
                  "highlights the importance of", "robust", "synergize", "ensure that")
DOC_TYPE_PATTERN = r"^([A-Z]+)-"
DOC_ID_PATTERN = r"\b([A-Z]{2,5}-(?:[A-Z]+-)*\d{4}-\d{3}|VTM-[A-Z0-9-]+[A-Z0-9])\b"
# outages, work orders, and asset tags of any three-letter type
ENTITY_PATTERN = r"\b(OUT-\d{4}-\d+|WO-\d{4,}(?:-\d+)?|[A-Z]{3}-\d{5,})\b(?!-)"
SITE_PATTERN = r"\b([A-Z][A-Za-z]*(?:-[A-Z][A-Za-z]*)*-(?:WIND|SOLAR|BATTERY)-\d{3,})\b"
VENDOR_PATTERN = (r"\b((?:[A-Z][A-Za-z&]+ ){1,4}"
                  r"(?:Inc\.|A/S|SE\b|Energy|Partners|Solutions|Maintenance|Power Grids))")
# a standard or manual, the word limit or threshold, and a value with its unit
CLAIM_PATTERN = (r"\b(MS-\d{4}-\d{2}|ISO \d+(?:-\d+)*|IEC \d+(?:-\d+)*|OEM(?: Manual)?(?: Rev\. \d+(?:\.\d+)*)?)"
                 r"\b[^.;|\n]*?\b(?:limit|threshold)\b[^0-9;|\n]*(\d+(?:\.\d+)?)\s*(mm/s|°C|ppm|kV|months?|%)")
HREF_PATTERN = r'href="([^"]*)"'
MIN_REFERENCES = 2
# Vibration bands (running-mean broadband RMS, mm/s) per OEM manual.
VIBRATION_BANDS = [
    ("siemens_gamesa", "Normal", 0.0, 2.0, "Continue normal operation"),
    ("siemens_gamesa", "Elevated", 2.0, 3.0, "Schedule unscheduled inspection within 14 days"),
    ("siemens_gamesa", "Alert", 3.0, 3.5, "Inspect within 7 days; review oil sample"),
    ("siemens_gamesa", "Replacement criterion", 3.5, None, "Gearbox replacement is recommended"),
    ("vestas", "Normal", 0.0, 3.0, "Continue normal operation"),
    ("vestas", "Elevated", 3.0, 5.0, "Inspect at next scheduled outage; pull oil sample"),
    ("vestas", "Alert (refurbishment evaluation)", 5.0, 7.0, "Schedule refurbishment evaluation"),
    ("vestas", "Replacement evaluation", 7.0, None, "Replacement evaluation"),
]
# Rate cards: vendor kind, hourly rate, minimum hours, weekend and overnight
# multipliers, parts mark-up, mobilisation fee per event.
RATE_CARDS = [
    ("scheduled", 185.0, 0.0, 1.0, 1.0, 0.08, 0.0),
    ("emergency", 420.0, 2.0, 1.5, 1.25, 0.35, 35000.0),
]
OVERNIGHT_FROM_HOUR = 22
OVERNIGHT_TO_HOUR = 6
APPROVAL_TIERS = ((250000, "VP, Asset Management"), (75000, "Regional Director of Operations"))
DEFAULT_APPROVER = "Regional Maintenance Planner"
# time per chunk of the running count of deferrals (c16)
DEFERRAL_CHUNK_DAYS = 30


# ------------------------------------------------------------------ parsing
def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, line) for every line of every document (1-based)."""
    return docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n", -1))
                       .alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


_BOLD = r"^\*\*([^*:]+):\*\*\s*(.*)$"
_FIELD_TABLE = r"(?m)^\|\s*\**Field\**\s*\|\s*\**Value\**\s*\|[ \t]*\n((?:\|.*(?:\n|\z))*)"
_FIELD_ROW = r"^\|\s*\**([^|*]+?)\**\s*\|\s*(.*?)\s*\|\s*$"


def header_fields(docs: DataFrame) -> DataFrame:
    """c01: ``(doc_id, field, value)`` from the rows of every ``| Field | Value |``
    table (leading header or trailing control table) and the ``**Field:** value``
    lines of the head, which ends at the first ``## `` line after a field.

    A per-row projection over the text's lines: no shuffle, no window.
    """
    rows = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(_FIELD_TABLE), 1),
                                 lambda t: F.split(t, "\n")))
    rows = F.filter(rows, lambda x: x.rlike(_FIELD_ROW) & ~x.rlike(r"^\|[\s:|-]+$"))
    head = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    x = docs.select("doc_id", rows.alias("_rows"), head.alias("_head"))
    field = F.filter("_head", lambda l: l["x"].rlike(_BOLD) | l["x"].rlike(r"^\|\s*\**Field\**\s*\|"))
    x = x.withColumn("_first", F.array_min(F.transform(field, lambda l: l["i"])))
    ends = F.filter("_head", lambda l: l["x"].startswith("## ") & (l["i"] > F.col("_first")))
    x = x.withColumn("_end", F.array_min(F.transform(ends, lambda l: l["i"])))
    bold = F.transform(F.filter("_head", lambda l: l["x"].rlike(_BOLD) & (F.col("_end").isNull()
                                                                         | (l["i"] < F.col("_end")))),
                       lambda l: l["x"])
    pair = lambda pattern: lambda l: F.struct(
        F.trim(F.regexp_extract(l, pattern, 1)).alias("field"), F.trim(F.regexp_extract(l, pattern, 2)).alias("value"))
    fields = F.concat(F.transform("_rows", pair(_FIELD_ROW)), F.transform(bold, pair(_BOLD)))
    return x.select("doc_id", F.explode(fields).alias("f")).select("doc_id", "f.field", "f.value")


def doc_types(docs: DataFrame) -> DataFrame:
    """c02: document type from the id prefix and the count per type."""
    t = docs.select(F.regexp_extract("doc_id", DOC_TYPE_PATTERN, 1).alias("doc_type"))
    return t.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n_docs"))


def section_chunks(docs: DataFrame, marker: str = "## ") -> DataFrame:
    """c03: split each document at heading lines into numbered sections.

    ``section_no`` is the running count of headings (0 = preamble, absent
    when the text opens with a heading); the chunk text is the section's
    lines in order.  The split is a regex split at the newline in front of
    each heading line, i.e. a per-row projection: no shuffle, no window, and
    a document is never cut anywhere but at its own headings.
    """
    import re
    m = re.escape(marker)
    parts = F.split(F.col("text"), rf"\n(?={m})", -1)
    x = docs.select("doc_id", F.col("text").startswith(marker).alias("_lead"),
                    F.posexplode(parts).alias("_pos", "body"))
    head = F.col("body").startswith(marker)
    return x.select(
        "doc_id",
        (F.col("_pos") + F.col("_lead").cast("int")).cast("long").alias("section_no"),
        F.when(head, F.regexp_extract("body", rf"^{m}([^\n]*)", 1)).alias("heading"),
        F.size(F.split("body", "\n", -1)).cast("long").alias("n_lines"),
        "body")


def doc_references(docs: DataFrame, pattern: str = DOC_ID_PATTERN) -> DataFrame:
    """c04 (markdown form): distinct document ids cited by each document,
    self-references dropped."""
    refs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1))
                       .alias("target"))
    return refs.filter(F.col("target") != F.col("doc_id")).distinct()


def doc_reference_rule(docs: DataFrame, min_refs: int = MIN_REFERENCES) -> DataFrame:
    """c05 (markdown form): per document, distinct references, references to
    documents absent from the corpus (dangling), and the minimum-refs flag."""
    refs = doc_references(docs)
    known = docs.select(F.col("doc_id").alias("target")).withColumn("_known", F.lit(True))
    per = refs.join(known, "target", "left").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_refs"),
        F.count_if(F.col("_known").isNull()).alias("n_dangling"),
        F.array_sort(F.collect_list(F.when(F.col("_known").isNull(), F.col("target"))))
        .alias("dangling"))
    z = F.lit(0).cast("long")
    out = docs.select("doc_id").join(per, "doc_id", "left").select(
        "doc_id", F.coalesce("n_refs", z).alias("n_refs"),
        F.coalesce("n_dangling", z).alias("n_dangling"), "dangling")
    return out.withColumn("below_min_refs", F.col("n_refs") < min_refs)


def _url_path(c):
    return F.regexp_extract(c, r"^[A-Za-z]+://[^/]+(/[^?#]*)?", 1)


def _target_path(c):
    return F.when(c.rlike("^[A-Za-z]+://"), _url_path(c)) \
            .otherwise(F.regexp_replace(c, r"[?#].*$", ""))


def page_links(pages: DataFrame) -> DataFrame:
    """c04: distinct ``(page_id, target)`` hrefs of each page, no self links."""
    p = pages.select("page_id", "url", F.explode(
        F.regexp_extract_all("html", F.lit(HREF_PATTERN), 1)).alias("target"))
    p = p.filter((F.col("target") != "") & (F.col("target") != F.col("url"))
                 & (_target_path(F.col("target")) != _url_path(F.col("url"))))
    return p.select("page_id", "target").distinct()


def link_rule(pages: DataFrame, min_refs: int = MIN_REFERENCES) -> DataFrame:
    """c05: per page, distinct outgoing references, how many point to no
    known page (dangling), and whether it has fewer than ``min_refs``."""
    links = page_links(pages).withColumn("tpath", _target_path(F.col("target")))
    known = pages.select(_url_path(F.col("url")).alias("tpath")).distinct() \
                 .withColumn("_known", F.lit(True))
    lk = links.join(known, "tpath", "left")
    per = lk.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_refs"),
        F.count_if(F.col("_known").isNull()).alias("n_dangling"))
    z = F.lit(0).cast("long")
    out = pages.select("page_id").join(per, "page_id", "left").select(
        "page_id", F.coalesce("n_refs", z).alias("n_refs"),
        F.coalesce("n_dangling", z).alias("n_dangling"))
    return out.withColumn("below_min_refs", F.col("n_refs") < min_refs)


def entity_mentions(docs: DataFrame, assets: DataFrame | None = None,
                    pattern: str = ENTITY_PATTERN) -> DataFrame:
    """c06: entity tags mentioned per document (distinct), joined to assets
    by ``asset_tag`` when an asset table is given."""
    m = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1))
                    .alias("tag")).distinct()
    if assets is not None:
        m = m.join(assets.select(F.col("asset_tag").alias("tag"), "asset_id"), "tag", "left")
    return m


def banned_phrases(docs: DataFrame, phrases=BANNED_PHRASES) -> DataFrame:
    """c07: occurrences of each banned phrase per document (case-insensitive).

    The phrase list is a fixed, small set, so it is applied as one array
    column per document (no join): byte length removed by ``replace``
    divided by the phrase length.
    """
    low = F.lower(F.col("text"))
    hits = F.array(*[F.struct(F.lit(p).alias("phrase"),
                              ((F.octet_length(low) - F.octet_length(F.replace(low, F.lit(p), F.lit(""))))
                               / len(p.encode())).cast("long").alias("occurrences"))
                     for p in phrases])
    x = docs.select("doc_id", F.explode(hits).alias("h"))
    return x.select("doc_id", "h.phrase", "h.occurrences").filter(F.col("occurrences") > 0)


STATED_MWH_PATTERN = r"\b((?:[A-Z]{3})-\d{4,})\b[^.\n]*?([0-9][0-9,]*(?:\.[0-9]+)?)\s*MWh"


def doc_vs_table(docs: DataFrame, per_asset: DataFrame, tag_col: str = "asset_tag",
                 value_col: str = "total_lost_mwh") -> DataFrame:
    """c15: figures stated in the text next to an asset tag (``WIN-10130 ...
    20,494 MWh``) against the same figure aggregated from the tables."""
    pairs = docs.select("doc_id", F.explode(F.regexp_extract_all(
        "text", F.lit(STATED_MWH_PATTERN), 0)).alias("_m"))
    stated = pairs.select(
        "doc_id", F.regexp_extract("_m", STATED_MWH_PATTERN, 1).alias(tag_col),
        F.regexp_replace(F.regexp_extract("_m", STATED_MWH_PATTERN, 2), ",", "")
        .cast("double").alias("stated"))
    j = stated.join(per_asset.select(tag_col, F.col(value_col).alias("from_tables")),
                    tag_col, "left")
    return j.withColumn("difference", F.col("stated") - F.col("from_tables"))


def named_things(docs: DataFrame) -> DataFrame:
    """c08: distinct ``(doc_id, kind, name)`` of the sites, regions (the part of a
    site name before its type) and vendors that the text names."""
    sites = F.regexp_extract_all("text", F.lit(SITE_PATTERN), 1)
    regions = F.transform(sites, lambda n: F.regexp_replace(n, r"-(WIND|SOLAR|BATTERY)-\d+$", ""))
    vendors = F.regexp_extract_all("text", F.lit(VENDOR_PATTERN), 1)
    all_of = lambda kind, names: F.transform(names, lambda n: F.struct(
        F.lit(kind).alias("kind"), n.alias("name")))
    both = F.concat(all_of("site", sites), all_of("region", regions), all_of("vendor", vendors))
    return docs.select("doc_id", F.explode(F.array_distinct(both)).alias("n")).select("doc_id", "n.kind", "n.name")


def glossary_check(mentions: DataFrame, glossary: DataFrame, col: str = "name") -> DataFrame:
    """c08: mentioned names that the glossary does not define."""
    return mentions.join(glossary.select(F.col(col).alias("_g")),
                         mentions[col] == F.col("_g"), "left_anti")


def invoice_lines(docs: DataFrame) -> DataFrame:
    """c09: markdown table rows carrying a ``$`` amount -> (doc, line, item,
    amount); rows whose item mentions 'total' are the stated totals."""
    ln = lines(docs).filter(F.col("line").startswith("|") & F.col("line").contains("$"))
    cells = F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|")
    x = ln.select("doc_id", "line_no", cells.alias("_c"))
    amount_txt = F.regexp_extract(F.element_at("_c", -1), r"\$\s*([0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    x = x.withColumn("_amount", F.regexp_replace(amount_txt, ",", ""))
    item = F.trim(F.regexp_replace(F.element_at("_c", 1), r"\*", ""))
    return x.select("doc_id", "line_no", item.alias("item"),
                    F.expr("try_cast(_amount AS DOUBLE)").alias("amount"),
                    F.lower(item).contains("total").alias("is_total"))


def invoice_check(inv: DataFrame) -> DataFrame:
    """c09: sum of line items vs the stated total per document."""
    return inv.groupBy("doc_id").agg(
        F.sum(F.when(~F.col("is_total"), F.col("amount"))).alias("line_sum"),
        F.max(F.when(F.col("is_total"), F.col("amount"))).alias("stated_total")) \
        .withColumn("difference", F.col("stated_total") - F.col("line_sum"))


def vendor_cost_ratio(costs: DataFrame) -> DataFrame:
    """c10: average emergency cost / average comparable (scheduled) cost per
    group; input ``(group, kind, amount)``."""
    g = costs.groupBy("group").agg(
        exact_avg(F.when(F.col("kind") == "emergency", F.col("amount"))).alias("avg_emergency"),
        exact_avg(F.when(F.col("kind") != "emergency", F.col("amount"))).alias("avg_comparable"))
    return g.withColumn("ratio", F.col("avg_emergency") / F.when(F.col("avg_comparable") != 0,
                                                                F.col("avg_comparable")))


def threshold_claims(docs: DataFrame, pattern: str = CLAIM_PATTERN) -> DataFrame:
    """c11: distinct ``(doc_id, standard, threshold, unit)`` stated per document."""
    said = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("_s"))
    part = lambda i: F.regexp_extract("_s", pattern, i)
    return said.select("doc_id", part(1).alias("standard"), part(2).cast("double").alias("threshold"),
                       part(3).alias("unit")).distinct()


def threshold_conflicts(claims: DataFrame) -> DataFrame:
    """c11: per standard and unit the values stated, a conflict when several; the
    values are distinct pairs first, so a list is as long as the disagreement."""
    values = claims.select("standard", "unit", "threshold").distinct()
    return values.groupBy("standard", "unit").agg(
        F.count(F.lit(1)).alias("distinct_values"), F.min("threshold").alias("lowest"),
        F.max("threshold").alias("highest")).withColumn("conflict", F.col("distinct_values") > 1)


def bands_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        VIBRATION_BANDS, "band_set string, level string, lo double, hi double, action string")


def threshold_bands(readings: DataFrame, bands: DataFrame, value: str = "running_mean") -> DataFrame:
    """c12: each reading's band by a range lookup ``lo <= v < hi`` within its
    band set.  The band table is a fixed handful of rows -> broadcast; the
    join is an equi-join on ``band_set`` with the range as residual."""
    b = F.broadcast(bands)
    v = F.col(value)
    cond = ((readings["band_set"] == b["band_set"]) & (v >= b["lo"])
            & (b["hi"].isNull() | (v < b["hi"])))
    return readings.join(b, cond, "left").drop(b["band_set"]).drop("lo", "hi")


def rate_cards_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RATE_CARDS, "vendor_kind string, hourly_rate double, min_hours double, "
                    "weekend_mult double, overnight_mult double, parts_markup double, "
                    "mobilization double")


def rate_card_cost(work_orders: DataFrame, cards: DataFrame) -> DataFrame:
    """c13: billed cost of each work order under its vendor's rate card:
    max(labour, minimum) x rate x (weekend or overnight multiplier) + parts
    x (1 + mark-up) + mobilisation; emergency work goes to the emergency
    vendor, everything else to the scheduled one."""
    w = work_orders.withColumn(
        "vendor_kind", F.when(F.col("work_order_type") == "emergency", "emergency")
                        .otherwise("scheduled"))
    j = w.join(F.broadcast(cards), "vendor_kind")
    h = F.hour("created_ts")
    weekend = F.dayofweek("created_ts").isin(1, 7)
    overnight = (h >= OVERNIGHT_FROM_HOUR) | (h < OVERNIGHT_TO_HOUR)
    mult = F.when(weekend, F.col("weekend_mult")).when(overnight, F.col("overnight_mult")) \
            .otherwise(dbl(1))
    labor = F.greatest(F.col("labor_hours"), F.col("min_hours")) * F.col("hourly_rate") * mult
    parts = F.col("parts_cost_usd") * (1 + F.col("parts_markup"))
    total = labor + parts + F.col("mobilization")
    return j.select("work_order_id", "vendor_kind", rnd(labor, 2).alias("labor_cost_usd"),
                    rnd(parts, 2).alias("parts_billed_usd"), rnd(total, 2).alias("billed_usd"))


def approval_tier(amount) -> F.Column:
    """c14: approver required for a single work order amount."""
    a = F.col(amount) if isinstance(amount, str) else amount
    out = None
    for lim, who in APPROVAL_TIERS:
        out = F.when(a > lim, who) if out is None else out.when(a > lim, who)
    return out.otherwise(DEFAULT_APPROVER)


def deferred_before_failure(tables) -> DataFrame:
    """c16: overdue (deferred) maintenance items planned on the same asset at
    any time up to each forced outage: a running count over both event kinds
    (chunked prefix sums; no pairs are materialised)."""
    ms = tables["maintenance_schedule"].filter(F.col("overdue_flag")).select(
        "asset_id", F.col("planned_date").cast("timestamp_ntz").alias("ts"),
        F.lit(None).cast("long").alias("outage_id"), F.col("schedule_id").alias("_uid"), F.lit(1).alias("_d"))
    fo = tables["outages"].filter(F.col("forced_outage_flag")).select(
        "asset_id", F.col("outage_start_ts").alias("ts"), "outage_id",
        F.col("outage_id").alias("_uid"), F.lit(0).alias("_d"))
    u = ms.unionByName(fo).withColumn("_e", F.unix_micros(F.col("ts").cast("timestamp")))
    # an item planned for the very time of an outage comes before it
    c = cumulative_sum(u, "asset_id", "_e", ["_e", F.desc("_d"), "_uid"], "_d", "deferred_items",
                       chunk_s=DEFERRAL_CHUNK_DAYS * 86400 * 1_000_000)
    return c.filter(F.col("outage_id").isNotNull()).select(
        "outage_id", "asset_id", F.col("ts").alias("outage_start_ts"), "deferred_items")


def _label_sums(batches):
    """Vector sum and count per label of a partition."""
    import numpy as np
    import pandas as pd
    sums = {}
    for pdf in batches:
        for label, g in pdf.groupby("label"):
            m = np.stack(g["embedding"].to_numpy()).astype(np.float64)
            s, n = sums.get(label, (0.0, 0))
            sums[label] = (s + m.sum(axis=0), n + len(m))
    rows = [(label, i, float(x), n) for label, (s, n) in sums.items() for i, x in enumerate(s)]
    yield pd.DataFrame(rows, columns=["label", "pos", "s", "n"])


def label_centroids(emb: DataFrame) -> DataFrame:
    """Mean vector per label (element-wise), as (label, pos, value): vectors are
    summed inside each partition, so the shuffle sees labels x width rows."""
    kind = emb.schema["label"].dataType.simpleString()
    part = emb.filter("label IS NOT NULL AND embedding IS NOT NULL").select("label", "embedding").mapInPandas(
        _label_sums, f"label {kind}, pos int, s double, n long")
    return part.groupBy("label", "pos").agg((F.sum("s") / F.sum("n")).alias("value"))


# query vectors per block (one broadcast matrix, one pass over the vectors each)
QUERY_BLOCK = 256


def _partition_topk(batches, qids, qmat, k):
    """Running top-k per query over one partition's Arrow batches."""
    import numpy as np
    import pandas as pd
    best_s = np.full((len(qids), 0), -np.inf)
    best_i = np.zeros((len(qids), 0), dtype=np.int64)
    for pdf in batches:
        if pdf.empty:
            continue
        m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        norms = np.linalg.norm(m, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            sc = (qmat @ m.T) / norms                   # queries x rows, qmat rows unit-length
        sc = np.where(np.isfinite(sc), sc, -np.inf)
        ids = np.broadcast_to(pdf["vec_id"].to_numpy(np.int64), sc.shape)
        cand_s = np.concatenate([best_s, sc], axis=1)
        cand_i = np.concatenate([best_i, ids], axis=1)
        # order by score desc, then id asc; keep k
        order = np.lexsort((cand_i, -cand_s), axis=1)[:, :k]
        best_s = np.take_along_axis(cand_s, order, axis=1)
        best_i = np.take_along_axis(cand_i, order, axis=1)
    rows = [(q, int(best_i[a, j]), float(best_s[a, j]))
            for a, q in enumerate(qids) for j in range(best_s.shape[1])
            if np.isfinite(best_s[a, j])]
    yield pd.DataFrame(rows, columns=["query", "vec_id", "score"])


def topk_by_cosine(emb: DataFrame, queries: list[tuple[object, list[float]]], k: int = 5,
                   query_type: str | None = None) -> DataFrame:
    """c17: the k vectors most cosine-similar to each query vector.

    Queries go in blocks of ``QUERY_BLOCK``: each block's matrix is broadcast,
    each partition scores its vectors with one matrix product (Arrow batches
    into numpy) and keeps a running top-k per query, so a task emits at most
    ``block x k`` rows.  The global top-k then ranks at most
    ``partitions x queries x k`` survivors.  Ties break on the vector id.
    """
    qtype = query_type or ("long" if all(isinstance(q, int) for q, _ in queries) else "string")
    if not queries:
        return emb.sparkSession.createDataFrame(
            [], f"query {qtype}, rank long, vec_id long, score double")
    blocks = [queries[i:i + QUERY_BLOCK] for i in range(0, len(queries), QUERY_BLOCK)]
    return reduce(DataFrame.unionByName, [_topk_block(emb, b, k, qtype) for b in blocks])


def _topk_block(emb: DataFrame, queries: list[tuple[object, list[float]]], k: int,
                qtype: str) -> DataFrame:
    import numpy as np
    qids = [q for q, _ in queries]
    qmat = np.array([v for _, v in queries], dtype=np.float64)
    qmat = qmat / np.linalg.norm(qmat, axis=1, keepdims=True)
    bc = emb.sparkSession.sparkContext.broadcast((qids, qmat))

    def score(batches):
        ids, mat = bc.value
        return _partition_topk(batches, ids, mat, k)

    part = emb.select("vec_id", "embedding").mapInPandas(
        score, f"query {qtype}, vec_id long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                .select("query", F.col("rank").cast("long").alias("rank"), "vec_id",
                        rnd("score", 6).alias("score")))


def centroid_queries(emb: DataFrame) -> list[tuple[object, list[float]]]:
    """Label centroids as a query list: the stated query set of c17, one vector
    per label, read block by block."""
    c = (label_centroids(emb).groupBy("label")
         .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v")))
    return [(r["label"], [p["value"] for p in r["v"]]) for r in c.toLocalIterator()]
