"""Dataset preparation queries: names, labels, times, duplicates, scaling, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.functions import hashing, text
from flowspark.operators import filters, prepare
from flowspark.plans import views as v
from flowspark.schemas import FEATURE_COLUMNS

FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]
# Label map of the event types: (label, attack, stage).
EVENT_LABELS = [("view", 0, 0), ("click", 0, None), ("signup", 1, 1), ("purchase", 1, 4)]


def _label_map(spark):
    return spark.createDataFrame(EVENT_LABELS, "label string, attack int, stage int")


def _lines(spark, sf):
    """Order lines as labelled events: 14 of 60 share their key with another line."""
    line = v.table(spark, sf, "lineitem")
    scored = F.year("l_shipdate")
    return line.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("fingerprint"),
        F.when(scored <= 1997, "train").when(scored == 1998, "validation").when(scored == 1999, "calibration").otherwise("test").alias("split"),
        scored.alias("capture"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("attack"),
        F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_linenumber") % 8).cast("int")).alias("stage"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src_ip"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst_ip"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts_us"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        *[c for c in FEATURES if c != "l_extendedprice"],
    )


def header_names(spark, sf):
    """Whole texts under the header rule, as length and digest."""
    docs = v.table(spark, sf, "documents").select("doc_id", text.norm_name(F.col("text")).alias("name"))
    return docs.select("doc_id", F.length("name").cast("bigint").alias("chars"), F.sha2("name", 256).alias("digest"))


def label_canonical(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", text.canonical_label(F.col("text")).alias("label"))
    return docs.select("doc_id", F.length("label").cast("bigint").alias("chars"), F.sha2("label", 256).alias("digest"))


def address_check(spark, sf):
    """Canonical addresses of packets, some of them damaged on purpose."""
    packets = v.packets_v(spark, sf)
    raw = (
        F.when(F.col("seq") % 7 == 0, F.concat(F.lit(" "), F.col("src_ip"), F.lit(" ")))
        .when(F.col("seq") % 7 == 1, F.concat(F.col("src_ip"), F.lit("00")))
        .when(F.col("seq") % 7 == 2, F.concat(F.lit("0"), F.col("src_ip")))
        .otherwise(F.col("src_ip"))
    )
    return packets.select("seq", raw.alias("raw"), text.canonical_ip(raw).alias("ip"))


def capture_times(spark, sf):
    """Day-first stamps without AM/PM, against the day of the capture."""
    events = v.table(spark, sf, "events")
    stamp = F.concat(
        F.date_format("ts", "d/M/yyyy "), (F.hour("ts") % 12).cast("string"), F.lit(":"), F.minute("ts").cast("string")
    )
    day = F.date_add(F.to_date("ts"), F.when(F.col("user_id") % 10 == 0, 1).otherwise(0))
    fixed = text.repair_capture_time(stamp, day)
    rows = events.select("event_id", stamp.alias("stamp"), fixed.alias("r"))
    return rows.select("event_id", "stamp", F.unix_micros("r.ts").alias("ts_us"), F.col("r.reason").alias("reason"))


def event_times(spark, sf):
    """Declared format and zone, start stamps moved to the end by the duration."""
    events = v.table(spark, sf, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("string")
    duration = F.floor("value") * 1000
    return events.select(
        "event_id",
        text.event_time_us(stamp, duration, "yyyy-MM-dd HH:mm:ss", "Asia/Kolkata", "start").alias("zoned_us"),
        text.event_time_us(seconds, duration).alias("raw_us"),
    )


def label_map_errors(spark, sf):
    """Order priority by status as a label map; contradictory rows are reported."""
    orders = v.table(spark, sf, "orders")
    rows = orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    mapped = rows.select(
        F.concat_ws(":", "o_orderpriority", "o_orderstatus").alias("label"),
        (F.substring("o_orderpriority", 1, 1).cast("int") % 3).alias("attack"),
        F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 9).otherwise(3).alias("stage"),
    )
    return prepare.label_map_errors(mapped)


def labelled_events(spark, sf):
    events = v.table(spark, sf, "events").withColumn("label", F.concat(F.lit(" "), F.col("event_type")))
    labelled = prepare.apply_labels(events, _label_map(spark))
    return labelled.groupBy("attack", "stage").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))


def unknown_event_labels(spark, sf):
    events = v.table(spark, sf, "events").withColumn("label", F.col("event_type"))
    return prepare.unknown_labels(events, _label_map(spark))


def event_fingerprints(spark, sf):
    flows = v.flows_v(spark, sf)
    digest = hashing.event_fingerprint(F.col("src_ip"), F.col("dst_ip"), F.col("last_us"), [F.col(c) for c in FEATURE_COLUMNS])
    return flows.select(*v.FLOW_IDENTITY, digest.alias("fingerprint"))


def leak_check(spark, sf):
    return prepare.find_leaks(_lines(spark, sf))


def deduplicated_events(spark, sf):
    order = ["ts_us", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]
    return prepare.dedupe_events(_lines(spark, sf), order).select("fingerprint", "ts_us", "l_partkey", "l_suppkey", "l_quantity")


def source_summary(spark, sf):
    return prepare.source_summary(_lines(spark, sf), ["capture"])


def train_scaler(spark, sf):
    scaler = prepare.fit_scaler(_lines(spark, sf), FEATURES)
    return v.rounded(scaler, [c for c in scaler.columns if c != "rows"])


def scaled_features(spark, sf):
    rows = _lines(spark, sf)
    scaled = prepare.apply_scaler(rows, prepare.fit_scaler(rows, FEATURES), FEATURES)
    names = [f"scaled_{c}" for c in FEATURES]
    means = scaled.groupBy("split").agg(*[F.avg(c).alias(c) for c in names])
    return v.rounded(means, names)


def label_counts(spark, sf):
    return prepare.label_counts(_lines(spark, sf), ["split", "capture", "attack", "stage"])


def split_support(spark, sf):
    return prepare.check_support(v.scored_v(spark, sf))


def conversion_report(spark, sf):
    """Per event type as file: accepted rows, reasons and labels after the time repair."""
    events = v.table(spark, sf, "events")
    stamp = F.concat(F.date_format("ts", "d/M/yyyy "), (F.hour("ts") % 12).cast("string"), F.lit(":"), F.minute("ts").cast("string"))
    day = F.date_add(F.to_date("ts"), F.when(F.col("user_id") % 10 == 0, 1).otherwise(0))
    reason = text.repair_capture_time(stamp, day)["reason"]
    rows = events.select(F.col("event_type").alias("file"), reason.alias("reason"), F.concat(F.lit("k"), F.length("props")).alias("label"))
    report = prepare.conversion_report(rows)

    def flat(name):
        pairs = F.array_sort(F.transform(F.map_entries(name), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
        return F.array_join(pairs, ",").alias(name)

    return report.select("file", "rows", "accepted", flat("reasons"), flat("labels"))


def row_validation(spark, sf):
    """Reject reasons of order lines with shifted features: negative, infinite and oversized values occur."""
    line = v.table(spark, sf, "lineitem")
    tax = F.when(F.col("l_linenumber") == 7, F.exp(F.col("l_quantity") * 20)).otherwise(F.col("l_tax") - 0.01)
    features = F.array("l_quantity", F.col("l_extendedprice"), tax)
    seconds = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("double")
    late = F.when(F.col("l_linenumber") == 6, seconds * 1e4).otherwise(seconds)
    reason = filters.training_row_reason(features, late)
    ok, bad = filters.split_quarantine(line, reason)
    good = ok.agg(F.lit("ok").alias("reason"), F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("keys"))
    return good.unionByName(bad.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("keys")))


def repeated_headers(spark, sf):
    """Rows whose label is the header itself: here one event type plays that role."""
    events = v.table(spark, sf, "events")
    label = F.when(F.col("event_type") == "error", " La-Bel ").otherwise(F.col("event_type"))
    kept = filters.drop_repeated_headers(events.withColumn("label", label))
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


def binary_weight(spark, sf):
    return v.rounded(prepare.binary_weight(v.scored_v(spark, sf).where("split = 'train'")), ["positive_weight"])


def stage_weights(spark, sf):
    return v.rounded(prepare.stage_weights(v.scored_v(spark, sf).where("split = 'train'")), ["weight"])


def family_weights(spark, sf):
    rows = v.table(spark, sf, "events").select(F.when(F.col("event_type") == "view", "benign").otherwise(F.concat_ws("-", "event_type", F.floor(F.col("value") / 100).cast("string"))).alias("family"))
    return v.rounded(prepare.family_weights(rows), ["weight"])


QUERIES = {
    f.__name__: f
    for f in (
        header_names,
        label_canonical,
        address_check,
        capture_times,
        event_times,
        label_map_errors,
        labelled_events,
        unknown_event_labels,
        event_fingerprints,
        leak_check,
        deduplicated_events,
        source_summary,
        train_scaler,
        scaled_features,
        label_counts,
        split_support,
        conversion_report,
        row_validation,
        repeated_headers,
        binary_weight,
        stage_weights,
        family_weights,
    )
}

_ID = ", ".join(v.FLOW_IDENTITY)
_YEAR = "CAST(year(l_shipdate) AS INT)"
_LINES = f"""WITH lines AS (SELECT l_orderkey || '/' || l_linenumber AS fingerprint, CASE WHEN year(l_shipdate) <= 1997 THEN 'train'
  WHEN year(l_shipdate) = 1998 THEN 'validation' WHEN year(l_shipdate) = 1999 THEN 'calibration' ELSE 'test' END AS split, {_YEAR} AS capture,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS attack, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_linenumber % 8 AS INT) END AS stage,
  's' || l_suppkey AS src_ip, 'p' || l_partkey AS dst_ip, epoch_us(l_shipdate) AS ts_us, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount
  FROM lineitem)"""
_STAMP = "strftime(ts, '%-d/%-m/%Y ') || (hour(ts) % 12) || ':' || minute(ts)"
_REPAIR = """repaired AS (SELECT *, CASE WHEN user_id % 10 = 0 THEN 'timestamp_date_mismatch'
    WHEN (CASE WHEN hour(ts) % 12 < 8 THEN hour(ts) % 12 + 12 ELSE hour(ts) % 12 END) > 18 THEN 'timestamp_outside_daytime_capture' END AS reason,
    CASE WHEN hour(ts) % 12 < 8 THEN hour(ts) % 12 + 12 ELSE hour(ts) % 12 END AS h FROM events)"""
_MAP = "(VALUES ('view', 0, 0), ('click', 0, NULL), ('signup', 1, 1), ('purchase', 1, 4)) m(label, attack, stage)"


def _pairs(name: str, condition: str) -> str:
    return f"""(SELECT string_agg({name} || '=' || n, ',' ORDER BY {name} || '=' || n) FROM
      (SELECT {name}, count(*) AS n FROM rows_c r WHERE r.file = f.file AND {condition} GROUP BY 1) x)"""


# Hexadecimal floats as the JVM writes them: a fraction always, no plus before the exponent.
_FP = ", ".join(f"regexp_replace(replace(format('{{:a}}', CAST({c} AS DOUBLE)), 'p+', 'p'), '^(-?0x[0-9a-f])p', '\\1.0p')" for c in FEATURE_COLUMNS)
ORACLE = {
    "header_names": """SELECT doc_id, length(n) AS chars, sha256(n) AS digest FROM
        (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS n FROM documents) d""",
    "label_canonical": r"""SELECT doc_id, length(n) AS chars, sha256(n) AS digest FROM
        (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[–—]', '-', 'g'), '\s+', ' ', 'g')) AS n FROM documents) d""",
    "address_check": f"""WITH {v.PACKETS}, r AS (SELECT seq, CASE seq % 7 WHEN 0 THEN ' ' || src_ip || ' ' WHEN 1 THEN src_ip || '00'
          WHEN 2 THEN '0' || src_ip ELSE src_ip END AS raw, src_ip FROM packets_v)
        SELECT seq, raw, CASE WHEN seq % 7 = 2 THEN NULL WHEN seq % 7 = 1 AND (CAST(split_part(raw, '.', 4) AS INT) > 255 OR length(split_part(raw, '.', 4)) > 3)
          THEN NULL ELSE trim(raw) END AS ip FROM r""",
    "capture_times": f"""WITH {_REPAIR} SELECT event_id, {_STAMP} AS stamp,
        CASE WHEN reason IS NULL THEN epoch_us(date_trunc('day', ts)) + (h * 60 + minute(ts)) * 60000000 END AS ts_us, reason FROM repaired""",
    "event_times": """SELECT event_id, epoch_us(date_trunc('second', ts)) - 19800000000 + CAST(floor(value) * 1000 AS BIGINT) AS zoned_us,
        epoch_us(date_trunc('second', ts)) AS raw_us FROM events""",
    "label_map_errors": """WITH m AS (SELECT DISTINCT o_orderpriority || ':' || o_orderstatus AS label, CAST(left(o_orderpriority, 1) AS INT) % 3 AS attack,
          CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 9 ELSE 3 END AS stage FROM orders)
        SELECT * FROM (SELECT *, CASE WHEN attack NOT IN (0, 1) THEN 'attack_flag' WHEN stage NOT BETWEEN 0 AND 7 THEN 'stage_range'
          WHEN stage = 0 AND attack <> 0 THEN 'attack_with_benign_stage' WHEN attack = 0 AND stage > 0 THEN 'benign_with_attack_stage' END AS error FROM m)
        WHERE error IS NOT NULL""",
    "labelled_events": f"""SELECT CAST(attack AS INT) AS attack, CAST(stage AS INT) AS stage, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids
        FROM events JOIN {_MAP} ON label = event_type GROUP BY 1, 2""",
    "unknown_event_labels": f"""SELECT event_type AS label, count(*) AS rows FROM events WHERE event_type NOT IN (SELECT label FROM {_MAP}) GROUP BY 1""",
    "event_fingerprints": f"""{v.FLOW_CTES} SELECT {_ID}, sha256('[' || src_ip || ',' || dst_ip || ',' || last_us || ',[' || concat_ws(',', {_FP}) || ']]') AS fingerprint
        FROM flows_v""",
    "leak_check": f"""{_LINES} SELECT fingerprint, count(*) AS rows, count(DISTINCT split) > 1 AS crosses_splits FROM lines GROUP BY 1
        HAVING count(DISTINCT (split, attack, coalesce(stage, -1))) > 1""",
    "deduplicated_events": f"""{_LINES} SELECT fingerprint, ts_us, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint
        ORDER BY ts_us, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS rn FROM lines) x WHERE rn = 1""",
    "source_summary": f"""{_LINES} SELECT a.capture, count(DISTINCT fingerprint) AS inserted, count(*) - count(DISTINCT fingerprint) AS duplicates_removed,
        count(DISTINCT src_ip) + count(DISTINCT dst_ip) AS nodes FROM lines a GROUP BY 1""",
    "train_scaler": f"""{_LINES} SELECT count(*) AS rows, {", ".join(f"round(avg(ln(1 + {c})), 6) AS mean_{c}" for c in FEATURES)},
        {", ".join(f"round(greatest(stddev_pop(ln(1 + {c})), 0.001), 6) AS scale_{c}" for c in FEATURES)} FROM lines WHERE split = 'train'""",
    "scaled_features": f"""{_LINES}, s AS (SELECT {", ".join(f"avg(ln(1 + {c})) AS m_{c}, stddev_pop(ln(1 + {c})) AS s_{c}" for c in FEATURES)} FROM lines WHERE split = 'train')
        SELECT split, {", ".join(f"round(avg((ln(1 + {c}) - m_{c}) / s_{c}), 6) AS scaled_{c}" for c in FEATURES)} FROM lines, s GROUP BY 1""",
    "label_counts": f"{_LINES} SELECT split, capture, attack, stage, count(*) AS rows FROM lines GROUP BY ALL",
    "split_support": f"""WITH {v.SCORED} SELECT split, count(*) FILTER (label = 1) AS attacks, count(*) FILTER (label = 0) AS benign,
        CASE WHEN split = 'calibration' THEN count(*) FILTER (label = 0) > 0 ELSE count(DISTINCT label) = 2 END AS supported FROM scored_v GROUP BY 1""",
    "conversion_report": f"""WITH {_REPAIR}, rows_c AS (SELECT event_type AS file, reason, 'k' || length(props) AS label FROM repaired),
        f AS (SELECT file, count(*) AS rows, count(*) FILTER (reason IS NULL) AS accepted FROM rows_c GROUP BY 1)
        SELECT file, rows, accepted, {_pairs("reason", "reason IS NOT NULL")} AS reasons, {_pairs("label", "reason IS NULL")} AS labels FROM f""",
    "row_validation": """WITH x AS (SELECT *, CASE WHEN l_linenumber = 7 THEN exp(l_quantity * 20) ELSE l_tax - 0.01 END AS tax,
          CASE WHEN l_linenumber = 6 THEN epoch(l_shipdate) * 1e4 ELSE epoch(l_shipdate) END AS secs FROM lineitem),
        r AS (SELECT l_orderkey, CASE WHEN NOT isfinite(tax) OR tax < 0 THEN 'invalid_numeric' WHEN ln(1 + tax) > 100 THEN 'numeric_range'
          WHEN secs > 1e12 THEN 'timestamp_range' ELSE 'ok' END AS reason FROM x)
        SELECT reason, count(*) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM r GROUP BY 1""",
    "repeated_headers": "SELECT event_type AS label, count(*) AS rows FROM events WHERE event_type <> 'error' GROUP BY 1",
    "binary_weight": f"""WITH {v.SCORED}, c AS (SELECT count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS attacks FROM scored_v WHERE split = 'train')
        SELECT *, round(least(20.0, sqrt(benign / attacks)), 6) AS positive_weight FROM c""",
    "stage_weights": f"""WITH {v.SCORED}, c AS (SELECT stage, count(*) AS n FROM scored_v WHERE split = 'train' AND stage IS NOT NULL GROUP BY 1),
        g AS (SELECT CAST(s AS INT) AS stage, coalesce(n, 0) AS rows FROM (SELECT unnest(range(8)) AS s) a LEFT JOIN c ON c.stage = a.s)
        SELECT stage, rows, round(least(greatest(sqrt((SELECT max(rows) FROM g) / greatest(rows, 1)), 1.0), 10.0), 6) AS weight FROM g""",
    "family_weights": """WITH f AS (SELECT CASE WHEN event_type = 'view' THEN 'benign' ELSE event_type || '-' || CAST(floor(value / 100) AS BIGINT) END AS family FROM events),
        c AS (SELECT family, count(*) AS rows FROM f GROUP BY 1),
        w AS (SELECT *, CASE WHEN family = 'benign' THEN 1.0 ELSE least(20.0, sqrt((SELECT max(rows) FROM c WHERE family <> 'benign') / rows)) END AS raw FROM c)
        SELECT family, rows, round(raw / (SELECT sum(raw * rows) / sum(rows) FROM w), 6) AS weight FROM w""",
}
