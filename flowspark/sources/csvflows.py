"""Labelled-flow CSV files: headers by alias, strict rows, manifests, inventories."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.text import canonical_ip, canonical_label, norm_name, norm_text
from flowspark.operators.ordered import ordered
from flowspark.operators.prepare import assert_none
from flowspark.schemas import FEATURE_COLUMNS, FEATURES, SPLITS

CORRUPT = "_corrupt"

# Spark reads ISO-8859-1 but not Windows-1252; the two differ in bytes 0x80-0x9F only.
_C1 = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
_C1 = {k: x for k, x in _C1.items() if x}
_CP1252 = ("".join(_C1), "".join(_C1.values()))


def _spark_encoding(encoding: str) -> str:
    return "iso-8859-1" if encoding.lower() in ("windows-1252", "cp1252") else encoding


def _decoded(column: Column, encoding: str) -> Column:
    return F.translate(column, *_CP1252) if _spark_encoding(encoding) != encoding else column

# Accepted header spellings of every feature, in feature order.
ALIASES = [
    ["Flow Duration", "FlowDuration"],
    ["Total Fwd Packet", "Total Fwd Packets", "Tot Fwd Pkts"],
    ["Total Bwd packets", "Total Backward Packets", "Tot Bwd Pkts"],
    ["Total Length of Fwd Packet", "Total Length of Fwd Packets", "TotLen Fwd Pkts"],
    ["Total Length of Bwd Packet", "Total Length of Bwd Packets", "TotLen Bwd Pkts"],
    ["Fwd Packet Length Mean", "Fwd Pkt Len Mean"],
    ["Bwd Packet Length Mean", "Bwd Pkt Len Mean"],
    ["Flow Bytes/s", "Flow Byts/s"],
    ["Flow Packets/s", "Flow Pkts/s"],
    ["Flow IAT Mean"],
    ["Fwd IAT Mean"],
    ["Bwd IAT Mean"],
    ["Fwd Packets/s", "Fwd Pkts/s"],
    ["Bwd Packets/s", "Bwd Pkts/s"],
    ["Average Packet Size", "Pkt Size Avg"],
    ["Down/Up Ratio"],
]
# Spellings of the other columns.
IDENTITY_ALIASES = {
    "src_ip": ["src_ip", "Source IP", "Src IP"],
    "dst_ip": ["dst_ip", "Destination IP", "Dst IP"],
    "timestamp": ["timestamp"],
    "label": ["label"],
}
# Labels of the audited export, and the families of the feature-only one.
EXPORT_LABELS = [
    "BENIGN", "FTP-Patator", "SSH-Patator", "DoS slowloris", "DoS Slowhttptest", "DoS Hulk", "DoS GoldenEye", "Heartbleed",
    "Web Attack - Brute Force", "Web Attack - XSS", "Web Attack - Sql Injection", "Infiltration", "Bot", "PortScan", "DDoS",
]
FAMILY_LABELS = [
    "Benign", "Bot", "Brute Force -Web", "Brute Force -XSS", "SQL Injection", "Infilteration", "Infiltration",
    "DDOS attack-HOIC", "DDOS attack-LOIC-UDP", "DDoS attacks-LOIC-HTTP", "DoS attacks-GoldenEye", "DoS attacks-Slowloris",
    "DoS attacks-SlowHTTPTest", "DoS attacks-Hulk", "FTP-BruteForce", "SSH-Bruteforce",
]


def _lines(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """``value, file, _block, _in_split``: every line with its place."""
    if encoding.upper() in ("UTF-8", "UTF8"):
        lines = spark.read.text(path)
    else:
        lines = spark.read.schema("value string").option("encoding", _spark_encoding(encoding)).option("sep", "\u0001").option("quote", "").csv(path)
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block")
    return lines.select(_decoded(F.col("value"), encoding).alias("value"), *place).withColumn("_in_split", F.monotonically_increasing_id())


def _names_of(line: str) -> list[str]:
    return next(csv.reader([line.lstrip("\ufeff")]))


def read_headers(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> list[tuple[list[str], list[str]]]:
    """``(column names, files)`` of each different first line, byte-order mark removed.

    One pass over the first block of each file; the driver gets the lines and the file names.
    """
    first = _lines(spark, path, encoding).where("_block = 0").groupBy("file").agg(F.min_by("value", "_in_split").alias("value"))
    groups = first.groupBy("value").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    if not groups:
        raise ValueError(f"empty file: {path}")
    return [(_names_of(r.value), [unquote(f) for f in r.files]) for r in sorted(groups, key=lambda r: r.files[0])]


def resolve_columns(
    headers: list[str], explicit: dict[str, str] | None = None, identity: bool = True, tolerate_unused: bool = False
) -> dict[str, int]:
    """Position of every target column; a target needs exactly one matching header.

    Repeated headers are an error unless ``tolerate_unused`` and no target wants them.
    """
    explicit = explicit or {}
    wanted = dict(zip(FEATURES, ALIASES))
    wanted |= IDENTITY_ALIASES if identity else {"label": ["label"]}
    unknown = sorted(set(explicit) - set(wanted))
    if unknown:
        raise ValueError(f"unknown column overrides: {unknown}")
    positions: dict[str, list[int]] = {}
    for at, header in enumerate(headers):
        positions.setdefault(norm_text(header), []).append(at)
    repeated = [headers[found[1]] for found in positions.values() if len(found) > 1]
    if repeated and not tolerate_unused:
        raise ValueError(f"ambiguous duplicate column: {repeated[0]}")
    out = {}
    for target, spellings in wanted.items():
        names = {norm_text(s) for s in ([explicit[target]] if target in explicit else spellings)}
        found = [at for name in names for at in positions.get(name, [])]
        if len(found) != 1:
            raise ValueError(f"exactly one {target!r} column required, found {len(found)}")
        out[target] = found[0]
    return out


def read_rows(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> list[tuple[DataFrame, list[str]]]:
    """``(rows, header)`` of each group of files with one header."""
    return [(_rows(spark, files, headers, encoding), headers) for headers, files in read_headers(spark, path, encoding)]


def _rows(spark: SparkSession, files: list[str], headers: list[str], encoding: str) -> DataFrame:
    """All-text rows as c0..cn with ``file``, split position and the raw text of rows whose
    width differs from the header."""
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(headers))]
    schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", _spark_encoding(encoding))
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    # Width checks need every token, so pruning is off for the parser of these rows.
    rows = reader.option("columnPruning", False).option("nullValue", "\u0001").option("emptyValue", "").csv(files)
    texts = [_decoded(F.col(f.name), encoding).alias(f.name) for f in fields]
    # The check needs every column parsed whatever a caller selects.
    everything = F.length(F.concat_ws("", *[f.name for f in fields])) >= 0
    texts.append(F.when(everything, _decoded(F.col(CORRUPT), encoding)).alias(CORRUPT))
    return rows.select(*texts, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))


def read_records(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """``file, record, raw``: the raw text of every record, line breaks in quotes included; the header is record 1.

    A line goes on with the record before it where the quotes up to it are odd in number.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = ordered(_lines(spark, path, encoding).withColumn("_q", quotes), ["file"], ["_block", "_in_split"]).running(_through=("sum", F.col("_q").cast("bigint")))
    lines = lines.with_column("_starts", ((F.col("_through") - F.col("_q")) % 2 == 0).cast("bigint")).running(record=("sum", "_starts")).done()
    alone = lines.where("_starts = 1 AND _through % 2 = 0").select("file", "record", F.col("value").alias("raw"))
    cut = lines.where("NOT (_starts = 1 AND _through % 2 = 0)").groupBy("file", "record")
    pieces = F.array_sort(F.collect_list(F.struct("_block", "_in_split", "value")))
    return alone.unionByName(cut.agg(F.array_join(F.transform(pieces, lambda x: x["value"]), "\n").alias("raw")))


def parse_records(records: DataFrame, headers: list[str]) -> DataFrame:
    """Text columns c0..cn of records under one header, with ``file, record, raw`` and ``reason`` (row_width)."""
    schema = ", ".join(f"c{i} string" for i in range(len(headers))) + f", {CORRUPT} string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "nullValue": "\u0001", "emptyValue": "", "maxCharsPerColumn": "-1", "escape": '"'}
    rows = records.withColumn("_r", F.from_csv("raw", schema, options))
    reason = F.when(F.col(f"_r.{CORRUPT}").isNotNull(), "row_width")
    return rows.select(*[F.col(f"_r.c{i}").alias(f"c{i}") for i in range(len(headers))], "file", "record", "raw", reason.alias("reason"))


def read_record_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", columns: dict[str, str] | None = None) -> DataFrame:
    """Line-keeping scan of labelled flow files: named text columns, ``file``, ``record``, ``raw`` and ``reason``."""
    parts = []
    for headers, files in read_headers(spark, path, encoding):
        rows = parse_records(read_records(spark, files, encoding).where("record > 1"), headers)
        parts.append(rows.select(*_named(resolve_columns(headers, columns, tolerate_unused=True)), "file", "record", "raw", "reason"))
    return _union(parts)


def known_label_reason(label: Column, known: list[str]) -> Column:
    """``unknown_label`` for a label that is not in the closed list, both in canonical form."""
    return F.when(~F.coalesce(canonical_label(label), F.lit("")).isin([k.replace("\u2013", "-") for k in known]), "unknown_label")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_record_numbers(rows: DataFrame) -> DataFrame:
    """Add ``record``: the line in its file, the header being line 1 (single-line records)."""
    placed = rows.withColumn("_in_split", F.monotonically_increasing_id())
    numbered = ordered(placed, ["file"], ["_block", "_in_split"]).running(_n=("sum", F.lit(1).cast("bigint"))).done()
    return numbered.withColumn("record", F.col("_n") + 1).drop("_n", "_in_split")


def _named(positions: dict[str, int]) -> list[Column]:
    names = dict(zip(FEATURES, FEATURE_COLUMNS))
    return [F.col(f"c{at}").alias(names.get(target, target)) for target, at in positions.items()]


def read_flow_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Strict scan: named text columns; running it fails on a row of another width."""
    message = F.concat(F.lit("number of fields differs from header: "), F.col("file"), F.lit(": "), F.col(CORRUPT))
    intact = F.when(F.col(CORRUPT).isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col("file"))
    return _union([rows.select(*_named(resolve_columns(headers, columns)), intact.alias("file")) for rows, headers in read_rows(spark, path)])


def read_export_csv(spark: SparkSession, path: str, encoding: str = "windows-1252") -> DataFrame:
    """Export scan: named text columns and ``reason`` (row_width) for quarantine."""
    kept = ["file", "_block", F.when(F.col(CORRUPT).isNotNull(), "row_width").alias("reason"), F.col(CORRUPT).alias("raw")]
    return _union([rows.select(*_named(resolve_columns(headers, tolerate_unused=True)), *kept) for rows, headers in read_rows(spark, path, encoding)])


def numeric_features(df: DataFrame) -> DataFrame:
    """Feature columns as doubles, NULL where the text is not a number."""
    return df.withColumns({c: F.trim(c).try_cast("double") for c in FEATURE_COLUMNS})


def read_feature_csv(spark: SparkSession, path: str) -> DataFrame:
    """Features and label only, numbers coerced, other columns pruned."""
    parts = []
    for headers, files in read_headers(spark, path):
        positions = resolve_columns(headers, identity=False, tolerate_unused=True)
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(headers))])
        rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(files)
        parts.append(rows.select(*_named(positions), F.col("_metadata.file_path").alias("file")))
    return numeric_features(_union(parts))


def feature_row_reason() -> Column:
    """Reject reason of a feature-only row: repeated header, or an unusable number."""
    bad = F.lit(False)
    for c in FEATURE_COLUMNS:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.col(c) == float("inf"))
    return F.when(norm_name(F.col("label")) == "label", "repeated_header").when(bad, "nonfinite_or_negative_feature")


def check_manifest(sources: list[dict], splits: list[str] | None = None) -> None:
    """Captures are unique and the required splits are exactly the ones present."""
    groups = [s.get("group") for s in sources]
    if not sources or len(set(groups)) != len(groups) or not all(isinstance(g, str) and g for g in groups):
        raise ValueError("every capture group must occur exactly once")
    if {s["split"] for s in sources} != set(splits or SPLITS):
        raise ValueError(f"capture groups for exactly these splits required: {splits or SPLITS}")
    for s in sources:
        if s.get("timestamp_kind", "end") not in ("start", "end"):
            raise ValueError("timestamp_kind must be start or end")


def read_manifest(spark: SparkSession, sources: list[dict], splits: list[str] | None = None) -> DataFrame:
    """All sources as one frame tagged with capture, split and the time rule of the source."""
    check_manifest(sources, splits)
    parts = []
    for s in sources:
        rows = read_flow_csv(spark, s["path"], s.get("columns"))
        tags = {
            "capture": s["group"], "split": s["split"], "timestamp_kind": s.get("timestamp_kind", "end"),
            "timestamp_format": s.get("timestamp_format"), "timezone": s.get("timezone", "UTC"),
        }
        parts.append(rows.withColumns({k: F.lit(x).cast("string") for k, x in tags.items()}))
    return _union(parts)


def write_quarantine(bad: DataFrame, path: str) -> None:
    bad.write.mode("errorifexists").json(path)


def write_prepared(df: DataFrame, path: str, max_rows: int = 100_000) -> None:
    """Time-sorted files of bounded size per split and capture; refuses to overwrite.

    Range partitioning on (split, capture, time) splits a large capture over many tasks.
    """
    if max_rows < 1:
        raise ValueError("positive shard size required")
    placed = df.repartitionByRange("split", "capture", "ts_us").sortWithinPartitions("split", "capture", "ts_us")
    placed.write.mode("errorifexists").option("maxRecordsPerFile", max_rows).partitionBy("split", "capture").parquet(path)


def prepared_digests(spark: SparkSession, path: str) -> DataFrame:
    """Digest of every data file, as (artifact, digest)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col("path").alias("artifact"), F.sha2("content", 256).alias("digest"))


def read_prepared(spark: SparkSession, path: str, split: str, schema: T.StructType, recorded: DataFrame | None = None) -> DataFrame:
    """Rows of one split by partition pruning; with ``recorded`` digests, files are verified first."""
    if recorded is not None:
        from flowspark.sources.artifacts import verify_digests

        assert_none(verify_digests(recorded, prepared_digests(spark, path)), "prepared file mismatch")
    return spark.read.schema(schema).parquet(path).where(F.col("split") == split)


def _spread(headers: list[str]) -> tuple[list[str], list[str]]:
    found: dict[str, list[str]] = {}
    for h in headers:
        found.setdefault(norm_text(h), []).append(h)
    wanted = dict(zip(FEATURES, ALIASES)) | IDENTITY_ALIASES
    missing = [t for t, names in wanted.items() if not any(norm_text(n) in found for n in names)]
    return missing, [same[0].strip() for same in found.values() if len(same) > 1]


def audit_inventory(spark: SparkSession, files: list[str], rows_per_file: int | None = None) -> DataFrame:
    """Per path and header in it: columns, missing and repeated headers, and error counts by kind.

    Reads every row; ``rows_per_file`` bounds the check to the first ones.
    """
    parts = []
    for path, (rows, headers) in [(p, group) for p in files for group in read_rows(spark, p)]:
        missing, repeated = _spread(headers)
        if rows_per_file is not None:
            rows = with_record_numbers(rows).where(F.col("record") <= rows_per_file + 1)
        names = [norm_text(h) for h in headers]

        def first(spellings: list[str]) -> Column | None:
            hits = [i for i, n in enumerate(names) if n in {norm_text(s) for s in spellings}]
            return F.col(f"c{hits[0]}") if hits else None

        whole = F.col(CORRUPT).isNull()
        numbers = [c for c in (first(a) for a in ALIASES) if c is not None]
        bad_number = sum(
            (F.coalesce((~(F.trim(c).try_cast("double") >= 0) | (F.trim(c).try_cast("double") == float("inf"))
                         | F.isnan(F.trim(c).try_cast("double"))), F.lit(True)).cast("bigint") for c in numbers), F.lit(0))
        ips = [c for c in (first(IDENTITY_ALIASES[k]) for k in ("src_ip", "dst_ip")) if c is not None]
        bad_ip = sum((canonical_ip(c).isNull().cast("bigint") for c in ips), F.lit(0))
        label = first(IDENTITY_ALIASES["label"])
        empty = (F.trim(label) == "") if label is not None else F.lit(False)
        parts.append(
            rows.agg(
                F.lit(path).alias("file"),
                F.lit(path.rstrip("/").rsplit("/", 2)[-2]).alias("folder"),
                F.lit(len(headers)).alias("columns"),
                F.lit(",".join(missing)).alias("missing"),
                F.lit(",".join(repeated)).alias("repeated"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(~whole).alias("wrong_column_count"),
                F.sum(F.when(whole, bad_number).otherwise(0)).alias("invalid_numeric"),
                F.sum(F.when(whole, bad_ip).otherwise(0)).alias("invalid_ip"),
                F.count_if(whole & empty).alias("empty_label"),
            )
        )
    return _union(parts)


def label_inventory(spark: SparkSession, files: list[str]) -> DataFrame:
    """Per path: rows of every label in canonical form; a path without a label column has none."""
    parts = []
    for path, (rows, headers) in [(p, group) for p in files for group in read_rows(spark, p)]:
        at = [i for i, h in enumerate(headers) if norm_text(h) in {norm_text(s) for s in IDENTITY_ALIASES["label"]}]
        label = canonical_label(F.col(f"c{at[0]}")) if at else F.lit(None).cast("string")
        parts.append(rows.where(F.col(CORRUPT).isNull()).select(F.lit(path).alias("file"), label.alias("label")))
    return _union(parts).where("label IS NOT NULL").groupBy("file", "label").agg(F.count(F.lit(1)).alias("rows"))
