"""Digests and write-once artifacts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators.ordered import ordered

#: The suffixes with the most bytes, whose files are read as streams, and what such a suffix looks like.
SUFFIXES, SUFFIX = 64, r"\.[A-Za-z0-9_-]+$"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def _hashed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each file from its lines, which come one after another.

    The reader drops a byte order mark, and does not tell whether the last line ends in a line feed; the
    file's size tells both.
    """
    path, size, read, hashes = None, 0, 0, ()

    def finished() -> pa.RecordBatch:
        missing = size - read
        if missing not in (0, 1, 3, 4):
            raise ValueError(f"{path} has {size} bytes, {read} were read")
        found = hashes[missing >= 3]
        found.update(b"\n" * (missing % 3))
        return pa.RecordBatch.from_pydict({"_file": [path], "digest": [found.hexdigest()]})

    for batch in batches:
        runs, at = pc.run_end_encode(batch.column("_file")), 0
        for file, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            lines = batch.column("value").slice(at, end - at).to_pylist()
            if file == path:
                lines.insert(0, b"")
            else:
                if path is not None:
                    yield finished()
                path, size, read = file, batch.column("_size")[at].as_py(), 0
                hashes = (hashlib.sha256(), hashlib.sha256(BYTE_ORDER_MARK))
            if batch.column("_part")[at].as_py() != size:
                raise ValueError(f"{file} was split")
            data = b"\n".join(lines)
            read += len(data)
            for known in hashes:
                known.update(data)
            at = end
    if path is not None:
        yield finished()


def _streamed_digests(spark: SparkSession, pattern: str, suffix: str) -> DataFrame:
    """``_file, digest`` of the matching files of a suffix: a task reads a file from its first line to its last.

    Hadoop's codec that passes bytes through takes the suffix, so its files are neither split nor decompressed.
    """
    # Hadoop's shaded client has its own name of the second option.
    options = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec"}
    options |= {f"{prefix}io.compress.passthrough.extension": suffix for prefix in ("", "org.apache.hadoop.shaded.")}
    lines = spark.read.options(lineSep="\n", pathGlobFilter=f"*{suffix}", **options).text(pattern)
    meta = {"_file": "file_path", "_size": "file_size", "_part": "file_block_length"}
    columns = [F.col("value").cast("binary").alias("value"), *[F.col(f"_metadata.{m}").alias(n) for n, m in meta.items()]]
    return lines.select(columns).mapInArrow(_hashed_lines, "_file string, digest string")


def file_fingerprints(spark: SparkSession, pattern: str) -> DataFrame:
    """SHA-256, size and modification time of every matching file that is not empty.

    Files are hashed as they are read, a batch of lines at a time; those without a suffix, or of the
    rarer of very many suffixes, are taken whole.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", "length", "modificationTime", F.col("_metadata.file_path").alias("_file"))
    named = files.withColumn("_suffix", F.regexp_extract("path", SUFFIX, 0))
    sizes = named.groupBy("_suffix").agg(F.sum("length").alias("_bytes")).orderBy(F.desc("_bytes"), "_suffix").limit(SUFFIXES + 1).collect()
    streamed = [r["_suffix"] for r in sizes if r["_suffix"]][:SUFFIXES]
    rest = named.where(~F.col("_suffix").isin(streamed)).select("path").collect()  # the session's own list of files has them, too
    parts = [_streamed_digests(spark, pattern, suffix) for suffix in streamed]
    if rest:
        whole = spark.read.format("binaryFile").load([re.sub(r"([\\{}\[\]*?])", r"\\\1", r["path"]) for r in rest])
        parts.append(whole.select(F.col("_metadata.file_path").alias("_file"), F.sha2("content", 256).alias("digest")))
    if not parts:
        return files.select("path", "length", "modificationTime", F.lit(None).cast("string").alias("digest"))
    # A file of a byte order mark alone has no line.
    bare = F.when(F.col("length") == 3, F.sha2(F.lit(BYTE_ORDER_MARK), 256))
    digest = F.coalesce("digest", bare, F.raise_error(F.concat(F.lit("no digest of "), "path")).cast("string"))
    return files.join(reduce(DataFrame.unionByName, parts), "_file", "left").select("path", "length", "modificationTime", digest.alias("digest"))


def duplicate_files(fingerprints: DataFrame) -> DataFrame:
    """Digests that more than one file carries."""
    return fingerprints.groupBy("digest").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("example")).where("files > 1")


def assert_no_duplicate_files(fingerprints: DataFrame) -> None:
    twice = duplicate_files(fingerprints).limit(1).collect()
    if twice:
        raise ValueError(f"identical source file included more than once: {twice[0].example}")


def verify_digests(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Artifacts whose recorded and recomputed digests disagree: changed, missing, unrecorded."""
    left = recorded.select("artifact", F.col("digest").alias("_recorded"))
    right = actual.select("artifact", F.col("digest").alias("_actual"))
    joined = left.join(right, "artifact", "full")
    problem = (
        F.when(F.col("_actual").isNull(), "missing")
        .when(F.col("_recorded").isNull(), "unrecorded")
        .when(F.col("_recorded") != F.col("_actual"), "changed")
    )
    return joined.select("artifact", problem.alias("problem")).where("problem IS NOT NULL")


IDENTITY = ["model_sha256", "protocol", "alpha"]


def save_calibration(
    spark: SparkSession,
    path: str,
    benign: DataFrame,
    model_sha256: str,
    protocol: str,
    alpha: float,
    captures: list[str],
    source_sha256: str,
    stages: DataFrame | None = None,
) -> None:
    """Write scores and identity once; refuses to replace an artifact.

    ``benign`` holds ``score``; ``stages`` holds ``y`` and ``probs``.
    """
    if not captures or not source_sha256:
        raise ValueError("capture identities and source digest are required")
    if len(model_sha256) != 64 or set(model_sha256) - set("0123456789abcdef"):
        raise ValueError("invalid model digest")
    if not protocol or not 0 < alpha < 1:
        raise ValueError("protocol and alpha in (0, 1) are required")
    classes = stages.select(F.max(F.size("probs"))).first()[0] if stages is not None else None
    benign.select("score").write.mode("errorifexists").parquet(f"{path}/benign")
    if stages is not None:
        stages.select("y", "probs").write.mode("errorifexists").parquet(f"{path}/stages")
    row = [(model_sha256, protocol, float(alpha), ",".join(captures), source_sha256, classes)]
    schema = "model_sha256 string, protocol string, alpha double, captures string, source_sha256 string, classes int"
    spark.createDataFrame(row, schema).write.mode("errorifexists").parquet(f"{path}/identity")


def load_calibration(spark: SparkSession, path: str, model_sha256: str, protocol: str, alpha: float, classes: int | None = None):
    """(benign, stages or None); any identity mismatch is an error."""
    identity = spark.read.parquet(f"{path}/identity").first()
    if (identity.model_sha256, identity.protocol, identity.alpha) != (model_sha256, protocol, float(alpha)):
        raise ValueError("calibration does not match model, protocol or alpha")
    if identity.classes is not None and identity.classes != classes:
        raise ValueError("calibration stage dimension does not match the model")
    benign = spark.read.schema("score double").parquet(f"{path}/benign")
    if identity.classes is None:
        return benign, None
    return benign, spark.read.schema("y int, probs array<double>").parquet(f"{path}/stages")


def calibration_diagnostics(stages: DataFrame) -> DataFrame:
    """In-sample support per class, and the confidence error of the top class."""
    from flowspark.functions.numeric import argmax
    from flowspark.operators.evaluate import ece

    support = stages.groupBy(F.col("y").alias("stage")).agg(F.count(F.lit(1)).alias("support"))
    top = stages.select((argmax(F.col("probs")) == F.col("y")).cast("int").alias("label"), F.array_max("probs").alias("p"))
    return support.crossJoin(F.broadcast(ece(top).select(F.col("ece").alias("confidence_ece"))))  # one row


WINDOW_STATE = T.StructType(
    [T.StructField("capture", T.StringType()), T.StructField("window", T.LongType()), T.StructField("state", T.ArrayType(T.DoubleType()))]
)


def write_window_states(states: DataFrame, path: str, drop_last: bool = True) -> None:
    """Write states per capture; the last window of a capture is still open and left out."""
    from flowspark.operators.forecast import state_errors
    from flowspark.operators.prepare import assert_none

    assert_none(state_errors(states), "unusable window states")
    rows = states
    if drop_last:
        last = states.groupBy("capture").agg(F.max("window").alias("_last"))
        rows = states.join(last, "capture").where(F.col("window") < F.col("_last")).drop("_last")
    rows.select("capture", "window", "state").write.mode("errorifexists").partitionBy("capture").parquet(path)


def read_window_states(spark: SparkSession, path: str, dims: int | None = None) -> DataFrame:
    """Window states; reading one of another dimension (than ``dims``, or than the first one read), a
    number that is not finite or a window twice in a capture is an error, whatever columns are taken."""
    rows = spark.read.schema(WINDOW_STATE).parquet(path)
    if dims is None:
        first = rows.select(F.size("state").alias("n")).first()
        dims = first.n if first else 0
    checked = ordered(rows, ["capture"], ["window"]).lag(_before="window").done()
    bad = (
        F.when(F.col("state").isNull() | (F.size("state") != dims), "dimension")
        .when(~F.forall("state", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), "nonfinite number")
        .when(F.col("window").isNull() | (F.col("window") <= F.col("_before")), "window order")
    )
    message = F.concat(F.lit("unusable window state: "), bad, F.lit(" in "), F.coalesce("capture", F.lit("no capture")))
    # A filter stays in the plan whatever columns a reader selects.
    return checked.where(F.when(bad.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True)).drop("_before")
