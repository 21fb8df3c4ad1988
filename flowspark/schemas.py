"""Fixed schemas; nothing is ever inferred from input files."""

from pyspark.sql import types as T

# The sixteen flow features, in vector order.
FEATURES = [
    "Flow Duration",
    "Total Fwd Packet",
    "Total Bwd packets",
    "Total Length of Fwd Packet",
    "Total Length of Bwd Packet",
    "Fwd Packet Length Mean",
    "Bwd Packet Length Mean",
    "Flow Bytes/s",
    "Flow Packets/s",
    "Flow IAT Mean",
    "Fwd IAT Mean",
    "Bwd IAT Mean",
    "Fwd Packets/s",
    "Bwd Packets/s",
    "Average Packet Size",
    "Down/Up Ratio",
]

# The same features as Spark column names.
FEATURE_COLUMNS = [
    "duration_us",
    "fwd_packets",
    "bwd_packets",
    "fwd_bytes",
    "bwd_bytes",
    "fwd_len_mean",
    "bwd_len_mean",
    "bytes_per_s",
    "packets_per_s",
    "iat_mean_us",
    "fwd_iat_mean_us",
    "bwd_iat_mean_us",
    "fwd_packets_per_s",
    "bwd_packets_per_s",
    "avg_packet_size",
    "down_up_ratio",
]

# Attack stages by class index, and the dataset splits.
STAGES = [
    "benign",
    "reconnaissance",
    "initial_access",
    "credential_access",
    "lateral_movement",
    "command_and_control",
    "exfiltration",
    "impact",
]
SPLITS = ["train", "validation", "calibration", "test"]

PACKET = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("tcp_window", T.IntegerType()),
        T.StructField("ttl", T.IntegerType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

CAPTURED_PACKET = T.StructType(
    [T.StructField("file", T.StringType())]
    + PACKET.fields
    + [T.StructField("raw_frame", T.BinaryType()), T.StructField("linktype", T.IntegerType())]
)

SEQUENCE = T.StructType(
    [
        T.StructField(
            "flows",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("src_ip", T.StringType()),
                        T.StructField("dst_ip", T.StringType()),
                        T.StructField("timestamp", T.DoubleType()),
                        T.StructField("features", T.ArrayType(T.DoubleType())),
                    ]
                )
            ),
        )
    ]
)

LEDGER_BLOCK = T.StructType(
    [
        T.StructField("block_index", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("prev_block_hash", T.StringType()),
        T.StructField("merkle_root", T.StringType()),
        T.StructField("leaf_count", T.LongType()),
        T.StructField("leaf_hashes", T.ArrayType(T.StringType())),
        T.StructField("block_hash", T.StringType()),
    ]
)
