"""Declared table schemas. Nothing in the package infers a schema from data."""

from pyspark.sql import types as T

PACKETS = T.StructType(
    [
        T.StructField("packet_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("proto", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("src_mac", T.StringType()),
        T.StructField("dst_mac", T.StringType()),
        T.StructField("eth_type", T.IntegerType()),
        T.StructField("ip_proto", T.IntegerType()),
        T.StructField("ip_id", T.IntegerType()),
        T.StructField("ip_len", T.IntegerType()),
        T.StructField("ip_mf", T.BooleanType()),
        T.StructField("ip_frag", T.IntegerType()),
        T.StructField("ip_payload_len", T.IntegerType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("icmp_type", T.IntegerType()),
        T.StructField("icmp_code", T.IntegerType()),
        T.StructField("icmp_id", T.IntegerType()),
        T.StructField("arp_op", T.IntegerType()),
        T.StructField("arp_psrc", T.StringType()),
        T.StructField("arp_pdst", T.StringType()),
        T.StructField("arp_hwsrc", T.StringType()),
        T.StructField("dns_qr", T.IntegerType()),
        T.StructField("dns_qname", T.StringType()),
        T.StructField("dns_txt_sizes", T.ArrayType(T.IntegerType())),
        T.StructField("payload", T.BinaryType()),
        T.StructField("frame", T.BinaryType()),
    ]
)

FRAMES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("frame_no", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("frame", T.BinaryType()),
    ]
)

ALERTS = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("detector", T.StringType()),
        T.StructField("sid", T.IntegerType()),
        T.StructField("threat", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("proto", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("info", T.StringType()),
        T.StructField("packet_id", T.LongType()),
    ]
)

ALERT_COLUMNS = ALERTS.fieldNames()
