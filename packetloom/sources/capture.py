"""Packet sources and sinks: capture files, frame decoding, the packet table."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetloom.functions import net
from packetloom.functions.text import utf8_text
from packetloom.schema import FRAMES, PACKETS

FRAMES_PER_BATCH = 4096


def spread(df: DataFrame) -> DataFrame:
    """Spread a source with fewer splits than cores, for work that costs far more than the shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ---------------------------------------------------------------- capture files

# Leading bytes of capture files and what they say about byte order and clock units.
CAPTURE_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1),
    b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\x3c\x4d": (">", 1000),
}
FILE_HEADER, RECORD_HEADER = 24, 16


def split_records(content: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(number, microseconds, length on the wire, frame) of every whole record of a capture."""
    order, unit = CAPTURE_MAGIC.get(content[:4], (None, 1))
    if order is None:
        raise ValueError("not a capture file")
    header = struct.Struct(order + "IIII")
    at, number = FILE_HEADER, 0
    while at + RECORD_HEADER <= len(content):
        seconds, fraction, stored, wire = header.unpack_from(content, at)
        at += RECORD_HEADER
        if at + stored > len(content):
            return
        yield number, seconds * 1_000_000 + fraction // unit, wire, content[at : at + stored]
        at += stored
        number += 1


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            rows = []
            for number, us, wire, frame in split_records(content):
                rows.append((path, number, pd.Timestamp(us, unit="us", tz="UTC"), wire, frame))
                if len(rows) == FRAMES_PER_BATCH:
                    yield pd.DataFrame(rows, columns=FRAMES.fieldNames())
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=FRAMES.fieldNames())


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all capture files under ``path``, one file per task at a time and small batches out.

    A record's start is only known from the one before it, so a file is the unit of work; rotate
    captures well below the 2 GB a binary column can hold.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_records, FRAMES)


# ---------------------------------------------------------------- frame decoding

ETHERNET = 14


def _number(frame: Column, at: Column, size: int) -> Column:
    """Big-endian number of ``size`` bytes at a zero-based offset; NULL beyond the end."""
    piece = F.substring(frame, at + 1, F.lit(size))
    return F.when(F.length(piece) == size, F.conv(F.hex(piece), 16, 10).cast("long"))


def _address(frame: Column, at: Column) -> Column:
    parts = [_number(frame, at + i, 1).cast("string") for i in range(4)]
    whole = F.length(F.substring(frame, at + 1, F.lit(4))) == 4
    return F.when(whole, F.concat_ws(".", *parts))


def _hardware(frame: Column, at: Column) -> Column:
    pairs = F.lower(F.hex(F.substring(frame, at + 1, F.lit(6))))
    return F.rtrim(F.regexp_replace(pairs, "(..)", "$1:"), F.lit(":"))


def _address6(frame: Column, at: Column) -> Column:
    """IPv6 address in groups without leading zeros; the longest zero run is not shortened."""
    groups = [F.lower(F.hex(_number(frame, at + 2 * i, 2))) for i in range(8)]
    return F.concat_ws(":", *groups)


def _held(value: Column, use) -> Column:
    """``use(value)`` with the value held as an object: read from a row, a message would be copied at every look at it."""
    return F.transform(F.array(value), use)[0]


def _walk(message: Column, start: Column, step, ended) -> Column:
    """State after enough steps for anything in a message: a label takes two bytes at least, an answer's fixed part ten.

    A state that has ``ended``, which no step changes, is handed on as it is, so a long message costs what its names and answers cost.
    """
    steps = F.sequence(F.lit(1), (F.coalesce(F.length(message), F.lit(0)) / 2 + 3).cast("int"))
    return F.aggregate(steps, start, lambda s, i: F.when(ended(s), s).otherwise(step(s, i)))


def walk_name(message: Column, begin: Column) -> Column:
    """struct(name, after) of the domain name at a zero-based offset: labels joined by dots, pointers followed,
    and the offset behind the name. The walk ends with the message; a cut-off or circular name is NULL."""
    return _held(message, lambda m: _walked_name(m, begin))


def _walked_name(message: Column, begin: Column) -> Column:
    start = F.struct(
        begin.cast("int").alias("at"), F.lit(None).cast("int").alias("after"), F.lit(False).alias("done"), F.lit(False).alias("bad"), F.lit("").cast("binary").alias("name")
    )

    def step(state: Column, _i: Column) -> Column:
        at, code = state["at"], _number(message, state["at"], 1).cast("int")
        going = ~state["done"] & ~state["bad"]
        target = (_number(message, at, 2).cast("int")).bitwiseAND(0x3FFF)
        piece = F.substring(message, at + 2, code)
        is_label, is_pointer = code.between(1, 63), code >= 192
        wrong = code.isNull() | code.between(64, 191) | (is_label & (F.length(piece) < code)) | (is_pointer & target.isNull())
        longer = F.when(F.length(state["name"]) > 0, F.concat(state["name"], F.lit(".").cast("binary"), piece)).otherwise(piece)
        return F.struct(
            F.when(going & is_pointer, target).when(going & is_label, at + 1 + code).otherwise(at).alias("at"),
            F.coalesce(state["after"], F.when(going & is_pointer, at + 2).when(going & (code == 0), at + 1)).alias("after"),
            (state["done"] | (going & F.coalesce(code == 0, F.lit(False)))).alias("done"),
            (state["bad"] | (going & wrong)).alias("bad"),
            F.when(going & is_label & ~wrong, longer).otherwise(state["name"]).alias("name"),
        )

    def found(walked: Column) -> Column:
        good = walked["done"] & ~walked["bad"]
        return F.struct(F.when(good, utf8_text(walked["name"])).alias("name"), F.when(good, walked["after"]).alias("after"))

    return _held(_walk(message, start, step, lambda s: s["done"] | s["bad"]), found)


def decode_frames(frames: DataFrame, id_column: str = "frame_no") -> DataFrame:
    """Header columns of Ethernet frames: VLAN tag, ARP, IPv4, IPv6 addresses, TCP, UDP, ICMP, DNS query.

    All expressions are built in. Each layer is its own projection, so offsets are computed once.
    """
    frame = F.col("frame")

    def num(at: Column, size: int) -> Column:
        return _number(frame, at, size)

    df = frames.withColumn("__outer", num(F.lit(12), 2))
    df = df.withColumn("__l3", F.when(F.col("__outer") == 0x8100, ETHERNET + 4).otherwise(ETHERNET))
    df = df.withColumn("eth_type", num(F.col("__l3") - 2, 2).cast("int"))
    l3 = F.col("__l3")
    ipv4 = (F.col("eth_type") == 0x0800) & (F.shiftright(num(l3, 1), 4) == 4)
    df = df.withColumn("__ip", F.coalesce(ipv4, F.lit(False))).withColumn(
        "__arp", F.coalesce(F.col("eth_type") == 0x0806, F.lit(False))
    )
    df = df.withColumn("__ip6", F.coalesce(F.col("eth_type") == 0x86DD, F.lit(False)))
    is_ip, is_arp = F.col("__ip"), F.col("__arp")
    fragment = num(l3 + 6, 2)
    df = (
        df.withColumn("__ihl", F.when(is_ip, num(l3, 1).bitwiseAND(0x0F) * 4))
        .withColumn("ip_proto", F.when(is_ip, num(l3 + 9, 1)).cast("int"))
        .withColumn("ip_id", F.when(is_ip, num(l3 + 4, 2)).cast("int"))
        .withColumn("ip_len", F.when(is_ip, num(l3 + 2, 2)).cast("int"))
        .withColumn("ip_mf", F.when(is_ip, fragment.bitwiseAND(0x2000) != 0))
        .withColumn("ip_frag", F.when(is_ip, fragment.bitwiseAND(0x1FFF)).cast("int"))
        .withColumn("src_mac", _hardware(frame, F.lit(6)))
        .withColumn("dst_mac", _hardware(frame, F.lit(0)))
        .withColumn("arp_op", F.when(is_arp, num(l3 + 6, 2)).cast("int"))
        .withColumn("arp_hwsrc", F.when(is_arp, _hardware(frame, l3 + 8)))
        .withColumn("arp_psrc", F.when(is_arp, _address(frame, l3 + 14)))
        .withColumn("arp_pdst", F.when(is_arp, _address(frame, l3 + 24)))
    )
    first = F.col("ip_frag") == 0
    df = (
        df.withColumn("__l4", (l3 + F.col("__ihl")).cast("int"))
        .withColumn("ip_payload_len", F.greatest(F.col("ip_len") - F.col("__ihl"), F.lit(0)).cast("int"))
        .withColumn(
            "src_ip",
            F.when(is_ip, _address(frame, l3 + 12))
            .when(F.col("__ip6"), _address6(frame, l3 + 8))
            .when(is_arp, F.col("arp_psrc"))
            .otherwise(""),
        )
        .withColumn(
            "dst_ip",
            F.when(is_ip, _address(frame, l3 + 16))
            .when(F.col("__ip6"), _address6(frame, l3 + 24))
            .when(is_arp, F.col("arp_pdst"))
            .otherwise(""),
        )
        .withColumn("__tcp", F.coalesce(first & (F.col("ip_proto") == 6), F.lit(False)))
        .withColumn("__udp", F.coalesce(first & (F.col("ip_proto") == 17), F.lit(False)))
        .withColumn("__icmp", F.coalesce(first & (F.col("ip_proto") == 1), F.lit(False)))
    )
    l4 = F.col("__l4")
    tcp, udp, icmp = F.col("__tcp"), F.col("__udp"), F.col("__icmp")
    end = l3 + F.col("ip_len")
    df = (
        df.withColumn("src_port", F.when(tcp | udp, num(l4, 2)).cast("int"))
        .withColumn("dst_port", F.when(tcp | udp, num(l4 + 2, 2)).cast("int"))
        .withColumn("tcp_flags", F.when(tcp, num(l4 + 12, 2).bitwiseAND(0x1FF)).cast("int"))
        .withColumn("icmp_type", F.when(icmp, num(l4, 1)).cast("int"))
        .withColumn("icmp_code", F.when(icmp, num(l4 + 1, 1)).cast("int"))
        .withColumn(
            "__data",
            F.when(tcp, l4 + F.shiftright(num(l4 + 12, 1), 4) * 4).when(udp | icmp, l4 + 8).otherwise(l4).cast("int"),
        )
    )
    # Only the echo, timestamp and address-mask messages carry an identifier.
    with_id = F.col("icmp_type").isin(0, 8, 13, 14, 15, 16, 17, 18)
    df = df.withColumn("icmp_id", F.when(with_id, num(l4 + 4, 2)).cast("int")).withColumn(
        "payload",
        F.when(is_ip, F.substring(frame, F.col("__data") + 1, F.greatest(end - F.col("__data"), F.lit(0)).cast("int"))),
    )
    dns = (F.col("src_port") == 53) | (F.col("dst_port") == 53)
    message = F.when(udp & dns & (F.length("payload") >= 12), F.col("payload")).when(
        tcp & dns & (F.length("payload") >= 14), F.substring(F.col("payload"), F.lit(3), F.length("payload"))
    )
    df = df.withColumn("__dns", message)
    df = df.withColumn("dns_qr", F.shiftright(_number(F.col("__dns"), F.lit(2), 1), 7).cast("int"))
    df = df.withColumn("__question", F.when(F.col("__dns").isNotNull(), walk_name(F.col("__dns"), F.lit(12))))
    df = df.withColumn("dns_qname", F.col("__question.name"))
    answers = F.when(F.col("dns_qr") == 1, F.col("__question.after") + 4)  # type and class of the question lie between
    df = df.withColumn("dns_txt_sizes", F.when(F.col("__dns").isNotNull(), txt_sizes(F.col("__dns"), answers)))
    label = net.protocol_label(is_arp, tcp, udp, icmp, F.col("src_port"), F.col("dst_port"))
    df = df.withColumn("proto", label).withColumn("packet_id", F.col(id_column).cast("long"))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PACKETS])


def txt_sizes(message: Column, begin: Column) -> Column:
    """Data sizes of all TXT answers; ``begin`` is the offset of the first answer. Owner names may be plain or compressed."""
    sizes = _held(message, lambda m: _answer_sizes(m, begin))
    return F.when(begin.isNotNull(), sizes).otherwise(F.array().cast("array<int>"))


def _answer_sizes(message: Column, begin: Column) -> Column:
    state = F.struct(
        begin.cast("int").alias("at"), _number(message, F.lit(6), 2).cast("int").alias("left"), F.lit(True).alias("in_name"), F.array().cast("array<int>").alias("sizes")
    )

    def step(acc: Column, _i: Column) -> Column:
        at, code = acc["at"], _number(message, acc["at"], 1).cast("int")
        going = acc["left"] > 0
        naming, data = going & acc["in_name"], going & ~acc["in_name"]
        kind, size = _number(message, at, 2), _number(message, at + 8, 2).cast("int")
        stuck = (naming & (code.isNull() | code.between(64, 191))) | (data & size.isNull())
        named = naming & ((code == 0) | (code >= 192))
        return F.struct(
            F.when(naming & (code >= 192), at + 2).when(naming, at + 1 + code).when(data, at + 10 + size).otherwise(at).alias("at"),
            F.when(stuck, 0).when(data, acc["left"] - 1).otherwise(acc["left"]).alias("left"),
            F.when(naming, ~named).when(data, F.lit(True)).otherwise(acc["in_name"]).alias("in_name"),
            F.when(data & (kind == 16) & size.isNotNull(), F.concat(acc["sizes"], F.array(size))).otherwise(acc["sizes"]).alias("sizes"),
        )

    return _walk(message, state, step, lambda s: F.coalesce(s["left"] <= 0, F.lit(False)))["sizes"]


# ---------------------------------------------------------------- the packet table


def number_packets(frames: DataFrame) -> DataFrame:
    """Packet numbers in capture order over several files, from per-file counts."""
    from pyspark.sql import Window

    counts = frames.groupBy("path").agg(F.count("*").alias("n"), F.min("ts").alias("begin"))
    before = Window.orderBy("begin", "path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return frames.join(offsets, "path").withColumn("packet_id", F.col("offset") + F.col("frame_no") + 1).drop("offset")


def read_packets(spark: SparkSession, path: str, *, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(PACKETS).parquet(path)


def write_packets(packets: DataFrame, path: str, mode: str = "append") -> None:
    """Packet table partitioned by day."""
    packets.withColumn("date", F.to_date("ts")).write.mode(mode).partitionBy("date").parquet(path)


def layer_tree(packets: DataFrame) -> Column:
    """array<struct<name, fields>> of the layers present, from the decoded columns."""

    def layer(name: str, present: Column, fields: dict[str, str]) -> Column:
        pairs = F.array(
            *[
                F.struct(F.lit(key).alias("key"), F.substring(F.coalesce(F.col(c).cast("string"), F.lit("None")), 1, 200).alias("value"))
                for key, c in fields.items()
                if c in packets.columns
            ]
        )
        return F.when(present, F.struct(F.lit(name).alias("name"), pairs.alias("fields")))

    has = [c for c in packets.columns]
    ether = F.col("eth_type").isNotNull() if "eth_type" in has else F.lit(False)
    return F.array_compact(
        F.array(
            layer("Ethernet", ether, {"dst": "dst_mac", "src": "src_mac", "type": "eth_type"}),
            layer(
                "ARP",
                F.col("arp_op").isNotNull(),
                {"op": "arp_op", "hwsrc": "arp_hwsrc", "psrc": "arp_psrc", "pdst": "arp_pdst"},
            ),
            layer(
                "IP",
                net.is_ip(),
                {"len": "ip_len", "id": "ip_id", "frag": "ip_frag", "proto": "ip_proto", "src": "src_ip", "dst": "dst_ip"},
            ),
            layer("TCP", net.is_tcp(), {"sport": "src_port", "dport": "dst_port", "flags": "tcp_flags"}),
            layer("UDP", net.is_udp(), {"sport": "src_port", "dport": "dst_port"}),
            layer("ICMP", net.is_icmp(), {"type": "icmp_type", "code": "icmp_code", "id": "icmp_id"}),
        )
    )
