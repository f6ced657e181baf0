"""Established-connection lookup: what the TCP handshake state says about a packet's flow.

A directed flow is established by a SYN/ACK of its peer, by the ACK completing a handshake (both
directions) or by its own ACK carrying data or PSH, and stays so for ``ttl`` seconds. RST and FIN
clear both directions.

A connection that carries a large share of the traffic is split into time slices. What an entry may
be remembered for, ``ttl`` seconds, is copied over between slices. A handshake has no such bound, since
repeated SYN and SYN/ACK packets keep it open; it is followed by a state machine over the few packets
that can change it, which hands its state on from one stretch of time to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from packetloom.functions.net import ACK, FIN, PSH, RST, SYN, has_flag
from packetloom.functions.timecols import to_us
from packetloom.operators.programs import Handshake
from packetloom.operators.scan import fold_or_scan, let
from packetloom.operators.sliding import _clean, slice_with_lookback

# Fixed values, in seconds: lifetimes of a pending handshake, of a completed one, of an entry.
HANDSHAKE_TTL = 180.0
COMPLETED_TTL = 600.0
ENTRY_TTL = 120.0

_STEPS = ["__a", "__b", "__fwd", "__syn", "__synack", "__ack", "__hs", "__done", "__mark_fwd", "__mark_rev", "__before", "__after"]

_DONE = T.StructType([T.StructField("done_us", T.LongType()), T.StructField("done_id", T.LongType())])


def _completed(steps: Column) -> Column:
    """Where a handshake completes among its steps (us, packet_id, kind) in order: what ``Handshake`` does."""
    pending, completed = F.lit(to_us(HANDSHAKE_TTL)), F.lit(to_us(COMPLETED_TTL))
    kind = "struct<last:bigint,answered:boolean,done:boolean>"
    fresh = F.struct(F.lit(None).alias("last"), F.lit(False).alias("answered"), F.lit(False).alias("done")).cast(kind)
    found = "array<struct<done_us:bigint,done_id:bigint>>"

    def step(acc: Column, row: Column) -> Column:
        def known(s: Column) -> Column:
            syn, synack = row["kind"] == "S", (row["kind"] == "A") & s["last"].isNotNull()
            ends = (row["kind"] == "K") & s["last"].isNotNull() & s["answered"] & ~s["done"]
            state = F.struct(
                F.when(syn | synack | ends, row["us"]).otherwise(s["last"]).alias("last"),
                (s["answered"] | synack).alias("answered"),
                (s["done"] | ends).alias("done"),
            ).cast(kind)
            at = F.array(F.struct(row["us"].alias("done_us"), row["packet_id"].alias("done_id")))
            return F.struct(state.alias("state"), F.when(ends, F.concat(acc["out"], at)).otherwise(acc["out"]).alias("out"))

        s = acc["state"]
        old = F.coalesce(row["us"] - s["last"] > F.when(s["done"], completed).otherwise(pending), F.lit(False))
        return let(F.when(old, fresh).otherwise(s), known)

    return F.aggregate(steps, F.struct(fresh.alias("state"), F.array().cast(found).alias("out")), step, lambda acc: acc["out"])


def _handshake_steps(rows: DataFrame, tie: str) -> DataFrame:
    """The packets that can change a handshake: SYN, SYN/ACK, and ACKs that may be the first after a SYN/ACK.

    Within a slice these are the ACKs right after a SYN/ACK; the first ACK of a slice may be one as well. An
    ACK after another one changes nothing, so the others are not needed.
    """
    of_slice = Window.partitionBy("__a", "__b", "__slice", "__hs").orderBy("__us", tie).rowsBetween(Window.unboundedPreceding, -1)
    prior = F.last(F.when(F.col("__synack"), "A").when(F.col("__ack"), "K"), ignorenulls=True).over(of_slice)
    kept = F.col("__syn") | F.col("__synack") | (F.coalesce(prior, F.lit("A")) == "A")
    kind = F.when(F.col("__synack"), "A").when(F.col("__syn"), "S").otherwise("K")
    steps = rows.where(F.col("__own") & (F.col("__syn") | F.col("__synack") | F.col("__ack"))).withColumn("__prior", kept)
    return steps.where("__prior").select("__a", "__b", "__hs", F.col("__us").alias("us"), F.col(tie).alias("packet_id"), kind.alias("kind"))


def with_flow_state(
    tcp_packets: DataFrame,
    *,
    ttl: float = ENTRY_TTL,
    ts: str = "ts",
    tie: str = "packet_id",
    slice_seconds: float = 3600.0,
) -> DataFrame:
    """Add ``handshake_done``, ``established_before`` and ``established_after`` to TCP packets.

    ``before`` is the state the packet meets, ``after`` includes its own effect. A handshake is a
    SYN, a SYN/ACK and the first ACK after it with no pause above 180 s. It counts once: after that, SYN and SYN/ACK
    packets at most 600 s apart belong to it. The result does not depend on ``slice_seconds``.
    """
    flags = F.col("tcp_flags")
    here, there = F.concat_ws("|", "src_ip", "src_port"), F.concat_ws("|", "dst_ip", "dst_port")
    has_syn, has_ack = has_flag(flags, SYN), has_flag(flags, ACK)
    df = slice_with_lookback(tcp_packets, ttl, ts, slice_seconds)
    df = (
        df.withColumn("__a", F.least(here, there))
        .withColumn("__b", F.greatest(here, there))
        .withColumn("__fwd", here <= there)
        .withColumn("__syn", has_syn & ~has_ack)
        .withColumn("__synack", has_syn & has_ack)
        .withColumn("__ack", has_ack & ~has_syn)
        .repartition("__a", "__b", "__slice")
    )
    # Handshakes are followed per client direction; the server's SYN/ACK belongs to the reverse one.
    df = df.withColumn("__hs", F.when(F.col("__synack") & (F.col("__a") != F.col("__b")), ~F.col("__fwd")).otherwise(F.col("__fwd")))
    conn = ["__a", "__b", "__slice"]
    us = F.col("__us")
    program = Handshake(HANDSHAKE_TTL, COMPLETED_TTL)
    done = fold_or_scan(_handshake_steps(df, tie), ["__a", "__b", "__hs"], ["us", "packet_id"], program, _DONE, _completed)
    # A marker right before the packet that completes a handshake, in every slice that sees the packet.
    marks = slice_with_lookback(done.withColumn("__at", F.timestamp_micros("done_us")), ttl, "__at", slice_seconds)
    marks = marks.select("__a", "__b", "__slice", "__us", F.col("done_id").alias(tie), F.lit(True).alias("__done"))
    df = df.withColumn("__done", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    at_packet = Window.partitionBy(*conn).orderBy("__us", tie, F.desc("__done"))
    same = F.lag("__done").over(at_packet) & (F.lag("__us").over(at_packet) == us) & (F.lag(tie).over(at_packet) == F.col(tie))
    df = df.withColumn("handshake_done", F.coalesce(same, F.lit(False))).where(~F.col("__done"))

    size = F.coalesce(F.octet_length("payload"), F.lit(0)) if "payload" in df.columns else F.lit(0)
    data = F.col("__ack") & (has_flag(flags, PSH) | (size > 0))
    loop = F.col("__a") == F.col("__b")

    def mark(forward: bool):
        own = F.col("__fwd") if forward else ~F.col("__fwd")
        sets = F.col("handshake_done") | (F.col("__synack") & (~own | loop)) | (data & own)
        return F.when(
            has_flag(flags, RST) | has_flag(flags, FIN), F.struct(F.lit(False).alias("on"), us.alias("at"))
        ).when(sets, F.struct(F.lit(True).alias("on"), us.alias("at")))

    df = df.withColumn("__mark_fwd", mark(True)).withColumn("__mark_rev", mark(False))
    by_conn = Window.partitionBy(*conn).orderBy("__us", tie)

    def state(upto: int):
        frame = by_conn.rowsBetween(Window.unboundedPreceding, upto)
        return F.when(F.col("__fwd"), F.last("__mark_fwd", ignorenulls=True).over(frame)).otherwise(
            F.last("__mark_rev", ignorenulls=True).over(frame)
        )

    df = df.withColumn("__before", state(-1)).withColumn("__after", state(0))
    for name in ("before", "after"):
        entry = F.col(f"__{name}")
        alive = entry["on"] & (us - entry["at"] <= to_us(ttl))
        df = df.withColumn(f"established_{name}", F.coalesce(alive, F.lit(False)))
    return _clean(df.where("__own").drop(*_STEPS))


def completed_handshakes(tcp_packets: DataFrame, **options) -> DataFrame:
    """The ACKs that complete a three-way handshake."""
    return with_flow_state(tcp_packets, **options).where("handshake_done")
