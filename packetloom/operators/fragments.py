"""IP fragmentation attacks: per-packet checks, fragment rate, and reassembly per datagram."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from packetloom.functions.timecols import from_micros, is_ntz, micros, to_us
from packetloom.operators.alerts import as_alerts, union_all
from packetloom.operators.chains import cooldown
from packetloom.operators.programs import Reassembly
from packetloom.operators.scan import fold_or_scan, let
from packetloom.operators.sliding import sliding_count


@dataclass(frozen=True)
class FragmentLimits:
    tiny: int
    per_second: int
    per_packet: int
    timeout: float


# Limits per sensitivity, suppression seconds, sids.
FRAGMENT_LIMITS = {
    "strict": FragmentLimits(100, 50, 20, 10.0),
    "moderate": FragmentLimits(64, 100, 50, 30.0),
    "loose": FragmentLimits(32, 200, 100, 60.0),
}
FRAGMENT_COOLDOWN = 30.0
REASSEMBLY_SIDS = {"overlap": 1000080, "oversized": 1000081, "excessive": 1000085, "timeout": 1000086, "duplicate": 1000088}

FRAGMENT_OUT = T.StructType(
    [
        T.StructField("us", T.LongType()),
        T.StructField("packet_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("value", T.LongType()),
    ]
)
_KEPT = ["packet_id", "ts", "src", "dst"]


def ip_fragments(packets: DataFrame) -> DataFrame:
    mf, offset = F.coalesce("ip_mf", F.lit(False)), F.coalesce("ip_frag", F.lit(0))
    return packets.where(F.col("ip_proto").isNotNull() & (mf | (offset > 0))).select(
        "packet_id",
        "ts",
        F.col("src_ip").alias("src"),
        F.col("dst_ip").alias("dst"),
        "ip_id",
        (offset * 8).cast("long").alias("start"),
        F.coalesce("ip_payload_len", F.lit(0)).cast("long").alias("size"),
        mf.alias("more"),
    )


_STATE = "struct<first:bigint,first_id:bigint,held:array<struct<a:bigint,b:bigint>>,starts:array<bigint>,n:bigint,total:bigint>"
_EVENTS = "array<struct<us:bigint,packet_id:bigint,kind:string,value:bigint>>"


def _event(us: Column, packet_id: Column, kind: str, value: Column) -> Column:
    return F.struct(us.alias("us"), packet_id.alias("packet_id"), F.lit(kind).alias("kind"), value.cast("bigint").alias("value"))


def _folded(fragments: Column, limits: FragmentLimits, largest: int = 65535) -> Column:
    """Events of one datagram id from its fragments (us, packet_id, start, size, more) in order: the steps of ``Reassembly``."""
    none = F.lit(None).cast("bigint")
    fresh = F.struct(none.alias("first"), none.alias("first_id"), F.array().alias("held"), F.array().alias("starts"), F.lit(0).alias("n"), F.lit(0).alias("total")).cast(_STATE)
    wait, zero = F.lit(to_us(limits.timeout)), F.lit(0)

    def expiry(s: Column) -> Column:
        return F.array(_event(s["first"] + wait, s["first_id"], "timeout", zero))

    def events(*cases: tuple[Column, Column]) -> Column:
        return F.flatten(F.array(*[F.when(F.coalesce(test, F.lit(False)), found).otherwise(F.array().cast(_EVENTS)) for test, found in cases]))

    def step(acc: Column, f: Column) -> Column:
        end = f["start"] + f["size"]

        def known(x: Column) -> Column:  # x: was the entry too old, and the state to go on from
            s = x["s"]
            clash = F.exists(s["held"], lambda h: (f["start"] < h["b"]) & (end > h["a"]))

            def decided(y: Column) -> Column:
                clash, again, n, total = y["clash"], y["again"], y["n"], y["total"]
                out = events(
                    (x["old"], expiry(acc["state"])),
                    (clash, F.array(_event(f["us"], f["packet_id"], "overlap", zero))),
                    (~clash & again, F.array(_event(f["us"], f["packet_id"], "duplicate", zero))),
                    (~clash & (n > limits.per_packet), F.array(_event(f["us"], f["packet_id"], "excessive", n))),
                    (~clash & (total > largest), F.array(_event(f["us"], f["packet_id"], "oversized", total))),
                )
                state = F.struct(
                    F.coalesce(s["first"], f["us"]).alias("first"),
                    F.when(s["first"].isNull(), f["packet_id"]).otherwise(s["first_id"]).alias("first_id"),
                    F.concat(s["held"], F.array(F.struct(f["start"].alias("a"), end.alias("b")))).alias("held"),
                    F.when(clash | again, s["starts"]).otherwise(F.concat(s["starts"], F.array(f["start"]))).alias("starts"),
                    n.alias("n"),
                    total.alias("total"),
                ).cast(_STATE)
                after = F.when(~clash & ~f["more"], fresh).otherwise(state)
                return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

            facts = F.struct(clash.alias("clash"), F.array_contains(s["starts"], f["start"]).alias("again"), (s["n"] + 1).alias("n"), (s["total"] + f["size"]).alias("total"))
            return let(facts, decided)

        old = F.coalesce(f["us"] - acc["state"]["first"] > wait, F.lit(False))
        return let(F.struct(old.alias("old"), F.when(old, fresh).otherwise(acc["state"]).alias("s")), known)

    begin = F.struct(fresh.alias("state"), F.array().cast(_EVENTS).alias("out"))
    last = lambda acc: F.concat(acc["out"], events((acc["state"]["first"].isNotNull(), expiry(acc["state"]))))
    return F.aggregate(fragments, begin, step, last)


def _batched(limits: FragmentLimits, largest: int = 65535):
    """``_folded`` for the datagrams of an Arrow batch at once: their first fragments, then their second ones, and so on."""
    wait, most = to_us(limits.timeout), limits.per_packet

    def run(bounds, columns):
        known = columns["us"].is_valid().to_numpy(zero_copy_only=False)
        us = columns["us"].fill_null(0).to_numpy(zero_copy_only=False)
        ids = columns["packet_id"].to_numpy(zero_copy_only=False)
        start, size = (columns[c].to_numpy(zero_copy_only=False) for c in ("start", "size"))
        end, more = start + size, columns["more"].to_numpy(zero_copy_only=False)
        before = np.concatenate(([0], np.cumsum(size)))
        counted = np.zeros(len(us), dtype=bool)  # fragments whose offset is on the datagram's list
        begin = np.full(len(bounds) - 1, -1)  # the fragment that an open datagram began with
        first = begin.copy()  # its first fragment with a time
        lengths = np.diff(bounds)
        found = []  # (key, time, whether it has one, packet, kind, value)

        def late(keys):
            of = first[keys]
            found.append((keys, us[of] + wait, known[of], ids[of], "timeout", np.zeros(len(keys), dtype=np.int64)))

        def seen(kind, test, value=None):
            at = rows[test]
            found.append((keys[test], us[at], known[at], ids[at], kind, np.zeros(len(at), dtype=np.int64) if value is None else value[test]))

        for place in range(int(lengths.max(initial=0))):
            keys = np.flatnonzero(lengths > place)
            rows = bounds[keys] + place
            old = (first[keys] >= 0) & known[rows] & (us[rows] - us[first[keys]] > wait)
            late(keys[old])
            begin[keys[old]] = first[keys[old]] = -1
            begin[keys] = np.where(begin[keys] < 0, rows, begin[keys])
            first[keys] = np.where((first[keys] < 0) & known[rows], rows, first[keys])
            n = rows - begin[keys] + 1
            clash, again = np.zeros(len(rows), dtype=bool), np.zeros(len(rows), dtype=bool)
            for back in range(1, int(n.max())):
                here = np.flatnonzero(n > back)
                row, earlier = rows[here], rows[here] - back
                clash[here] |= (start[row] < end[earlier]) & (end[row] > start[earlier])
                again[here] |= counted[earlier] & (start[row] == start[earlier])
            total = before[rows + 1] - before[begin[keys]]
            counted[rows] = ~clash
            seen("overlap", clash)
            seen("duplicate", ~clash & again)
            seen("excessive", ~clash & (n > most), n)
            seen("oversized", ~clash & (total > largest), total)
            closed = keys[~clash & ~more[rows]]
            begin[closed] = first[closed] = -1
        late(np.flatnonzero(first >= 0))
        of, at, timed, packet, value = (np.concatenate([f[i] for f in found]) for i in (0, 1, 2, 3, 5))
        kinds = pa.array(np.repeat([f[4] for f in found], [len(f[0]) for f in found]), pa.string())
        out = [pa.array(at, pa.int64(), mask=~timed), pa.array(packet, pa.int64()), kinds, pa.array(value, pa.int64())]
        return of, pa.RecordBatch.from_arrays(out, names=FRAGMENT_OUT.fieldNames())

    return run


def reassembly_events(packets: DataFrame, limits: FragmentLimits, **options) -> DataFrame:
    """Overlaps, repeats, counts, sizes and incomplete datagrams. A datagram that is still open counts
    as incomplete only when the capture goes on past its time limit.

    Ids with few fragments between one pair of hosts are folded many at a time; the others go to the state machine, whose keys are cut
    into segments.
    """
    fragments = ip_fragments(packets)
    timed = fragments.withColumn("us", micros(fragments, "ts"))
    program, keys = Reassembly(limits.timeout, limits.per_packet), ["src", "dst", "ip_id"]
    events = fold_or_scan(timed, keys, ["us", "packet_id"], program, FRAGMENT_OUT, batched=_batched(limits), **options)
    end = packets.where("ip_proto is not null").agg(F.max(micros(packets, "ts")).alias("end_us"))
    events = events.crossJoin(F.broadcast(end)).where((F.col("kind") != "timeout") | (F.col("us") < F.col("end_us")))
    return events.drop("end_us").withColumn("ts", from_micros("us", is_ntz(packets, "ts"))).drop("us")


def fragment_hits(packets: DataFrame, limits: FragmentLimits, **options) -> DataFrame:
    """All detections before suppression."""
    return _detections(packets, limits, **options).select(*_KEPT, "sid", _info().alias("info"))


def _info() -> Column:
    """Message of a detection from its sid, number and datagram id."""
    sid, value, ip_id = F.col("sid"), F.col("value"), F.col("ip_id")
    of = REASSEMBLY_SIDS
    return (
        F.when(sid == 1000087, F.lit("Fragmentation: Zero-length fragment detected"))
        .when(sid == 1000083, F.format_string("Fragmentation: Tiny fragment detected (%d bytes)", value))
        .when(sid == 1000084, F.format_string("Fragmentation: Invalid fragment offset (%d)", value))
        .when(sid == 1000082, F.format_string("Fragmentation: Fragment flood detected (%d frags/sec)", value))
        .when(sid == of["overlap"], F.format_string("Fragmentation: Overlapping fragments detected (Teardrop attack, ID:%d)", ip_id))
        .when(sid == of["duplicate"], F.format_string("Fragmentation: Duplicate fragment offset detected (ID:%d)", ip_id))
        .when(sid == of["excessive"], F.format_string("Fragmentation: Excessive fragments (%d) for single packet", value))
        .when(sid == of["oversized"], F.format_string("Fragmentation: Ping of Death detected (%d bytes)", value))
        .otherwise(F.format_string("Fragmentation: Incomplete reassembly timeout (ID:%d)", ip_id))
    )


def _detections(packets: DataFrame, limits: FragmentLimits, **options) -> DataFrame:
    """Detections with the numbers of their messages, which are written later. Fragments, a small part of the packets, are read once
    and kept for all of them."""
    fragments = ip_fragments(packets).persist(StorageLevel.MEMORY_AND_DISK)

    def entry(sid: int, test, value):
        return F.when(test, F.struct(F.lit(sid).alias("sid"), value.alias("value")))

    size, start = F.col("size"), F.col("start")
    checks = F.array(
        entry(1000087, (size == 0) & F.col("more"), size),
        entry(1000083, (size > 0) & (size < limits.tiny), size),
        entry(1000084, start > 65535, start),
    )
    singles = fragments.select(*_KEPT, "ip_id", F.explode_outer(F.array_compact(checks)).alias("hit")).where("hit is not null")
    singles = singles.select(*_KEPT, "hit.sid", "ip_id", "hit.value")

    paced = sliding_count(fragments.select("packet_id", "ts", "src"), ["src"], 1.0)
    flood = paced.where(F.col("n") > limits.per_second).select(
        "packet_id",
        "ts",
        "src",
        F.lit("multiple").alias("dst"),
        F.lit(1000082).alias("sid"),
        F.lit(None).cast(fragments.schema["ip_id"].dataType).alias("ip_id"),
        F.col("n").cast("long").alias("value"),
    )

    events = reassembly_events(packets, limits, **options)
    sid = F.element_at(F.create_map(*[F.lit(x) for kv in REASSEMBLY_SIDS.items() for x in kv]), F.col("kind"))
    grouped = events.select(*_KEPT, sid.alias("sid"), "ip_id", "value")
    return union_all([singles, flood, grouped])


def detect_fragmentation(
    packets: DataFrame, sensitivity: str = "moderate", limits: FragmentLimits | None = None, **options
) -> DataFrame:
    found = _detections(packets, limits or FRAGMENT_LIMITS[sensitivity], **options)
    kept = cooldown(found, ["src", "sid"], FRAGMENT_COOLDOWN, strict=True)
    return as_alerts(kept, "FragmentationDetector", F.col("sid"), _info(), F.col("src"), F.col("dst"))
