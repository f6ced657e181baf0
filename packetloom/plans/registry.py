"""Detectors as plug-ins: registration, selection, isolation of failures, one common feed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from packetloom.functions.timecols import micros
from packetloom.operators import arp, bruteforce, dns, dos, fragments, patterns, synscan
from packetloom.operators.alerts import DETECTORS, union_all
from packetloom.operators.durable import checkpointed
from packetloom.operators.numbering import numbered
from packetloom.schema import ALERT_COLUMNS, ALERTS

Detect = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Detector:
    id: str
    name: str
    description: str
    severity: str
    enabled: bool
    run: Detect


_RUN: dict[str, Detect] = {
    "ArpSpoofDetector": arp.detect_arp,
    "BruteForceDetector": bruteforce.detect_brute_force,
    "DNSTunnelDetector": dns.detect_dns_tunnel,
    "DosDetector": dos.detect_dos,
    "FragmentationDetector": fragments.detect_fragmentation,
    "RCEDetector": patterns.detect_rce,
    "SQLiDetector": patterns.detect_sqli,
    "SynScanDetector": synscan.detect_syn_scan,
    "XSSDetector": patterns.detect_xss,
}


def _alert_schema(packets: DataFrame) -> T.StructType:
    """The alert table with the packets' kind of time."""
    return T.StructType([T.StructField(f.name, packets.schema["ts"].dataType if f.name == "ts" else f.dataType) for f in ALERTS])


class Registry:
    """Known detectors; all built-in ones start disabled."""

    def __init__(self) -> None:
        self._known = {d[0]: Detector(*d, _RUN[d[0]]) for d in DETECTORS}

    def register(
        self, id: str, run: Detect, *, name: str | None = None, severity: str = "HIGH", description: str | None = None, enabled: bool = True
    ) -> None:
        """Add a detector: a function from packets to rows of the alert table."""
        text = (description or (run.__doc__ or "").strip().split("\n")[0]) or "Dynamic security detector."
        self._known[id] = Detector(id, name or id, text, severity, enabled, run)

    def toggle(self, id: str, enabled: bool) -> bool:
        """Switch a detector; False when it is unknown."""
        if id not in self._known:
            return False
        self._known[id] = replace(self._known[id], enabled=enabled)
        return True

    def enabled(self) -> list[str]:
        return [d.id for d in self._known.values() if d.enabled]

    def metadata(self, spark: SparkSession) -> DataFrame:
        rows = [(d.id, d.name, d.description, d.severity, d.enabled) for d in self._known.values()]
        return spark.createDataFrame(rows, "id string, name string, description string, severity string, enabled boolean")

    def run(self, packets: DataFrame, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(alerts, errors) of the chosen detectors, enabled ones by default.

        Every detector is planned on its own: one that cannot be planned against these packets
        becomes an error row and the others go on. One that fails while running fails the union; run it alone (``only``).
        """
        spark = packets.sparkSession
        alerts, errors = [], []
        for id in only if only is not None else self.enabled():
            try:
                alerts.append(self._known[id].run(packets).select(*ALERT_COLUMNS))
            except Exception as error:
                errors.append((id, type(error).__name__, str(error).split("\n")[0]))
        failed = spark.createDataFrame(errors, "detector string, error string, message string")
        if alerts:
            return union_all(alerts), failed
        return spark.createDataFrame([], _alert_schema(packets)), failed

    def run_isolated(self, packets: DataFrame, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """As ``run``, with every detector carried out and stored on its own before the alerts are united.

        A detector that fails on some row, or that cannot be planned, becomes an error row and leaves no alerts; those of the others
        are complete.
        """
        spark = packets.sparkSession
        alerts, errors = [], []
        for id in only if only is not None else self.enabled():
            try:
                alerts.append(checkpointed(self._known[id].run(packets).select(*ALERT_COLUMNS)))
            except Exception as error:
                errors.append((id, type(error).__name__, str(error).split("\n")[0]))
        failed = spark.createDataFrame(errors, "detector string, error string, message string")
        return (union_all(alerts) if alerts else spark.createDataFrame([], _alert_schema(packets))), failed

    def run_shared(self, packets: DataFrame, only: list[str] | None = None, isolate: bool = False) -> tuple[DataFrame, DataFrame]:
        """As ``run``, over candidate tables that are read from the packets once each and stored in the checkpoint folder.

        Headers (without payloads) serve the detectors of rates, scans, ARP, DNS and fragments, payloads on web ports the
        three payload detectors in one pass, and replies with a payload the brute-force detector. So nine detectors scan the
        packet table three times, and a detector reads only what it can use. Storing runs jobs; other plug-ins get the packets.
        ``isolate`` stores each part's alerts as well, so that one that fails while it runs becomes an error row (the payload
        detectors, which share a pass, become one).
        """
        chosen = only if only is not None else self.enabled()
        built_in = [id for id in chosen if id in self._known and self._known[id].run is _RUN.get(id)]
        first_byte = F.substring("payload", 1, 1).alias("payload")
        alerts, errors, tables = [], [], {}

        def stored(name: str, make: Callable[[], DataFrame]) -> DataFrame:
            if name not in tables:
                tables[name] = checkpointed(make())
            return tables[name]

        def headers() -> DataFrame:
            kept = [c for c in packets.columns if c not in ("payload", "frame")]
            return packets.select(*kept, *([first_byte] if "payload" in packets.columns else []))

        def payloads() -> DataFrame:
            return packets.where(F.octet_length("payload") > 0)

        tasks = []
        web = [id for id in built_in if id in patterns.PAYLOAD_DETECTORS]
        if web:
            tasks.append((", ".join(web), lambda: patterns.detect_payloads(stored("web", lambda: payloads().where(patterns.on_ports(patterns.WEB_PORTS))), web)))
        for id in chosen:
            if id in web:
                continue
            if id not in built_in:
                tasks.append((id, lambda id=id: self._known[id].run(packets)))
            elif id == "BruteForceDetector":
                tasks.append((id, lambda id=id: self._known[id].run(stored("replies", payloads))))
            else:
                tasks.append((id, lambda id=id: self._known[id].run(stored("headers", headers))))
        for id, make in tasks:
            try:
                found = make().select(*ALERT_COLUMNS)
                alerts.append(checkpointed(found) if isolate else found)
            except Exception as error:
                errors.append((id, type(error).__name__, str(error).split("\n")[0]))
        spark = packets.sparkSession
        failed = spark.createDataFrame(errors, "detector string, error string, message string")
        return (union_all(alerts) if alerts else spark.createDataFrame([], _alert_schema(packets))), failed

    def report(self, packets: DataFrame, only: list[str] | None = None) -> DataFrame:
        """(detector, alerts, error): how many alerts each chosen detector raises, or why it could not be planned."""
        parts = []
        for id in only if only is not None else self.enabled():
            alerts, failed = self.run(packets, [id])
            counted = alerts.agg(F.count("*").alias("alerts"))
            errors = failed.agg(F.first("error").alias("error"))
            parts.append(counted.crossJoin(F.broadcast(errors)).select(F.lit(id).alias("detector"), "alerts", "error"))  # one row each
        return union_all(parts)


def numbered_feed(alerts: DataFrame) -> DataFrame:
    """One feed with a running id by (time, packet, sid, detector), numbered in ranges that tasks share."""
    placed = alerts.withColumn("__us", micros(alerts, "ts"))
    return numbered(placed, ["__us", "packet_id", "sid", "detector", "info"], "id").drop("__us")
