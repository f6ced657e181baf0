"""Failed logins of five services: rates, several services at once, name guessing, slow attempts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from packetloom.functions import net, text
from packetloom.functions.timecols import from_micros, is_ntz, micros, to_us
from packetloom.operators.alerts import as_alerts, union_all
from packetloom.operators.chains import greedy_chain
from packetloom.operators.programs import UsernameEnumeration
from packetloom.operators.scan import keyed_scan
from packetloom.operators.sliding import null_safe_join, running_rank, slice_with_lookback, sliding_count


@dataclass(frozen=True)
class Service:
    name: str
    window: float
    threshold: int
    sid: int
    severity: str
    human: str


# Services in test order with their ports, windows, thresholds and messages.
SERVICES = [
    Service("ssh", 120.0, 5, 1000020, "HIGH", "SSH authentication failures"),
    Service("rdp", 120.0, 4, 1000021, "CRITICAL", "RDP authentication failures (CRITICAL)"),
    Service("ftp", 120.0, 5, 1000022, "MEDIUM", "FTP login failures"),
    Service("http", 180.0, 10, 1000023, "MEDIUM", "HTTP authentication failures"),
    Service("smtp", 120.0, 5, 1000024, "HIGH", "SMTP authentication failures"),
]
FTP_PORTS = [21, 2121]
HTTP_PORTS = [80, 443, 8080, 8443]
SMTP_PORTS = [25, 587, 465]
TLS_ALERTS = [40, 49, 42, 45]
FTP_CODES = [500, 501, 502, 503, 504, 530, 532, 550]
SMTP_CODES = ["535", "534", "538", "454"]
LOGIN_PHRASES = [
    "login failed", "invalid credentials", "authentication failed",
    "incorrect password", "username or password", "login error",
]
STUFFING = (300.0, 3, 1000025)
ENUMERATED_NAMES = 10
SLOW = (3600.0, 30)


def _has(subject: Column, word: str) -> Column:
    return F.contains(subject, F.lit(word))


def _ssh(raw: Column) -> Column:
    """Name seen in a failed SSH login, NULL when there is no failure."""
    run = F.regexp_extract(F.substring(raw, 11, 50), "[\\x20-\\x7e]{3,32}", 0)
    named = F.when(run != "", run).otherwise("unknown")
    mismatch = _has(raw, "SSH-") & (_has(raw, "Protocol") | _has(raw, "mismatch"))
    return F.when(
        F.length(raw) >= 10,
        F.when(_has(F.substring(raw, 1, 100), "\x33"), named).when(mismatch, "protocol_negotiation"),
    )


def _rdp(raw: Column) -> Column:
    tls = raw.startswith("\x15") & F.ascii(F.substring(raw, 7, 1)).isin(TLS_ALERTS)
    asn = _has(F.substring(raw, 1, 20), "\x30\x82") & (
        _has(raw, "\x02\x01\x05") | _has(raw, "\x02\x01\x07") | _has(raw, "\x02\x01\x09")
    )
    x224 = raw.startswith("\x03\x00") & (F.length(raw) >= 11) & _has(F.substring(raw, 8, 4), "\x0e\xd0")
    return (F.length(raw) >= 10) & (tls | asn | x224)


def _ftp(line: Column) -> tuple[Column, Column]:
    code = F.regexp_extract(line, "^([0-9]{3})", 1).try_cast("int")
    failed = line.startswith("530") | line.startswith("421") | (line.startswith("5") & code.isin(FTP_CODES))
    user = F.regexp_extract(line, r"(?d)530[- ].*?(\w+@?\w*)", 1)
    name = F.when(line.startswith("530"), F.when(user != "", user).otherwise("unknown"))
    return F.coalesce(failed, F.lit(False)), name


def _http(body: Column) -> Column:
    folded = F.lower(body)
    phrase = F.lit(False)
    for words in LOGIN_PHRASES:
        phrase = phrase | _has(folded, words)
    return _has(body, "HTTP/") & (_has(body, " 401 ") | _has(body, " 403 ") | (_has(body, " 200 ") & phrase))


def login_failures(packets: DataFrame, ftp_ports: list[int] | None = None) -> DataFrame:
    """One row per failed login: client, server, service and, for SSH and FTP, the name used."""
    ftp = ftp_ports or FTP_PORTS
    sport, dport = F.col("src_port"), F.col("dst_port")

    def on(ports: list[int]) -> Column:
        return sport.isin(ports) | dport.isin(ports)

    service = (
        F.when(on([22]), "ssh")
        .when(on([3389]), "rdp")
        .when(on(ftp), "ftp")
        .when(on(HTTP_PORTS), "http")
        .when(on(SMTP_PORTS), "smtp")
    )
    from_server = (
        F.when(F.col("service") == "ssh", dport != 22)
        .when(F.col("service") == "rdp", dport != 3389)
        .when(F.col("service") == "ftp", sport.isin(ftp))
        .when(F.col("service") == "http", sport.isin(HTTP_PORTS))
        .otherwise(sport.isin(SMTP_PORTS))
    )
    all_ports = [22, 3389, *ftp, *HTTP_PORTS, *SMTP_PORTS]
    rows = packets.where(net.is_ip() & net.is_tcp() & on(all_ports) & (F.length("payload") >= 5)).withColumn(
        "service", service
    )
    # The decoded texts pass through a generator, which keeps later filters from decoding them again.
    texts = F.struct(
        text.byte_text(F.col("payload")).alias("raw"),
        F.when(F.col("service").isin("ftp", "smtp"), text.ascii_text(F.col("payload"))).alias("line"),
    )
    rows = rows.select(
        "packet_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "service", F.explode(F.array(texts)).alias("t")
    ).select("*", "t.raw", "t.line")
    kind = F.col("service")
    ftp_failed, ftp_name = _ftp(F.col("line"))
    smtp_failed = F.lit(False)
    for code in SMTP_CODES:
        smtp_failed = smtp_failed | F.col("line").startswith(code)
    rows = rows.withColumn("ssh_name", F.when(kind == "ssh", _ssh(F.col("raw"))))
    failed = (
        F.when(kind == "ssh", F.col("ssh_name").isNotNull())
        .when(kind == "rdp", _rdp(F.col("raw")))
        .when(kind == "ftp", ftp_failed)
        .when(kind == "http", _http(F.col("raw")))
        .otherwise(smtp_failed)
    )
    name = F.when(kind == "ssh", F.col("ssh_name")).when(kind == "ftp", ftp_name)
    return rows.where(failed).select(
        "packet_id",
        "ts",
        F.when(from_server, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("client"),
        F.when(from_server, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("server"),
        "service",
        name.alias("username"),
    )


def _alerts(hits: DataFrame, sid: Column, info: Column) -> DataFrame:
    return as_alerts(hits, "BruteForceDetector", sid, info, F.col("client"), F.col("server"))


def service_sid(extra: int = 0) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for s in SERVICES for x in (s.name, s.sid + extra)]), F.col("service"))


def failure_rates(failures: DataFrame, services: list[Service] | None = None) -> DataFrame:
    out = []
    for s in services or SERVICES:
        counted = sliding_count(failures.where(F.col("service") == s.name), ["client"], s.window)
        info = F.format_string(
            f"BRUTEFORCE - {s.human} [Severity: {s.severity}] - %d failures in {float(s.window)}s", "n"
        )
        out.append(_alerts(counted.where(F.col("n") >= s.threshold), F.lit(s.sid), info))
    return union_all(out)


def credential_stuffing(failures: DataFrame, window: float = STUFFING[0], threshold: int = STUFFING[1]) -> DataFrame:
    """Clients failing at several services within the window; five running maxima tell which."""
    window_us = to_us(window)
    sliced = slice_with_lookback(failures, window, "ts", None)
    seen = (
        Window.partitionBy("client", "__slice")
        .orderBy("__us", "packet_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last = {f"last_{s.name}": F.max(F.when(F.col("service") == s.name, F.col("__us"))).over(seen) for s in SERVICES}
    rows = sliced.withColumns(last).where("__own")
    active = F.array_compact(
        F.array(*[F.when(F.col("__us") - F.col(f"last_{s.name}") <= window_us, F.lit(s.name)) for s in SERVICES])
    )
    hits = rows.withColumn("active", active).where(F.size("active") >= threshold)
    # Services are listed in the order in which the client first failed at them.
    firsts = failures.groupBy("client", "service").agg(F.min(F.struct("ts", "packet_id")).alias("first"))
    order = firsts.groupBy("client").agg(F.sort_array(F.collect_list(F.struct("first", "service"))).alias("order"))
    listed = null_safe_join(hits, order, ["client"])
    named = F.filter(F.transform("order", lambda o: o["service"]), lambda s: F.array_contains("active", s))
    info = F.concat(
        F.lit("BRUTEFORCE - Multi-service credential stuffing detected (targeting "), F.array_join(named, ", "), F.lit(")")
    )
    return _alerts(listed, F.lit(STUFFING[2]), info)


ENUM_OUT = T.StructType(
    [
        T.StructField("us", T.LongType()),
        T.StructField("packet_id", T.LongType()),
        T.StructField("server", T.StringType()),
        T.StructField("found", T.LongType()),
    ]
)


def username_enumeration(failures: DataFrame, names: int = ENUMERATED_NAMES, **options) -> DataFrame:
    """Every ``names`` distinct names of a (client, service). Pairs that never show that many are left out first."""
    keys = ["client", "service"]
    named = failures.where(F.col("username").isNotNull() & (F.col("username") != "unknown"))
    busy = named.select(*keys, "username").distinct().groupBy(*keys).count().where(F.col("count") >= names)
    rows = null_safe_join(named, busy.select(*keys), keys, "left_semi")
    timed = rows.withColumn("us", micros(rows, "ts"))
    hits = keyed_scan(timed, keys, ["us", "packet_id"], UsernameEnumeration(names), ENUM_OUT, **options)
    hits = hits.withColumn("ts", from_micros("us", is_ntz(failures, "ts")))
    info = F.format_string(
        "BRUTEFORCE - Username enumeration detected on %s (%d usernames attempted)", F.upper("service"), F.col("found")
    )
    return _alerts(hits, service_sid(100), info)


def slow_attempts(failures: DataFrame, span: float = SLOW[0], attempts: int = SLOW[1], **options) -> DataFrame:
    """``attempts`` failures stretching over ``span`` seconds since the first one or the last alert.

    An alert restarts both measures, so alerts form a chain with a gap in position and in time.
    """
    ranked = running_rank(failures, ["client"], "__pos2")
    timed = ranked.withColumn("__pos", micros(failures, "ts"))
    begin = failures.groupBy("client").agg(F.min(micros(failures, "ts")).alias("begin"))
    ready = null_safe_join(timed, begin, ["client"]).where(
        (F.col("__pos2") >= attempts) & (F.col("__pos") - F.col("begin") >= to_us(span))
    )
    fired = greedy_chain(ready, ["client"], to_us(span), gap2=attempts, **options)
    in_order = Window.partitionBy("client").orderBy("__pos")
    since = fired.withColumn("total", F.col("__pos2") - F.coalesce(F.lag("__pos2").over(in_order), F.lit(0))).withColumn(
        "length", F.col("__pos") - F.coalesce(F.lag("__pos").over(in_order), F.col("begin"))
    )
    info = F.format_string(
        "BRUTEFORCE - Slow brute-force attack detected (%d attempts over %.1f minutes)",
        F.col("total"),
        F.col("length") / 60_000_000.0,
    )
    return _alerts(since, service_sid(200), info)


def detect_brute_force(packets: DataFrame, ftp_ports: list[int] | None = None) -> DataFrame:
    """All detections. Replies are decoded once; the failures, a narrow part of them, are kept in even parts for all four."""
    failures = login_failures(packets, ftp_ports).repartition("client", "service", "packet_id").persist(StorageLevel.MEMORY_AND_DISK)
    return union_all(
        [failure_rates(failures), credential_stuffing(failures), username_enumeration(failures), slow_attempts(failures)]
    )
