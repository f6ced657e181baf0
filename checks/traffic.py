"""Labels, roll-ups, sliding windows, floods and scans over packets derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import alert_sql, query
from checks.views import duck, view
from packetloom.functions import labels, net, text
from packetloom.operators import dos, flowstate, rollups, sliding

LABEL_SQL = """CASE WHEN arp_op IS NOT NULL THEN 'ARP'
  WHEN tcp_flags IS NOT NULL THEN CASE
    WHEN dst_port = 80 THEN 'HTTP' WHEN dst_port = 443 THEN 'TLS' WHEN dst_port = 22 THEN 'SSH'
    WHEN dst_port IN (20, 21) THEN 'FTP' WHEN dst_port IN (25, 587) THEN 'SMTP'
    WHEN src_port = 80 THEN 'HTTP' WHEN src_port = 443 THEN 'TLS' WHEN src_port = 22 THEN 'SSH'
    WHEN src_port IN (20, 21) THEN 'FTP' WHEN src_port IN (25, 587) THEN 'SMTP' ELSE 'TCP' END
  WHEN ip_proto = 17 AND src_port IS NOT NULL THEN CASE WHEN dst_port = 53 OR src_port = 53 THEN 'DNS' ELSE 'UDP' END
  WHEN icmp_type IS NOT NULL THEN 'ICMP' ELSE 'OTHER' END"""
LABELLED = f"(SELECT *, {LABEL_SQL} AS proto FROM {duck('packets_ev')} p0)"
EV = duck("packets_ev")


def packets(spark, d):
    return rollups.labelled(view(spark, d, "packets_ev"))


# ---------------------------------------------------------------- labels, listing, filters


@query("protocol_label", f"SELECT packet_id, ts, src_ip, dst_ip, src_port, dst_port, proto, length FROM {LABELLED} p")
def _(spark, d):
    return packets(spark, d).select("packet_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "length")


@query("packet_latest", f"SELECT packet_id, ts, src_ip, proto, length FROM {LABELLED} p ORDER BY packet_id DESC LIMIT 200")
def _(spark, d):
    return rollups.latest(packets(spark, d), 200).select("packet_id", "ts", "src_ip", "proto", "length")


@query(
    "packet_sorted",
    f"""SELECT packet_id, proto, length, row_number() OVER (ORDER BY length DESC, packet_id) AS rank FROM {LABELLED} p""",
)
def _(spark, d):
    return rollups.numbered(packets(spark, d), "length", ascending=False).select("rank", "packet_id", "proto", "length")


def display_sql(typed, more=""):
    return f"""SELECT packet_id FROM (SELECT *, lower(concat(src_ip, ' > ', dst_ip)) AS info, 'LOW' AS threat FROM {LABELLED} p) q
        WHERE contains(src_ip, '{typed}') OR contains(dst_ip, '{typed}') OR contains(lower(proto), '{typed}') OR contains(info, '{typed}')
        OR contains(CAST(packet_id AS VARCHAR), '{typed}') OR contains(lower(threat), '{typed}') {more}"""


def _shown(spark, d, typed):
    rows = packets(spark, d).withColumn("info", F.concat("src_ip", F.lit(" > "), "dst_ip"))
    rows = rows.withColumn("threat", F.lit("LOW")).withColumn("is_alert", F.lit(False))
    return rows.where(rollups.display_filter(typed)).select("packet_id")


@query("display_filter_text", display_sql("0.0.7"))
def _(spark, d):
    return _shown(spark, d, "0.0.7")


@query(
    "display_filter_port",
    display_sql("port 44", "OR contains(CAST(src_port AS VARCHAR), '44') OR contains(CAST(dst_port AS VARCHAR), '44')"),
)
def _(spark, d):
    return _shown(spark, d, "PORT 44")


@query("display_filter_keyword", display_sql("udp", "OR proto = 'UDP'"))
def _(spark, d):
    return _shown(spark, d, "UDP")


@query(
    "filter_text_valid",
    """SELECT page_id, regexp_full_match(url, '[\\w\\s\\.\\*:!\\[\\]\\-><"''/]+') AS valid FROM pages""",
)
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", rollups.is_valid_filter(F.col("url")).alias("valid"))


# ---------------------------------------------------------------- scalar functions


@query(
    "address_number",
    f"""SELECT packet_id, CAST(split_part(src_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(src_ip, '.', 2) AS BIGINT) * 65536
        + CAST(split_part(src_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(src_ip, '.', 4) AS BIGINT) AS number,
        CAST(split_part(src_ip, '.', 4) AS INT) < 8 AS in_net FROM {EV} p""",
)
def _(spark, d):
    src = F.col("src_ip")
    return view(spark, d, "packets_ev").select(
        "packet_id", net.ipv4_to_long(src).alias("number"), net.in_cidr(src, "10.0.0.3/29").alias("in_net")
    )


MIXED_ADDRESS = "concat(CAST(200 + user_id % 60 AS {t}), '.0.0.', CAST(event_id % 256 AS {t}))"


@query(
    "multicast_test",
    f"""SELECT event_id, split_part(ip, '.', 1) BETWEEN '224' AND '239' AND length(split_part(ip, '.', 1)) = 3 AS is_group
        FROM (SELECT event_id, {MIXED_ADDRESS.format(t='VARCHAR')} AS ip FROM events) e""",
)
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    ip = F.expr(MIXED_ADDRESS.format(t="STRING"))
    return events.select("event_id", net.is_multicast_or_broadcast(ip).alias("is_group"))


@query(
    "tcp_flag_tests",
    f"""SELECT packet_id, (tcp_flags & 2) <> 0 AS syn, (tcp_flags & 16) <> 0 AS ack, (tcp_flags & 1) <> 0 AS fin,
        (tcp_flags & 4) <> 0 AS rst, (tcp_flags & 9) = 9 AS needs_fp FROM {EV} p WHERE tcp_flags IS NOT NULL""",
)
def _(spark, d):
    flags = F.col("tcp_flags")
    return view(spark, d, "packets_ev").where(net.is_tcp()).select(
        "packet_id",
        net.has_flag(flags, net.SYN).alias("syn"),
        net.has_flag(flags, net.ACK).alias("ack"),
        net.has_flag(flags, net.FIN).alias("fin"),
        net.has_flag(flags, net.RST).alias("rst"),
        net.flags_satisfied(flags, net.required_bits(F.lit("FPx"))).alias("needs_fp"),
    )


HUMAN = """CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10)
           WHEN n < 1073741824 THEN printf('%.2f MB', floor(n / 1048576.0 * 100 + 0.5) / 100)
           ELSE printf('%.2f GB', floor(n / 1073741824.0 * 100 + 0.5) / 100) END"""
WEIGHT = "CAST(l_quantity AS BIGINT) * CAST(floor(l_extendedprice) AS BIGINT)"


@query(
    "human_bytes",
    f"""SELECT l_orderkey, n, {HUMAN} AS shown FROM (SELECT l_orderkey, CAST(sum({WEIGHT}) AS BIGINT) AS n
        FROM lineitem GROUP BY l_orderkey) q""",
)
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey")
    sums = rows.agg(F.sum(F.expr(WEIGHT)).alias("n"))
    return sums.withColumn("shown", text.human_bytes(F.col("n")))


# ---------------------------------------------------------------- roll-ups


@query(
    "protocol_counts",
    f"""SELECT b.proto, count(p.proto) AS packets FROM (SELECT unnest(['TCP','UDP','ICMP','ARP','HTTP','DNS','TLS','SSH','FTP',
        'SMTP','OTHER']) AS proto) b LEFT JOIN {LABELLED} p ON b.proto = p.proto GROUP BY b.proto""",
)
def _(spark, d):
    return rollups.protocol_counts(packets(spark, d))


@query("total_bytes", f"SELECT CAST(sum(length) AS BIGINT) AS total_bytes, count(*) AS packets FROM {EV} p")
def _(spark, d):
    return rollups.total_bytes(packets(spark, d))


RATE = f"""WITH s AS (SELECT CAST(epoch_us(ts) // 1000000 AS BIGINT) AS sec, count(*) AS n, sum(length) AS b FROM {EV} p GROUP BY 1),
    grid AS (SELECT unnest(generate_series((SELECT min(sec) FROM s), (SELECT max(sec) FROM s))) AS sec),
    r AS (SELECT sec, coalesce(n, 0) AS n, coalesce(b, 0) AS b FROM grid LEFT JOIN s USING (sec))"""


@query(
    "traffic_rate",
    f"""{RATE} SELECT make_timestamp(sec * 1000000) AS second, CAST(n AS DOUBLE) AS pps, CAST(b AS BIGINT) AS bps,
        CAST(sum(n) OVER (ORDER BY sec) AS BIGINT) AS total FROM r""",
)
def _(spark, d):
    return rollups.traffic_rate(packets(spark, d))


@query(
    "traffic_rate_mean5",
    f"""{RATE} SELECT make_timestamp(sec * 1000000) AS second,
        CAST(floor(avg(b) OVER (ORDER BY sec ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) + 0.5) AS BIGINT) AS mean_bps FROM r""",
)
def _(spark, d):
    return rollups.mean_rate(rollups.traffic_rate(packets(spark, d))).select("second", "mean_bps")


@query(
    "traffic_history",
    f"""{RATE} SELECT make_timestamp(sec * 1000000) AS second, CAST(b AS BIGINT) AS bps FROM r ORDER BY sec DESC LIMIT 60""",
)
def _(spark, d):
    return rollups.latest(rollups.traffic_rate(packets(spark, d)), 60, by="second").select("second", "bps")


@query(
    "dominant_source_now",
    f"""WITH w AS (SELECT * FROM {EV} p ORDER BY packet_id DESC LIMIT 100), c AS (SELECT src_ip, count(*) AS n,
        (SELECT count(*) FROM w) AS total FROM w GROUP BY src_ip)
        SELECT src_ip, n, total, n > greatest(3, CAST(floor(total * 0.03) AS INT)) AS dominant FROM c""",
)
def _(spark, d):
    return rollups.dominant_source(packets(spark, d), floor=3, share=0.03)


@query(
    "dominant_source_running",
    f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY packet_id) AS pos FROM {EV} p),
        c AS (SELECT a.packet_id, a.ts, a.src_ip, count(*) AS n, least(100, max(a.pos)) AS total
              FROM r a JOIN r b ON a.src_ip = b.src_ip AND b.pos BETWEEN a.pos - 99 AND a.pos GROUP BY ALL)
        SELECT packet_id, src_ip, n FROM c WHERE n > greatest(14, CAST(floor(total * 0.14) AS INT))""",
)
def _(spark, d):
    return rollups.dominant_source_running(packets(spark, d), floor=14, share=0.14).select("packet_id", "src_ip", "n")


@query(
    "capture_status",
    f"""SELECT count(*) AS packets, count_if(tcp_flags = 4) AS alerts, 9 AS active_detectors,
        printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS uptime FROM (SELECT *, 1 AS one FROM {EV} p) q,
        (SELECT CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS BIGINT) AS s FROM {EV} p) t GROUP BY s""",
)
def _(spark, d):
    return rollups.capture_status(packets(spark, d), F.col("tcp_flags") == 4, active_detectors=9)


# ---------------------------------------------------------------- sliding windows


def later(keys, a="a", b="b"):
    same = " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)
    return same


def window_join(rel, keys, seconds, select, having="", adds="true"):
    """Every row of ``rel`` with what its key did in the closed window before it."""
    return f"""SELECT {select} FROM {rel} a LEFT JOIN {rel} b ON {later(keys)} AND ({adds})
        AND b.ts BETWEEN a.ts - INTERVAL '{seconds} seconds' AND a.ts AND (b.ts < a.ts OR b.packet_id <= a.packet_id)
        GROUP BY ALL {having}"""


TCP = f"(SELECT * FROM {EV} p WHERE tcp_flags IS NOT NULL)"


@query("sliding_count", window_join(EV, ["src_ip", "dst_ip"], 20, "a.packet_id, count(b.packet_id) AS n"))
def _(spark, d):
    rows = view(spark, d, "packets_ev").select("packet_id", "ts", "src_ip", "dst_ip")
    return sliding.sliding_count(rows, ["src_ip", "dst_ip"], 20).select("packet_id", "n")


@query("sliding_distinct", window_join(TCP, ["src_ip", "dst_ip"], 30, "a.packet_id, count(DISTINCT b.dst_port) AS n_distinct"))
def _(spark, d):
    rows = view(spark, d, "packets_ev").where(net.is_tcp()).select("packet_id", "ts", "src_ip", "dst_ip", "dst_port")
    return sliding.sliding_distinct(rows, ["src_ip", "dst_ip"], "dst_port", 30).select("packet_id", "n_distinct")


@query(
    "sliding_first_seen",
    window_join(
        EV, ["src_ip"], 30, "a.packet_id, count(DISTINCT b.dst_ip) AS n_distinct", adds="b.tcp_flags = 2 OR b.ip_proto = 17"
    ),
)
def _(spark, d):
    rows = view(spark, d, "packets_ev").select("packet_id", "ts", "src_ip", "dst_ip", "tcp_flags", "ip_proto")
    adds = (F.col("tcp_flags") == 2) | (F.col("ip_proto") == 17)
    return sliding.sliding_distinct(rows, ["src_ip"], "dst_ip", 30, where=adds).select("packet_id", "n_distinct")


@query(
    "cumulative_distinct",
    f"""SELECT packet_id, sum(fresh) OVER (PARTITION BY src_ip ORDER BY ts, packet_id ROWS UNBOUNDED PRECEDING) AS n_distinct
        FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY src_ip, dst_port ORDER BY ts, packet_id) = 1 THEN 1 ELSE 0 END AS fresh
              FROM {TCP} p) q""",
)
def _(spark, d):
    rows = view(spark, d, "packets_ev").where(net.is_tcp()).select("packet_id", "ts", "src_ip", "dst_port")
    return sliding.cumulative_distinct(rows, ["src_ip"], "dst_port", slice_seconds=120).select("packet_id", "n_distinct")


@query(
    "running_bytes",
    f"SELECT packet_id, CAST(sum(length) OVER (PARTITION BY src_ip ORDER BY ts, packet_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM {EV} p",
)
def _(spark, d):
    rows = view(spark, d, "packets_ev").select("packet_id", "ts", "src_ip", "length")
    return sliding.running_total(rows, ["src_ip"], F.col("length"), slice_seconds=120).select("packet_id", "total")


# ---------------------------------------------------------------- floods and scans

SMALL = {
    "any": (60.0, 4),
    "syn": (60.0, 3),
    "syn_port_scan": (60.0, 4),
    "udp": (60.0, 3),
    "udp_port_scan": (60.0, 3),
    "icmp": (60.0, 3),
    "port_scan": (60.0, 5),
    "hscan": (60.0, 5),
    "flags": (60.0, 3),
}


def dos_sql(rel, name, keys, *, value=None, adds="true", message=None):
    window, threshold = SMALL[name]
    measure = f"count(DISTINCT b.{value})" if value else "count(b.packet_id)"
    hits = window_join(rel, keys, int(window), "a.ts, a.packet_id, a.src_ip, a.dst_ip", f"HAVING {measure} >= {threshold}", adds)
    text = message or dos.DOS_MESSAGES[name]
    return alert_sql(f"({hits})", "DosDetector", "HIGH", str(dos.DOS_SIDS[name]), f"'{text}'", "src_ip", "dst_ip")


def dos_query(name, oracle):
    @query(f"dos_{name}", oracle)
    def _(spark, d):
        return dos.detect_dos(view(spark, d, "packets_ev"), [name], **SMALL)


SYN = f"(SELECT * FROM {EV} p WHERE (tcp_flags & 2) <> 0 AND (tcp_flags & 16) = 0)"
BARE_SYN = f"(SELECT * FROM {EV} p WHERE (tcp_flags & 23) = 2)"
UDP = f"(SELECT * FROM {EV} p WHERE ip_proto = 17 AND src_port IS NOT NULL)"
PORTED = f"(SELECT * FROM {EV} p WHERE dst_port IS NOT NULL)"
ICMP = f"(SELECT * FROM {EV} p WHERE icmp_type IS NOT NULL)"

PAIR = ["src_ip", "dst_ip"]
dos_query("syn", dos_sql(BARE_SYN, "syn", PAIR))
dos_query("syn_port_scan", dos_sql(SYN, "syn_port_scan", PAIR, value="dst_port"))
dos_query("udp", dos_sql(UDP, "udp", [*PAIR, "dst_port"]))
dos_query("udp_port_scan", dos_sql(UDP, "udp_port_scan", PAIR, value="dst_port"))
dos_query("icmp", dos_sql(ICMP, "icmp", PAIR))
dos_query("port_scan", dos_sql(PORTED, "port_scan", PAIR, value="dst_port"))
dos_query(
    "hscan",
    dos_sql(EV, "hscan", ["src_ip"], value="dst_ip", adds="(b.tcp_flags & 18) = 2 OR (b.tcp_flags IS NULL AND b.ip_proto = 17)"),
)



def listed_sql():
    """The list of each source's targets, packet by packet."""
    window, threshold = SMALL["hscan"]
    keep = f"lambda x: x.t >= n.us - {round(window * 1_000_000)}"
    hits = f"""(WITH RECURSIVE n AS (SELECT *, epoch_us(ts) AS us, coalesce((tcp_flags & 18) = 2 OR (tcp_flags IS NULL AND ip_proto = 17), false) AS adds,
          row_number() OVER (PARTITION BY src_ip ORDER BY ts, packet_id) AS rn FROM {EV} p),
      st AS (
        SELECT src_ip, dst_ip, ts, packet_id, rn, list_filter([{{'t': us, 'd': dst_ip}}], lambda x: adds) AS listed FROM n WHERE rn = 1
        UNION ALL
        SELECT n.src_ip, n.dst_ip, n.ts, n.packet_id, n.rn, list_filter(CASE WHEN n.adds AND NOT list_contains(list_transform(p.listed, lambda x: x.d), n.dst_ip)
            THEN list_append(p.listed, {{'t': n.us, 'd': n.dst_ip}}) ELSE p.listed END, {keep})
        FROM st p JOIN n ON n.src_ip = p.src_ip AND n.rn = p.rn + 1)
      SELECT * FROM st WHERE len(listed) >= {threshold})"""
    return alert_sql(hits, "DosDetector", "HIGH", str(dos.DOS_SIDS["hscan"]), f"'{dos.DOS_MESSAGES['hscan']}'", "src_ip", "dst_ip")


@query("dos_hscan_ageing", listed_sql())
def _(spark, d):
    return dos.detect_dos(view(spark, d, "packets_ev"), ["hscan"], reference_ageing=True, **SMALL)


def conn_sql(rel):
    """Handshakes replayed packet by packet, then the entries they and other packets set, over whole connections."""
    return f"""(WITH RECURSIVE p AS (
    SELECT *, src_ip || '|' || src_port AS e1, dst_ip || '|' || dst_port AS e2, epoch_us(ts) AS us,
        (tcp_flags & 18) = 2 AS syn, (tcp_flags & 18) = 18 AS synack, (tcp_flags & 18) = 16 AS ack,
        (tcp_flags & 8) <> 0 OR coalesce(octet_length(payload), 0) > 0 AS data, (tcp_flags & 5) <> 0 AS closing FROM {rel} c0),
  q AS (SELECT *, least(e1, e2) AS a, greatest(e1, e2) AS b, e1 <= e2 AS fwd, CASE WHEN synack THEN e2 <= e1 ELSE e1 <= e2 END AS hs FROM p),
  n AS (SELECT a, b, hs, packet_id, us, syn, synack, ack, row_number() OVER (PARTITION BY a, b, hs ORDER BY us, packet_id) AS rn
        FROM q WHERE syn OR synack OR ack),
  r AS (SELECT a, b, hs, rn, packet_id, CASE WHEN syn THEN us END AS last, false AS answered, false AS done, false AS now FROM n WHERE rn = 1
        UNION ALL
        SELECT x.a, x.b, x.hs, x.rn, x.packet_id,
               CASE WHEN x.syn THEN x.us WHEN NOT alive THEN NULL WHEN x.synack OR completes THEN x.us ELSE o.last END,
               CASE WHEN x.synack AND alive THEN true ELSE alive AND o.answered END,
               alive AND (o.done OR completes), completes
        FROM (SELECT r.*, x AS x, coalesce(x.us - r.last <= CASE WHEN r.done THEN 600000000 ELSE 180000000 END, false) AS alive,
                     x.ack AND r.answered AND NOT r.done
                     AND coalesce(x.us - r.last <= 180000000, false) AS completes
              FROM r JOIN n x ON x.a = r.a AND x.b = r.b AND x.hs = r.hs AND x.rn = r.rn + 1) o),
  h AS (SELECT q.*, coalesce(r.now, false) AS done FROM q LEFT JOIN r ON r.packet_id = q.packet_id),
  m AS (SELECT *, CASE WHEN closing THEN -us WHEN done OR (synack AND NOT fwd) OR (ack AND data AND fwd) THEN us END AS mf,
               CASE WHEN closing THEN -us WHEN done OR (synack AND fwd) OR (ack AND data AND NOT fwd) THEN us END AS mr FROM h),
  z AS (SELECT *, CASE WHEN fwd THEN last_value(mf IGNORE NULLS) OVER before_row ELSE last_value(mr IGNORE NULLS) OVER before_row END AS mb,
        CASE WHEN fwd THEN last_value(mf IGNORE NULLS) OVER with_row ELSE last_value(mr IGNORE NULLS) OVER with_row END AS ma FROM m
        WINDOW before_row AS (PARTITION BY a, b ORDER BY us, packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               with_row AS (PARTITION BY a, b ORDER BY us, packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT packet_id, ts, src_ip, dst_ip, src_port, dst_port, tcp_flags, done AS handshake_done,
         coalesce(mb > 0 AND us - mb <= 120000000, false) AS established_before,
         coalesce(ma > 0 AND us - ma <= 120000000, false) AS established_after FROM z)"""


CONN = conn_sql(duck("conn_ev"))


@query("flow_state", f"SELECT packet_id, handshake_done, established_before, established_after FROM {CONN} c")
def _(spark, d):
    state = flowstate.with_flow_state(view(spark, d, "conn_ev"), slice_seconds=600)
    return state.select("packet_id", "handshake_done", "established_before", "established_after")


# Sessions that stay open for hours: SYN, then SYN/ACKs at most 175 s apart, and an ACK now and then.
@query("handshake_long_session", f"SELECT slices, packet_id FROM {conn_sql(duck('long_ev'))} c, (VALUES (600), (3600), (100000)) v(slices) WHERE handshake_done")
def _(spark, d):
    packets, found = view(spark, d, "long_ev"), None
    for slices in (600, 3600, 100_000):
        rows = flowstate.completed_handshakes(packets, slice_seconds=float(slices)).select(F.lit(slices).alias("slices"), "packet_id")
        found = rows if found is None else found.unionByName(rows)
    return found


@query("handshake_completed", f"SELECT packet_id, ts, src_ip, dst_ip FROM {CONN} c WHERE handshake_done")
def _(spark, d):
    return flowstate.completed_handshakes(view(spark, d, "conn_ev")).select("packet_id", "ts", "src_ip", "dst_ip")


OPEN = f"(SELECT * FROM {CONN} c WHERE NOT established_before)"


@query("dos_any", dos_sql(OPEN, "any", PAIR))
def _(spark, d):
    return dos.detect_dos(view(spark, d, "conn_ev"), ["any"], **SMALL)


FLAGGED = f"""(SELECT *, CASE tcp_flags WHEN 0 THEN 'NULL' WHEN 1 THEN 'FIN' WHEN 41 THEN 'XMAS' ELSE 'ACK' END AS flagname FROM (
    SELECT packet_id, ts, src_ip, dst_ip, tcp_flags FROM {EV} p WHERE tcp_flags IN (0, 1, 41)
    UNION ALL SELECT packet_id + 1000000, ts, src_ip, dst_ip, tcp_flags FROM {CONN} c WHERE tcp_flags = 16 AND NOT established_after) u)"""


@query(
    "dos_flags",
    alert_sql(
        "(" + window_join(FLAGGED, ["flagname", "src_ip"], 60, "a.ts, a.packet_id, a.src_ip, a.dst_ip, a.flagname", "HAVING count(b.packet_id) >= 3") + ")",
        "DosDetector", "HIGH", "1000011", "'SCAN - ' || flagname || ' flag scan detected'", "src_ip", "dst_ip",
    ),
)
def _(spark, d):
    probes = view(spark, d, "packets_ev").where("tcp_flags in (0, 1, 41)")
    conns = view(spark, d, "conn_ev").withColumn("packet_id", F.col("packet_id") + 1000000)
    return dos.detect_dos(probes.unionByName(conns, allowMissingColumns=True), ["flags"], **SMALL)


STATES = f"(SELECT * FROM {conn_sql('(SELECT *, CAST(NULL AS BLOB) AS payload FROM ' + EV + ' v WHERE tcp_flags IS NOT NULL)')} c)"
LOOSE = f"""(SELECT packet_id, ts, src_ip, dst_ip FROM {EV} p WHERE tcp_flags IS NULL
    UNION ALL SELECT packet_id, ts, src_ip, dst_ip FROM {STATES} s WHERE NOT established_before)"""
ALL_FLAGS = f"""(SELECT packet_id, ts, src_ip, dst_ip, CASE tcp_flags WHEN 0 THEN 'NULL' WHEN 1 THEN 'FIN' ELSE 'XMAS' END AS flagname FROM {EV} p
    WHERE tcp_flags IN (0, 1, 41) UNION ALL SELECT packet_id, ts, src_ip, dst_ip, 'ACK' FROM {STATES} s WHERE tcp_flags = 16 AND NOT established_after)"""
ALL_DOS = " UNION ALL ".join(
    [
        dos_sql(LOOSE, "any", PAIR), dos_sql(BARE_SYN, "syn", PAIR), dos_sql(SYN, "syn_port_scan", PAIR, value="dst_port"),
        dos_sql(UDP, "udp", [*PAIR, "dst_port"]), dos_sql(UDP, "udp_port_scan", PAIR, value="dst_port"), dos_sql(ICMP, "icmp", PAIR),
        dos_sql(PORTED, "port_scan", PAIR, value="dst_port"),
        dos_sql(EV, "hscan", ["src_ip"], value="dst_ip", adds="(b.tcp_flags & 18) = 2 OR (b.tcp_flags IS NULL AND b.ip_proto = 17)"),
        alert_sql(
            "(" + window_join(ALL_FLAGS, ["flagname", "src_ip"], 60, "a.ts, a.packet_id, a.src_ip, a.dst_ip, a.flagname", "HAVING count(b.packet_id) >= 3") + ")",
            "DosDetector", "HIGH", "1000011", "'SCAN - ' || flagname || ' flag scan detected'", "src_ip", "dst_ip",
        ),
    ]
)


@query("dos_all", ALL_DOS)
def _(spark, d):
    return dos.detect_dos(view(spark, d, "packets_ev"), **SMALL)


# ---------------------------------------------------------------- alert text functions

NAMED = """(SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'DOS - UDP flood detected' WHEN 1 THEN 'XSS: Polyglot'
    WHEN 2 THEN 'FLOOD - high packet rate (any)' WHEN 3 THEN 'BRUTEFORCE - Slow brute-force' WHEN 4 THEN 'x [Severity: MEDIUM]'
    ELSE 'RDP (CRITICAL) high' END AS info FROM events)"""


@query(
    "alert_threat_and_type",
    f"""SELECT event_id, CASE WHEN contains(lower(info), 'critical') THEN 'CRITICAL' WHEN contains(lower(info), 'high') THEN 'HIGH'
        WHEN contains(lower(info), 'medium') THEN 'MEDIUM' WHEN contains(lower(info), 'low') THEN 'LOW' ELSE 'HIGH' END AS threat,
        CASE WHEN contains(info, ' - ') THEN split_part(info, ' - ', 1) ELSE 'D' END AS type FROM {NAMED} n""",
)
def _(spark, d):
    spark.read.parquet(f"{d}/events.parquet").createOrReplaceTempView("events")
    rows = spark.sql(f"SELECT * FROM {NAMED} n")
    return rows.select(
        "event_id",
        labels.message_threat(F.col("info"), F.lit("HIGH")).alias("threat"),
        labels.alert_type(F.col("info"), F.lit("D")).alias("type"),
    )


@query(
    "overall_threat_level",
    f"""SELECT packet_id, CASE max(rank) OVER (ORDER BY packet_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
        WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS level
        FROM (SELECT packet_id, CASE WHEN length > 1490 THEN 4 WHEN length > 1450 THEN 3 WHEN length > 1300 THEN 2 ELSE 1 END AS rank FROM {EV} p) q""",
)
def _(spark, d):
    size = F.col("length")
    threat = F.when(size > 1490, "CRITICAL").when(size > 1450, "HIGH").when(size > 1300, "MEDIUM").otherwise("LOW")
    alerts = view(spark, d, "packets_ev").select("packet_id", "ts", threat.alias("threat"))
    return rollups.overall_level(alerts, order="packet_id").select("packet_id", "level")
