"""DNS, ARP, SYN-scan, fragmentation and brute-force detections, and suppression."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import alert_sql, cooldown_sql, query
from checks.traffic import window_join
from checks.views import duck, view
from packetloom.functions import text
from packetloom.operators import arp, bruteforce, chains, dns, fragments, sliding, synscan

# ---------------------------------------------------------------- suppression

EV = duck("packets_ev")
for _strict in (True, False):

    def _cool(spark, d, strict=_strict):
        rows = view(spark, d, "packets_ev").select("packet_id", "ts", "src_ip", "dst_ip")
        return chains.cooldown(rows, ["src_ip", "dst_ip"], 30, strict=strict)

    _name = "cooldown_strict" if _strict else "cooldown_inclusive"
    query(_name, f"SELECT packet_id, ts, src_ip, dst_ip FROM {cooldown_sql(EV, ['src_ip', 'dst_ip'], 30, _strict)} c")(_cool)


@query("cooldown_long_keys", f"SELECT packet_id, ts, src_ip FROM {cooldown_sql(EV, ['src_ip'], 5, True)} c")
def _(spark, d):
    rows = view(spark, d, "packets_ev").select("packet_id", "ts", "src_ip")
    return chains.cooldown(rows, ["src_ip"], 5, strict=True, fold_limit=100)


# ---------------------------------------------------------------- DNS

DNS = duck("dns_ev")
LIMITS = dns.DnsLimits(length=30, length_high=90, entropy=2.5, entropy_high=3.4, rate=3, subdomains=8, txt_size=200)
QUERIES = f"""(SELECT packet_id, ts, src_ip AS src, dst_ip AS dst, qname, CASE WHEN contains(qname, '.') THEN
    array_to_string(string_split(qname, '.')[-2:], '.') ELSE qname END AS base, string_split(qname, '.')[1] AS label
    FROM (SELECT *, rtrim(dns_qname, '.') AS qname FROM {DNS} r) q WHERE dst_port = 53 AND dns_qr = 0)"""
ENTROPY = """(SELECT *, CASE WHEN length(c) = 0 THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split(c, '')),
    lambda x: -((length(c) - length(replace(c, x, ''))) / length(c)) * log2((length(c) - length(replace(c, x, ''))) / length(c)))) END AS entropy
    FROM (SELECT *, regexp_replace(lower(label), '[^\\p{L}\\p{N}]', '', 'g') AS c FROM %s q) e)"""
ENTROPY = ENTROPY.replace("%s", QUERIES)
RAPID = window_join(QUERIES, ["src", "base"], 10, "a.packet_id, a.ts, a.src, a.dst, a.base, count(*) AS n")
DNS_HITS = f"""(SELECT packet_id, ts, src, dst, 1000090 AS sid, CASE WHEN length(qname) >= 90
      THEN printf('DNS Tunnel: Unusually long domain name (%d chars): %s...', length(qname), substring(qname, 1, 50))
      ELSE printf('DNS Tunnel: Long domain name (%d chars): %s', length(qname), substring(qname, 1, 60)) END AS info
    FROM {QUERIES} a WHERE length(qname) >= 30
  UNION ALL SELECT packet_id, ts, src, dst, 1000091, printf('DNS Tunnel: %s entropy subdomain (entropy=%.2f): %s',
      CASE WHEN entropy >= 3.4 THEN 'Very high' ELSE 'High' END, entropy, label) FROM {ENTROPY} b WHERE entropy >= 2.5
  UNION ALL SELECT packet_id, ts, src, dst, 1000097, 'DNS Tunnel: Null bytes detected in DNS query' FROM {QUERIES} c WHERE contains(qname, chr(0))
  UNION ALL SELECT packet_id, ts, src, dst, 1000092, printf('DNS Tunnel: Rapid repeated queries to %s (%d in 10s)', base, n) FROM ({RAPID}) d WHERE n >= 3
  UNION ALL SELECT packet_id, ts, src, dst, 1000095, printf('DNS Tunnel: Many subdomains under %s (%d unique subdomains)', base, CAST(n AS BIGINT))
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY base ORDER BY ts, packet_id ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT *,
      CASE WHEN row_number() OVER (PARTITION BY base, qname ORDER BY ts, packet_id) = 1 THEN 1 ELSE 0 END AS fresh FROM {QUERIES} f) g) e WHERE n >= 8
  UNION ALL SELECT packet_id, ts, src_ip, dst_ip, 1000094, printf('DNS Tunnel: Large TXT record response (%d bytes) from %s', dns_txt_sizes[1], dst_ip)
    FROM {DNS} h WHERE dst_port = 53 AND dns_qr = 1 AND dns_txt_sizes[1] >= 200)"""


@query("dns_hits", f"SELECT packet_id, src, dst, sid, info FROM {DNS_HITS} h")
def _(spark, d):
    return dns.dns_hits(view(spark, d, "dns_ev"), LIMITS).select("packet_id", "src", "dst", "sid", "info")


@query(
    "dns_alerts",
    alert_sql(cooldown_sql(DNS_HITS, ["src", "sid"], 30, True), "DNSTunnelDetector", "MEDIUM", "sid", "info", "src", "dst"),
)
def _(spark, d):
    return dns.detect_dns_tunnel(view(spark, d, "dns_ev"), limits=LIMITS)


@query("label_entropy", f"SELECT packet_id, base, round(entropy, 6) AS entropy FROM {ENTROPY} e")
def _(spark, d):
    rows = dns.dns_messages(view(spark, d, "dns_ev")).where("dns_qr = 0")
    label = F.substring_index("qname", ".", 1)
    return rows.select("packet_id", "base", F.round(text.label_entropy(label), 6).alias("entropy"))


# ---------------------------------------------------------------- ARP

ARP = duck("arp_ev")


def arp_alert(hits, info):
    return alert_sql(hits, "ArpSpoofDetector", "HIGH", "1000005", info, "'ARP Protocol'", "'Local Network'")


FLOOD = f"""(WITH RECURSIVE r AS (SELECT packet_id, ts, row_number() OVER (ORDER BY ts, packet_id) AS pos FROM {ARP} a),
    cand AS (SELECT b.* FROM r b JOIN r o ON o.pos = b.pos - 24 WHERE o.ts >= b.ts - INTERVAL '10 seconds'),
    chain AS (SELECT * FROM (SELECT * FROM cand ORDER BY pos LIMIT 1) f
      UNION ALL SELECT n.* FROM chain c, LATERAL (SELECT * FROM cand WHERE cand.pos >= c.pos + 25 ORDER BY pos LIMIT 1) n)
    SELECT * FROM chain)"""


ARP_FLOODS = arp_alert(FLOOD, "'[ALERT] ARP-FLOOD Detected count=25 window=10s priority=HIGH'")
ARP_TAKEOVERS = arp_alert(
    f"(SELECT * FROM (SELECT *, lag(arp_hwsrc) OVER (PARTITION BY arp_psrc ORDER BY ts, packet_id) AS old FROM {ARP} a) b WHERE old <> arp_hwsrc)",
    "printf('[ALERT] ARP-SPOOFING / POISONING Detected IP=%s old_mac=%s new_mac=%s conflicts=2 priority=HIGH', arp_psrc, old, arp_hwsrc)",
)
ARP_GRATUITOUS = arp_alert(
    f"(SELECT * FROM {ARP} a WHERE arp_op = 2 AND arp_psrc = arp_pdst)",
    "printf('[ALERT] Suspicious Gratuitous ARP Detected IP=%s MAC=%s priority=MEDIUM', arp_psrc, arp_hwsrc)",
)


@query("arp_flood", ARP_FLOODS)
def _(spark, d):
    return arp.arp_flood(view(spark, d, "arp_ev"))


@query("arp_takeover", ARP_TAKEOVERS)
def _(spark, d):
    return arp.arp_takeover(view(spark, d, "arp_ev"))


@query(
    "previous_value",
    f"SELECT packet_id, arp_hwsrc, lag(arp_hwsrc) OVER (PARTITION BY arp_psrc ORDER BY ts, packet_id) AS previous FROM {ARP} a",
)
def _(spark, d):
    rows = view(spark, d, "arp_ev").select("packet_id", "ts", "arp_psrc", "arp_hwsrc")
    return sliding.previous_value(rows, ["arp_psrc"], "arp_hwsrc", slice_seconds=300).select("packet_id", "arp_hwsrc", "previous")


@query("arp_gratuitous", ARP_GRATUITOUS)
def _(spark, d):
    return arp.arp_gratuitous(view(spark, d, "arp_ev"))


@query("arp_all", f"{ARP_FLOODS} UNION ALL {ARP_TAKEOVERS} UNION ALL {ARP_GRATUITOUS}")
def _(spark, d):
    return arp.detect_arp(view(spark, d, "arp_ev"))


# ---------------------------------------------------------------- SYN scans


PROBES = f"""(SELECT packet_id, ts, epoch_us(ts) AS us, src_ip AS src, dst_ip AS dst, dst_port FROM {duck('packets_ev')} p0
    WHERE (tcp_flags & 18) = 2 AND dst_port IS NOT NULL)"""
# Row by row: what the source has probed in the window since its last alert, and when each target was last reported.
SYN_SCANS = f"""(WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts, packet_id) AS rn FROM {PROBES} p1),
    st AS (
      SELECT src, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS since, CAST([] AS STRUCT(k VARCHAR, t BIGINT)[]) AS told, CAST(NULL AS VARCHAR) AS kind,
             CAST(0 AS BIGINT) AS count, CAST(NULL AS VARCHAR) AS dst FROM p WHERE rn = 1
      UNION ALL
      SELECT src, rn, CASE WHEN kind IS NULL THEN since ELSE rn END,
             CASE WHEN kind IS NULL THEN told ELSE list_append(told, {{'k': CASE kind WHEN 'syn_scan_per_target' THEN 'to ' || target ELSE 'distributed' END, 't': us}}) END,
             kind, CASE kind WHEN 'syn_scan_per_target' THEN here ELSE pairs END, CASE kind WHEN 'syn_scan_per_target' THEN target ELSE 'multiple_targets' END
      FROM (SELECT *, CASE WHEN here >= 3 AND len(list_filter(told, lambda x: x.k = 'to ' || target AND us - x.t <= 30000000)) = 0 THEN 'syn_scan_per_target'
                           WHEN pairs >= 6 AND len(list_filter(told, lambda x: x.k = 'distributed' AND us - x.t <= 30000000)) = 0 THEN 'syn_scan_distributed' END AS kind
            FROM (SELECT n.src, n.rn, s.since, s.told, n.us, n.dst AS target, count(DISTINCT CASE WHEN o.dst = n.dst THEN o.dst_port END) AS here,
                         count(DISTINCT o.dst || '|' || o.dst_port) AS pairs
                  FROM st s JOIN p n ON n.src = s.src AND n.rn = s.rn + 1
                       JOIN p o ON o.src = n.src AND o.rn > s.since AND o.rn <= n.rn AND o.us >= n.us - 60000000
                  GROUP BY ALL) c) q)
    SELECT st.src, p.packet_id, p.ts, st.dst, st.kind, st.count FROM st JOIN p ON p.src = st.src AND p.rn = st.rn WHERE st.kind IS NOT NULL)"""


@query(
    "syn_scan",
    alert_sql(
        SYN_SCANS, "SynScanDetector", "HIGH", "CASE kind WHEN 'syn_scan_per_target' THEN 1000013 ELSE 1000014 END",
        "printf('[ALERT] SYN-SCAN Detected (custom detector) src=%s -> %s ports=%d window=60s priority=HIGH type=%s', src, dst, count, kind)", "src", "dst",
    ),
)
def _(spark, d):
    return synscan.detect_syn_scan(view(spark, d, "packets_ev"), window=60, ports=3, pairs=6)


# ---------------------------------------------------------------- fragments

FRAG = f"""(SELECT packet_id, ts, src_ip AS src, dst_ip AS dst, ip_id, CAST(ip_frag * 8 AS BIGINT) AS s, CAST(ip_payload_len AS BIGINT) AS size, ip_mf AS more
    FROM {duck('frag_ev')} f0 WHERE ip_mf OR ip_frag > 0)"""
FRAG_LIMITS = fragments.FragmentLimits(tiny=64, per_second=6, per_packet=4, timeout=2.0)
FOLD = f"""(WITH RECURSIVE f AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY src, dst, ip_id ORDER BY ts, packet_id) AS rn FROM {FRAG} f1),
    st AS (
      SELECT *, us AS first_us, packet_id AS first_id, [{{'a': s, 'b': s + size}}] AS frags, [s] AS offs, 1 AS n, size AS total,
             false AS overlap, false AS dup, false AS expired, us AS old_us, packet_id AS old_id, NOT more AS closed FROM f WHERE rn = 1
      UNION ALL
      SELECT packet_id, ts, src, dst, ip_id, s, size, more, us, rn, CASE WHEN fresh THEN us ELSE first_us END, CASE WHEN fresh THEN packet_id ELSE first_id END,
             list_append(held, {{'a': s, 'b': s + size}}), CASE WHEN overlap THEN kept ELSE list_append(kept, s) END,
             CASE WHEN fresh THEN 1 ELSE n + 1 END, CASE WHEN fresh THEN size ELSE total + size END,
             overlap, NOT overlap AND list_contains(kept, s), NOT closed AND us - first_us > 2000000, first_us, first_id, NOT overlap AND NOT more
      FROM (SELECT f.*, p.first_us, p.first_id, p.n, p.total, p.closed, p.closed OR f.us - p.first_us > 2000000 AS fresh,
              CASE WHEN p.closed OR f.us - p.first_us > 2000000 THEN [] ELSE p.frags END AS held,
              CASE WHEN p.closed OR f.us - p.first_us > 2000000 THEN [] ELSE p.offs END AS kept,
              len(list_filter(CASE WHEN p.closed OR f.us - p.first_us > 2000000 THEN [] ELSE p.frags END,
                lambda x: f.s < x.b AND f.s + f.size > x.a)) > 0 AS overlap
            FROM st p JOIN f ON f.src = p.src AND f.dst = p.dst AND f.ip_id = p.ip_id AND f.rn = p.rn + 1) g),
    ends AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY src, dst, ip_id ORDER BY rn DESC) = 1)
    SELECT packet_id, ts, src, dst, ip_id, 'overlap' AS kind, 0 AS value FROM st WHERE overlap
    UNION ALL SELECT packet_id, ts, src, dst, ip_id, 'duplicate', 0 FROM st WHERE dup
    UNION ALL SELECT packet_id, ts, src, dst, ip_id, 'excessive', n FROM st WHERE NOT overlap AND n > 4
    UNION ALL SELECT packet_id, ts, src, dst, ip_id, 'oversized', total FROM st WHERE NOT overlap AND total > 65535
    UNION ALL SELECT old_id, make_timestamp(old_us + 2000000), src, dst, ip_id, 'timeout', 0 FROM st WHERE expired
    UNION ALL SELECT first_id, make_timestamp(first_us + 2000000), src, dst, ip_id, 'timeout', 0 FROM ends
      WHERE NOT closed AND first_us + 2000000 < (SELECT epoch_us(max(ts)) FROM {duck('frag_ev')} z))"""
FRAG_RATE = window_join(FRAG, ["src"], 1, "a.packet_id, a.ts, a.src, count(*) AS n")
FRAG_HITS = f"""(SELECT packet_id, ts, src, dst, 1000087 AS sid, 'Fragmentation: Zero-length fragment detected' AS info FROM {FRAG} a WHERE size = 0 AND more
    UNION ALL SELECT packet_id, ts, src, dst, 1000083, printf('Fragmentation: Tiny fragment detected (%d bytes)', size) FROM {FRAG} b WHERE size > 0 AND size < 64
    UNION ALL SELECT packet_id, ts, src, 'multiple', 1000082, printf('Fragmentation: Fragment flood detected (%d frags/sec)', n) FROM ({FRAG_RATE}) c WHERE n > 6
    UNION ALL SELECT packet_id, ts, src, dst, CASE kind WHEN 'overlap' THEN 1000080 WHEN 'oversized' THEN 1000081 WHEN 'excessive' THEN 1000085
        WHEN 'timeout' THEN 1000086 ELSE 1000088 END, CASE kind WHEN 'overlap' THEN printf('Fragmentation: Overlapping fragments detected (Teardrop attack, ID:%d)', ip_id)
        WHEN 'duplicate' THEN printf('Fragmentation: Duplicate fragment offset detected (ID:%d)', ip_id)
        WHEN 'excessive' THEN printf('Fragmentation: Excessive fragments (%d) for single packet', value)
        WHEN 'oversized' THEN printf('Fragmentation: Ping of Death detected (%d bytes)', value)
        ELSE printf('Fragmentation: Incomplete reassembly timeout (ID:%d)', ip_id) END FROM {FOLD} d)"""


@query("fragment_reassembly", f"SELECT packet_id, ts, src, dst, ip_id, kind, CAST(value AS BIGINT) AS value FROM {FOLD} f")
def _(spark, d):
    return fragments.reassembly_events(view(spark, d, "frag_ev"), FRAG_LIMITS).select(
        "packet_id", "ts", "src", "dst", "ip_id", "kind", "value"
    )


@query("fragment_hits", f"SELECT packet_id, ts, src, dst, sid, info FROM {FRAG_HITS} h")
def _(spark, d):
    return fragments.fragment_hits(view(spark, d, "frag_ev"), FRAG_LIMITS)


@query(
    "fragment_alerts",
    alert_sql(cooldown_sql(FRAG_HITS, ["src", "sid"], 30, True), "FragmentationDetector", "MEDIUM", "sid", "info", "src", "dst"),
)
def _(spark, d):
    return fragments.detect_fragmentation(view(spark, d, "frag_ev"), limits=FRAG_LIMITS)


# ---------------------------------------------------------------- brute force

FAIL = f"""(SELECT packet_id, ts, dst_ip AS client, src_ip AS server, CASE src_port WHEN 22 THEN 'ssh' WHEN 21 THEN 'ftp' WHEN 80 THEN 'http'
      WHEN 25 THEN 'smtp' ELSE 'rdp' END AS service, CASE WHEN src_port = 22 THEN substring(reply, 11, 32)
      WHEN src_port = 21 AND starts_with(reply, '530') THEN string_split(reply, ' ')[2] END AS username
    FROM {duck('auth_ev')} a WHERE CASE src_port WHEN 22 THEN contains(reply, '3') WHEN 21 THEN NOT starts_with(reply, '230')
      WHEN 80 THEN reply <> 'HTTP/1.1 200 ok' WHEN 25 THEN NOT starts_with(reply, '250') ELSE substring(reply, 7, 1) IN ('(', '*') END)"""


NAMED = f"(SELECT * FROM {FAIL} n0 WHERE username IS NOT NULL AND username <> 'unknown')"


def failures(spark, d):
    return bruteforce.login_failures(view(spark, d, "auth_ev"))


@query("login_failures", f"SELECT * FROM {FAIL} f")
def _(spark, d):
    return failures(spark, d)


RATES = " UNION ALL ".join(
    alert_sql(
        "(" + window_join(f"(SELECT * FROM {FAIL} f WHERE service = '{s.name}')", ["client"], int(s.window),
                          "a.packet_id, a.ts, a.client, a.server, count(*) AS n", f"HAVING count(*) >= {s.threshold}") + ")",
        "BruteForceDetector", "HIGH", str(s.sid),
        f"printf('BRUTEFORCE - {s.human} [Severity: {s.severity}] - %d failures in {s.window}s', n)", "client", "server",
    )
    for s in bruteforce.SERVICES
)


@query("brute_force_rates", RATES)
def _(spark, d):
    return bruteforce.failure_rates(failures(spark, d))


def stuff_sql(seconds):
    return f"""(WITH f AS (SELECT * FROM {FAIL} f0), o AS (SELECT client, service, min({{'t': ts, 'p': packet_id}}) AS born FROM f GROUP BY ALL),
    near AS (SELECT DISTINCT a.packet_id, a.ts, a.client, a.server, b.service FROM f a JOIN f b ON a.client = b.client
      AND b.ts BETWEEN a.ts - INTERVAL '{seconds} seconds' AND a.ts AND (b.ts < a.ts OR b.packet_id <= a.packet_id))
    SELECT n.packet_id, n.ts, n.client, n.server, string_agg(n.service, ', ' ORDER BY o.born) AS active FROM near n JOIN o USING (client, service)
    GROUP BY ALL HAVING count(*) >= 3)"""


def stuffing(seconds):
    info = "'BRUTEFORCE - Multi-service credential stuffing detected (targeting ' || active || ')'"
    return alert_sql(stuff_sql(seconds), "BruteForceDetector", "HIGH", "1000025", info, "client", "server")


@query(
    "credential_stuffing",
    stuffing(20),
)
def _(spark, d):
    return bruteforce.credential_stuffing(failures(spark, d), window=20)


ENUM = f"""(WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY client, service ORDER BY ts, packet_id) AS rn FROM {FAIL} f0
        WHERE username IS NOT NULL AND username <> 'unknown'),
    st AS (SELECT *, [username] AS names, 1 AS found FROM f WHERE rn = 1
      UNION ALL SELECT f.*, CASE WHEN len(p.names) >= 10 THEN [f.username] WHEN list_contains(p.names, f.username) THEN p.names
          ELSE list_append(p.names, f.username) END, 0 FROM st p JOIN f ON f.client = p.client AND f.service = p.service AND f.rn = p.rn + 1)
    SELECT * FROM st WHERE len(names) = 10)"""
# The set is emptied by the alert, so a row repeating a name of a full set starts a new one.
SID_SQL = "CASE service WHEN 'ssh' THEN 1000020 WHEN 'rdp' THEN 1000021 WHEN 'ftp' THEN 1000022 WHEN 'http' THEN 1000023 ELSE 1000024 END"


ENUMERATIONS = alert_sql(
    ENUM, "BruteForceDetector", "HIGH", f"{SID_SQL} + 100",
    "'BRUTEFORCE - Username enumeration detected on ' || upper(service) || ' (10 usernames attempted)'", "client", "server",
)


@query("username_enumeration", ENUMERATIONS)
def _(spark, d):
    return bruteforce.username_enumeration(failures(spark, d))


def slow_sql(seconds):
    us = seconds * 1_000_000
    return f"""(WITH RECURSIVE f AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY client ORDER BY ts, packet_id) AS pos,
        epoch_us(min(ts) OVER (PARTITION BY client)) AS begin_us FROM {FAIL} f0),
    st AS (SELECT f.*, pos AS total, us - begin_us AS len_us FROM f WHERE pos >= 30 AND us - begin_us >= {us}
             QUALIFY row_number() OVER (PARTITION BY client ORDER BY pos) = 1
      UNION ALL SELECT n.*, n.pos - c.pos, n.us - c.us FROM st c, LATERAL (SELECT * FROM f WHERE f.client = c.client AND f.pos >= c.pos + 30
             AND f.us >= c.us + {us} ORDER BY pos LIMIT 1) n)
    SELECT * FROM st)"""


def slow(seconds):
    info = "printf('BRUTEFORCE - Slow brute-force attack detected (%d attempts over %.1f minutes)', total, len_us / 60000000.0)"
    return alert_sql(slow_sql(seconds), "BruteForceDetector", "HIGH", f"{SID_SQL} + 200", info, "client", "server")


@query(
    "slow_attempts",
    slow(300),
)
def _(spark, d):
    return bruteforce.slow_attempts(failures(spark, d), span=300.0)


ALL_BRUTE = f"{RATES} UNION ALL {stuffing(300)} UNION ALL {ENUMERATIONS} UNION ALL {slow(3600)}"


@query("brute_force_all", ALL_BRUTE)
def _(spark, d):
    return bruteforce.detect_brute_force(view(spark, d, "auth_ev"))
