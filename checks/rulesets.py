"""Rule parsing and packet-rule matching; rule lines are derived from ``supplier``."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import cooldown_sql, query
from checks.traffic import LABELLED
from checks.views import duck, view
from packetloom.operators import matching
from packetloom.operators.durable import checkpointed
from packetloom.operators.rollups import labelled
from packetloom.sources import rules as rl
from packetloom.sources.capture import spread

LINES = duck("rules_ev")
TEXT = f"(SELECT line, trim(text) AS text FROM {LINES} l WHERE trim(text) <> '' AND NOT starts_with(trim(text), '#'))"
OPTIONED = "regexp_matches(text, '^(alert|drop) ') AND contains(text, '(')"
# Positional rules in DuckDB: words, then address and port of each side.
SIMPLE = f"""(SELECT line, text, w, CASE WHEN len(w) = 6 THEN split_part(w[1], ':', 1) ELSE '' END AS sid, w[len(w) - 4] AS proto,
    split_part(w[len(w) - 3], ':', 1) AS src_ip, split_part(w[len(w) - 3], ':', 2) AS src_port, w[len(w) - 2] AS direction,
    split_part(w[len(w) - 1], ':', 1) AS dst_ip, split_part(w[len(w) - 1], ':', 2) AS dst_port, w[len(w)] AS payload
    FROM (SELECT line, text, string_split(text, ' ') AS w FROM {TEXT} t WHERE NOT ({OPTIONED})) s WHERE len(w) IN (5, 6))"""


def arrivals(spark, d):
    """Packets as they come; meeting every class of rules costs more than dealing them out, as splits within a row group are empty."""
    packets = view(spark, d, "packets_ev")
    return packets.repartition(max(spark.sparkContext.defaultParallelism, packets.rdd.getNumPartitions()))


def rule_table(spark, d):
    """Parsed rules; parsing a line costs more than spreading the single split."""
    return rl.parse_rules(spread(view(spark, d, "rules_ev")))


def simple_rules(spark, d):
    return rule_table(spark, d).where("kind = 'simple'")


@query(
    "rules_positional",
    f"SELECT line, sid, proto, src_ip, src_port, direction, dst_ip, dst_port, payload, proto || ' ' || src_ip || ':' || src_port || ' ' || direction || ' ' || dst_ip || ':' || dst_port || ' ' || payload AS rule_text, 'ruleID ' || sid AS name FROM {SIMPLE} s",
)
def _(spark, d):
    rows = rl.usable(simple_rules(spark, d)).withColumn("name", rl.rule_name())
    return rows.select("line", "sid", "proto", "src_ip", "src_port", "direction", "dst_ip", "dst_port", "payload", "rule_text", "name")


OPT = f"(SELECT line, text, regexp_extract(text, '\\((.*)\\)', 1) AS block, string_split(trim(split_part(text, '(', 1)), ' ') AS h FROM {TEXT} t WHERE {OPTIONED})"


def opt(key, pattern="([^;]*)"):
    return f"trim(regexp_extract(block, '[ ;]{key}:{pattern};', 1))"


@query(
    "rules_options",
    f"""SELECT line, h[1] AS action, CASE WHEN len(h) < 7 THEN 'ip' ELSE h[2] END AS protocol, CASE WHEN len(h) < 7 THEN 'any' ELSE h[3] END AS src_ip,
        CASE WHEN len(h) < 7 THEN 'any' ELSE h[7] END AS dst_port, {opt('sid')} AS sid, {opt('msg', '"([^"]*)"')} AS msg, {opt('flow')} AS flow,
        CASE WHEN contains(block, 'service:http') OR len(h) < 7 THEN 'http' ELSE '' END AS service,
        CASE WHEN contains(block, '"SCRIPT"') THEN 'SCRIPT' ELSE {opt('content', '"([^"]*)"[^;]*')} END AS content,
        contains(block, 'nocase') AS nocase, CASE WHEN contains(block, 'depth 40') THEN 40 ELSE 0 END AS depth,
        contains(block, 'fast_pattern') AS fast_pattern, try_cast({opt('itype')} AS INT) AS itype, try_cast({opt('id')} AS INT) AS icmp_id,
        CASE WHEN contains(block, 'flags:S') THEN 2 ELSE 0 END AS flags_mask, {opt('rev')} AS rev, {opt('classtype')} AS classtype,
        {opt('byte_test')} AS byte_test, regexp_extract(block, 'track ([a-z_]+)', 1) AS track, try_cast(regexp_extract(block, 'count ([0-9]+)', 1) AS INT) AS count
        FROM {OPT} o""",
)
def _(spark, d):
    rows = rule_table(spark, d).where("kind = 'snort'")
    return rows.select(
        "line", "action", "protocol", "src_ip", "dst_port", "sid", "msg", "flow", "service", "content", "nocase", "depth",
        "fast_pattern", "itype", "icmp_id", "flags_mask", "rev", "classtype", "byte_test",
        F.coalesce("detection_filter.track", F.lit("")).alias("track"), F.col("detection_filter.count").alias("count"),
    )


@query("rules_rejected", f"SELECT line, text, 'unrecognised rule format: ' || text AS error FROM {TEXT} t WHERE NOT ({OPTIONED}) AND len(string_split(text, ' ')) NOT IN (5, 6)")
def _(spark, d):
    return rl.rejected(rule_table(spark, d))


@query(
    "rules_verified",
    f"""SELECT line, trim(text) AS text, CASE WHEN trim(text) = '' THEN 'Empty' ELSE 'Invalid' END || ' rule at position ' || line AS problem
        FROM {LINES} l WHERE NOT (trim(text) <> '' AND ({OPTIONED} OR len(string_split(trim(text), ' ')) IN (5, 6)) AND NOT starts_with(text, '#'))""",
)
def _(spark, d):
    return rl.verify_rules(view(spark, d, "rules_ev"))


@query("rules_catalogue", f"SELECT line, trim(text) AS text, starts_with(text, '#') AS is_comment, trim(text) = '' AS is_empty FROM {LINES} l")
def _(spark, d):
    return rl.catalogue(view(spark, d, "rules_ev"))


@query(
    "rule_variables",
    f"""SELECT line, src_neg, src_terms, dst_neg, dst_terms, port_lo FROM (SELECT line, false AS src_neg,
        CASE h[3] WHEN '$HOME_NET' THEN 3 WHEN '10.0.0.0/28' THEN 1 ELSE 0 END AS src_terms, starts_with(h[6], '!') AS dst_neg,
        CASE WHEN h[6] IN ('any', '$EXTERNAL_NET', '!$NOPE') THEN 0 ELSE 1 END AS dst_terms,
        CASE WHEN h[7] = '$HTTP_PORTS' THEN 80 WHEN h[7] = '80:' THEN 80 WHEN h[7] = '!22' THEN 22 WHEN starts_with(h[7], '[53,') THEN 53
             WHEN h[7] = '[1:200]' THEN 1 END AS port_lo FROM {OPT} o WHERE len(h) = 7) q""",
)
def _(spark, d):
    rows = rule_table(spark, d).where("kind = 'snort' and text not like 'alert http%'")
    return rows.select(
        "line",
        F.col("src_nets.neg").alias("src_neg"),
        F.size("src_nets.terms").alias("src_terms"),
        F.col("dst_nets.neg").alias("dst_neg"),
        F.size("dst_nets.terms").alias("dst_terms"),
        F.get("dst_ports.terms", F.lit(0))["lo"].alias("port_lo"),
    )


@query("rules_both_directions", f"SELECT line, src_ip, dst_ip, dst_port, false AS turned FROM {SIMPLE} s UNION ALL SELECT line, dst_ip, src_ip, src_port, true FROM {SIMPLE} t WHERE direction = '<>'")
def _(spark, d):
    return rl.both_directions(rl.usable(simple_rules(spark, d))).select("line", "src_ip", "dst_ip", "dst_port", "turned")


# ---------------------------------------------------------------- matching


def plain_port(rule, actual):
    core = f"ltrim({rule}, '!')"
    neg = f"starts_with({rule}, '!')"
    inside = f"{actual} BETWEEN CAST(split_part(trim({core}, '[]'), '-', 1) AS INT) AND CAST(split_part(trim({core}, '[]'), '-', 2) AS INT)"
    return f"""CASE WHEN {rule} = 'any' THEN true WHEN starts_with({core}, '[') THEN coalesce({inside} <> {neg}, false)
        ELSE ({core} = coalesce(CAST({actual} AS VARCHAR), 'any')) <> {neg} END"""


def plain_ip(rule, actual):
    return f"CASE WHEN {rule} = 'any' THEN true WHEN starts_with({rule}, '!') THEN substring({rule}, 2) <> {actual} ELSE {rule} = {actual} END"


SIMPLE_HIT = f"""(r.proto IN ('any', 'IP') OR r.proto = p.proto) AND {plain_ip('r.src_ip', 'p.src_ip')} AND {plain_ip('r.dst_ip', 'p.dst_ip')}
    AND {plain_port('r.src_port', 'p.src_port')} AND {plain_port('r.dst_port', 'p.dst_port')}"""
LABELS = f"(SELECT line, proto || ' ' || src_ip || ':' || src_port || ' ' || direction || ' ' || dst_ip || ':' || dst_port || ' ' || payload AS label FROM {SIMPLE} s)"
FIRST = f"""(SELECT p.*, m.line AS rule_pos, l.label AS matched_rule FROM {LABELLED} p LEFT JOIN (SELECT p.packet_id, min(r.line) AS line FROM {LABELLED} p
    JOIN {SIMPLE} r ON {SIMPLE_HIT} GROUP BY p.packet_id) m USING (packet_id) LEFT JOIN {LABELS} l ON l.line = m.line)"""
SHOW = "packet_id, rule_pos, matched_rule, rule_pos IS NOT NULL AS is_alert, CASE WHEN rule_pos IS NULL THEN 'LOW' ELSE 'CRITICAL' END AS threat"
OUT = ["packet_id", "rule_pos", "matched_rule", "is_alert", "threat"]


def traffic(spark, d):
    """Labelled packets; testing every rule costs far more than spreading the single split."""
    return labelled(spread(view(spark, d, "packets_ev")))


@query("rule_first_match", f"SELECT {SHOW} FROM {FIRST} f")
def _(spark, d):
    return matching.first_match(traffic(spark, d), simple_rules(spark, d)).select(*OUT)


@query("rule_first_match_compiled", f"SELECT {SHOW} FROM {FIRST} f")
def _(spark, d):
    rows = matching.leading(rl.usable(simple_rules(spark, d))).collect()
    return matching.first_match_compiled(traffic(spark, d), rows).select(*OUT)


@query("rule_first_match_indexed", f"SELECT {SHOW} FROM {FIRST} f")
def _(spark, d):
    return matching.first_match_indexed(traffic(spark, d), rl.usable(simple_rules(spark, d)), chunk_rules=20).select(*OUT)


@query(
    "rule_first_match_rollup",
    f"SELECT proto, CASE WHEN rule_pos IS NULL THEN 'LOW' ELSE 'CRITICAL' END AS threat, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM {FIRST} f GROUP BY ALL",
)
def _(spark, d):
    matched = matching.first_match(traffic(spark, d), simple_rules(spark, d))
    return matched.groupBy("proto", "threat").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))


@query(
    "threat_counts",
    f"SELECT t.threat, count(f.packet_id) AS packets FROM (SELECT unnest(['LOW','MEDIUM','HIGH','CRITICAL']) AS threat) t LEFT JOIN (SELECT packet_id, CASE WHEN rule_pos IS NULL THEN 'LOW' ELSE 'CRITICAL' END AS threat FROM {FIRST} f0) f USING (threat) GROUP BY t.threat",
)
def _(spark, d):
    from packetloom.operators.rollups import threat_counts

    return threat_counts(matching.first_match(traffic(spark, d), simple_rules(spark, d)))


@query(
    "rule_match_alerts",
    f"""SELECT ts, 'RuleMatch' AS detector, CAST(NULL AS INT) AS sid, 'CRITICAL' AS threat, 'Rule Match' AS type, src_ip AS src, dst_ip AS dst, proto,
        matched_rule AS rule, concat_ws(' ', proto, concat_ws(':', src_ip, src_port), '>', concat_ws(':', dst_ip, dst_port)) AS info, packet_id
        FROM {FIRST} f WHERE rule_pos IS NOT NULL""",
)
def _(spark, d):
    return matching.rule_match_alerts(matching.first_match(traffic(spark, d), simple_rules(spark, d)))


LOG_RULES = f"(SELECT line, proto, src_ip, src_port, dst_ip, dst_port, payload FROM {SIMPLE} a UNION ALL SELECT line, proto, dst_ip, dst_port, src_ip, src_port, payload FROM {SIMPLE} b WHERE direction = '<>')"


def log_port(rule, actual):
    core = f"trim(ltrim({rule}, '!'), '[]')"
    return f"""CASE WHEN {rule} = 'any' OR {actual} IS NULL THEN true ELSE ({actual} BETWEEN CAST(split_part({core}, '-', 1) AS INT)
        AND CAST(CASE WHEN contains({core}, '-') THEN split_part({core}, '-', 2) ELSE {core} END AS INT)) <> starts_with({rule}, '!') END"""


@query(
    "log_analyser_match",
    f"""SELECT p.packet_id, min(r.line) AS rule_pos FROM (SELECT *, CASE ip_proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS tr FROM {LABELLED} p0) p
        JOIN {LOG_RULES} r ON (r.proto = 'any' OR r.proto = tr OR (r.proto = 'IP' AND tr <> 'ICMP')) AND {plain_ip('r.src_ip', 'p.src_ip')}
        AND {plain_ip('r.dst_ip', 'p.dst_ip')} AND {log_port('r.src_port', 'p.src_port')} AND {log_port('r.dst_port', 'p.dst_port')} AND r.payload IN ('*', 'any')
        GROUP BY p.packet_id""",
)
def _(spark, d):
    rules = rl.both_directions(rl.usable(simple_rules(spark, d)))
    return matching.log_matches(traffic(spark, d), rules)


# Option rules: what each template of ``rules_ev`` asks for, written out.
KIND = "(line - 1) % 20"
STAGED = f"""(SELECT p.packet_id, p.ts, p.src_ip, p.dst_ip, r.line AS rule_pos, CAST(r.line - 1 AS VARCHAR) AS sid, {KIND} AS kind FROM {LABELLED} p
    JOIN (SELECT line, (line - 1) % 8 + 1 AS t FROM {TEXT} x WHERE {OPTIONED}) r ON CASE {KIND}
    WHEN 9 THEN tcp_flags IS NOT NULL AND p.dst_ip = '192.168.0.' || t AND dst_port BETWEEN 1 AND 200 AND (tcp_flags & 2) <> 0 AND src_port >= dst_port
    WHEN 10 THEN ip_proto = 17 AND CAST(split_part(p.src_ip, '.', 4) AS INT) < 16 AND dst_port IN (53, (line - 1) % 500)
    WHEN 11 THEN icmp_type = 8 AND icmp_code = 0 AND icmp_id = (line - 1) % 100
    WHEN 12 THEN tcp_flags IS NOT NULL AND dst_port IN (80, 443, 8080, 8443) AND (tcp_flags & 16) <> 0 AND dst_port >= src_port
    ELSE false END)"""


@query("rule_all_matches", f"SELECT packet_id, rule_pos, sid FROM {STAGED} s")
def _(spark, d):
    rules = rule_table(spark, d).where("kind = 'snort'")
    return matching.all_matches(arrivals(spark, d), rules, chunk_rules=30).select("packet_id", "rule_pos", "sid")


FILTERED = f"""(SELECT * FROM {STAGED} s WHERE kind IN (9, 10) UNION ALL
    SELECT a.* FROM {STAGED} a JOIN {STAGED} b ON a.sid = b.sid AND a.src_ip = b.src_ip AND b.ts BETWEEN a.ts - INTERVAL '60 seconds' AND a.ts
      AND (b.ts < a.ts OR b.packet_id <= a.packet_id) WHERE a.kind = 11 GROUP BY ALL HAVING count(*) >= 3 UNION ALL
    SELECT a.* FROM {STAGED} a JOIN {STAGED} b ON a.sid = b.sid AND a.dst_ip = b.dst_ip AND b.ts BETWEEN a.ts - INTERVAL '30 seconds' AND a.ts
      AND (b.ts < a.ts OR b.packet_id <= a.packet_id) WHERE a.kind = 12 GROUP BY ALL HAVING count(*) >= 2)"""


@query("rule_detection_filter", f"SELECT packet_id, rule_pos, sid FROM {FILTERED} f")
def _(spark, d):
    few, members = matching.stand_ins(rule_table(spark, d).where("kind = 'snort'"))
    hits = matching.all_matches(arrivals(spark, d), few).select("packet_id", "ts", "src_ip", "dst_ip", "rule_pos", "sid", "detection_filter")
    kept = matching.detection_filter(checkpointed(hits))  # hits with and without a threshold come from one pass
    return matching.with_members(kept, members).select("packet_id", "rule_pos", "sid")


@query(
    "signature_alerts",
    f"SELECT packet_id, ts, sid, src_ip, dst_ip FROM {cooldown_sql(f'(SELECT * FROM {FILTERED} f WHERE dst_ip NOT LIKE {chr(39)}%.255{chr(39)})', ['sid', 'src_ip', 'dst_ip'], 60, False)} c",
)
def _(spark, d):
    rules = rule_table(spark, d).where("kind = 'snort'")
    return matching.signature_alerts(arrivals(spark, d), rules).select("packet_id", "ts", "sid", "src_ip", "dst_ip")


WEB = duck("http_ev")


@query(
    "rule_content_matches",
    f"""SELECT packet_id, line AS rule_pos FROM {WEB} p JOIN (SELECT line, {KIND} AS kind FROM {TEXT} x WHERE {OPTIONED}) r ON CASE kind
        WHEN 14 THEN contains(lower(txt), 'script') AND dst_port <> 22
        WHEN 15 THEN dst_port = 80 AND contains(txt, '&') AND (contains(txt, 'Content-Length:') OR contains(txt, 'application/x-www-form-urlencoded'))
        ELSE false END""",
)
def _(spark, d):
    rules = rule_table(spark, d).where("kind = 'snort' and content <> ''")
    return matching.all_matches(view(spark, d, "http_ev"), rules).select("packet_id", "rule_pos")


@query(
    "rule_pcre_matches",
    f"SELECT packet_id, line AS rule_pos FROM {WEB} p JOIN (SELECT line FROM {TEXT} x WHERE {KIND} = 17) r ON regexp_matches(txt, '(?i)se(le)ct')",
)
def _(spark, d):
    rules = rule_table(spark, d).where("pcre <> ''")

    def searched(r):
        return matching.staged_match(r, pcre="on")

    return matching.all_matches(view(spark, d, "http_ev"), rules, condition=searched).select("packet_id", "rule_pos")


@query(
    "http_header_and_uri_contains",
    f"""SELECT packet_id, contains('h' || packet_id % 9, '3') AS in_header, contains(lower(string_split(split_part(txt, chr(13) || chr(10), 1), ' ')[2]), 'script') AS in_uri
        FROM {WEB} h""",
)
def _(spark, d):
    rows = matching.prepared(view(spark, d, "http_ev"))
    return rows.select(
        "packet_id",
        matching.header_contains(F.col("payload"), "h3").alias("in_header"),
        matching.uri_contains(F.col("payload"), "SCRIPT", nocase=True).alias("in_uri"),
    )


PROTOCOLS = "CASE r_regionkey WHEN 0 THEN 6 WHEN 1 THEN 17 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE 2 END"


@query(
    "rule_ip_protocol",
    f"""SELECT packet_id, CAST(7000 + r_regionkey AS VARCHAR) AS sid FROM {duck("packets_ev")} p, (SELECT r_regionkey, {PROTOCOLS} AS wanted FROM region) r
        WHERE ip_proto IS NOT NULL AND wanted IN (0, ip_proto)""",
)
def _(spark, d):
    """Rules that ask for a protocol number of the IP header; 0 asks for none."""
    text = F.concat(F.lit("alert ip any any -> any any ( ip_proto:"), F.expr(PROTOCOLS), F.lit('; msg:"number"; sid:'), 7000 + F.col("r_regionkey"), F.lit("; )"))
    lines = spark.read.parquet(f"{d}/region.parquet").select((F.col("r_regionkey") + 1).cast("int").alias("line"), text.alias("text"))
    rules = rl.usable(rl.parse_rules(lines))
    return matching.all_matches(view(spark, d, "packets_ev"), rules).select("packet_id", "sid")
