"""Payload patterns, URL decoding and HTTP parsing over ``pages``, ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import alert_sql, cooldown_sql, query
from checks.views import duck, view
from packetloom.functions import text
from packetloom.operators import patterns as pt

# RE2 spelling of the shorthand classes, which there cover ASCII only.
CLASSES = {r"\s": r"[\s\x0B\x{85}\p{Z}]", r"\w": r"[\p{L}\p{N}_]", r"\d": r"\p{Nd}"}


def re2(pattern: str, ignore_case=True) -> str:
    dotall = pattern.startswith("(?s)")
    body = pattern.removeprefix("(?s)").replace(r"\%", "%").replace(r"\`", "`")
    for short, spelled in CLASSES.items():
        body = body.replace(short, spelled)
    flags = ("i" if ignore_case else "") + ("s" if dotall else "")
    return (f"(?{flags})" if flags else "") + body.replace("'", "''")


def found(subject, pattern):
    return f"regexp_matches({subject}, '{re2(pattern, pattern not in pt.CASE_SENSITIVE)}')"


def any_found(subject, patterns):
    return "(" + " OR ".join(found(subject, p) for p in patterns) + ")"


DECODE = "raw"
for _ in range(3):
    DECODE = f"url_decode(replace(url_decode({DECODE}), '+', ' '))"


def tests_sql(detector):
    table = {"SQLiDetector": pt.SQLI_PATTERNS, "XSSDetector": pt.XSS_PATTERNS, "RCEDetector": pt.RCE_PATTERNS}[detector]
    for sid, (info, patterns) in table.items():
        subject = "raw" if sid in pt.RAW_FAMILIES else "decoded"
        if sid in pt.BYTE_FAMILIES:
            subject = "regexp_replace(raw, '[^\\x{00}-\\x{ff}]', '', 'g')"
        yield sid, info, any_found(subject, patterns)
    if detector == "SQLiDetector":
        kinds = " + ".join(f"CAST({found('decoded', p)} AS INT)" for p in pt.SQL_COMMENTS)
        yield *pt.COMMENT_BYPASS, f"({found('decoded', pt.SQL_KEYWORDS)} AND {kinds} >= 2)"
        shown = " OR ".join(f"({found('decoded', p)} AND NOT {found('raw', p)})" for p in pt.SQLI_PATTERNS[1000040][1])
        count = lambda s: f"len(regexp_extract_all({s}, '{re2(pt.SQL_KEYWORDS)}'))"
        yield *pt.ENCODING_BYPASS, f"(raw <> decoded AND ({shown} OR ({count('decoded')} > {count('raw')} AND {count('decoded')} >= 2)))"


def gate_sql(detector):
    ports = pt.SQLI_PORTS if detector == "SQLiDetector" else pt.WEB_PORTS
    listed = ", ".join(map(str, ports))
    port = f"(src_port IN ({listed}) OR dst_port IN ({listed}))"
    if detector == "SQLiDetector":
        return port + " AND regexp_matches(raw, '^(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH) ')"
    if detector == "XSSDetector":
        return port + " AND (starts_with(raw, 'GET ') OR starts_with(raw, 'POST '))"
    return port + " AND (starts_with(raw, 'POST') OR contains(raw, 'Content-Type'))"


def hits_sql(rel, detector):
    base = f"(SELECT *, {DECODE} AS decoded FROM (SELECT packet_id, ts, src_ip, dst_ip, src_port, dst_port, txt AS raw FROM {rel} v) w)"
    gated = f"(SELECT * FROM {base} b WHERE {gate_sql(detector)})"
    parts = [
        f"SELECT packet_id, ts, src_ip AS src, dst_ip AS dst, {sid} AS sid, '{info.replace(chr(39), chr(39) * 2)}' AS info FROM gated WHERE {test}"
        for sid, info, test in tests_sql(detector)
    ]
    return f"(WITH gated AS MATERIALIZED {gated} " + " UNION ALL ".join(parts) + ")"


def suppressed_sql(hits, detector):
    if detector == "SQLiDetector":
        return cooldown_sql(hits, ["src", "sid"], 30, False)
    if detector == "XSSDetector":
        return cooldown_sql(hits, ["src", "sid"], 60, True)
    groups = {60: "sid NOT IN (1000051, 1000055, 1000062, 1000063)", 90: "sid IN (1000055, 1000062, 1000063)", 120: "sid = 1000051"}
    parts = [cooldown_sql(f"(SELECT * FROM {hits} x WHERE {test})", ["src", "sid"], s, False) for s, test in groups.items()]
    return "(" + " UNION ALL ".join(f"SELECT * FROM {p} y" for p in parts) + ")"


for _name, _detector, _run in (
    ("sqli", "SQLiDetector", pt.detect_sqli),
    ("xss", "XSSDetector", pt.detect_xss),
    ("rce", "RCEDetector", pt.detect_rce),
):
    for _view in ("http_ev", "post_ev"):
        _kind = "pages" if _view == "http_ev" else "documents"

        def _hits(spark, d, detector=_detector, source=_view):
            return pt.pattern_hits(view(spark, d, source), [detector]).select("packet_id", "src", "dst", "sid", "info")

        def _alerts(spark, d, run=_run, source=_view):
            return run(view(spark, d, source))

        _sql = hits_sql(duck(_view), _detector)
        query(f"{_name}_hits_{_kind}", f"SELECT packet_id, src, dst, sid, info FROM {_sql} h")(_hits)
        query(
            f"{_name}_alerts_{_kind}",
            alert_sql(suppressed_sql(_sql, _detector), _detector, "CRITICAL", "sid", "info", "src", "dst"),
        )(_alerts)


@query(
    "payload_hits_all_detectors",
    " UNION ALL ".join(f"SELECT packet_id, ts, src, dst, '{name}' AS detector, sid, info FROM {hits_sql(duck('post_ev'), name)} h_{name}" for name in pt.PAYLOAD_DETECTORS),
)
def _(spark, d):
    return pt.pattern_hits(view(spark, d, "post_ev"))


ENCODED = "concat('q=', replace(replace(text, ' ', '+'), 'e', '%2565'), '%', 'a%2', '%252B+1')"
DECODE_ENC = "x"
for _ in range(3):
    DECODE_ENC = f"url_decode(replace(url_decode({DECODE_ENC}), '+', ' '))"


@query("deep_url_decode", f"SELECT conv_id, turn, {DECODE_ENC} AS decoded FROM (SELECT conv_id, turn, {ENCODED} AS x FROM conversations) c")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return rows.select("conv_id", "turn", text.deep_url_decode(F.expr(ENCODED)).alias("decoded"))


@query(
    "ascii_and_utf8_text",
    "SELECT doc_id, regexp_replace(text, '[^\\x{00}-\\x{7f}]', '', 'g') AS ascii, length(text) AS chars FROM documents",
)
def _(spark, d):
    payload = F.col("text").cast("binary")
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return rows.select("doc_id", text.ascii_text(payload).alias("ascii"), F.length(text.utf8_text(payload)).alias("chars"))


@query(
    "http_request_uri",
    f"""SELECT packet_id, string_split(split_part(txt, chr(13) || chr(10), 1), ' ')[2] AS uri,
        regexp_matches(txt, '^(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH) ') AS is_request FROM {duck('http_ev')} h""",
)
def _(spark, d):
    rows = view(spark, d, "http_ev")
    return rows.select(
        "packet_id", text.http_uri(F.col("payload")).alias("uri"), text.is_http_request(F.col("txt")).alias("is_request")
    )


@query(
    "http_headers",
    f"SELECT packet_id, 'h' || CAST(packet_id % 9 AS VARCHAR) AS host, 'text/plain' AS content_type, 2 AS n_headers FROM {duck('post_ev')} h",
)
def _(spark, d):
    headers = text.http_headers(F.col("payload"))
    return view(spark, d, "post_ev").select(
        "packet_id",
        text.header_value(headers, "Host").alias("host"),
        text.header_value(headers, "content-type").alias("content_type"),
        F.size(headers).alias("n_headers"),
    )
