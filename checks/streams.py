"""Streams that are stopped and resumed, repeated batches, late rows, streamed classification and a streamed feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.feeds import BOTH, COUNT_OUT, EV, PAIR, SLIDING, folder, in_turns, landed, over, two_detections
from checks.flows import ALIGNED, BENIGN, BUCKET, FEATURES
from checks.registry import query
from checks.traffic import BARE_SYN, ICMP, PORTED, SMALL, SYN, UDP, dos_sql
from checks.views import view
from packetloom.functions.timecols import micros
from packetloom.operators import classify as cl
from packetloom.operators.durable import fresh
from packetloom.operators.programs import SlidingCount
from packetloom.sources import alertlog
from packetloom.streaming import detectors, flows as st, sinks


RATES = "(" + " UNION ALL ".join(dos_sql(rel, name, keys, value=value) for rel, name, keys, value in (
    (BARE_SYN, "syn", PAIR, None), (SYN, "syn_port_scan", PAIR, "dst_port"), (UDP, "udp", [*PAIR, "dst_port"], None),
    (UDP, "udp_port_scan", PAIR, "dst_port"), (ICMP, "icmp", PAIR, None), (PORTED, "port_scan", PAIR, "dst_port"))) + ")"


@query("stream_resumed", SLIDING)
def _(spark, d):
    """Stopped after two of five files; a new stream over the same folder goes on from the checkpoint when the others have landed."""
    rows, path, to = view(spark, d, "packets_ev"), fresh(spark, "landed"), folder(spark)
    parts = in_turns(rows)

    def counts():
        return st.stream_scan(over(spark, path, rows.schema), PAIR, SlidingCount(20), COUNT_OUT)

    for part in parts[:2]:
        part.write.mode("append").parquet(path)
    st.run_available(counts(), to)
    for part in parts[2:]:
        part.write.mode("append").parquet(path)
    return st.run_to_end(counts(), to).drop("at")


TWICE = f"SELECT kind, info, sid, src, dst, count(*) AS n FROM (SELECT *, unnest(['table', 'log']) AS kind FROM {BOTH} b) t GROUP BY ALL"


@query("stream_alert_sinks", TWICE)
def _(spark, d):
    """Alerts to a table and a log; every batch comes twice, the second time after a failure between the two."""
    to = folder(spark)
    write = sinks.alert_sinks(to)

    def repeated(alerts, batch):
        sinks.put_batch(alerts, f"{to}/alerts", batch)  # as far as a batch that failed came
        write(alerts, batch)
        write(alerts, batch)

    st.run_sinks(landed(spark, two_detections(view(spark, d, "packets_ev"))), repeated, f"{to}/checkpoint")
    table = spark.read.parquet(f"{to}/alerts").select(F.lit("table").alias("kind"), "info", "sid", "src", "dst")
    log = alertlog.parse_log_lines(spark.read.text(f"{to}/log")).select(F.lit("log").alias("kind"), "info", "sid", "src", "dst")
    return table.unionByName(log).groupBy("kind", "info", "sid", "src", "dst").agg(F.count("*").alias("n"))


CHUNK = 50_000
#: Flows land in so many files by ranges of their keys, of which a batch takes some; totals are kept by chunk.
FILES, FILES_A_BATCH = 48, 12


@query(
    "stream_flow_progress",
    f"""SELECT row_number() OVER (ORDER BY chunk) - 1 AS batch, total_rows, benign, attacks, critical, tcp, round(benign / total_rows * 100, 1) AS benign_pct,
        round(least(total_rows / (SELECT count(*) FROM {ALIGNED} f) * 100, 100), 1) AS pct FROM (SELECT chunk, CAST(sum(n) OVER w AS BIGINT) AS total_rows,
        CAST(sum(b) OVER w AS BIGINT) AS benign, CAST(sum(n - b) OVER w AS BIGINT) AS attacks, CAST(sum(c) OVER w AS BIGINT) AS critical, CAST(sum(t) OVER w AS BIGINT) AS tcp
        FROM (SELECT flow_key // {CHUNK} AS chunk, count(*) AS n, count_if({BENIGN}) AS b, count_if({BUCKET} = 'CRITICAL') AS c, count_if(protocol = 6) AS t
        FROM {ALIGNED} a GROUP BY 1) g WINDOW w AS (ORDER BY chunk)) q""",
)
def _(spark, d):
    """Flows that land in ranges of chunks, classified batch by batch and counted chunk by chunk; every batch comes twice."""
    flows, path, to = view(spark, d, "flows_ev"), fresh(spark, "landed"), folder(spark)
    means = cl.feature_means(flows, FEATURES).first().asDict()
    chunk = F.floor(F.col("flow_key") / CHUNK)
    flows.repartitionByRange(FILES, "flow_key").write.parquet(path)
    landing = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", FILES_A_BATCH).parquet(path)

    def predict(rows):  # the given label stands in for the prediction
        return cl.align(rows.withColumn("prediction", F.col("label")), FEATURES, means, ["flow_key", "prediction"])

    write = sinks.classified_sink(to, predict, step=chunk)

    def repeated(rows, batch):
        write(rows, batch)
        write(rows, batch)

    st.run_sinks(landing, repeated, f"{to}/checkpoint")
    steps = sinks.classified_progress(spark, to, total_rows=flows.count())
    return steps.select("batch", "total_rows", "benign", "attacks", "critical", "tcp", "benign_pct", "pct")


@query(
    "stream_late_rows",
    f"""SELECT count(*) AS dropped FROM {EV} p WHERE packet_id % 10 = 3
        AND epoch_us(ts) <= ((SELECT max(epoch_us(ts)) FROM {EV} m WHERE packet_id % 10 NOT IN (3, 5)) // 1000 - 60000) * 1000""",
)
def _(spark, d):
    """Three files. Rows of the last are dropped, and counted, where the watermark that the first left for the second has passed them."""
    rows, path, to = view(spark, d, "packets_ev"), fresh(spark, "landed"), folder(spark)
    digit = F.col("packet_id") % 10
    for part in (rows.where(~digit.isin(3, 5)), rows.where(digit == 5), rows.where(digit == 3)):
        part.coalesce(1).write.mode("append").parquet(path)
    late = sinks.LateRows(spark, f"{to}/late")
    spark.streams.addListener(late)
    try:
        query = st.run_available(st.stream_scan(over(spark, path, rows.schema), PAIR, SlidingCount(20), COUNT_OUT), to)
        counted = late.table(query)
    finally:
        spark.streams.removeListener(late)
    return counted.agg(F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"))


@query("stream_alert_feed", f"SELECT row_number() OVER (ORDER BY ts, packet_id, sid) AS id, epoch_us(ts) AS us, sid, threat, type, src, dst, info, packet_id FROM {RATES} b")
def _(spark, d):
    """Rates and spreads as branches of one stream, numbered over its batches."""
    to = folder(spark)
    stream = landed(spark, view(spark, d, "packets_ev"))
    alerts = detectors.stream_rates(stream, **SMALL)
    st.run_sinks(alerts, sinks.numbered_sink(to, ["ts", "packet_id", "sid"]), f"{to}/checkpoint")
    feed = sinks.read_batches(spark, f"{to}/feed", "id long, ts timestamp, sid int, threat string, type string, src string, dst string, info string, packet_id long")
    return feed.select("id", micros(feed, "ts").alias("us"), "sid", "threat", "type", "src", "dst", "info", "packet_id")
