"""Flow classification and its statistics over flows derived from ``lineitem``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from checks.registry import query
from checks.views import duck, view
from packetloom.functions import labels, net
from packetloom.operators import classify as cl
from packetloom.operators.durable import fresh
from packetloom.sources.flows import read_flows

FLOWS = duck("flows_ev")
FEATURES = ["flow_duration", "tot_fwd_pkts", "flow_byts_s", "protocol", "dst_port"]
USABLE = "CASE WHEN isfinite(try_cast({c} AS DOUBLE)) THEN try_cast({c} AS DOUBLE) END"
MEANS = "(SELECT " + ", ".join(f"avg({USABLE.format(c=c)}) AS {c}" for c in FEATURES) + f" FROM {FLOWS} f0)"
ALIGNED = (
    "(SELECT f.flow_key, f.part, f.label AS prediction, " + ", ".join(f"coalesce({USABLE.format(c='f.' + c)}, m.{c}) AS {c}" for c in FEATURES)
    + f", 0.5 AS fwd_header_len FROM {FLOWS} f, {MEANS} m)"
)
BENIGN = "lower(trim(prediction)) IN ('benign', 'normal', 'benign traffic')"
BUCKET = f"""CASE WHEN {BENIGN} THEN 'LOW' WHEN contains(lower(prediction), 'ddos') OR contains(lower(prediction), 'bot') THEN 'CRITICAL'
    WHEN contains(lower(prediction), 'dos') THEN 'HIGH' ELSE 'MEDIUM' END"""
RATED = f"""count(*) AS total_rows, count_if({BENIGN}) AS benign, count_if({BUCKET} = 'LOW') AS low, count_if({BUCKET} = 'MEDIUM') AS medium,
    count_if({BUCKET} = 'HIGH') AS high, count_if({BUCKET} = 'CRITICAL') AS critical, count_if(protocol = 6) AS tcp, count_if(protocol = 17) AS udp,
    count_if(protocol NOT IN (6, 17)) AS other, count_if(NOT ({BENIGN})) AS attacks, round(count_if({BENIGN}) / count(*) * 100, 1) AS benign_pct,
    round(count_if(NOT ({BENIGN})) / count(*) * 100, 1) AS attack_pct, 'CRITICAL' AS system_threat"""


def aligned(spark, d):
    """Aligned flows with the given label standing in for the prediction."""
    flows = view(spark, d, "flows_ev")
    means = cl.feature_means(flows, FEATURES).first().asDict()
    rows = flows.withColumn("prediction", F.col("label"))
    return cl.align(rows, [*FEATURES, "fwd_header_len"], {**means, "fwd_header_len": 0.5}, ["flow_key", "part", "prediction"])


COLS = ", ".join(f"floor({c} * 1000) AS {c}" for c in [*FEATURES, "fwd_header_len"])


@query("flows_aligned", f"SELECT flow_key, part, prediction, {COLS} FROM {ALIGNED} a")
def _(spark, d):
    rows = aligned(spark, d)
    return rows.select("flow_key", "part", "prediction", *[F.expr(f"CAST(floor({c} * 1000) AS DOUBLE)").alias(c) for c in [*FEATURES, "fwd_header_len"]])


@query(
    "flow_csv_rows",
    """SELECT how, count(*) AS n, count(d) AS filled, CAST(sum(a) AS BIGINT) AS total FROM (
         SELECT l_orderkey * 10 + l_linenumber AS a, CASE WHEN l_linenumber % 4 <> 1 THEN 'x' END AS d FROM lineitem WHERE l_linenumber % 4 <> 2) r,
         (VALUES ('all'), ('first'), ('counted')) v(how) GROUP BY how""",
)
def _(spark, d):
    """Lines with too few fields (filled), too many (dropped), quoted commas; the rows don't depend on what is selected."""
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")
    kind = F.col("l_linenumber") % 4
    line = F.when(kind == 1, F.concat(key, F.lit(",2"))).when(kind == 2, F.concat(key, F.lit(",2,3,4,5"))).when(kind == 3, F.concat(key, F.lit(',"p,q",3,x')))
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.coalesce(line, F.concat(key, F.lit(",2,3,x"))).alias("value"))
    folder = fresh(spark, "flow-csv")

    def with_header(batches):
        yield pd.DataFrame({"value": ["a,b,c,d"]})
        yield from batches

    lines.mapInPandas(with_header, "value string").write.text(folder)
    rows = read_flows(spark, folder, ["a", "b", "c", "d"])
    everything = rows.agg(F.lit("all").alias("how"), F.count("*").alias("n"), F.count("d").alias("filled"), F.sum(F.col("a").cast("long")).alias("total"))
    first = rows.select("a").agg(F.lit("first").alias("how"), F.count("*").alias("n"), F.sum(F.col("a").cast("long")).alias("total"))
    filled = rows.select("d").agg(F.count("d").alias("filled"))
    counted = rows.agg(F.lit("counted").alias("how"), F.count("*").alias("n"))
    return everything.unionByName(first.crossJoin(filled).select(*everything.columns)).unionByName(
        counted.crossJoin(everything.select("filled", "total")).select(*everything.columns)
    )  # one row on either side


@query("flow_feature_means", "SELECT " + ", ".join(f"round({c}, 4) AS {c}" for c in FEATURES) + f" FROM {MEANS} m")
def _(spark, d):
    return cl.feature_means(view(spark, d, "flows_ev"), FEATURES).select(*[F.round(c, 4).alias(c) for c in FEATURES])


@query(
    "flow_labels",
    f"SELECT flow_key, part, prediction, {BENIGN} AS benign, {BUCKET} AS bucket, CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'Other' END AS proto FROM {ALIGNED} a",
)
def _(spark, d):
    label = F.col("prediction")
    return aligned(spark, d).select(
        "flow_key", "part", "prediction", labels.is_benign(label).alias("benign"), labels.threat_bucket(label).alias("bucket"),
        net.flow_protocol(F.col("protocol")).alias("proto"),
    )


@query(
    "class_distribution",
    f"SELECT prediction, count(*) AS count, round(count(*) / (SELECT count(*) FROM {FLOWS} f) * 100, 2) AS pct FROM {ALIGNED} a GROUP BY prediction",
)
def _(spark, d):
    return cl.class_distribution(aligned(spark, d))


SUM = f"SELECT {RATED}, round(avg(flow_duration), 1) AS mean_flow_dur, round(avg(flow_byts_s), 1) AS mean_bandwidth FROM {ALIGNED} a"


def rounded(df):
    return df.withColumn("mean_flow_dur", F.round("mean_flow_dur", 1)).withColumn("mean_bandwidth", F.round("mean_bandwidth", 1))


@query("flow_summary", SUM)
def _(spark, d):
    return rounded(cl.summary(aligned(spark, d)))


@query(
    "system_threat_by_part",
    f"""SELECT k, n, benign, CASE WHEN benign = n THEN 'LOW' WHEN (n - benign) / n <= 0.05 THEN 'MEDIUM' WHEN (n - benign) / n <= 0.2 THEN 'HIGH'
        ELSE 'CRITICAL' END AS level FROM (SELECT part % 500 AS k, count(*) AS n, count_if({BENIGN} OR part % 4 > 0) AS benign FROM {ALIGNED} a GROUP BY 1) q""",
)
def _(spark, d):
    rows = aligned(spark, d)
    calm = labels.is_benign(F.col("prediction")) | (F.col("part") % 4 > 0)
    sums = rows.groupBy((F.col("part") % 500).alias("k")).agg(F.count("*").alias("n"), F.count_if(calm).alias("benign"))
    return sums.withColumn("level", labels.system_threat(F.col("n"), F.col("benign")))


@query(
    "flow_progress",
    f"""SELECT chunk, total_rows, benign, attacks, critical, tcp, round(benign / total_rows * 100, 1) AS benign_pct,
        round(least(total_rows / (SELECT count(*) FROM {FLOWS} f) * 100, 100), 1) AS pct FROM (SELECT chunk, CAST(sum(n) OVER w AS BIGINT) AS total_rows,
        CAST(sum(b) OVER w AS BIGINT) AS benign, CAST(sum(n - b) OVER w AS BIGINT) AS attacks, CAST(sum(c) OVER w AS BIGINT) AS critical, CAST(sum(t) OVER w AS BIGINT) AS tcp
        FROM (SELECT flow_key // 50000 AS chunk, count(*) AS n, count_if({BENIGN}) AS b, count_if({BUCKET} = 'CRITICAL') AS c, count_if(protocol = 6) AS t
        FROM {ALIGNED} a GROUP BY 1) g WINDOW w AS (ORDER BY chunk)) q""",
)
def _(spark, d):
    rows = aligned(spark, d).withColumn("chunk", F.floor(F.col("flow_key") / 50000))
    steps = cl.progress(rows, "chunk", total_rows=rows.count(), block=5)
    return steps.select("chunk", "total_rows", "benign", "attacks", "critical", "tcp", "benign_pct", "pct")


@query(
    "prediction_sample",
    f"SELECT row_number() OVER (ORDER BY flow_key, part, prediction) AS row, flow_key, prediction FROM (SELECT * FROM {ALIGNED} a ORDER BY flow_key, part, prediction LIMIT 100) s",
)
def _(spark, d):
    rows = aligned(spark, d).withColumn("at", F.struct("flow_key", "part", "prediction"))
    return cl.sample(rows, "at").select("row", "flow_key", "prediction")


@query(
    "flow_report_attacks",
    f"SELECT 'attack types' AS section, prediction AS key, CAST(count(*) AS VARCHAR) AS value FROM {ALIGNED} a WHERE NOT ({BENIGN}) GROUP BY prediction",
)
def _(spark, d):
    return cl.report(aligned(spark, d)).where("section = 'attack types'")


def model(spark, d, scaled=True):
    return cl.fit_forest(view(spark, d, "flows_ev"), FEATURES, "label", scaled=scaled, trees=8, depth=6)


@query("forest_predictions")
def _(spark, d):
    return cl.predict(model(spark, d), view(spark, d, "flows_ev"), ["flow_key", "part"])


@query("forest_predictions_raw")
def _(spark, d):
    preds = cl.predict(model(spark, d, False), view(spark, d, "flows_ev"), ["flow_key"])
    return cl.class_distribution(preds)


@query("forest_requests")
def _(spark, d):
    requests = view(spark, d, "flows_ev").select("flow_key", "flow_duration", "dst_port")
    return cl.predict_requests(model(spark, d), requests, ["flow_key"])


@query("forest_report")
def _(spark, d):
    fitted = model(spark, d)
    preds = cl.predict(fitted, view(spark, d, "flows_ev"))
    return cl.report(preds, cl.importances(fitted, cl.REPORT_FEATURES))


@query("forest_catalogue")
def _(spark, d):
    fitted = model(spark, d)
    return cl.catalogue(fitted).join(cl.importances(fitted), "feature")
