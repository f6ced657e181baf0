"""Steps that must not grow faster than their input: what they hand to Python, read twice, or hold at once."""

import random
import re

from pyspark.sql import functions as F

from packetloom.llm import tokens
from packetloom.operators import bruteforce, chains, classify, fragments, scan, sliding
from packetloom.operators.programs import Reassembly
from packetloom.sources import alertlog, capture

S = 1_000_000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_datagrams_of_a_batch_equal_their_program(spark, monkeypatch):
    """Datagrams are folded many at a time, also those that go on in the next batch or have no address; longer ones reach the state machine."""
    own = random.Random(3)
    rows = [
        (i, own.randrange(40 * S), own.choice(["a", "b", "c", None]), own.randrange(60), own.randrange(0, 12) * 8, own.choice([0, 8, 16, 40000]), own.random() < 0.8)
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "packet_id long, us long, src string, ip_id int, start long, size long, more boolean")
    limits, keys, order = fragments.FragmentLimits(64, 6, 4, 2.0), ["src", "ip_id"], ["us", "packet_id"]
    program = Reassembly(limits.timeout, limits.per_packet)
    want = sorted(map(repr, scan.keyed_scan(df, keys, order, program, fragments.FRAGMENT_OUT).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for folded in (12, 128):
            monkeypatch.setattr(scan, "FOLDED", folded)
            got = scan.fold_or_scan(df, keys, order, program, fragments.FRAGMENT_OUT, batched=fragments._batched(limits))
            assert sorted(map(repr, got.collect())) == want and len(want) > 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_chains_hand_only_positions_to_python(spark):
    df = spark.range(200).select(F.col("id").alias("packet_id"), F.timestamp_seconds("id").alias("ts"), F.lit("a").alias("k"), F.lit("text").alias("message"))
    plan = plan_of(chains.cooldown(df, ["k"], 3, strict=True, fold_limit=0))
    steps = [line for line in plan.splitlines() if "FlatMapGroupsInPandas" in line]
    assert steps and not any("message" in line for line in steps)


def test_messages_of_fragments_are_written_for_kept_rows(spark):
    packets = spark.range(8).select(
        F.col("id").alias("packet_id"), F.timestamp_seconds("id").alias("ts"), F.lit("a").alias("src_ip"), F.lit("b").alias("dst_ip"),
        F.lit(17).alias("ip_proto"), F.lit(1).alias("ip_id"), F.lit(0).alias("ip_frag"), F.lit(8).alias("ip_payload_len"), F.lit(True).alias("ip_mf"),
    )
    limits = fragments.FRAGMENT_LIMITS["moderate"]
    assert "info" not in fragments._detections(packets, limits).columns
    got = {r.info for r in fragments.detect_fragmentation(packets).collect()}
    assert "Fragmentation: Tiny fragment detected (8 bytes)" in got and len(got) == 2


def test_logins_are_decoded_once(spark):
    row = (0, "10.0.0.1", "10.0.0.2", 6, 21, 50000, bytearray(b"530 user denied"))
    packets = spark.createDataFrame([row], "packet_id long, src_ip string, dst_ip string, ip_proto int, src_port int, dst_port int, payload binary")
    packets = packets.withColumn("ts", F.timestamp_seconds("packet_id")).withColumn("tcp_flags", F.lit(24))
    alerts = bruteforce.detect_brute_force(packets)
    plan = alerts._jdf.queryExecution().withCachedData().toString()
    kept = re.findall(r"InMemoryRelation \[([^\]]*)\]", plan)
    assert ["packet_id", "ts", "client", "server", "service", "username"] in [[c.split("#")[0] for c in columns.split(", ")] for columns in kept]


def test_walks_stop_where_names_and_answers_end(spark):
    """Steps are taken up to the last answer, not up to the length of the message."""
    message = bytes.fromhex("abcd81800001000200000000" + "017800" + "00100001") + 2 * (bytes.fromhex("c00c0010000100000000") + b"\x01\x2c" + 300 * b"A")
    df = spark.createDataFrame([(bytearray(message),), (bytearray(message[:20]),), (None,)], "m binary")
    name = capture.walk_name(F.col("m"), F.lit(12))
    got = df.select(name["name"].alias("name"), capture.txt_sizes(F.col("m"), name["after"] + 4).alias("sizes")).collect()
    assert [tuple(r) for r in got] == [("x", [300, 300]), ("x", []), (None, [])]
    taken = []
    step = lambda s, i: (s + 1).cast("int")
    ended = lambda s: taken.append(s) or s >= 5
    assert df.select(capture._walk(F.col("m"), F.lit(0), step, ended).alias("n")).first().n == 5 and taken


def test_training_reads_its_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    flows = spark.range(200).select((F.col("id") % 7).cast("string").alias("a"), F.when(F.col("id") % 9 == 0, "n/a").otherwise((F.col("id") % 5).cast("string")).alias("b"), F.when(F.col("id") % 7 > 3, "x").otherwise("y").alias("label"))
    kept = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    fitted = classify.fit_forest(flows.mapInPandas(counted, flows.schema), ["a", "b"], "label", trees=3, depth=3)
    assert read.value == 200 and spark.sparkContext._jsc.sc().getPersistentRDDs().size() == kept
    assert classify.predict(fitted, flows, ["label"]).where("label = prediction").count() == 200


def test_evidence_is_one_pass_over_slices(spark):
    """The rows of a plain search, without a row for each packet an alert might ask for and without a join."""
    own = random.Random(7)
    us = [-90 * S, 40 * S, 40 * S, 80 * S, *[own.choice([own.randrange(-100 * S, 100 * S), own.randrange(0, 200) * S // 2]) for _ in range(600)]]
    rows = [(own.randrange(10**6) * 1000 + i, t, own.choice(["a", "a", "b", None]), str(i)) for i, t in enumerate(us)]
    packets = spark.createDataFrame(rows, "packet_id long, us long, src_ip string, dst_ip string").withColumn("ts", F.timestamp_micros("us")).drop("us")
    asked = [(i, t, s) for i, t, s, _ in own.sample(rows, 150)] + [(1, 40 * S, "nobody"), (2, 300 * S, "a"), (3, 110 * S, "a")]
    alerts = spark.createDataFrame(asked, "packet_id long, us long, src string").select("packet_id", F.timestamp_micros("us").alias("ts"), "src", F.lit(5).alias("sid"))
    for per_alert, within in ((3, 10), (8, 2)):
        want = set()
        for a, t, s in asked:
            found = sorted((u, p) for p, u, src, _ in rows if s is not None and src == s and t - within * S <= u <= t)
            want |= {(a, k, p) for k, (_, p) in enumerate(found[:per_alert], 1)}
        got = alertlog.evidence(alerts, packets, per_alert=per_alert, within_seconds=within)
        assert {(r.alert_id, r.position, r.packet_id) for r in got.collect()} == want and len(want) > 150
    plan = plan_of(alertlog.evidence(alerts, packets))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_slices_are_not_merged_into_one_task(spark):
    """Alike packets compress well, so a size after compression says little about a task's memory."""
    packets = spark.range(4000).select(F.col("id").alias("packet_id"), F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 2).alias("k"), (F.col("id") % 3).alias("v"))
    for rows in (sliding.reaches_count(packets, ["k"], 5, 3), sliding.sliding_distinct(packets, ["k"], "v", 5), sliding.sliding_count(packets, ["k"], 5)):
        assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_words_of_many_texts_stay_in_memory():
    """A worker's memory of words holds those that its tasks meet again, and the model is asked without a new object each time."""
    words = [f"{a}{b}{c}{d}" for a in "bcdfghjklmnpstvz" for b in "aeiouy" for c in ("st", "nd", "ll", "rr", "mp", "ck", "ng", "th", "sh", "qu") for d in (x + y + z for x in "aeiou" for y in "bcdfgklmnprst" for z in "aeiou")]
    memory = tokens.WordIds(tokens.default_tokenizer())
    memory.encode(" ".join(words))
    assert len(set(words)) > 300_000 and len(memory) == len(set(words)) and memory.size < memory.limit
    assert memory[words[5]] == memory.whole(words[5])
