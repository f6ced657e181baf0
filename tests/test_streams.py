"""Streams that end, resume and repeat batches; sinks; numbering; folds against their state machines."""

import random

import pytest
from pyspark.sql import functions as F, types as T

from packetloom.operators import flowstate, fragments, matching, numbering, scan
from packetloom.operators.programs import FirstSeen, Handshake, Reassembly, SlidingCount, SlidingDistinct
from packetloom.sources import rules as rl
from packetloom.streaming import flows as st, sinks

S = 1_000_000
OUT = T.StructType([T.StructField("us", T.LongType()), T.StructField("packet_id", T.LongType()), T.StructField("n", T.LongType())])


def rows_of(seed, n=400, keys=3, span=600):
    own = random.Random(seed)
    times = sorted(own.randrange(span * S) for _ in range(n))
    return [(i, t, f"k{own.randrange(keys)}", own.randrange(6)) for i, t in enumerate(times)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "packet_id long, us long, k string, value int").withColumn("ts", F.timestamp_micros("us")).drop("us")


def counts(rows, window):
    return {i: sum(k == key and us - window * S <= t <= us for j, t, k, _ in rows if j <= i) for i, us, key, _ in rows}


def test_resumed_equals_single_run(spark, tmp_path):
    rows, path = rows_of(1), str(tmp_path / "in")
    df = frame(spark, rows)
    parts = [df.where(F.col("packet_id").between(a, a + 99)).coalesce(1) for a in range(0, 400, 100)]

    def stream():
        files = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
        return st.stream_scan(files, ["k"], SlidingCount(40), OUT)

    for part in parts[:2]:
        part.write.mode("append").parquet(path)
    st.run_available(stream(), str(tmp_path / "run"))
    before = spark.read.schema(stream().schema).parquet(str(tmp_path / "run/out")).count()
    assert 0 < before < 200  # the rest waits for the watermark
    for part in parts[2:]:
        part.write.mode("append").parquet(path)
    got = {r.packet_id: r.n for r in st.run_to_end(stream(), str(tmp_path / "run")).collect()}
    assert got == counts(rows, 40)


def test_stream_without_rows_ends(spark, tmp_path):
    df = frame(spark, rows_of(2)).limit(0)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert st.run_to_end(st.stream_scan(stream, ["k"], SlidingCount(40), OUT), str(tmp_path / "run")).count() == 0


def test_repeated_batches_are_replaced(spark, tmp_path):
    write = sinks.numbered_sink(str(tmp_path / "feed"), ["packet_id"])
    parts = [frame(spark, rows_of(3)).where(F.pmod("packet_id", F.lit(3)) == k) for k in range(3)]
    for k, part in enumerate(parts):
        write(part, k)
    first = sorted(map(tuple, spark.read.parquet(str(tmp_path / "feed/feed")).select("id", "packet_id").collect()))
    for k in (1, 2, 1):
        write(parts[k], k)
    again = sorted(map(tuple, spark.read.parquet(str(tmp_path / "feed/feed")).select("id", "packet_id").collect()))
    assert first == again and [i for i, _ in first] == list(range(1, 401))


@pytest.mark.parametrize("descending", [False, True])
def test_numbered(spark, descending):
    rows = rows_of(4)
    key = F.col("value").desc() if descending else F.col("value").asc()
    got = numbering.numbered(frame(spark, rows).repartition(5), [key, F.col("packet_id").asc()], "n").collect()
    want = sorted(rows, key=lambda r: (-r[3] if descending else r[3], r[0]))
    assert [r.packet_id for r in sorted(got, key=lambda r: r.n)] == [r[0] for r in want] and sorted(r.n for r in got) == list(range(1, 401))
    assert numbering.numbered(frame(spark, rows).limit(0), ["packet_id"]).count() == 0


def test_sliding_distinct_and_first_seen():
    rows, distinct, listed = rows_of(5, keys=1), SlidingDistinct(30), FirstSeen(30)
    state, held, own = distinct.initial(), listed.initial(), []
    for i, us, _, value in rows:
        [(_, _, n)] = distinct.step(state, (us, i, value))
        assert n == len({v for j, t, _, v in rows if j <= i and t >= us - 30 * S})
        if all(v != value for _, v in own):
            own.append((us, value))
        own = [x for x in own if x[0] >= us - 30 * S]
        [(_, _, m, _)] = listed.step(held, (us, i, value, True))
        assert m == len(own)


@pytest.mark.parametrize("folded", [0, 5, 1000])
def test_folds_equal_their_programs(spark, folded, monkeypatch):
    monkeypatch.setattr(scan, "FOLDED", folded)
    own = random.Random(6)
    limits = fragments.FragmentLimits(tiny=64, per_second=6, per_packet=4, timeout=2.0)
    pieces = [(i, t, k, own.randrange(0, 40) * 8, own.choice([0, 8, 8, 16, 30000]), own.random() < 0.7) for i, t, k, _ in rows_of(7, n=300, keys=20, span=60)]
    df = spark.createDataFrame(pieces, "packet_id long, us long, k string, start long, size long, more boolean")
    order, program = ["us", "packet_id"], Reassembly(limits.timeout, limits.per_packet)
    want = sorted(map(tuple, scan.keyed_scan(df, ["k"], order, program, fragments.FRAGMENT_OUT).collect()))
    got = scan.fold_or_scan(df, ["k"], order, program, fragments.FRAGMENT_OUT, lambda r: fragments._folded(r, limits))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50

    steps = [(i, 4 * t, k, own.choice("SSAAKKK")) for i, t, k, _ in rows_of(8, n=300, keys=12)]
    df = spark.createDataFrame(steps, "packet_id long, us long, k string, kind string")
    program = Handshake(flowstate.HANDSHAKE_TTL, flowstate.COMPLETED_TTL)
    want = sorted(map(tuple, scan.keyed_scan(df, ["k"], order, program, flowstate._DONE).collect()))
    got = scan.fold_or_scan(df, ["k"], order, program, flowstate._DONE, flowstate._completed)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 5


def test_rules_are_met_under_their_network(spark):
    """A thousand rules for hosts and networks: a packet is tested against the few that name its own, and matches stay the same."""
    lines = [(i + 1, f"TCP 10.0.{i % 250}.7:any -> any:any *") for i in range(500)]
    lines += [(i + 501, f'alert tcp any any -> 10.{i % 250}.0.0/16 any ( msg:"n"; sid:{i}; )') for i in range(500)]
    table = rl.parse_rules(spark.createDataFrame(lines, "line int, text string")).where("error is null").persist()
    packets = spark.createDataFrame([(i, f"10.0.{i % 250}.{7 if i % 3 else 8}", f"10.{i % 240}.1.2", 1024, 9999, 6, 2) for i in range(60)], "packet_id long, src_ip string, dst_ip string, src_port int, dst_port int, ip_proto int, tcp_flags int")
    for name in ("arp_op", "icmp_type"):
        packets = packets.withColumn(name, F.lit(None).cast("int"))
    packets = packets.withColumn("ts", F.timestamp_seconds("packet_id"))
    met = matching._candidates(packets, matching._keyed(table), matching.RULE_FIELDS, 1000, 20_000, lambda access: F.lit(True))
    assert met.count() <= 60 * 4
    hits = {r.packet_id: r["__hit"].pos for r in matching.first_hits(packets, table, rule_count=1000).collect()}
    want = {}
    for i in range(60):
        found = [n for n, t in lines if (n <= 500 and t.split()[1] == f"10.0.{i % 250}.{7 if i % 3 else 8}:any") or (n > 500 and f" 10.{i % 240}.0.0/16 " in t)]
        want[i] = min(found) if found else None
    assert {i: hits.get(i) for i in range(60)} == want


def test_keys_that_share_a_state(spark, tmp_path):
    """Datagrams by the hundred in four states: the rows of one state each, null keys among them, and few calls for many keys."""
    own, limits = random.Random(5), fragments.FragmentLimits(100, 50, 20, 10.0)
    rows = [(i, t, None if k == "k7" else k, 8 * own.randrange(4), own.choice([8, 16]), own.random() < 0.6) for i, t, k, _ in rows_of(6, n=300, keys=90)]
    df = spark.createDataFrame(rows, "packet_id long, us long, k string, start long, size long, more boolean")
    program = Reassembly(limits.timeout, limits.per_packet)
    want = sorted(map(repr, scan.keyed_scan(df, ["k"], ["us", "packet_id"], program, fragments.FRAGMENT_OUT).collect()))
    timed, path = df.withColumn("ts", F.timestamp_micros("us")).drop("us"), str(tmp_path / "in")
    for part in (timed.where("packet_id < 150"), timed.where("packet_id >= 150")):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(path)
    one = st.stream_scan(stream, ["k"], program, fragments.FRAGMENT_OUT, buckets=4)
    assert sorted(map(repr, st.run_to_end(one, str(tmp_path / "run")).collect())) == want and len(want) > 50


def test_progress_by_steps(spark, tmp_path):
    """Two batches that share the steps between them, each of them twice."""
    write = sinks.classified_sink(str(tmp_path), lambda rows: rows, step=F.floor(F.col("n") / 10))
    df = spark.range(60).selectExpr("id AS n", "IF(id % 3 = 0, 'BENIGN', 'Bot') AS prediction", "CAST(6 AS DOUBLE) AS protocol", "1.0D AS flow_duration", "1.0D AS flow_byts_s")
    for batch in (0, 0, 1, 1):
        write(df.where(F.col("n") % 2 == batch), batch)
    got = [(r["batch"], r.total_rows, r.benign) for r in sinks.classified_progress(spark, str(tmp_path), 60).orderBy("batch").collect()]
    assert got == [(k, 10 * k + 10, len(range(0, 10 * k + 10, 3))) for k in range(6)]


def test_states_stay_small():
    """Spark sends a state along with every Arrow batch of its group's rows."""
    own = random.Random(9)
    times = sorted(own.randrange(600 * S) for _ in range(20_000))
    wait = [[1_700_000_000_000_000 + t, i, own.choice(["a", None]), i % 2 == 0, i / 2] for i, t in enumerate(times)]
    kept = [(("k", None), {"of": {"n": [1]}, "wait": wait, "last": 5}), (("m", 2), {"of": [], "wait": [], "last": None})]
    packed = st.pack_state(kept)
    assert st.unpack_state(packed) == [[list(key), whole] for key, whole in kept]
    assert [type(v) for v in st.unpack_state(packed)[0][1]["wait"][0]] == [int, int, type(wait[0][2]), bool, float]
    assert 4 * len(packed) < len(scan.dump_state(kept))


def test_more_turns_land_the_same_rows(spark):
    from checks.feeds import in_turns

    df = frame(spark, rows_of(10))
    parts = in_turns(df, files=3, jitter=5, most=50)
    turns = [sorted(r.packet_id for r in part.collect()) for part in parts]
    assert len(turns) == 8 and sorted(sum(turns, [])) == list(range(400)) and max(map(len, turns)) < 100
    assert all(part.rdd.getNumPartitions() == 1 and part.columns == df.columns for part in parts)
    assert all(max(a) < min(b) + 25 for a, b in zip(turns, turns[1:]))  # in the order of their times, but for the jitter


def test_branches_share_states(spark, tmp_path):
    """Keys of all branches in few states give the rows that a state for each gives, ports and values beside nulls included."""
    from packetloom.streaming import detectors

    own = random.Random(11)
    times = sorted(own.randrange(300 * S) for _ in range(400))
    rows = [(i, t, f"10.0.0.{own.randrange(2)}", "10.1.0.1", own.choice([6, 17, 1]), own.randrange(4) if own.random() < 0.8 else None) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "packet_id long, us long, src_ip string, dst_ip string, ip_proto int, dst_port int").withColumn("ts", F.timestamp_micros("us"))
    df = df.withColumn("tcp_flags", F.when(F.col("ip_proto") == 6, 2)).withColumn("icmp_type", F.when(F.col("ip_proto") == 1, 8)).withColumn("arp_op", F.lit(None).cast("int")).withColumn("src_port", F.lit(9))
    for part in [df.where(F.col("packet_id").between(a, a + 99)).coalesce(1) for a in range(0, 400, 100)]:
        part.write.mode("append").parquet(str(tmp_path / "in"))
    limits = {"syn": (60.0, 3), "syn_port_scan": (60.0, 3), "udp": (60.0, 3), "udp_port_scan": (60.0, 3), "icmp": (60.0, 3), "port_scan": (60.0, 4)}
    found, states = [], []
    for buckets in (None, 2):
        files = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream, to = detectors.stream_rates(files, buckets=buckets, **limits), str(tmp_path / f"run{buckets}")
        queries = st.run_available(stream, to)
        states.append(max(o.numRowsTotal for p in queries.recentProgress for o in p.stateOperators))
        st.close(queries)
        st.run_available(stream, to)
        found.append(sorted(map(repr, spark.read.parquet(f"{to}/out").select("packet_id", "sid", "src", "dst", "info").collect())))
    assert found[0] == found[1] and len(found[0]) > 100
    assert states[0] > 10 and states[1] <= 2  # a state for each key, and two for all


def test_numbered_batches_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    df = frame(spark, rows_of(12))
    sinks.numbered_sink(str(tmp_path / "feed"), ["packet_id"])(df.mapInPandas(counted, df.schema), 0)
    assert seen.value == 400
