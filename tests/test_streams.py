import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import feeds as S

T0 = dt.datetime(2024, 1, 1)


def stream_of(spark, tmp_path, rows, schema, files=3):
    """A stream that brings the rows in several batches."""
    path = str(tmp_path / "in")
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


def run(spark, tmp_path, df, mode):
    got = []
    q = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).start()
    q.awaitTermination()
    return got


def fold(spark, tmp_path, stream, made, columns):
    stream.writeStream.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).foreachBatch(made).start().awaitTermination()
    return sorted(map(tuple, made.emitted(columns).collect()), key=str)


def test_transitions(spark, tmp_path):
    rows = [(i % 3, i % 2, ["inStock", "lowStock", "outOfStock"][i * i // 7 % 3], T0 + dt.timedelta(minutes=i), i) for i in range(60)]
    stream, batch = stream_of(spark, tmp_path, rows, "retailer bigint, k bigint, level string, ts timestamp, n bigint")
    args = (("retailer", "k"), "level", "ts", "n")
    want = sorted(map(tuple, S.transitions(batch, *args).collect()), key=str)
    got = fold(spark, tmp_path, stream, S.transitions_fold(stream, *args, str(tmp_path / "fold"), compact_every=2), "retailer bigint, k bigint, ts timestamp, n bigint, before string, after string")
    assert got == want and len(got) > 10


def test_unread(spark, tmp_path):
    kinds = ["incoming", "incoming", "read_one", "incoming", "incoming", "read_all", "incoming"]
    rows = [(i % 2, kinds[i % 7], i % 5, T0 + dt.timedelta(minutes=i), i) for i in range(70)]
    rows += rows[10:20]  # delivered again
    stream, batch = stream_of(spark, tmp_path, rows, "u bigint, action string, item bigint, ts timestamp, n bigint")
    args = ("u", "action", "item", "ts", "n")
    states = S.unread_states(stream, *args)
    seen = spark.createDataFrame(run(spark, tmp_path, states, "update"), states.schema)
    last = {r["u"]: r["unread"] for r in S.unread_counts(seen, "u", "item").collect()}
    assert len(last) == 2 and last == {r["u"]: r["unread"] for r in S.unread(batch, *args).collect()}


def test_session_context(spark, tmp_path):
    rows = [(i % 4, i // 4, None if i % 3 else f"said {i}", "user") for i in range(48)]
    stream, batch = stream_of(spark, tmp_path, rows, "s bigint, t bigint, said string, role string")
    args = ("s", "t", "said", "role")
    want = sorted(map(tuple, S.context(batch, *args).collect()), key=str)
    got = fold(spark, tmp_path, stream, S.context_fold(stream, *args, str(tmp_path / "fold"), compact_every=2), "s bigint, t bigint, topic_said string, topic_role string, recent string")
    assert sorted(got, key=str) == want


def test_stateless_folds_over_a_stream(spark, tmp_path):
    rows = [(i, ["{\"k\": 3}", "oops", "", None, "{\"j\": 1}"][i % 5], i % 4) for i in range(40)]
    stream, batch = stream_of(spark, tmp_path, rows, "n bigint, body string, retailer bigint")
    wanted = spark.createDataFrame([(0,), (0,), (1,)], "retailer bigint")
    fold = lambda df: S.subscribed(S.parse_updates(df, "body"), wanted, "retailer")
    got = run(spark, tmp_path, fold(stream), "append")
    assert sorted(got) == sorted(map(tuple, fold(batch).collect())) and {r[-1] for r in got} == {3}


def test_ages(spark):
    now = F.lit(T0)
    seconds = [0, 59, 60, 3599, 3600, 86399, 86400, 604799, 604800, 1300000]
    df = spark.createDataFrame([(i, T0 - dt.timedelta(seconds=s)) for i, s in enumerate(seconds)], "i int, ts timestamp")
    assert [r[0] for r in df.orderBy("i").select(S.age(F.col("ts"), now)).collect()] == ["Just now", "Just now", "1m ago", "59m ago", "1h ago", "23h ago", "1d ago", "6d ago", "1w ago", "2w ago"]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    args = (("k",), "level", "ts", "n")
    schema = "k bigint, level string, ts timestamp, n bigint"
    batches = [[(1, "a", T0, 1), (1, "b", T0 + dt.timedelta(1), 2), (2, "a", T0, 3)], [(1, "c", T0 + dt.timedelta(2), 5), (1, "b", T0 + dt.timedelta(hours=1), 4), (2, "a", T0 + dt.timedelta(3), 6)], [(2, "d", T0 + dt.timedelta(4), 7)]]
    frames = [spark.createDataFrame(b, schema) for b in batches]
    made = S.transitions_fold(frames[0], *args, str(tmp_path / "fold"), compact_every=3)
    for number in (0, 1, 1, 0, 1, 2, 2):
        made(frames[number], number)
    got = sorted((r["k"], r["n"], r["before"], r["after"]) for r in made.emitted("k bigint, ts timestamp, n bigint, before string, after string").collect())
    assert got == [(1, 2, "a", "b"), (1, 5, "b", "c"), (2, 7, "a", "d")]  # the update that came late is skipped
    assert sorted((r["k"], r["level"]) for r in made.state.read().collect()) == [(1, "c"), (2, "d")]
    assert sorted((r["k"], r["level"]) for r in made.state.read(before=1).collect()) == [(1, "b"), (2, "a")]


def test_latest_levels_are_upserted(spark, tmp_path):
    rows = [(i % 4, ["a", "b", "c"][i % 3], T0 + dt.timedelta(minutes=i), i) for i in range(30)] + [(0, "late", T0 - dt.timedelta(1), 99), (1, "z", T0 + dt.timedelta(1), 100)]
    stream, batch = stream_of(spark, tmp_path, rows, "k bigint, level string, ts timestamp, n bigint", files=4)
    states = S.latest_levels(stream, ("k",), "level", "ts", "n")
    table = S.levels_upsert(states, ("k",), str(tmp_path / "levels"))

    def twice(df, number):
        table.upsert(df, number)
        table.upsert(df, number)

    states.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    want = sorted(map(tuple, S.latest_levels(batch, ("k",), "level", "ts", "n").collect()))
    assert sorted(map(tuple, table.read().collect())) == want
    table.compact(2)
    assert sorted(map(tuple, table.read().collect())) == want
    table.compact(3, idle=1)  # only keys that the last batch changed are left
    assert {r["k"] for r in table.read().collect()} == {r["k"] for r in table.read(changed=True).where("batch = 3").collect()} != set()


def test_state_of_unread_counts_is_given_up(spark, tmp_path):
    day = lambda n, **more: T0 + dt.timedelta(days=n, **more)
    rows = [(1, "incoming", i, day(0, minutes=i), i) for i in range(20)] + [(1, "incoming", 3, day(0, minutes=3), 3)] * 2
    rows += [(1, "read_one", 5, day(1), 50), (1, "incoming", 21, day(5), 51)]
    late = [(1, "incoming", 77, day(0, hours=1), 52), (1, "incoming", 4, day(0, minutes=4), 4), (1, "incoming", 23, day(9, minutes=1), 54)]  # the first two come too late
    path, schema = str(tmp_path / "in"), "u bigint, action string, item bigint, ts timestamp, n bigint"
    for part in (rows[:22], rows[22:24], [(1, "incoming", 22, day(9), 53)], late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)
    states, seen = S.unread_states_within(stream, "u", "action", "item", "ts", "n"), []
    q = states.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect()))).start()
    q.awaitTermination()
    found = S.unread_counts(spark.createDataFrame(seen, states.schema).drop("span"), "u", "item").collect()
    assert [(r["u"], r["unread"]) for r in found] == [(1, 22)]  # 20 + items 21, 22 and 23, less item 5; item 77 doesn't count
    kept = [[op["numRowsTotal"] for op in p["stateOperators"]] for p in q.recentProgress]
    dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    assert max(k[0] for k in kept) >= 20 and all(n <= 3 for n in kept[-1]) and dropped >= 2


def test_a_key_with_very_many_rows(spark, tmp_path):
    rows = spark.range(300_000).selectExpr("1L AS k", "CASE WHEN id % 1000 = 0 THEN 'x' ELSE 'y' END AS level", "timestamp_seconds(id) AS ts", "id AS n").repartition(7)
    made = S.transitions_fold(rows, ("k",), "level", "ts", "n", str(tmp_path / "fold"))
    made(rows, 0)
    assert made.emitted("k bigint, ts timestamp, n bigint, before string, after string").count() == 2 * 300 - 1
