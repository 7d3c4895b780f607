import datetime as dt

from tidemark.operators import snapshots
from tidemark.streaming import streams


def test_events(spark, sf, tmp_path):
    src = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(2).write.parquet(str(src))
    q = streams.daily_counts(streams.events(spark, str(src), 10)).writeStream.format("memory").queryName("days").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["d"], r["event_type"]): r["n"] for r in spark.sql("select * from days").collect()}
    want = {(r["d"], r["event_type"]): r["count"] for r in events.selectExpr("cast(ts as date) d", "event_type").groupBy("d", "event_type").count().collect()}
    last = max(d for d, _ in want)
    assert got and all(want[k] == n for k, n in got.items()) and {k for k in want if k[0] < last - dt.timedelta(2)} <= got.keys()


def test_last_row_of_each_key(spark, sf, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "last")
    events = spark.read.parquet(f"{sf}/events.parquet")
    want = {r["user_id"]: r["event_id"] for r in events.groupBy("user_id").agg({"event_id": "max"}).withColumnRenamed("max(event_id)", "event_id").collect()}
    for k in range(2):
        events.where(f"event_id % 2 = {k}").write.mode("append").parquet(src)
        q = streams.keep_last(streams.events(spark, src, 1), out, ["user_id"], "event_id", str(tmp_path / "ck"))
        q.awaitTermination(120)
    assert {r["user_id"]: r["event_id"] for r in snapshots.current(spark, out).collect()} == want


def test_sessions(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "in"))
    q = streams.user_sessions(streams.events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select * from sessions where n < 1 or end <= start").isEmpty()


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def land(spark, folder, *rows):
    spark.createDataFrame([(k, dt.datetime(2024, 1, d, h, tzinfo=dt.UTC), u, "view", float(k)) for k, d, h, u in rows], EVENTS).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_late_rows_go_aside_and_none_is_lost(spark, tmp_path):
    """Restarted between files: each row is in a final day's count, in a day that is still open, or late."""
    at = lambda x: str(tmp_path / x)

    def run():
        streams.late_aside(stream(spark, at("in")), at("parted"), at("ck1")).awaitTermination(120)
        streams.appended(streams.daily_counts(stream(spark, at("parted/kept"))), at("days"), at("ck2")).awaitTermination(120)

    land(spark, at("in"), (1, 1, 5, 1), (2, 2, 5, 1), (3, 4, 1, 2))
    run()
    land(spark, at("in"), (4, 1, 9, 1), (5, 3, 9, 1), (6, 4, 2, 1))  # the first is late: day 1 ended a day before 4 01:00
    land(spark, at("in"), (7, 9, 0, 1), (8, 4, 3, 1))
    run()
    land(spark, at("in"), (9, 4, 4, 1), (10, 9, 1, 1), (11, 8, 1, 1))  # the first is late by now
    run()
    late = spark.read.option("recursiveFileLookup", True).schema(EVENTS).parquet(at("parted/late")).collect()
    assert {r["event_id"] for r in late} == {4, 9}
    days = {r["d"].day: r["n"] for r in spark.read.parquet(at("days")).collect()}
    assert days == {1: 1, 2: 1, 3: 1, 4: 3}  # 8 and 9 January are open


def test_a_replayed_batch_writes_nothing_twice(spark, tmp_path):
    import shutil

    at = lambda x: str(tmp_path / x)
    land(spark, at("in"), (1, 1, 5, 1), (2, 2, 5, 1))
    go = lambda: streams.late_aside(stream(spark, at("in")), at("parted"), at("ck")).awaitTermination(120)
    go()
    before = sorted(p.name for p in (tmp_path / "parted").rglob("*.parquet"))
    shutil.rmtree(at("ck") + "/commits")  # as after a crash between the write and its commit
    go()
    assert sorted(p.name for p in (tmp_path / "parted").rglob("*.parquet")) == before


def test_keyed_state_outlives_a_restart_and_expires(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    run = lambda: streams.last_with_state(stream(spark, at("in")), at("out"), at("ck"), silent="2 days").awaitTermination(180)
    known = lambda: {r["user_id"]: (r["event_id"], r["expired"]) for r in streams.last_known(spark, at("out")).collect()}
    land(spark, at("in"), (1, 1, 5, 1), (2, 1, 6, 1), (3, 2, 0, 2))
    run()
    assert known() == {1: (2, False), 2: (3, False)}
    land(spark, at("in"), (4, 2, 1, 2), (5, 5, 0, 3))  # user 1 is silent since 1 06:00, the watermark is 4 00:00
    run()
    assert known() == {1: (2, True), 2: (4, False), 3: (5, False)}
    land(spark, at("in"), (6, 5, 1, 1), (7, 9, 0, 3))  # user 1 is back, then all others go silent
    run()
    assert known() == {1: (6, True), 2: (4, True), 3: (7, False)}


def test_the_first_of_a_day_wins(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    rows = lambda s: streams.first_of_day(s.withColumn("d", s["ts"].cast("date"))).select("d", "event_id")
    run = lambda: streams.appended(rows(stream(spark, at("in"))), at("out"), at("ck")).awaitTermination(120)
    land(spark, at("in"), (1, 1, 5, 1), (2, 2, 5, 1))
    run()
    land(spark, at("in"), (3, 2, 6, 1), (4, 3, 1, 1))  # a repeated day
    run()
    land(spark, at("in"), (5, 9, 1, 1))
    run()
    land(spark, at("in"), (6, 2, 7, 1), (7, 5, 1, 1), (8, 9, 2, 1))  # repeated and late, late, repeated
    run()
    assert {r["d"].day: r["event_id"] for r in spark.read.parquet(at("out")).collect()} == {1: 1, 2: 2, 3: 4, 9: 5}


def test_queries_meet_their_cases(spark):
    from tidemark.plans import catalog

    sf = "/root/testdata/sf0.01"

    assert {r["kind"] for r in catalog.stream_final_days(spark, sf).collect()} == {"final", "late"}
    assert {r["expired"] for r in catalog.stream_last_state(spark, sf).collect()} == {True, False}


def test_no_task_numbers_a_whole_day(spark, monkeypatch):
    from tidemark.plans import catalog

    sf, numbers, sizes = "/root/testdata/sf0.01", catalog._day_numbers, []

    def numbered(e, width, tasks):
        out = numbers(e, width, tasks)
        sizes.append(out.groupBy("d", "b").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(catalog, "_day_numbers", numbered)
    monkeypatch.setattr(catalog, "EVENTS_A_BLOCK", 40)
    got = sorted((r["d"], r["run"], r["n"], r["first_id"]) for r in catalog.stream_first_snapshot(spark, sf).collect())
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("first_events")
    day = "SELECT to_date(ts) d, event_id, row_number() OVER (PARTITION BY to_date(ts) ORDER BY event_id) k FROM first_events"
    want = spark.sql(f"SELECT d, 0 run, count(*) n, min(event_id) first_id FROM ({day}) WHERE (k - 1) % 3 = 0 GROUP BY d")
    assert got == sorted(map(tuple, want.collect()))
    assert sizes and max(sizes) <= 40 < max(n for _, _, n, _ in got)
