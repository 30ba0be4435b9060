from trialloom.streaming import assembly


def test_trials_leave_when_they_end(spark, tmp_path):
    schema = "trial_id long, event string, t double"
    batches = [[(1, "TrialStart", 10.0), (2, "TrialStart", 5.0), (1, "go", 14.0)], [(1, "TrialEnd", 20.0), (2, "go", 6.0)], [(2, "TrialEnd", 9.0), (3, "go", 1.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = assembly.assemble(stream).writeStream.format("memory").queryName("assembled").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.trial_id: r for r in spark.table("assembled").collect()}
    assert set(got) == {1, 2} and got[1].names == ["TrialStart", "go", "TrialEnd"] and got[1].times == [0.0, 4.0, 10.0]
    assert got[2].t_end == 4.0 and got[2].complete


def test_windows_and_sessions(spark, tmp_path):
    schema = "ts timestamp, event string, user long"
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) as ts, 'e' as event, cast(1 as long) as user from values (0),(3),(12),(40) as t(m)")
    rows.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df in (("counted", assembly.windowed_counts(read(), "10 minutes", "1 minute")), ("sat", assembly.sessions(read(), "user", "10 minutes", "1 minute"))):
        q = df.writeStream.format("memory").outputMode("append").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.n for r in spark.table("counted").collect()) == [1, 2]
    assert [r.n for r in spark.table("sat").collect()] == [3]
