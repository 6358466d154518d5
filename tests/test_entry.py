"""The driver contract."""


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_ingest_reads_csv_variants(spark, tmp_path):
    from fieldmark.sources.ingest import read_fires, unpack_series

    (tmp_path / "a.csv").write_text("latitude,longitude,brightness,acq_date,acq_time,confidence,frp\n1,2,300.1,2024-01-02,305,l,1.5\n1,2,301,2024-01-02,1405,130,2\n1,2,301,2024-01-02,1405,??,2\n")
    rows = sorted(read_fires(spark, str(tmp_path / "a.csv"), "modis").collect(), key=lambda r: r["acquired"])
    assert [(r["confidence"], r["acquired"], r["brightness"]) for r in rows] == [(20, 1704164700, 300.1), (100, 1704204300, 301.0)]
    df = spark.createDataFrame([(1.0,), (-32768.2,), (float("nan"),), (None,)], "v double")
    assert [r["value"] for r in unpack_series(df, "v", 0.1, 2.0, -32768.0).collect()] == [2.1]


def test_latest_facts_and_append(spark, tmp_path):
    from fieldmark.operators.lookup import append_facts, latest_facts, read_facts

    rows = [(1, "a", 1, 1.0, 10, 1), (1, "a", 1, 2.0, 11, 2), (2, "b", 1, 3.0, 5, 3)]
    df = spark.createDataFrame(rows, "cell long, band string, tslot long, num double, signed_at long, event_id long")
    append_facts(df.limit(1), str(tmp_path / "f"))
    append_facts(df, str(tmp_path / "f"))
    got = latest_facts(read_facts(spark, str(tmp_path / "f"), bands=["a"], tslots=(0, 5)).select(*df.columns))
    assert [r["num"] for r in got.collect()] == [2.0]
