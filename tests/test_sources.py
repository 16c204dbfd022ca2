"""Sources and sinks: CSV scan + cleaning, schedules, scenario bundles, writers, registered queries."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from wattline.functions.clean import clean_intervals, date_window, interval_quality
from wattline.session import prepare_session
from wattline.sources import scenarios as SC
from wattline.sources.intervals import read_interval_csv
from wattline.sources.schedule import default_schedule_wide, read_schedule_csv, schedule_long, schedule_wide
from wattline.sources.sinks import preview, write_table, write_text

CSV = """Datetime,Wind (MW),Solar (MW),Load (MW),Market Price ($/MWh)
2015-05-01 00:00:00,10,0,50,30
2015-05-01 01:00:00,,5,50,-5
not a date,1,1,1,1
2015-05-01 02:00:00,-3,x,,40
2015-05-02 23:00:00,4,4,40,35
"""


def test_csv_scan_clean_quality_and_window(spark, tmp_path):
    p = tmp_path / "site.csv"
    p.write_text(CSV)
    raw = read_interval_csv(spark, str(p), site_id=7)
    q = interval_quality(raw).first()
    assert q.n_rows == 5 and q.n_bad_ts == 1 and not q.has_natgas_mw
    clean = clean_intervals(raw)
    rows = clean.orderBy("ts").collect()
    assert len(rows) == 4                                    # bad timestamp dropped
    assert rows[1].wind_mw == 0.0 and rows[1].price == -5.0  # null -> 0; price never clipped
    assert rows[2].wind_mw == 0.0 and rows[2].solar_mw == 0.0 and rows[2].load_mw == 0.0  # clip / bad text
    assert all(r.natgas_mw == 0.0 for r in rows)             # missing column -> 0
    assert date_window(clean, "2015-05-01", "2015-05-01").count() == 3   # end day included whole


def test_schedule_template_roundtrip(spark, tmp_path):
    lng = schedule_long(default_schedule_wide(spark))
    assert lng.count() == 288
    acts = {(r.month, r.hour): r.action for r in lng.collect()}
    assert acts[(1, 7)] == "D" and acts[(1, 12)] == "C" and acts[(6, 9)] == "C" and acts[(6, 20)] == "D"
    assert acts[(6, 0)] == ""
    path = str(tmp_path / "sched")
    write_table(schedule_wide(lng).withColumnsRenamed({f"h{h}": str(h) for h in range(24)}), path, "csv")
    back = schedule_long(read_schedule_csv(spark, path))
    assert {(r.month, r.hour): r.action for r in back.collect()} == acts


def test_scenario_bundle_roundtrip(spark, tmp_path):
    path = str(tmp_path / "scn")
    SC.write_scenarios(SC.scenarios_df(spark, [SC.COMMERCIAL]), path)
    b = SC.read_scenarios(spark, path, multi_line=False)
    r = b.first()
    assert r.name == "Commercial C&I" and r.reliability_target_pct == 95.0 and r.run_config.rte == 0.86
    flat = SC.ranges_flat(b)
    assert flat.count() == 5
    nested = SC.ranges_nested(flat).first().screening_ranges
    assert list(nested.solar["values"]) == [20.0, 50.0, 80.0] and nested.gas.mode == "absolute"


def test_indented_scenario_file(spark, tmp_path):
    import json

    import pytest
    bundle = {"name": "one", "description": "d", "reliability_target_pct": 97.5, "grid_allowed": True,
              "run_config": {"load_mw": 42.0, "load_type": "24-7", "battery_power_mw": 1.0, "battery_duration_h": 2.0,
                             "rte": 0.9, "poi_limit_mw": 5.0},
              "econ": {"carbon_price_usd_per_ton": 12.0, "solar": {"capex_usd_per_kw": 1.0}},
              "screening_ranges": {n: {"name": n, "mode": "absolute", "values": [1.0]} for n in (
                  "solar", "wind", "bess_power", "bess_duration", "gas")}}
    (tmp_path / "a.json").write_text(json.dumps(bundle, indent=2))
    r = SC.read_scenarios(spark, str(tmp_path / "a.json")).first()
    assert r.run_config.base_load_mw == 42.0 and r.run_config.dt_hours == 1.0 and r.grid_allowed
    assert r.run_config.carbon_price_usd_per_ton == 12.0      # the economics' price is the run's
    assert r.econ.solar.capex_usd_per_kw == 1.0 and r.econ.solar.life_years == 30.0
    (tmp_path / "b.json").write_text(json.dumps({"title": "something else"}, indent=2))
    with pytest.raises(Exception, match="no scenario in"):
        SC.read_scenarios(spark, str(tmp_path / "b.json")).collect()


def test_csv_column_after_many_others(spark, tmp_path):
    (tmp_path / "wide.csv").write_text(",".join(["Datetime", *(f"x{k}" for k in range(80)), "Wind (MW)"]) + "\n"
                                       + ",".join(["2015-05-01 00:00:00", *["0"] * 80, "12.5"]) + "\n")
    (tmp_path / "narrow.csv").write_text("Datetime,Wind (MW)\n2015-05-01 00:00:00,3\n")
    got = {r.file_name: r.wind_mw for r in read_interval_csv(spark, str(tmp_path)).collect()}
    assert got == {"wide.csv": "12.5", "narrow.csv": "3"}


def test_csv_folder_with_differing_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Datetime,Wind (MW),Solar (MW),Load (MW),Market Price ($/MWh)\n2015-05-01 00:00:00,1,2,3,4\n")
    (tmp_path / "b.csv").write_text("Market Price ($/MWh),Load (MW),Datetime,Wind (MW)\n40,30,2015-05-01 00:00:00,10\n")
    got = {r.file_name: r for r in read_interval_csv(spark, str(tmp_path)).collect()}
    a, b = got["a.csv"], got["b.csv"]
    assert (a.wind_mw, a.solar_mw, a.load_mw, a.price) == ("1", "2", "3", "4")
    assert (b.wind_mw, b.solar_mw, b.load_mw, b.price) == ("10", None, "30", "40") and a.site_id != b.site_id


def test_required_columns(spark):
    import pytest
    df = spark.createDataFrame([(1, "2015-05-01 00:00:00", 1.0)], "site_id long, ts string, load_mw double")
    with pytest.raises(ValueError, match="price"):
        clean_intervals(df)


def test_random_load_is_random(spark):
    """Mean, variance and autocorrelation of the normal draws of consecutive hours."""
    import numpy as np
    from wattline.functions.profiles import std_normal
    rows = spark.range(0, 8 * 720).select((F.col("id") % 8).alias("s"), F.floor(F.col("id") / 8).alias("h")).withColumn(
        "z", std_normal(F.col("h") + 473_000, F.col("s"))).collect()
    for s in range(8):
        z = np.array([r.z for r in sorted(rows, key=lambda r: r.h) if r.s == s])
        assert abs(z.mean()) < 0.15 and abs(z.std() - 1) < 0.12
        z = z - z.mean()
        for lag in range(1, 60):
            assert abs((z[lag:] * z[:-lag]).mean() / z.var()) < 0.17


def test_checkpoint_folder_must_be_named_on_a_cluster(monkeypatch):
    import pytest
    from wattline import session

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_text_and_preview_sinks(spark, tmp_path):
    df = spark.range(30).withColumn("line", F.concat(F.lit("row "), F.col("id").cast("string")))
    assert [r.id for r in preview(df, ["id"], 5).collect()] == [0, 1, 2, 3, 4]
    write_text(df, "line", str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).count() == 30


def test_record_and_key_value_sinks(spark, tmp_path):
    from wattline.sources.sinks import write_key_values, write_records
    df = spark.createDataFrame([(1, 2.5, "x")], "site_id long, cost double, name string")
    write_records(df, str(tmp_path / "rec"))
    assert spark.read.json(str(tmp_path / "rec")).first().asDict() == {"site_id": 1, "cost": 2.5, "name": "x"}
    write_key_values(spark.createDataFrame([(1, "cost", 2.5)], "site_id long, metric string, value double"), str(tmp_path / "kv"))
    assert os.listdir(str(tmp_path / "kv"))


def test_entry_and_registry(spark):
    out = E.entry(spark)
    assert out.count() > 0
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 40
    for name, fn in q.items():
        assert fn.__doc__, name
    assert os.path.exists("/root/testdata/sf0.001/events.parquet")


def test_parse_values_and_action_code(spark):
    from wattline.functions.text import action_code, parse_values
    df = spark.createDataFrame([("10; 20 x,30",), ("",), (None,)], "t string")
    out = [r.v for r in df.select(parse_values(F.col("t"), [1.0]).alias("v")).collect()]
    assert out == [[10.0, 20.0, 30.0], [1.0], [1.0]]
    acts = spark.createDataFrame([(" c ",), (None,), ("d",)], "a string").select(action_code(F.col("a")).alias("x"))
    assert [r.x for r in acts.collect()] == ["C", "", "D"]


def test_gas_availability_and_tidy(spark):
    from wattline.functions.clean import tidy_columns, with_gas_availability
    df = spark.createDataFrame([(1, 5.0, None, "3", None), (1, 6.0, 2.0, "x", None)],
                               "site_id long, natgas_mw double, gas_avail_mw double, `Unnamed: 0` string, "
                               "empty double")
    av = [r.gas_avail_mw for r in with_gas_availability(df).collect()]
    assert av == [5.0, 2.0]
    assert [r.gas_avail_mw for r in with_gas_availability(df.drop("gas_avail_mw")).collect()] == [5.0, 6.0]
    t = tidy_columns(df, keep=("site_id",))
    assert t.columns == ["site_id", "natgas_mw", "gas_avail_mw"]


def _events(spark, path):
    """Events of some sites with gaps, repeated hours, null ids, times and values."""
    import datetime as dt
    rows, t0 = [], dt.datetime(2024, 1, 6, 5)
    for site in (*range(40), None):
        for i in range(6):
            at = t0 + dt.timedelta(hours=((site or 3) * 7 + i * i * 13) % 400, minutes=i)
            rows += [(at, site, kind, None if i == 4 else 1.5 * i + k) for k, kind in enumerate(("view", "click", "purchase"))]
    rows += [(None, 1, "view", 9.0)]
    spark.createDataFrame(rows, "ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return rows


def test_intervals_fill_each_hour_of_a_site_in_many_tasks(spark, tmp_path):
    import datetime as dt
    from wattline.sources.intervals import intervals_from_events
    rows = [r for r in _events(spark, str(tmp_path)) if r[0] is not None]
    floor = lambda t: t.replace(minute=0)
    for window in (None, ("2024-01-08", "2024-01-12")):
        want = {}
        for site in {r[1] for r in rows}:
            mine = [r for r in rows if r[1] == site]
            t, end = min(floor(r[0]) for r in mine), max(floor(r[0]) for r in mine)
            while t <= end:
                here = [r for r in mine if floor(r[0]) == t and site is not None]
                total = lambda *kinds: float(sum(r[3] for r in here if r[2] in kinds and r[3] is not None))
                sun = total("click") if 6 <= t.hour <= 18 else 0.0
                some = any(r[3] is not None for r in here)
                price = round(total("view", "click", "purchase") / len(here), 4) if some else 35.0
                if window is None or dt.datetime(2024, 1, 8) <= t < dt.datetime(2024, 1, 13):
                    want[site, t] = (total("view"), sun, 0.0, total("purchase"), price)
                t += dt.timedelta(hours=1)
        df = intervals_from_events(spark, str(tmp_path), window)
        got = df.collect()
        assert len(got) == len(want)
        assert {(r.site_id, r.ts): tuple(r)[2:] for r in got} == want
        assert df.select(F.spark_partition_id()).distinct().count() >= 6  # of 8; small tables were made in one


def test_distinct_times_are_counted_apart(spark):
    """No group per site and time carries the other facts."""
    import re
    from wattline.functions.clean import interval_quality
    df = spark.sql("""SELECT * FROM VALUES (1, '2024-01-01 00:00:00', 1.0), (1, '2024-01-01 00:00:00', 2.0), (1, 'x', 3.0),
                      (NULL, '2024-01-01 00:00:00', 4.0), (NULL, '2024-01-01 00:00:00', 4.0), (NULL, '2024-01-01 00:00:00', 4.0),
                      (2, NULL, 5.0) AS t(site_id, ts, load_mw)""").withColumn("price", F.lit(30.0))
    q = interval_quality(df)
    got = {r.site_id: (r.n_rows, r.n_bad_ts, r.n_repeated_ts) for r in q.collect()}
    assert got == {1: (3, 1, 1), None: (3, 0, 2), 2: (1, 1, 0)}
    plan = q._jdf.queryExecution().sparkPlan().toString()
    by_time = [a for a in re.findall(r"Aggregate\(keys?=\[([^\]]*)\], functions=\[([^\n]*)", plan) if "ts#" in a[0]]
    assert by_time and not any("max(price" in f for _, f in by_time)


def test_partitioned_writes_need_no_sort(spark, tmp_path):
    prepare_session(spark)
    df = spark.range(600).select("id", (F.col("id") % 24).cast("string").alias("month"))  # more months than open files
    df.createOrReplaceTempView("months_in")
    spark.sql(f"CREATE TABLE months_out (id LONG, month STRING) USING parquet PARTITIONED BY (month) LOCATION '{tmp_path}/t'")
    plan = spark.sql("EXPLAIN INSERT INTO months_out SELECT * FROM months_in").collect()[0][0]
    spark.sql("DROP TABLE months_out")
    assert "Sort" not in plan
    write_table(df, f"{tmp_path}/rows", partition_by=["month"])
    back = spark.read.schema("id long, month string").parquet(f"{tmp_path}/rows")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
