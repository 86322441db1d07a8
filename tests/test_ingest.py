from __future__ import annotations

import dataclasses
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from panelspark.functions.periods import decimal_year, label_from_ix, parse_period, period_ix, period_label
from panelspark.functions.timeline import totals_before
from panelspark.operators import events as ev, ingest as ing, quality as dq
from panelspark.schema import TABLES, DataQualityError
from panelspark.sources import normalize as nz, release as rel, tables as st
from panelspark.streaming import landing

DAY = dt.date(2026, 1, 1)


def test_period_parsing(spark):
    good = {"2020": (2020, 0, 0), "2020-Q3": (2020, 3, 0), "2020-07": (2020, 0, 7), " 2020-12 ": (2020, 0, 12)}
    bad = ["", "20", "2020-13", "2020-Q5", "2020-W07", "2020-07-15", "n/a", "2020-00"]
    rows = spark.createDataFrame([(p,) for p in [*good, *bad]], "p string").select("p", parse_period("p").alias("r"))
    for r in rows.collect():
        assert (tuple(r["r"]) if r["r"] else None) == good.get(r["p"])


def test_period_arithmetic(spark):
    rows = [(2020, 0, 0, 1), (2020, 4, 0, 4), (2020, 0, 12, 12), (2020, 0, 1, 12)]
    df = spark.createDataFrame(rows, "year int, quarter int, month int, freq int")
    got = df.select(period_label().alias("a"), decimal_year().alias("t"), period_ix().alias("ix"),
                    label_from_ix(period_ix(), "freq").alias("b"),
                    label_from_ix(period_ix() + F.lit(12) / F.col("freq"), "freq").alias("next")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == ["2020", "2020-Q4", "2020-12", "2020-01"]
    assert [r["next"] for r in got] == ["2021", "2021-Q1", "2021-01", "2020-02"]
    assert got[1]["t"] == 2020.75


def test_validation_order(spark):
    rows = [(1, "DEU", "x", 2020, 1.0), (2, "DEU", "x", 2020, 2.0), (3, "XXX", "x", 1700, 1.0),
            (4, "DEU", "x", 1700, 1.0), (5, "DEU", "x", 2021, float("nan")), (6, "DEU", "y", 2021, None)]
    df = spark.createDataFrame(rows, "ordinal int, iso3 string, indicator_code string, year int, value double")
    df = df.withColumn("quarter", F.lit(None).cast("int")).withColumn("month", F.lit(None).cast("int"))
    valid, rejected = ing.validate(df, spark.createDataFrame([("DEU",), ("DEU",)], "code string"))
    assert [r["ordinal"] for r in valid.collect()] == [1]
    assert {r["ordinal"]: r["reason"] for r in rejected.collect()} == {
        2: "duplicate", 3: "unknown_iso3", 4: "year_out_of_range", 5: "non_finite_value", 6: "non_finite_value"}


def test_dedup_and_append_are_idempotent(spark, make_panel):
    p = make_panel([("DEU", 1, 4, 2015, 1), ("DEU", 1, 4, 2015, 1), ("FRA", 1, 4, 2015, 2), ("FRA", 1, 4, 2015, 2),
                    ("FRA", 1, 4, 2015, 3, dt.date(2027, 1, 1))])
    old = p.records.withColumn("quarter", F.nullif("quarter", F.lit(0))).withColumn(
        "retrieved_at", F.lit(None).cast("timestamp"))
    clean = ing.dedup_records(old)
    assert clean.count() == 3 and clean.where("quarter <> 0 or month <> 0").count() == 0
    assert sorted(r["id"] for r in clean.collect()) == [1, 3, 4]          # highest id wins
    assert ing.dedup_records(clean).exceptAll(clean).count() == 0
    assert ing.append_new(clean, clean).count() == 0
    undated = clean.withColumn("vintage_date", F.lit(None).cast("date"))
    assert ing.append_new(clean, undated).count() == 2                    # without dates FRA has one key, kept once
    assert ing.append_new(undated, undated).count() == 0                  # null vintages match
    view = ["geography_id", "indicator_id", "year", "quarter", "month", "value"]
    after = dataclasses.replace(p, records=clean, _views={})
    ing.assert_same_view(p.best, after.best, view)
    with pytest.raises(DataQualityError):
        ing.assert_same_view(p.best, after.best.where("geography_id = 1"), view)
    with pytest.raises(DataQualityError):
        ing.assert_same_view(p.best.limit(0), after.best, view)


def test_key_resolution_counts_the_unmatched(spark, make_panel):
    p = make_panel([("DEU", 1, 4, 2015, 1)])
    rows = spark.createDataFrame([("FR10", "demo_pjan"), ("DEU", "nope"), ("ZZZ", "alpha")], "iso3 string, indicator_code string")
    matched, unmatched = ing.resolve_keys(rows, p.geography, p.indicator)
    assert [(r["geography_id"], r["indicator_id"]) for r in matched.collect()] == [(11, 3)] and unmatched.count() == 2


def test_ingestion_summary(spark):
    t = dt.datetime(2026, 1, 1)
    hour = dt.timedelta(hours=1)
    runs = spark.createDataFrame([("a", t, t + hour, "completed", 5, None), ("a", t + 5 * hour, None, "failed", 0, "x"),
                                  ("b", t, t + hour, "completed", 1, None), ("b", t, t + hour, "completed", 1, None)],
                                 TABLES["ingestion_run"].simpleString()[7:-1].replace(":", " "))
    runs = runs if "started_at" in runs.columns else runs.toDF(*TABLES["ingestion_run"].names)
    errors = spark.createDataFrame([("a", "s", "e", t + hour / 2), ("a", "s", "e", t + hour), ("a", "s", "e", t + 2 * hour),
                                    ("b", "s", "e", t - hour)], TABLES["ingestion_error"])
    got = sorted((r["source"], r["status"], r["series_errors"]) for r in ing.ingestion_summary(runs, errors).collect())
    assert got == [("a", "completed", 2), ("a", "failed", 0), ("b", "completed", 0), ("b", "completed", 0)]


def test_timeline_totals(spark):
    obs = [("k", 3 * i % 50, float(i)) for i in range(40)] + [("other", 5, 1.0)]
    probes = [("k", p, at) for p, at in enumerate((-5, 0, 7, 7, 23, 49, 50, 99))] + [("none", 9, 5)]
    got = totals_before(spark.createDataFrame(obs, "key string, at int, value double"),
                        spark.createDataFrame(probes, "key string, probe int, at int"), ["key"], 10).collect()
    assert len(got) == len(probes)
    for r in got:
        hit = [v for k, a, v in obs if k == r["key"] and a < r["at"]]
        assert (r["n_before"], float(r["sum_before"])) == (len(hit), sum(hit))


def test_point_event_study_against_brute_force(spark):
    obs = [(f"u{i % 3 % 2}", (i * 37) % 200, float(i % 11)) for i in range(150)]
    events = [(f"e{i}", f"u{i % 2}", 20 * i + 3) for i in range(9)]
    got = ev.point_event_study(spark.createDataFrame(events, "event_code string, unit string, tick int"),
                               spark.createDataFrame(obs, "unit string, tick int, value double"), window=25, chunk=7)
    rows = {r["event_code"]: r for r in got.collect()}
    for code, unit, at in events:
        before = [v for u, t, v in obs if u == unit and at - 25 <= t < at]
        after = [v for u, t, v in obs if u == unit and at <= t <= at + 25]
        if not before or not after:
            assert code not in rows
            continue
        assert rows[code]["n_before"] == len(before) and rows[code]["n_after"] == len(after)
        assert rows[code]["delta"] == pytest.approx(sum(after) / len(after) - sum(before) / len(before))


# --- normalizers -------------------------------------------------------------
def _sdmx(spark, rows):
    return spark.createDataFrame(rows, nz.SDMX_COLUMNS)


def test_sdmx_and_currency_rows(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("KEY,REF_AREA,CURRENCY,TIME_PERIOD,OBS_VALUE\nM1,FR,EUR,2020-07,1.5\nM2,XX,EUR,2020-07,1\n"
                    "M3,DE,EUR,2020-W01,1\nM4,DE,EUR,2020,oops\n")
    areas = nz.lookup(spark, {"FR": "FRA", "DE": "DEU"})
    out = nz.normalize_sdmx(nz.read_sdmx_csv(spark, str(path)), areas, "IRS").collect()
    assert [(r["iso3"], r["year"], r["month"], r["value"], r["currency"]) for r in out] == [("FRA", 2020, 7, 1.5, "EUR")]
    rates = _sdmx(spark, [("", "GBP", "2020-01", "0.85"), ("", "PLN", "2020-01", "4.2"), ("", "USD", "2020-01", "1.1")])
    got = nz.normalize_exchange_rates(rates, nz.lookup(spark, nz.CURRENCY_ISSUERS), "EXR").collect()
    assert {(r["iso3"], r["unit"]) for r in got} == {("GBR", "GBP per EUR"), ("POL", "PLN per EUR")}
    known = spark.createDataFrame([("FRA",)], "iso3 string")
    one = nz.normalize_iso3(_sdmx(spark, [("FRA", None, "2020-Q2", "7"), ("EA19", None, "2020-Q2", "8")]), known, "U", "%")
    assert [(r["iso3"], r["quarter"], r["unit"]) for r in one.collect()] == [("FRA", 2, "%")]


@pytest.mark.parametrize("as_list", [True, False])
def test_cube(spark, as_list):
    def index(codes):
        return codes if as_list else {c: i for i, c in reversed(list(enumerate(codes)))}

    cube = {"id": ["unit", "geo", "time"], "size": [1, 2, 2], "value": {"0": 10, "1": 11, "3": 21.5},
            "dimension": {"unit": {"category": {"index": index(["PC"])}},
                          "geo": {"category": {"index": index(["EL", "FR"])}},
                          "time": {"category": {"index": index(["2020", "2021"])}}}}
    rows = nz.flatten_jsonstat(spark.createDataFrame([("d#y", json.dumps(cube))], "code string, payload string"))
    assert {(r["geo"], r["TIME_PERIOD"], r["value"]) for r in rows.collect()} == {
        ("EL", "2020", 10.0), ("EL", "2021", 11.0), ("FR", "2021", 21.5)}
    out = nz.normalize_cube(rows, nz.lookup(spark, {"FR": "FRA"}), F.col("code")).collect()
    assert {(r["iso3"], r["year"], r["indicator_code"]) for r in out} == {
        ("GRC", 2020, "d#y"), ("GRC", 2021, "d#y"), ("FRA", 2021, "d#y")}
    regions = spark.createDataFrame([("FR",)], "code string")
    assert [r["iso3"] for r in nz.normalize_cube(rows, None, "d", known_regions=regions).collect()] == ["FR"]
    assert rows.select(nz.dataset_id(F.col("code")).alias("d")).first()["d"] == "d"


def test_wide(spark):
    wide = spark.createDataFrame([("FRA", 1.0, None), ("USA", 2.0, 3.0)], "economy string, YR2000 double, YR2001 double")
    out = nz.normalize_wide(wide, spark.createDataFrame([("FRA",)], "iso3 string"), "pop", ["YR2000", "YR2001"])
    assert [(r["iso3"], r["year"], r["value"]) for r in out.collect()] == [("FRA", 2000, 1.0)]
    codes = spark.createDataFrame([("pop", "demo_pjan")], "external string, catalog string")
    assert nz.map_codes(out, codes).first()["indicator_code"] == "demo_pjan"


# --- contracts, release ------------------------------------------------------
def _check(df):
    row = df.first()
    return row["passed"], row["severity"], row["blocking"]


def test_contracts_pass_and_fail(spark, make_panel):
    rows = [("FRA", 3, 4, 2020, 30), ("FR10", 3, 4, 2020, 20), ("FR20", 3, 4, 2020, 10)]
    p = make_panel(rows)
    assert _check(dq.check_rollup(p)) == (True, "error", False)
    off = make_panel([*rows[:2], ("FR20", 3, 4, 2020, 30)])
    assert _check(dq.check_rollup(off)) == (False, "error", True)
    assert dq.check_rollup(off).first()["metrics"]["n_mismatched"] == 1
    zero = make_panel([("FRA", 3, 4, 2020, 0), ("FR10", 3, 4, 2020, 0)])
    assert _check(dq.check_rollup(zero)) == (False, "error", True)
    assert _check(dq.check_rollup(make_panel([("DEU", 3, 4, 2020, 1)]))) == (True, "warn", False)
    assert _check(dq.check_row_count(p.records, 3)) == (True, "error", False)
    assert _check(dq.check_row_count(p.records, 4)) == (False, "error", True)
    assert _check(dq.check_fk(p.records, p.geography, p.indicator, p.source)) == (True, "error", False)
    orphan = make_panel([*rows, ("NOWHERE", 3, 4, 2020, 1)])
    assert dq.check_fk(orphan.records, p.geography, p.indicator, p.source).first()["metrics"]["orphan_geography"] == 1
    assert _check(dq.check_finite(p.records)) == (True, "error", False)
    bad = make_panel([("FRA", 3, 4, 2020, float("inf")), ("FRA", 3, 4, 2021, None), ("FRA", 3, 4, 2022, float("nan"))])
    assert dq.check_finite(bad.records).first()["metrics"]["non_finite"] == 2


@pytest.mark.parametrize("last, want", [(2024, (True, "warn", False)), (2022, (False, "warn", False)),
                                        (2018, (False, "error", True))])
def test_freshness(make_panel, last, want):
    p = make_panel([("DEU", 1, 4, last, 1)])
    assert _check(dq.check_freshness(p.records, p.indicator, "2026-01-01")) == want


def test_latest_run_decides(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("a", t, t, "failed", 0, None), ("a", t + dt.timedelta(1), t, "completed", 0, None)]
    assert _check(dq.check_runs(spark.createDataFrame(rows, TABLES["ingestion_run"]))) == (True, "error", False)
    rows.append(("a", t + dt.timedelta(2), t, "failed", 0, "boom"))
    row = dq.check_runs(spark.createDataFrame(rows, TABLES["ingestion_run"])).first()
    assert row["blocking"] and "a" in row["detail"]


def test_release_gate_and_exports(spark, make_panel, tmp_path):
    p = make_panel([("DEU", 1, 4, (2025, 0, 1), 1), ("DEU", 1, 4, (2025, 0, 2), 2), ("DEU", 1, 5, 2025, 9)])
    out = str(tmp_path / "release")
    with pytest.raises(DataQualityError, match="row_count"):
        rel.gated_release(p, out, "2026-01-01")
    rel.gated_release(p, out, "2026-01-01", min_rows=1)
    rows = spark.read.parquet(out).collect()
    assert {(r["source_name"], r["month"]) for r in rows} == {("S four", 1), ("S four", 2)}
    report = dq.run_checks(p, "2026-01-01")
    assert "BLOCKED" in dq.summary(report) and report.count() == 5
    rel.export_view(p.best.select("year", "value"), str(tmp_path / "v"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "v")).count() == 3
    with pytest.raises(ValueError):
        rel.export_view(p.best, out, "xls")


def test_upsert_and_manifest(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "u", 1.0), (2, "b", "v", 2.0)], "id int, name string, unit string, x double")
    new = spark.createDataFrame([(2, "B", None, 9.0), (3, "C", "w", 3.0)], "id int, name string, unit string, x double")
    got = {r["id"]: tuple(r)[1:] for r in st.upsert_dim(old, new, ["id"], ["name", "unit"]).collect()}
    assert got == {1: ("a", "u", 1.0), 2: ("B", "v", 2.0), 3: ("C", "w", 3.0)}
    import hashlib

    (tmp_path / "p.raw").write_bytes(b"payload")
    digest = hashlib.sha256(b"payload").hexdigest()
    row = st.snapshot_files(spark, str(tmp_path), "src").first()
    assert row["sha256"] == digest and row["file_name"].endswith(f"_{digest[:12]}.raw") and "/" not in row["file_name"]


def stored_panel(p, root):
    for name in ("geography", "indicator", "source"):
        df = getattr(p, name)
        df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                    for f in TABLES[name]]).write.parquet(f"{root}/{name}")
    facts = p.records.select(*[(F.col(f.name) if f.name in p.records.columns else F.lit(None)).cast(f.dataType)
                               .alias(f.name) for f in TABLES["statistic_record"]])
    st.write_records(facts, root, "overwrite")


def test_landing_stream_is_idempotent(spark, make_panel, tmp_path):
    p = make_panel([("DEU", 1, 4, 2015, 1)])
    root = str(tmp_path / "panel")
    stored_panel(p, root)
    rows = [("DEU", "nama_10_gdp", 2015, None, None, 1.0, None, None, None, "S four", DAY, 1),
            ("DEU", "nama_10_gdp", 2016, None, None, 2.0, None, None, None, "S four", DAY, 2),
            ("DEU", "nama_10_gdp", 2016, None, None, 3.0, None, None, None, "S one", DAY, 3),
            ("QQQ", "nama_10_gdp", 2016, None, None, 3.0, None, None, None, "S one", DAY, 4)]
    batch = spark.createDataFrame(rows, landing.LANDING)
    batch.write.mode("append").parquet(str(tmp_path / "in"))
    for attempt in range(2):       # the second run has lost its stream state, so it replays the file
        query = landing.start(spark, str(tmp_path / "in"), root, str(tmp_path / f"ckpt{attempt}"))
        query.awaitTermination(120)
        stored = st.read_table(spark, root, "statistic_record")
        assert sorted((r["source_id"], r["year"], r["value"]) for r in stored.collect()) == [
            (1, 2016, 3.0), (4, 2015, 1.0), (4, 2016, 2.0)]
        assert stored.select("id").distinct().count() == 3
    logged = st.read_table(spark, root, "ingestion_error").collect()
    assert {(r["source"], r["error"]) for r in logged} == {("S one", "unknown_iso3: 1 rows")}
    runs = sorted((r["source"], r["status"], r["records_processed"]) for r in st.read_table(spark, root, "ingestion_run").collect())
    assert runs == [("S four", "completed", 0), ("S four", "completed", 1), ("S one", "completed_with_errors", 0),
                    ("S one", "completed_with_errors", 1)]


def test_repeated_ordinals_are_rows_of_their_own(spark, make_panel):
    p = make_panel([("DEU", 1, 4, 2015, 1)])
    facts = p.records.withColumn("vintage_date", F.lit(DAY))
    rows = [("DEU", "nama_10_gdp", 2015, None, None, 1.0, None, None, None, "S four", DAY, 0),
            ("DEU", "nama_10_gdp", 2016, None, None, 2.0, None, None, None, "S four", DAY, 0)] + [
            ("FRA", "nama_10_gdp", 2016, None, None, 5.0, None, None, None, "S four", DAY, None)] * 3
    judged = landing.judge_batch(spark.createDataFrame(rows, landing.LANDING).repartition(3), facts, p.geography, p.indicator, p.source)
    assert sorted((r["iso3"], r["year"], r["status"]) for r in judged.collect()) == [
        ("DEU", 2015, "known"), ("DEU", 2016, "stored"), ("FRA", 2016, "duplicate"), ("FRA", 2016, "duplicate"), ("FRA", 2016, "stored")]
    new = landing.facts(judged, 2).collect()
    assert len({r["id"] for r in new}) == len(new) == 2 and all(2 << 40 <= r["id"] < 3 << 40 for r in new)


@pytest.mark.parametrize("fails_at", ["append_new", "problems", "run_log", None])
def test_a_replayed_batch_takes_effect_once(spark, make_panel, tmp_path, monkeypatch, fails_at):
    """The first attempt dies before the facts, the errors or the runs are written, or after all of them."""
    root = str(tmp_path / "panel")
    stored_panel(make_panel([("DEU", 1, 4, 2015, 1)]), root)
    rows = [("DEU", "nama_10_gdp", 2016, None, None, 2.0, None, None, None, "S four", DAY, 0),
            ("QQQ", "nama_10_gdp", 2016, None, None, 3.0, None, None, None, "S four", DAY, 0)]
    batch = spark.createDataFrame(rows, landing.LANDING)
    if fails_at:
        real, calls = getattr(landing, fails_at), []

        def dies(*args):
            calls.append(1)
            if len(calls) == (2 if fails_at == "append_new" else 1):       # judging appends too
                raise RuntimeError("executor lost")
            return real(*args)

        with monkeypatch.context() as m:
            m.setattr(landing, fails_at, dies)
            with pytest.raises(RuntimeError):
                landing.refresh(batch, spark, root, 7, "s")
    for _ in range(1 if fails_at else 2):
        total = landing.refresh(batch, spark, root, 7, "s").collect()
        assert [(r["received"], r["inserted"], r["rejected"]) for r in total] == [(2, 1, 1)]
    assert sorted(r["year"] for r in st.read_table(spark, root, "statistic_record").collect()) == [2015, 2016]
    assert [r["error"] for r in st.read_table(spark, root, "ingestion_error").collect()] == ["unknown_iso3: 1 rows"]
    runs = st.read_table(spark, root, "ingestion_run").collect()
    assert [(r["status"], r["records_processed"]) for r in runs] == [("completed_with_errors", 1)]
    if fails_at:
        return
    landing.refresh(batch, spark, root, 8, "s")
    assert [f.name for f in (tmp_path / "panel" / "landing_journal").iterdir() if not f.name.startswith(".")] == ["s-8"]
    assert st.read_table(spark, root, "ingestion_run").count() == 2


def test_every_landed_row_is_accounted_for(spark, make_panel):
    p = make_panel([("DEU", 1, 4, 2015, 1)])
    facts = p.records.withColumn("vintage_date", F.lit(DAY))
    rows = [("DEU", "nama_10_gdp", 2015, None, None, 1.0, None, None, None, "S four", DAY, 1),
            ("DEU", "nama_10_gdp", 2016, None, None, 2.0, None, None, None, "S four", DAY, 2),
            ("DEU", "nama_10_gdp", 2016, None, None, 9.0, None, None, None, "S four", DAY, 3),
            ("DEU", "no_such", 2016, None, None, 9.0, None, None, None, "S four", DAY, 4),
            ("DEU", "nama_10_gdp", 2016, None, None, None, None, None, None, "S one", DAY, 5),
            ("DEU", "nama_10_gdp", 2016, None, None, 1.0, None, None, None, "who", DAY, 6),
            ("DEU", "nama_10_gdp", 2016, None, None, 1.0, None, None, None, None, DAY, 7)]
    judged = landing.judge_batch(spark.createDataFrame(rows, landing.LANDING), facts, p.geography, p.indicator, p.source)
    assert {r["ordinal"]: r["status"] for r in judged.collect()} == {
        1: "known", 2: "stored", 3: "duplicate", 4: "unmatched", 5: "non_finite_value", 6: "unknown_source", 7: "unknown_source"}
    total = landing.accounting(judged).groupBy().sum().first()
    assert total["sum(received)"] == 7 and total["sum(inserted)"] == 1 and total["sum(rejected)"] == 4
    assert sorted(r["value"] for r in landing.facts(judged, 3).collect()) == [2.0]


def test_append_keeps_one_row_of_a_key(spark, make_panel):
    p = make_panel([("DEU", 1, 4, 2015, 1), ("DEU", 1, 4, 2016, 1)])
    twice = p.records.where("year = 2016").withColumn("ordinal", F.explode(F.array(F.lit(7), F.lit(5)))).withColumn(
        "value", F.col("ordinal") * 1.0)
    kept = ing.append_new(p.records.where("year = 2015"), twice, "ordinal").collect()
    assert [r["value"] for r in kept] == [5.0]


def test_views_are_compared_in_all_tasks(spark):
    """Both views' windows and two hash tables of their rows met in one packed task (F16)."""
    from panelspark.operators import ingest as ing, views

    facts = spark.createDataFrame([(g, 1, s, 2000, 0, 0, None, float(g)) for g in range(40) for s in (1, 2)],
                                  "geography_id int, indicator_id int, source_id int, year int, quarter int, month int, vintage_date date, value double")
    scores = spark.createDataFrame([(1, .9), (2, .8)], "id int, reliability_score double")
    best = views.best_source(facts, scores)
    columns = ["geography_id", "indicator_id", "year", "quarter", "month", "value"]
    odd = spark.createDataFrame([(0, 1, 2000, 0, 0, 0.0), (0, 1, 2000, 0, 0, 0.0), (None, 1, 2000, 0, 0, None)],
                                "geography_id int, indicator_id int, year int, quarter int, month int, value double")
    out = ing.view_difference(best, odd, columns)
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    assert tuple(out.first()) == (40, 39, 2)


def test_release_facts_are_dealt_before_they_get_their_labels(spark, make_panel):
    """A writer sorts the labelled rows: 715 MB in one packed task (F14)."""
    from panelspark.sources import release as rel

    facts = rel.release_facts(make_panel([("DEU", 1, 1, 2000 + y, float(y)) for y in range(9)] + [("FRA", 1, 5, 2000, 1.0)]))
    assert facts._jdf.queryExecution().executedPlan().toString().count(", 2), REPARTITION_BY_NUM") == 1
    assert sorted(r["value"] for r in facts.collect()) == [float(y) for y in range(9)]
