from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.api import PanelData
from panelspark.functions.ranking import cumulative_counts, group_median
from panelspark.operators import aggregates as agg, revisions as rev, series as ser, views
from panelspark.schema import PanelLookupError

GDP, UNEMP = 1, 2


@pytest.fixture(scope="module")
def data(make_panel, make_events):
    rows = [("DEU", GDP, 4, 2010 + i, 100 + 10 * i) for i in range(11)]
    rows += [("FRA", GDP, 4, 2010 + i, 90 + 8 * i) for i in range(11)]
    rows += [("DEU", UNEMP, 4, y, 1.0 if y < 2020 else 2.0) for y in range(2017, 2024)]
    a = [1, 4, 2, 8, 5, 7, 3, 6, 9, 2, 5]
    rows += [("ITA", 4, 4, 2010 + i, v) for i, v in enumerate(a)]
    rows += [("ITA", 5, 4, 2012 + i, v) for i, v in enumerate(a)]
    rows += [("ESP", UNEMP, 4, (2019 + i // 12, 0, i % 12 + 1), 1.0 + i // 12) for i in range(24)]
    events = make_events([("pandemic", "Pandemic", "pandemic", None, None, dt.date(2020, 3, 11), "health,shock"),
                          ("vote", "Vote", "policy", "GBR", None, dt.date(2016, 6, 23), "vote"),
                          ("pact", "Pact", "policy", None, "EU", dt.date(2019, 5, 1), "fiscal")])
    return PanelData(make_panel(rows, event=events))


def test_yoy_and_rebase(data):
    yoy = data.series(country="Germany", indicator="gdp", yoy=True).collect()
    assert len(yoy) == 10 and yoy[0]["year"] == 2011 and yoy[0]["value"] == pytest.approx(10)
    base = {(r["unit"], r["year"]): r["value"] for r in data.series(indicator="GDP", rebase=2010).collect()}
    assert base["DEU", 2020] == pytest.approx(200) and base["FRA", 2010] == pytest.approx(100)
    with pytest.raises(ValueError):
        data.series(rebase=2010, yoy=True)


def test_latest_rank_and_median(data):
    latest = agg.latest(ser.series(data.panel)).where("indicator = 'GDP'")
    rows = {r["unit"]: r for r in agg.headline(latest, ["GDP"]).collect()}
    assert rows["DEU"]["median"] == 185 and rows["DEU"]["rank"] == 1 and rows["FRA"]["rank"] == 2
    assert rows["DEU"]["of"] == 2
    assert [r["unit"] for r in data.latest("GDP").collect()] == ["DEU", "FRA"]


def test_headline_ties_break_by_unit(spark):
    rows = spark.createDataFrame([(u, "I", 5.0 if u < "d" else 1.0, "x", "2020") for u in "fedcba"],
                                 "unit string, indicator string, value double, value_unit string, period string")
    ranks = {r["unit"]: r["rank"] for r in agg.headline(rows, ["I"]).collect()}
    assert ranks == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "f": 6}


def test_event_study_annual_and_monthly(data):
    rows = {r["unit"]: r for r in data.event_study("Unemployment Rate", event_code="pandemic").collect()}
    deu = rows["DEU"]
    assert (deu["before_mean"], deu["after_mean"], deu["delta"], deu["pct_change"]) == (1.0, 2.0, 1.0, 100.0)
    esp = data.event_study("Unemployment Rate", event_code="pandemic", window_years=1).where("unit = 'ESP'").first()
    assert (esp["n_before"], esp["n_after"]) == (12, 10)
    assert esp["before_mean"] == pytest.approx(14 / 12)
    with pytest.raises(PanelLookupError):
        data.event_study("GDP", event_code="nothing")


def test_lagged_correlation(data):
    levels = data.lagged_correlation("Alpha", "Beta", lag=2, on="levels", min_years=8).first()
    assert levels["unit"] == "ITA" and levels["correlation"] == pytest.approx(1.0) and levels["n_years"] == 11
    same = data.correlate("Alpha", "Beta", on="levels", min_years=8).collect()
    assert all(r["correlation"] < .9 for r in same)
    assert data.lagged_correlation("Alpha", "Beta", lag=2, min_years=8).first()["n_years"] == 10
    with pytest.raises(ValueError):
        data.correlate("Alpha", "Beta", on="ranks")


def test_provenance_and_disagreements(make_panel):
    p = make_panel([("DEU", GDP, 4, 2015, 150), ("DEU", GDP, 1, 2015, 999), ("DEU", GDP, 4, 2016, 7),
                    ("DEU", GDP, 1, 2016, 7), ("FRA", GDP, 4, 2015, 1)])
    rows = views.provenance(p.current, p.source, p.indicator, p.geography).where("period = '2015' and unit = 'DEU'")
    assert {(r["source"], r["value"], r["is_best"]) for r in rows.collect()} == {
        ("S four", 150.0, False), ("S one", 999.0, True)}
    split = views.source_disagreements(p.current, p.source, p.indicator, p.geography).collect()
    assert {(r["period"], r["unit"]) for r in split} == {("2015", "DEU")} and len(split) == 2


def test_revisions(make_panel):
    later = dt.date(2027, 1, 1)
    p = make_panel([("FRA", GDP, 4, 2015, 130), ("FRA", GDP, 4, 2015, 999, later), ("FRA", GDP, 4, 2016, 5),
                    ("FRA", GDP, 4, 2016, 5, later), ("DEU", GDP, 4, 2015, 10), ("DEU", GDP, 4, 2015, 11, None)])
    trail = rev.revisions(p.records).orderBy("vintage_date").collect()
    assert [(r["period"], r["value"], r["previous_value"], r["is_latest"]) for r in trail] == [
        ("2015", 130.0, None, False), ("2015", 999.0, 130.0, True)]
    assert trail[1]["delta"] == 869 and trail[1]["pct_change"] == pytest.approx(869 / 130 * 100)
    summary = rev.revision_periods(p.records).collect()
    assert len(summary) == 1 and summary[0]["latest_value"] == 999
    handle = PanelData(p)
    assert handle.revisions("GDP", "DEU").count() == 0
    assert [r["country"] for r in handle.revisions_summary().collect()] == ["FRA"]


def test_current_vintage_keeps_ties_and_best_is_unique(make_panel):
    p = make_panel([("DEU", GDP, 4, 2021, 100, dt.date(2021, 1, 1)), ("DEU", GDP, 4, 2021, 105, dt.date(2022, 1, 1)),
                    ("FRA", GDP, 4, 2021, 1, None), ("FRA", GDP, 4, 2021, 2, None)])
    assert p.records.count() == 4
    assert sorted(r["value"] for r in p.current.collect()) == [1.0, 2.0, 105.0]
    assert p.best.count() == 2
    assert views.as_of(p.records, "2021-06-30").where("geography_id = 1").first()["value"] == 100


def test_trends_share_a_base_year(make_panel):
    rows = [("DEU", GDP, 4, y, 100 + y - 2010) for y in range(2010, 2019)]
    rows += [("FRA", UNEMP, 4, y, 50 + y - 2010) for y in range(2010, 2019)]
    data = PanelData(make_panel(rows))
    out = data.indicator_trends(["GDP", "Unemployment Rate"]).collect()
    assert {r["base_year"] for r in out} == {2010}
    assert all(r["value"] == pytest.approx(100) for r in out if r["year"] == 2010)
    cut = data.indicator_trends(["GDP", "Unemployment Rate"], start=2015, end=2018).collect()
    assert {r["base_year"] for r in cut} == {2015}
    assert data.indicator_trends(["GDP", "Alpha"]).count() == 0


def test_compare_and_extracts(data):
    wide = data.compare(["DEU", "fr"], "GDP", start=2019).collect()
    assert [(r["period"], r["DEU"], r["FRA"]) for r in wide] == [("2019", 190.0, 162.0), ("2020", 200.0, 170.0)]
    matrix = ser.observation_matrix(ser.series(data.panel), ["GDP", "Alpha"])
    assert matrix.where("unit = 'ITA' and year = 2011").first()["Alpha"] == 4
    kpi = ser.kpi(ser.series(data.panel)).where("unit = 'DEU' and indicator = 'GDP'").first()
    assert kpi["value"] == 200 and kpi["yoy"] == pytest.approx(10 / 190 * 100)


def test_names_blocs_and_search(data):
    with pytest.raises(PanelLookupError, match="Germany"):
        data.series(country="Germny")
    with pytest.raises(PanelLookupError):
        data.bloc_members("XX")
    with pytest.raises(PanelLookupError):
        data.series(bloc="XX")
    assert {r["iso3"] for r in data.countries().collect()} == {"DEU", "FRA", "ITA", "ESP", "GBR"}
    assert [r["code"] for r in data.regions("FRA").collect()] == ["FR10", "FR20"]
    assert {(r["code"], r["current_members"]) for r in data.blocs().collect()} == {("EU", 3), ("EZ", 2)}
    assert data.bloc_members("eu").count() == 4
    assert [r["bloc_code"] for r in data.country_blocs("GBR").collect()] == ["EU"]
    assert [r["name"] for r in data.search_indicators("0% COVER_").collect()] == ["100% Cover_age"]
    assert data.search_indicators("cover-").count() == 0
    assert {r["unit"] for r in data.series(bloc="ez", indicator="GDP").collect()} == {"DEU", "FRA"}
    assert data.years() == (2010, 2023)
    assert data.query("select count(*) as n from statistic_best where indicator_id = 1").first()["n"] == 22


def test_events_and_scopes(data):
    assert {r["code"] for r in data.events(country="DEU").collect()} == {"pandemic", "pact"}
    assert {r["code"] for r in data.events(country="GBR").collect()} == {"pandemic", "vote"}
    assert [r["code"] for r in data.events(tag="fiscal").collect()] == ["pact"]
    assert data.events(tag="fisc").count() == 0
    assert {(r["event_type"], r["events"]) for r in data.event_types().collect()} == {("policy", 2), ("pandemic", 1)}
    from panelspark.operators.events import expand_events

    p = data.panel
    spread = expand_events(p.event, p.geography, p.bloc, p.geography_bloc)
    units = {(r["code"], r["unit"]) for r in spread.collect()}
    assert ("pact", "GBR") in units and ("pact", "ESP") not in units
    assert {u for c, u in units if c == "pandemic"} == {"DEU", "FRA", "ITA", "ESP", "GBR"}


def test_coverage_and_profile(make_panel):
    rows = [(c, GDP, 4, y, v * (y - 2000)) for v, c in enumerate(("DEU", "FRA", "ITA", "ESP", "GBR"), 1)
            for y in (2010, 2020)]
    rows += [(c, UNEMP, 4, y, -v * (y - 2000)) for v, c in enumerate(("DEU", "FRA", "ITA", "ESP", "GBR"), 1)
             for y in (2010, 2020)]
    data = PanelData(make_panel(rows))
    cover = {r["indicator"]: r for r in data.coverage(as_of_year=2026).collect()}
    assert cover["GDP"]["rows"] == 10 and cover["GDP"]["countries"] == 5 and cover["GDP"]["years_stale"] == 6
    assert cover["Alpha"]["rows"] == 0 and cover["Alpha"]["last_year"] is None
    gbr = data.country_profile("GB").first()
    assert gbr["fastest_rising"]["indicator"] == "GDP" and gbr["fastest_rising"]["percentile"] == 100
    assert gbr["fastest_falling"]["indicator"] == "Unemployment Rate"
    assert gbr["headline"][0]["rank"] == 1 and gbr["n_indicators"] == 2
    assert gbr["blocs"][0]["until_year"] == 2020
    deu = data.country_profile("DEU").first()
    # its unemployment fell least and its GDP rose least: the top is no rise, the bottom no fall
    assert deu["fastest_rising"] is None and deu["fastest_falling"] is None


def test_counts_and_medians_against_brute_force(spark):
    import random
    import statistics

    rng = random.Random(3)
    rows = [(g, rng.choice([0.0, -1.5, 1e-9, 2.0, rng.gauss(0, 100)])) for g in "ab" for _ in range(201 + (g == "b"))]
    df = spark.createDataFrame(rows, "g string, v double")
    for r in cumulative_counts(df, ["g"], "v").collect():
        mine = [v for g, v in rows if g == r["g"]]
        assert r["n_less"] == sum(v < r["v"] for v in mine) and r["n_ties"] == mine.count(r["v"])
        assert r["n_total"] == len(mine)
    medians = {r["g"]: r["median"] for r in group_median(df, ["g"], "v").collect()}
    assert medians == {g: statistics.median(v for k, v in rows if k == g) for g in "ab"}


def test_growth_gaps(spark):
    df = spark.createDataFrame([("u", "i", 2000, 1.0), ("u", "i", 2002, 2.0), ("u", "i", 2003, 0.0),
                                ("u", "i", 2004, 5.0)], "unit string, indicator string, year int, value double")
    assert [(r["year"], r["growth"]) for r in ser.growth(df).orderBy("year").collect()] == [
        (2002, 100.0), (2003, -100.0)]
    assert [r["year"] for r in ser.growth(df, strict_gap=True).collect()] == [2003]


def test_filters_reach_the_scan(make_panel, spark, tmp_path):
    from panelspark.sources.tables import read_table, write_records
    from panelspark.schema import TABLES

    p = make_panel([("DEU", GDP, 4, 2015, 1)])
    rows = p.records.select(*[(F.col(f.name) if f.name in p.records.columns else F.lit(None)).cast(f.dataType)
                              .alias(f.name) for f in TABLES["statistic_record"]])
    write_records(rows, str(tmp_path))
    stored = read_table(spark, str(tmp_path), "statistic_record")
    plan = views.best_source(views.current_vintage(stored), p.source).where("indicator_id = 1 and year >= 2015")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(indicator_id" in text and "GreaterThanOrEqual(year,2015)" in text
    assert "WindowGroupLimit" in text


def test_views_shuffle_the_facts_once(spark, make_panel, tmp_path):
    p = make_panel([("DEU", 1, 4, 2015, 1), ("DEU", 1, 3, 2015, 2)])
    p.records.write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for view, exchanges in ((views.current_vintage(facts), 1), (views.best_source(facts, p.source), 1)):
            plan = view._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == exchanges and plan.count("FileScan") == 1, plan
            assert "WindowGroupLimit" in plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert views.best_source(facts, p.source).exceptAll(views.best_source(views.current_vintage(facts), p.source)).count() == 0


def test_suggestions_need_no_common_piece(spark):
    from panelspark.operators import catalog as cat

    asked = spark.createDataFrame([("xbydz",), ("qqqqq",)], "asked string")
    pool = spark.createDataFrame([(1, "abcde"), (2, "ab"), (3, "abcdefghijklmnop")], "id int, name string")
    out = {r["asked"]: r["suggestions"] for r in cat.resolve_names(asked, "asked", pool, ["name"]).collect()}
    assert out == {"xbydz": ["abcde"], "qqqqq": []}


def test_days_of_validity_equal_as_of(spark, tmp_path):
    """On every publication date, the days beside it, and before and after all: the stored intervals hold as_of's rows."""
    import datetime as dt
    import random

    from panelspark.operators import views
    from panelspark.sources.tables import store_validity

    rng, day = random.Random(4), dt.date(2020, 1, 1)
    days = [None] + [day + dt.timedelta(days=rng.randrange(60)) for _ in range(6)]
    rows = [(i, rng.randrange(2), rng.randrange(2), 1, 2000 + rng.randrange(3), 0, 0, float(rng.randrange(3)), None, rng.choice(days))
            for i in range(120)]
    records = spark.createDataFrame(rows, "id long, geography_id int, indicator_id int, source_id int, year int, quarter int, "
                                          "month int, value double, unit string, vintage_date date")
    stored = store_validity(records, str(tmp_path / "validity"))
    asked = sorted({d + dt.timedelta(days=k) for d in days if d for k in (-1, 0, 1)} | {dt.date(1, 1, 1), dt.date(2100, 1, 1)})
    for on in asked:
        known, best = views.known_on(stored, on), {}
        for r in rows:
            vintage = r[9] or dt.date(1, 1, 1)
            if vintage <= on:
                best.setdefault(r[1:7], []).append((vintage, r[0]))
        want = {i for group in best.values() for v, i in group if v == max(group)[0]}
        got = [r["id"] for r in known.select("id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert known.columns == records.columns
    assert {r["id"] for r in views.as_of(records, asked[5]).collect()} == {r["id"] for r in views.known_on(stored, asked[5]).collect()}
    plan = views.known_on(stored, day)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "PushedFilters: [IsNotNull(valid_from), LessThanOrEqual" in plan


def test_facts_are_not_shuffled_by_the_ids_of_a_small_catalog(spark):
    """Five sources or seven indicators would deal all facts over as many tasks (F2 to F21)."""
    from panelspark.panel import Panel
    from panelspark.plans import tables

    facts = spark.range(1000, numPartitions=2).selectExpr(
        "cast(id % 50 as int) as geography_id", "cast(id % 6 + 1 as int) as indicator_id", "cast(id % 5 + 1 as int) as source_id",
        "1990 + cast(id % 7 as int) as year", "0 as quarter", "0 as month", "date'2000-01-01' as vintage_date",
        "cast(id as double) as value", "cast(null as string) as unit")
    places = spark.range(50).selectExpr("cast(id as int) as id", "concat('N', id) as code", "concat('N', id) as iso3", "'country' as level",
                                        "concat('name ', id) as name")
    panel = Panel(records=facts, geography=places, indicator=tables.indicator(spark), domain=tables.domain(spark), source=tables.source(spark))
    for df in (panel.best, ser.series(panel), ser.latest_series(panel), ser.yoy_series(panel),
               views.unit_year_frame(panel.best, places, panel.indicator)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for key in ("source_id", "indicator_id", "domain_id"):
            assert f"hashpartitioning({key}#" not in plan
        assert df.count() > 0
    assert [tuple(r) for r in tables.domain(spark).collect()] == [(i, n, f"{n} figures") for i, n in tables.DOMAINS]
    assert tables.indicator(spark).where("proxy_note is null").count() == 6


def test_sales_are_dealt_over_more_tasks_as_they_grow(spark, tmp_path, monkeypatch):
    """Adaptive execution packs 64 MB of shuffled sales in a task, whose hash table of facts took 813 MB (F3 to F20)."""
    from panelspark.plans import tables

    def store(name, df):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))

    store("customer", spark.range(1, 9).selectExpr("id as c_custkey", "cast(id % 3 as int) as c_nationkey"))
    store("part", spark.range(1, 7).selectExpr("id as p_partkey", "element_at(array('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'), cast(id as int)) as p_type",
                                               "'brand' as p_brand"))
    store("orders", spark.range(1, 41).selectExpr("id as o_orderkey", "id % 8 + 1 as o_custkey", "date_add(date'1995-01-01', cast(id * 50 as int)) as o_orderdate",
                                                  "concat(id % 5 + 1, '-X') as o_orderpriority"))
    store("lineitem", spark.range(120).selectExpr("id % 40 + 1 as l_orderkey", "id % 6 + 1 as l_partkey", "date_add(date'1995-02-01', cast(id * 17 as int)) as l_shipdate",
                                                  "100.0D + id as l_extendedprice", "0.0D as l_discount"))
    few = tables.build_records(spark, str(tmp_path))
    monkeypatch.setattr(tables, "SALES_PER_TASK", 9)
    many = tables.build_records(spark, str(tmp_path))
    assert [df._jdf.queryExecution().executedPlan().toString().count(f", {n}), REPARTITION_BY_NUM") for df, n in ((few, 2), (many, 14))] == [1, 1]
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    # a sale of 100 + id counts for its nation and its customer
    totals = many.groupBy((F.col("geography_id") < 1000).alias("nation")).agg(F.sum("value").alias("total")).collect()
    assert {(r["nation"], r["total"]) for r in totals} == {(True, 19140.0), (False, 19140.0)}


def test_observation_matrix_is_dealt_by_unit_and_year(spark):
    """A packed task's tables of means and of wide rows took 738 MB (F15)."""
    rows = [(f"u{i}" if i else None, 2000 + y, ind, float(10 * i + y), "x") for i in range(4) for y in range(3) for ind in ("A", "B") if (i, ind) != (2, "B")]
    df = spark.createDataFrame([*rows, ("u1", 2000, "A", 12.0, "x")], "unit string, year int, indicator string, value double, source string")
    out = ser.observation_matrix(df, ["A", "B"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 2), REPARTITION_BY_NUM") == 1 and "ENSURE_REQUIREMENTS" not in plan
    got = {(r["unit"], r["year"]): (r["A"], r["B"]) for r in out.collect()}
    want = {(f"u{i}" if i else None, 2000 + y): (10.0 * i + y, None if i == 2 else 10.0 * i + y) for i in range(4) for y in range(3)}
    assert got == want | {("u1", 2000): (11.0, 10.0)}
