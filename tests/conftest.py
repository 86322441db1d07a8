from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelspark.panel import Panel  # noqa: E402
from panelspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=2, memory="4g")
    yield session
    session.stop()


GEOGRAPHY = [(1, "DEU", "country", None, "Germany", "DE", "DEU"), (2, "FRA", "country", None, "France", "FR", "FRA"),
             (3, "ITA", "country", None, "Italy", "IT", "ITA"), (4, "ESP", "country", None, "Spain", "ES", "ESP"),
             (5, "GBR", "country", None, "United Kingdom", "GB", "GBR"),
             (11, "FR10", "NUTS2", 2, "Ile de France", None, None), (12, "FR20", "NUTS2", 2, "Centre", None, None),
             (13, "DE11", "NUTS2", 1, "Stuttgart", None, None)]
INDICATORS = [(1, 1, "GDP", "EUR", "nama_10_gdp", False), (2, 2, "Unemployment Rate", "%", "une_rt_a", False),
              (3, 1, "Population", "persons", "demo_pjan", False), (4, 1, "Alpha", "x", "alpha", True),
              (5, 2, "Beta", "x", "beta", False), (6, 2, "100% Cover_age", "%", "cover", False)]
SOURCES = [(1, "S one", .95, True), (2, "S two", .95, True), (3, "S three", .92, True), (4, "S four", .90, True),
           (5, "S five", .85, False)]
SENTINEL = dt.date(2026, 1, 1)


@pytest.fixture(scope="session")
def make_panel(spark):
    """Panel from rows (code, indicator id, source id, period, value, vintage)."""
    def build(rows, **tables) -> Panel:
        ids = {g[1]: g[0] for g in GEOGRAPHY}
        facts = []
        for i, row in enumerate(rows):
            code, ind, src, period, value = row[:5]
            vintage = row[5] if len(row) > 5 else SENTINEL
            year, quarter, month = period if isinstance(period, tuple) else (period, 0, 0)
            facts.append((i, ids.get(code, 999), ind, src, year, quarter, month,
                          None if value is None else float(value), None, vintage))
        frame = spark.createDataFrame
        return Panel(
            records=frame(facts, "id long, geography_id int, indicator_id int, source_id int, year int, quarter int, "
                                 "month int, value double, unit string, vintage_date date"),
            geography=frame([(*g, False, False) for g in GEOGRAPHY],
                            "id int, code string, level string, parent_id int, name string, iso2 string, iso3 string, "
                            "is_transcontinental boolean, is_disputed boolean"),
            indicator=frame([(*i[:5], f"about {i[2].lower()}", i[5], "note" if i[5] else None) for i in INDICATORS],
                            "id int, domain_id int, name string, unit string, api_code string, definition string, "
                            "is_proxy boolean, proxy_note string"),
            domain=frame([(1, "Economy", "e"), (2, "Labour", "l")], "id int, name string, description string"),
            source=frame(SOURCES, "id int, name string, reliability_score double, redistributable boolean"),
            bloc=frame([(1, "EU", "Union"), (2, "EZ", "Euro")], "id int, code string, name string"),
            geography_bloc=frame([(1, 1, 1958, None), (2, 1, 1958, None), (3, 1, 1958, None), (5, 1, 1973, 2020),
                                  (1, 2, 1999, None), (2, 2, 1999, None)],
                                 "geography_id int, bloc_id int, since_year int, until_year int"),
            **tables)
    return build


EVENT = ("code string, title string, event_type string, iso3 string, bloc_code string, start_date date, "
         "tags string")


@pytest.fixture(scope="session")
def make_events(spark):
    def build(rows):
        return spark.createDataFrame(rows, EVENT)
    return build
