"""Table schemas, keys and fixed settings of the panel model."""
from __future__ import annotations

from pyspark.sql import types as T

# Fixed values (shared with existing panel data).
NO_VINTAGE = "0001-01-01"          # a null vintage sorts as this date
LEVEL_COUNTRY = "country"
LEVEL_REGION = "NUTS2"
MIN_YEAR, MAX_YEAR = 1900, 2035    # accepted years at ingest
PROFILE_INDICATORS = ("GDP", "GDP per capita", "Population",
                      "Unemployment Rate", "Inflation (HICP)")
ADDITIVE_INDICATORS = ("demo_pjan", "nama_10_gdp")

PERIOD = ["year", "quarter", "month"]
SOURCE_KEY = ["geography_id", "indicator_id", "source_id", *PERIOD]
BEST_KEY = ["geography_id", "indicator_id", *PERIOD]
RECORD_KEY = [*SOURCE_KEY, "vintage_date"]


class PanelLookupError(LookupError):
    """An unknown unit, indicator, bloc or event."""


class DataQualityError(RuntimeError):
    """A blocking data contract failed."""


def _struct(spec: str) -> T.StructType:
    kinds = {"int": T.IntegerType(), "long": T.LongType(), "str": T.StringType(),
             "double": T.DoubleType(), "bool": T.BooleanType(), "date": T.DateType(),
             "ts": T.TimestampType()}
    fields = (part.split(":") for part in spec.split())
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


TABLES: dict[str, T.StructType] = {
    "statistic_record": _struct(
        "id:long geography_id:int indicator_id:int source_id:int year:int quarter:int "
        "month:int value:double unit:str currency:str price_basis:str "
        "confidence_score:double is_estimated:bool vintage_date:date retrieved_at:ts"),
    "geography": _struct(
        "id:int code:str level:str parent_id:int name:str iso2:str iso3:str "
        "is_transcontinental:bool is_disputed:bool note:str"),
    "bloc": _struct("id:int code:str name:str"),
    "geography_bloc": _struct("geography_id:int bloc_id:int since_year:int until_year:int"),
    "domain": _struct("id:int name:str description:str color:str"),
    "indicator": _struct(
        "id:int domain_id:int name:str unit:str api_code:str source_priority:int "
        "frequency:str definition:str is_proxy:bool proxy_note:str"),
    "source": _struct(
        "id:int name:str organization:str url:str api_endpoint:str "
        "reliability_score:double license:str redistributable:bool update_frequency:str"),
    "event": _struct(
        "code:str title:str description:str event_type:str iso3:str bloc_code:str "
        "start_date:date end_date:date source:str source_url:str confidence:double "
        "tags:str affected_domains:str"),
    "ingestion_run": _struct(
        "source:str started_at:ts ended_at:ts status:str records_processed:int error:str"),
    "ingestion_error": _struct("source:str series:str error:str occurred_at:ts"),
}

# One normalized row from a source, before keys are resolved.
INGEST_ROW = _struct(
    "iso3:str indicator_code:str year:int quarter:int month:int value:double "
    "unit:str currency:str price_basis:str")
