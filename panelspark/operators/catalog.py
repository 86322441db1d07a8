"""Dimension lookups, search and name resolution."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.text import contains_ci
from panelspark.operators.views import unit_code
from panelspark.panel import Panel
from panelspark.schema import LEVEL_COUNTRY, LEVEL_REGION


def countries(geography: DataFrame, keep_id: bool = False) -> DataFrame:
    cols = ["iso3", "iso2", "name", "is_transcontinental", "is_disputed"]
    return geography.where(F.col("level") == LEVEL_COUNTRY).select(*(["id"] if keep_id else []), *cols)


def regions(geography: DataFrame, country_id: int | None = None) -> DataFrame:
    parents = geography.select(F.col("id").alias("parent_id"), F.col("iso3").alias("country_iso3"),
                               F.col("name").alias("country"))
    rows = geography.where(F.col("level") == LEVEL_REGION)
    if country_id is not None:
        rows = rows.where(F.col("parent_id") == country_id)
    return rows.join(parents, "parent_id").select("code", "name", "country_iso3", "country")


def blocs(bloc: DataFrame, geography_bloc: DataFrame) -> DataFrame:
    members = (geography_bloc.where(F.col("until_year").isNull() & F.col("geography_id").isNotNull())
               .groupBy(F.col("bloc_id").alias("id")).agg(F.count(F.lit(1)).alias("n")))
    return bloc.join(members, "id", "left").select(
        "code", "name", F.coalesce("n", F.lit(0)).alias("current_members"))


def _spans(bloc: DataFrame, geography_bloc: DataFrame, geography: DataFrame) -> DataFrame:
    b = bloc.select(F.col("id").alias("bloc_id"), F.col("code").alias("bloc_code"),
                    F.col("name").alias("bloc_name"))
    g = unit_code(geography).select(F.col("id").alias("geography_id"), "unit", "name")
    return geography_bloc.join(b, "bloc_id").join(g, "geography_id")


def bloc_members(bloc: DataFrame, geography_bloc: DataFrame, geography: DataFrame) -> DataFrame:
    return _spans(bloc, geography_bloc, geography).select(
        F.col("bloc_code").alias("bloc"), "unit", "name", "since_year", "until_year")


def unit_blocs(bloc: DataFrame, geography_bloc: DataFrame, geography: DataFrame) -> DataFrame:
    return _spans(bloc, geography_bloc, geography).select(
        "unit", "bloc_code", "bloc_name", "since_year", "until_year")


def domains(domain: DataFrame) -> DataFrame:
    return domain.orderBy("id").select("name", "description")


def indicators(indicator: DataFrame, domain: DataFrame, name: str | None = None) -> DataFrame:
    d = domain.select(F.col("id").alias("domain_id"), F.col("name").alias("domain"))
    if name is not None:
        d = d.where(F.lower("domain") == name.lower())
    return (indicator.join(d, "domain_id").orderBy("domain_id", "name")
            .select("name", "domain", "unit", "api_code", "definition", "is_proxy", "proxy_note"))


def sources(source: DataFrame) -> DataFrame:
    return source.orderBy(F.desc("reliability_score"), "id").drop("id")


def source_catalog(panel: Panel) -> DataFrame:
    """What each source actually delivered: its indicators with all their metadata."""
    counts = panel.records.groupBy("source_id", "indicator_id").agg(F.count(F.lit(1)).alias("records"))
    src = panel.source.select(F.col("id").alias("source_id"), F.col("name").alias("source"), "reliability_score")
    dom = panel.domain.select(F.col("id").alias("domain_id"), F.col("name").alias("domain"))
    ind = panel.indicator.withColumnRenamed("id", "indicator_id").withColumnRenamed("name", "indicator")
    return (counts.join(src, "source_id").join(ind, "indicator_id").join(dom, "domain_id")
            .select("source", "reliability_score", "indicator", "domain", "unit", "api_code", "definition",
                    "is_proxy", "proxy_note", "records"))


def search_indicators(indicator: DataFrame, domain: DataFrame, text: str) -> DataFrame:
    """Case-insensitive literal substring over name, definition, code and domain."""
    d = domain.select(F.col("id").alias("domain_id"), F.col("name").alias("domain"))
    hit: Column = F.lit(False)
    for column in ("name", "definition", "api_code", "domain"):
        hit = hit | contains_ci(F.col(column), text)
    return indicator.join(d, "domain_id").where(hit).select(
        F.col("id").alias("indicator_id"), "name", "domain", "unit", "api_code", "definition", "is_proxy")


def resolve_names(asked: DataFrame, column: str, dim: DataFrame, match_on: Sequence[str], *,
                  suggest_from: DataFrame | None = None, suggest_cols: Sequence[str] = ("name",),
                  k: int = 3, cutoff: float = 0.4) -> DataFrame:
    """Adds ``id`` by case-insensitive match on any of ``match_on``; names that
    match nothing get up to ``k`` close names instead.

    Closeness is 1 - levenshtein / longer length. ``suggest_from`` is a catalog;
    only unknown names are compared with it, each with the names whose length
    lets them reach ``cutoff``: two names differ by at least their difference in length.
    """
    keys = dim.select("id", F.explode(F.array_distinct(F.array_compact(F.array(
        *[F.lower(F.col(c)) for c in match_on])))).alias("_key"))
    keys = keys.groupBy("_key").agg(F.min("id").alias("id"))
    names = asked.select(column).distinct().withColumn("_key", F.lower(column))
    found = names.join(keys, "_key", "left")
    pool = (suggest_from if suggest_from is not None else dim)
    pool = pool.select(F.explode(F.array_compact(F.array(*[F.col(c) for c in suggest_cols])))
                       .alias("_name")).distinct()
    close = _suggestions(found.where("id is null").select(column, "_key"), column, pool, k, cutoff)
    return (found.join(close, column, "left")
            .select(column, "id", F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions")))


def _suggestions(unknown: DataFrame, column: str, pool: DataFrame, k: int, cutoff: float) -> DataFrame:
    size = F.length("_key")
    reach = F.sequence(F.ceil(size * cutoff - 1e-9).cast("int"), F.floor(size / cutoff + 1e-9).cast("int"))
    left = unknown.select(column, "_key", F.explode(reach).alias("_size"))
    right = pool.select("_name", F.length("_name").alias("_size"))
    longer = F.greatest(size, F.length("_name"))
    score = F.lit(1.0) - F.levenshtein(F.col("_key"), F.lower("_name")) / longer
    pairs = left.join(right, "_size").select(column, "_name", score.alias("_score"))
    w = Window.partitionBy(column).orderBy(F.desc("_score"), "_name")
    best = pairs.where(F.col("_score") >= cutoff).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return best.groupBy(column).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_rn", "_name"))), lambda s: s["_name"]).alias("suggestions"))


def register_views(panel: Panel) -> None:
    """Temp views under the model's table names, for ``spark.sql``."""
    views = {"statistic_record": panel.records, "statistic_current": panel.current,
             "statistic_best": panel.best, "geography": panel.geography, "indicator": panel.indicator,
             "domain": panel.domain, "source": panel.source, "bloc": panel.bloc,
             "geography_bloc": panel.geography_bloc, "event": panel.event}
    for name, df in views.items():
        if df is not None:
            df.createOrReplaceTempView(name)
