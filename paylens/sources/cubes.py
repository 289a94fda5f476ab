"""Statistical cubes: one JSON document per cube, flattened to one row per cell.

The index, label, value and status maps of a cube are keyed by whatever codes it uses, so
they are read as map columns; a schema given up front spares a pass over the files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_MAP = "map<string,string>"


def read_cubes(spark: SparkSession, path: str, name: str = "cube") -> DataFrame:
    """Documents as (cube, doc): whole files, because a document spans lines."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias(name), F.col("value").alias("doc"))


def layout(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Dimension ids and sizes, given at the top or inside ``dimension``."""
    get = lambda p: F.get_json_object(doc, p)
    return df.withColumns(
        {
            "ids": F.from_json(F.coalesce(get("$.id"), get("$.dimension.id")), "array<string>"),
            "sizes": F.from_json(F.coalesce(get("$.size"), get("$.dimension.size")), "array<int>"),
            "dims": F.from_json(get("$.dimension"), TEXT_MAP),
        }
    )


def categories(dim_json: Column) -> Column:
    """Category codes of one dimension in order; the index is a list or a code -> position map."""
    index = F.get_json_object(dim_json, "$.category.index")
    as_map = F.from_json(index, "map<string,int>")
    ordered = F.transform(
        F.array_sort(F.transform(F.map_entries(as_map), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("k")))), lambda e: e["k"]
    )
    only = F.map_keys(F.from_json(F.get_json_object(dim_json, "$.category.label"), TEXT_MAP))  # one category needs no index
    return F.when(index.startswith("["), F.from_json(index, "array<string>")).otherwise(F.coalesce(ordered, only))


def flatten_cube(df: DataFrame, key: Sequence[str], doc: str = "doc") -> DataFrame:
    """(key, cell, coords map, value, flag): row-major cells decoded by stride; null cells dropped.

    Values are a dense list or a sparse map keyed by cell number; flags, where published, are a
    map, a list or one mark for all cells.
    """
    d = layout(df, doc)
    d = d.withColumn("cats", F.transform("ids", lambda i: categories(F.try_element_at("dims", i))))
    # stride of a dimension: product of the sizes after it
    stride = F.transform(
        F.sequence(F.lit(1), F.size("sizes")),
        lambda i: F.aggregate(F.slice("sizes", i + 1, F.size("sizes")), F.lit(1).cast("long"), lambda a, s: a * s),
    )
    value = F.get_json_object(doc, "$.value")
    dense = F.from_json(value, "array<double>")
    sparse = F.from_json(value, "map<string,double>")
    cells = F.when(
        value.startswith("["),
        F.transform(dense, lambda v, i: F.struct(i.cast("long").alias("cell"), v.alias("v"))),
    ).otherwise(F.transform(F.map_entries(sparse), lambda e: F.struct(e["key"].cast("long").alias("cell"), e["value"].alias("v"))))
    status = F.get_json_object(doc, "$.status")
    d = d.withColumns({"strides": stride, "flags": F.when(status.startswith("{"), F.from_json(status, TEXT_MAP)), "flag_list": F.when(status.startswith("["), F.from_json(status, "array<string>"))})
    d = d.select(*key, "ids", "sizes", "cats", "strides", "flags", "flag_list", F.explode(cells).alias("c")).filter("c.v IS NOT NULL")
    code = lambda i: F.element_at(F.get("cats", i), (F.floor(F.col("c.cell") / F.get("strides", i)) % F.get("sizes", i) + 1).cast("int"))
    coords = F.map_from_arrays("ids", F.transform(F.sequence(F.lit(0), F.size("ids") - 1), code))
    flag = F.coalesce(F.try_element_at("flags", F.col("c.cell").cast("string")), F.get("flag_list", F.col("c.cell").cast("int")))
    return d.select(*key, F.col("c.cell").alias("cell"), coords.alias("coords"), F.col("c.v").alias("value"), flag.alias("flag"))


def cube_table(cells: DataFrame, key: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Coordinates of named dimensions as columns."""
    return cells.select(*key, *[F.try_element_at("coords", F.lit(d)).alias(d) for d in dims], "value", "flag")


def cube_labels(df: DataFrame, key: Sequence[str], dim: str, doc: str = "doc") -> DataFrame:
    """(key, code, label) of one dimension."""
    label = F.from_json(F.get_json_object(F.try_element_at("dims", F.lit(dim)), "$.category.label"), TEXT_MAP)
    return layout(df, doc).select(*key, F.explode(label).alias("code", "label"))


def wage_cube(cells: DataFrame, code_dim: str, year_dim: str, content_dim: str, fields: dict[str, str], extra: Sequence[str] = ()) -> DataFrame:
    """Wage cube with its content codes as columns: one row per occupation, year and extra dimension."""
    dims = [code_dim, year_dim, *extra]
    name = F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])
    t = cells.select(
        *[F.try_element_at("coords", F.lit(d)).alias(d) for d in dims],
        F.try_element_at(name, F.try_element_at("coords", F.lit(content_dim))).alias("field"), "value",
    ).filter("field IS NOT NULL")
    wide = t.groupBy(*dims).pivot("field", list(fields.values())).agg(F.first("value"))
    return wide.withColumnsRenamed({code_dim: "national_code", year_dim: "year"}).withColumn("year", F.col("year").try_cast("int"))


# Fixed values: (code dimension, year dimension, content dimension, content code -> field) per office.
WAGE_CUBES = {
    "SE": ("Yrke2012", "Tid", "ContentsCode", {"mean": "mean_sek_month", "median": "median_sek_month", "p10": "p10_sek_month", "p25": "p25_sek_month", "p75": "p75_sek_month", "p90": "p90_sek_month"}),
    "NO": ("Yrke", "Tid", "content", {"mean": "mean_nok_month", "median": "median_nok_month", "avtalt_mean": "avtalt_mean_nok_month", "avtalt_median": "avtalt_median_nok_month"}),
    "DK": ("ARBF", "Tid", "LONMAL", {"STAND": "mean_std_dkk_hour", "MEDIAN": "median_std_dkk_hour", "PENSST": "employer_pension_std_dkk_hour", "UREGELST": "irregular_std_dkk_hour"}),
    "FI": ("ammatti", "vuosi", "content", {"total_mean": "total_mean_eur_month", "regular_mean": "regular_mean_eur_month", "total_median": "total_median_eur_month", "regular_median": "regular_median_eur_month"}),
    "IE": ("occupation", "year", "statistic", {"mean": "mean_eur_hour", "median": "median_eur_hour", "mean_hours": "mean_paid_weekly_hours", "median_hours": "median_paid_weekly_hours"}),
}


def with_fallback(primary: DataFrame, fallback: DataFrame, entity: str, tag: str, primary_tag: str, fallback_tag: str) -> DataFrame:
    """Rows of ``primary``; an entity that has none there takes its rows of ``fallback``. ``tag`` names which."""
    rest = fallback.join(primary.select(entity).distinct(), entity, "left_anti")
    return primary.withColumn(tag, F.lit(primary_tag)).unionByName(rest.withColumn(tag, F.lit(fallback_tag)))
