"""Writers: CSV, GeoJSON features, tables, lookup documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """A folder of CSV files, each with a header, so that the usual reader option fits all of them; an empty frame still writes one."""
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def to_features(df: DataFrame, lon: str = "lon", lat: str = "lat", line_to: tuple[str, str] | None = None) -> DataFrame:
    """(feature) GeoJSON text of each row: a point, or with line_to a line to a second point; other columns are properties."""
    used = {lon, lat, *(line_to or ())}
    here = F.array(F.col(lon), F.col(lat))
    if line_to is None:
        shape = F.struct(F.lit("Point").alias("type"), here.alias("coordinates"))
    else:
        shape = F.struct(F.lit("LineString").alias("type"), F.array(here, F.array(F.col(line_to[0]), F.col(line_to[1]))).alias("coordinates"))
    properties = F.struct(*[c for c in df.columns if c not in used])
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def write_features(layers: dict[str, DataFrame], path: str) -> None:
    """One folder of line-wise GeoJSON a layer."""
    for name, features in layers.items():
        features.write.mode("overwrite").text(f"{path}/{name}")


def with_wkt_point(df: DataFrame, wkt: str | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df with x and y: from a POINT text where it is one, else from lon and lat."""
    def part(i: int, other: str) -> Column:
        if wkt is None:
            return F.col(other).cast("double")
        number = F.regexp_extract(wkt, r"^\s*POINT\s*\(\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s*\)\s*$", i)
        return F.coalesce(F.nullif(number, F.lit("")).cast("double"), F.col(other).cast("double"))

    return df.withColumns({"x": part(1, lon), "y": part(2, lat)})


def write_table(df: DataFrame, target: str, mode: str = "overwrite", url: str | None = None, properties: dict | None = None) -> None:
    """Replace or append a table: by JDBC with a URL, else a table of the session's catalogue."""
    if url is not None:
        df.write.jdbc(url, target, mode=mode, properties=properties or {})
    else:
        df.write.mode(mode).saveAsTable(target)


def lookup_entries(company: DataFrame, ftype: DataFrame) -> DataFrame:
    """(section, key, value) of the lookup document: names of companies (section 0) and of types (1), and websites of companies or '' (2); rows without id
    or name are skipped, of rows with one id the least name counts."""
    def entries(df: DataFrame, section: int, key: str, value: Column) -> DataFrame:
        kept = df.filter(F.col(key).isNotNull() & (F.coalesce("name", F.lit("")) != ""))
        least = kept.groupBy(F.col(key).cast("bigint").alias("key")).agg(F.min(F.struct("name", value.alias("value"))).alias("x"))
        return least.select(F.lit(section).alias("section"), "key", F.col("x.value").alias("value"))

    site = F.coalesce("website", F.lit(""))
    return entries(company, 0, "company_id", F.col("name")).unionAll(entries(ftype, 1, "facility_type_id", F.col("name"))).unionAll(entries(company, 2, "company_id", site))


#: Sections of the lookup document, in their order; fixed values.
SECTIONS = ("companies", "facilityTypes", "companyWebsites")


def lookup_lines(company: DataFrame, ftype: DataFrame) -> DataFrame:
    """(section, key, line): the lookup document by its lines, one entry each; in order of section and key (null first: the line that opens a section) they
    are one JSON text.  Sections are there even if they are empty."""
    entries = lookup_entries(company, ftype)
    first = entries.groupBy(F.col("section").alias("_section")).agg(F.min("key").alias("_first"))
    rows = entries.join(F.broadcast(first), F.col("section") == F.col("_section"))  # a row a section
    text = F.to_json(F.map_from_arrays(F.array(F.col("key").cast("string")), F.array("value")))
    line = F.concat(F.when(F.col("key") == F.col("_first"), "").otherwise(","), F.regexp_extract(text, r"(?s)^\{(.*)\}$", 1))
    opening = ", ".join(f"({i}, cast(null as bigint), '{'},' if i else '{'}\"{name}\":{{')" for i, name in enumerate(SECTIONS))
    frame = company.sparkSession.sql(f"select * from values {opening}, ({len(SECTIONS)}, cast(null as bigint), '}}}}') as t(section, key, line)")
    return rows.select("section", "key", line.alias("line")).unionAll(frame)


def write_lookups(company: DataFrame, ftype: DataFrame, path: str) -> None:
    """The lookup document as a folder of parts, which in order of their names are one JSON text (hadoop fs -getmerge joins them): lines are dealt to
    ranges of section and key, so no task holds a whole section."""
    lookup_lines(company, ftype).repartitionByRange("section", "key").sortWithinPartitions("section", "key").select("line").write.mode("overwrite").text(path)


def write_table_files(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV (with header), JSON or Parquet files; another format is an error."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"no such format: {fmt}")
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
