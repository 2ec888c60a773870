"""Keys of the public land survey: parse and normalise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOWNSHIP = r"^T(\d+)([NS])-R(\d+)([EW])$"
SECTION = r"^S(\d+)-T(\d+)([NS])-R(\d+)([EW])$"
QUARTER = r"^(\d{1,2})([NS])(\d{1,2})([EW])(\d{1,2})([NSEW]{4})$"


def _parts(df: DataFrame, label: str, pattern: str, names: list[str]) -> DataFrame:
    """Rows that match, with a column for each group."""
    return df.filter(F.col(label).rlike(pattern)).select("*", *[F.regexp_extract(label, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def parse_township(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds township, township_dir, range, range_dir and township_key 'T# R#'; labels of another form are dropped."""
    out = _parts(df, label, TOWNSHIP, ["township", "township_dir", "range", "range_dir"])
    out = out.withColumns({"township": F.col("township").cast("int"), "range": F.col("range").cast("int")})
    return out.withColumn("township_key", F.format_string("T%d%s R%d%s", "township", "township_dir", "range", "range_dir"))


def parse_section(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds section, township, township_dir, range, range_dir and plss_key 'S# T#d R#d'; labels of another form are dropped."""
    out = _parts(df, label, SECTION, ["section", "township", "township_dir", "range", "range_dir"])
    out = out.withColumns({n: F.col(n).cast("int") for n in ("section", "township", "range")})
    return out.withColumn("plss_key", F.format_string("S%d T%d%s R%d%s", "section", "township", "township_dir", "range", "range_dir"))


def parse_quarter(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds the parts of a quarter-quarter label, its quarter and sixteenth, and the section's and its own key."""
    out = _parts(df, label, QUARTER, ["township", "township_dir", "range", "range_dir", "section", "aliquot"])
    out = out.withColumns({"quarter": F.substring("aliquot", 1, 2), "sixteenth": F.substring("aliquot", 3, 2)})
    key = F.concat(F.lit("S"), F.col("section").cast("int").cast("string"), F.lit(" T"), "township", "township_dir", F.lit(" R"), "range", "range_dir")
    return out.withColumns({"section_key": key, "quarter_key": F.concat_ws(" ", key, "quarter", "sixteenth")})


def parcel_section_key(section: Column, township: Column, range_: Column) -> Column:
    """'S#-T#d-R#d' of a parcel's parts: digits of the section as they are, township and range without leading zeros; null if any is null."""
    bare = [F.regexp_replace(section, r"[^0-9]", ""), *[F.regexp_replace(F.upper(F.trim(x)), r"^0+", "") for x in (township, range_)]]
    return F.concat(F.lit("S"), bare[0], F.lit("-T"), bare[1], F.lit("-R"), bare[2])
