"""Files in and out: vintages, matrices, recessions, group maps, error tables, selections."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import clean_name

ERROR_COLUMNS = ("filename", "model_name", "start", "horizon", "target_var", "model_label", "date", "crisis", "values")
#: fixed values: the series that the override gives code 6 whatever the file says
SECOND_DIFFERENCE = ("CPIMEDSL", "DDURRG3M086SBEA", "DSERRG3M086SBEA", "CES0600000008")
_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, which all executors share; a temporary folder only in a local session without that setting."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="panelcast-"))
    return f"{top.rstrip('/')}/panelcast/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def table_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back, so lineage ends there and a lost executor repeats nothing before it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_vintages(spark: SparkSession, path: str, sep: str = ",", date_format: str = "yyyy-MM-dd", panel: str = r"([^/]*?)(\.[^./]*)?$") -> tuple[DataFrame, DataFrame]:
    """``obs`` and ``series_meta(panel_id, series, tcode)`` of a folder of vintages, each a panel named by its file (the first group of ``panel`` in its path).

    Each file has its own header, so columns may come, go and move between files.  A file is one row (a vintage is a
    few megabytes), its lines are dealt over tasks, and a line meets the names of its file by position.
    Blanks and texts that are no numbers are NULL; a line's surplus cells are left out; a file without a header gives no rows.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), panel, 1).alias("panel_id"), F.regexp_replace("value", "^\ufeff", "").alias("v"))
    lines = raw.select("panel_id", F.filter(F.split("v", "\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    heads = lines.select("panel_id", "lines", F.split(F.col("lines")[0], re.escape(sep)).alias("names")).where(F.size("lines") > 1)
    rows = heads.select("panel_id", "names", F.explode(F.slice("lines", 2, F.size("lines") - 1)).alias("line")).repartition("panel_id", "line")
    cells = rows.select("panel_id", F.split("line", re.escape(sep)).alias("c"), "names")
    day = F.try_to_timestamp(F.trim(F.col("c")[0]), F.lit(date_format)).cast("date").alias("ds")
    place = F.arrays_zip(F.slice("names", 2, F.size("names")).alias("n"), F.slice("c", 2, F.size("c")).alias("v"))
    long = cells.select("panel_id", day, F.explode(place).alias("p")).where("trim(p.n) <> ''")
    long = long.select("panel_id", "ds", clean_name(F.trim(F.col("p.n"))).alias("series"), F.expr("try_cast(trim(p.v) as double)").alias("value"))
    obs = long.where("ds is not null").select("panel_id", "series", "ds", F.nanvl("value", F.lit(None).cast("double")).alias("value"))
    meta = long.where("ds is null and value is not null").select("panel_id", "series", F.col("value").cast("int").alias("tcode"))
    return obs, meta


def read_vintage(spark: SparkSession, path: str, sep: str = ",", panel: str = "vintage", date_format: str = "yyyy-MM-dd") -> tuple[DataFrame, DataFrame]:
    """``obs`` and ``series_meta(panel_id, series, tcode)`` from a wide file: names, then codes, then one row a month; blanks are NULL."""
    raw = spark.read.csv(path, sep=sep, header=True)
    first, *names = raw.columns
    day = F.try_to_timestamp(F.col(f"`{first}`"), F.lit(date_format)).cast("date")
    long = raw.select(F.col(f"`{first}`").alias("_label"), day.alias("ds"), *[F.col(f"`{n}`") for n in names]).unpivot(["_label", "ds"], [F.col(f"`{n}`") for n in names], "series", "_v")
    long = long.withColumn("series", clean_name(F.col("series"))).withColumn("value", F.expr("try_cast(trim(_v) as double)"))
    obs = long.where("ds is not null").select(F.lit(panel).alias("panel_id"), "series", "ds", F.nanvl("value", F.lit(None).cast("double")).alias("value"))
    meta = long.where("ds is null and value is not null").select(F.lit(panel).alias("panel_id"), "series", F.col("value").cast("int").alias("tcode"))
    return obs, meta


def write_vintage(obs: DataFrame, meta: DataFrame, path: str, names: list[str], sep: str = ",") -> None:
    """The wide file of one panel, as one part with its header."""
    codes = meta.groupBy().pivot("series", names).agg(F.first(F.col("tcode").cast("string"))).select(F.lit("Transform:").alias("sasdate"), F.lit(0).alias("o"), *[F.col(f"`{n}`") for n in names])
    rows = obs.groupBy("ds").pivot("series", names).agg(F.first(F.col("value").cast("string")))
    rows = rows.select(F.col("ds").cast("string").alias("sasdate"), F.lit(1).alias("o"), *[F.col(f"`{n}`") for n in names])
    codes.unionByName(rows).orderBy("o", "sasdate").drop("o").coalesce(1).write.csv(path, sep=sep, header=True)  # one vintage is one small file by definition


def write_vintages(obs: DataFrame, meta: DataFrame, path: str, sep: str = ",") -> None:
    """A wide file for each panel, in a folder ``panel_id=...``: its own names, their codes, then one line a month; a panel's lines meet in one task."""
    names = meta.groupBy("panel_id").agg(F.array_sort(F.collect_list(F.struct("series", "tcode"))).alias("m")).select("panel_id", F.col("m.series").alias("names"), F.col("m.tcode").alias("codes"))
    head = F.concat_ws(sep, F.lit("sasdate"), "names"), F.concat_ws(sep, F.lit("Transform:"), F.col("codes").cast("array<string>"))
    heads = names.select("panel_id", F.posexplode(F.array(*head)).alias("o", "value"))
    cells = obs.groupBy("panel_id", "ds").agg(F.map_from_entries(F.collect_list(F.struct("series", "value"))).alias("v")).join(names, "panel_id")
    line = F.concat_ws(sep, F.col("ds").cast("string"), F.transform("names", lambda n: F.coalesce(F.try_element_at("v", n).cast("string"), F.lit(""))))
    lines = heads.unionByName(cells.select("panel_id", F.lit(2).alias("o"), line.alias("value")))
    lines.repartition("panel_id").sortWithinPartitions("panel_id", "o", "value").select("panel_id", "value").write.partitionBy("panel_id").text(path)


def override_tcode(series: Column, tcode: Column) -> Column:
    """4 becomes 5, 6 becomes 5, then the named series get 6."""
    return F.when(series.isin(*SECOND_DIFFERENCE), 6).when(tcode.isin(4, 6), 5).otherwise(tcode)


def read_matrix(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """``row, col, value`` (from 1) of a headerless matrix; rows are numbered in order of files, then of lines.

    Lines are counted by split of a file, and only those counts are summed up in order.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = raw.select(F.regexp_replace("value", "^\ufeff", "").alias("line"), "file", "block").where("line <> ''")
    lines = lines.withColumn("id", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each split
    placed = lines.join(splits.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before")), ["file", "block"])
    numbered = placed.select((F.col("before") + F.col("id") - F.col("first") + 1).cast("int").alias("row"), "line")
    cells = numbered.select("row", F.posexplode(F.split("line", sep)).alias("col", "v"))
    return cells.select("row", (F.col("col") + 1).alias("col"), F.expr("try_cast(trim(v) as double)").alias("value"))


def parse_recessions(rows: DataFrame) -> DataFrame:
    """``start, end`` from texts such as ``December 2007 (IV)``."""
    day = lambda c: F.try_to_timestamp(F.trim(F.regexp_replace(c, r"\(.*?\)", "")), F.lit("MMMM yyyy")).cast("date")
    return rows.select(day("start").alias("start"), day("end").alias("end")).where("start is not null and end is not null")


def read_recessions(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    return parse_recessions(spark.read.csv(path, sep=sep, header=True).toDF("start", "end"))


def read_group_map(spark: SparkSession, path: str) -> DataFrame:
    """``series, var_group``; keyed on the variable, since ids may repeat."""
    raw = spark.read.csv(path, sep=";", header=True, encoding="UTF-8")
    raw = raw.toDF(*[c.replace("﻿", "") for c in raw.columns])
    return raw.select(F.col("VAR").alias("series"), F.col("Group").alias("var_group"))


def write_errors(errors: DataFrame, path: str, append: bool = False) -> None:
    """Writes an error table; another column set is refused, and so is an existing path unless ``append``."""
    if set(errors.columns) != set(ERROR_COLUMNS):
        raise ValueError(f"error tables have the columns {ERROR_COLUMNS}")
    writer = errors.select(*ERROR_COLUMNS).repartition("target_var", "horizon").write.partitionBy("target_var", "horizon")
    writer.mode("append" if append else "errorifexists").parquet(path)


def write_selection(selection: DataFrame, path: str) -> None:
    selection.repartition("method", "h", "target").write.partitionBy("method", "h", "target").parquet(path)
