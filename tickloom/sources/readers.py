"""Readers and writers of position logs, bars and macro series."""

from __future__ import annotations

import json
from functools import reduce
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a position log that are numbers; all others stay text.
NUMBERS = ("entryPrice", "initalSL", "idealTP", "maxTP", "avgClosePrice", "avgRiskReward", "maxRiskReward", "rPnL", "uPnL", "amount", "amountClosed", "exchangeRate", "initialBalance", "currentRealizedBalance")
WHOLE = {"id": "bigint", "day": "int"}


def read_trades(spark: SparkSession, path: str, zone: str = "America/New_York") -> DataFrame:
    """A position log in CSV, its columns known by the header in any order; sorted by start, then id.

    Local times become UTC (a time that a clock change skips or repeats takes Spark's rule), with win flag and R.  All
    columns stay; what is no number in a column of numbers is null.
    """
    t = spark.read.option("header", True).csv(path)
    kinds = {**dict.fromkeys(NUMBERS, "double"), **WHOLE}
    t = t.select(*(F.expr(f"try_cast(`{c}` AS {kinds[c]})").alias(c) if c in kinds else F.col(f"`{c}`") for c in t.columns))
    utc = lambda c: F.to_utc_timestamp(F.to_timestamp(c, "yyyy/MM/dd HH:mm:ss"), zone)
    t = t.withColumns({"start_utc": utc("dateStart"), "end_utc": utc("dateEnd"), "is_win": F.col("rPnL") > 0, "r_multiple": F.col("avgRiskReward")})
    return t.orderBy("start_utc", "id")


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars in Parquet under the names used here; NaN becomes null."""
    b = spark.read.parquet(path)
    names = {"datetime": "bar_ts"}
    b = b.select(*(F.col(c).alias(names.get(c, c)) for c in b.columns))
    return b.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if b.schema[c].dataType == T.DoubleType() else F.col(c) for c in b.columns))


def read_series_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(date, name) of a two-column CSV; what is no number is null."""
    raw = spark.read.option("header", True).schema("date string, value string").csv(path)
    return raw.select(F.to_date("date").alias("date"), F.expr("try_cast(value AS DOUBLE)").alias(name))


def read_series_json(df: DataFrame, column: str, name: str) -> DataFrame:
    """(date, name) of JSON with parallel arrays ``timestamp`` and ``close``; null values go, the first of a date stays."""
    x = df.select(F.from_json(column, "timestamp array<bigint>, close array<double>").alias("j"))
    x = x.select(F.posexplode(F.arrays_zip("j.timestamp", "j.close")).alias("pos", "z")).where("z.close is not null")
    x = x.select(F.to_date(F.timestamp_seconds("z.timestamp")).alias("date"), "pos", F.col("z.close").alias(name))
    return x.groupBy("date").agg(F.min_by(name, "pos").alias(name))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV of the flat columns."""
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, title: str, limit: int = 100) -> DataFrame:
    """One row with a Markdown table of the first rows (a report: the limit is its feature)."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in df.columns)), F.lit(" |"))
    rows = df.limit(limit).select(cells.alias("line")).agg(F.concat_ws("\n", F.sort_array(F.collect_list("line"))).alias("body"))
    head = f"# {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return rows.select(F.concat(F.lit(head), "body").alias("report"))


def report(parts: list[tuple[str, DataFrame]], title: str, limit: int = 100) -> DataFrame:
    """One row with a Markdown report: a section for each table, in the order given."""
    sections = [markdown(df, name, limit).select(F.lit(i).alias("i"), F.concat(F.lit("#"), F.col("report")).alias("text")) for i, (name, df) in enumerate(parts)]
    whole = reduce(DataFrame.unionByName, sections).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("x"))
    return whole.select(F.concat(F.lit(f"# {title}\n\n"), F.concat_ws("\n\n", "x"), F.lit("\n")).alias("report"))


#: Fills a table for each list of rows that the page carries.
_SCRIPT = """for (const s of JSON.parse(document.getElementById("data").textContent)) {
  const h = document.createElement("h2"), t = document.createElement("table");
  h.textContent = s.title;
  t.append(...[Object.fromEntries(s.columns.map(c => [c, c])), ...s.rows].map(r => {
    const tr = document.createElement("tr");
    tr.append(...s.columns.map(c => { const td = document.createElement("td"); td.textContent = r[c] ?? ""; return td; }));
    return tr;
  }));
  document.body.append(h, t);
}"""


def html(parts: list[tuple[str, DataFrame]], title: str, limit: int = 1000) -> DataFrame:
    """One row with a page of its own that carries each table's first rows as JSON and lays them out (a report: the limit is its feature)."""
    sections = []
    for i, (name, df) in enumerate(parts):
        rows = df.limit(limit).select(F.to_json(F.struct(*df.columns)).alias("j")).agg(F.concat_ws(",", F.sort_array(F.collect_list("j"))).alias("j"))
        head = json.dumps({"title": name, "columns": df.columns})[:-1]
        sections.append(rows.select(F.lit(i).alias("i"), F.concat(F.lit(head + ', "rows": ['), F.col("j"), F.lit("]}")).alias("text")))
    whole = reduce(DataFrame.unionByName, sections).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("x"))
    data = F.replace(F.concat_ws(",", "x"), F.lit("</"), F.lit("<\\/"))  # no text ends the script element
    page = [F.lit(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><script type="application/json" id="data">['), data, F.lit(f"]</script><script>{_SCRIPT}</script></body></html>")]
    return whole.select(F.concat(*page).alias("page"))
