"""Readers of landed feeds: JSON documents, zipped CSV with free text around it, stores. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import parsed, rounded
from ..functions.text import listed, same_class

DAILY = "map<string,map<string,string>>"
HEADER, DAY_KEY = re.compile(r",\s*\S"), re.compile(r"\d{8}", re.ASCII)


def feed_error(doc: Column) -> Column:
    """What a feed says instead of data, although it answered."""
    return F.coalesce(*[F.get_json_object(doc, f"$['{k}']") for k in ("Error Message", "Note", "Information", "error")])


def parted(docs: DataFrame, key: str = "sym") -> tuple[DataFrame, DataFrame]:
    """Feed documents -> those with data, and (key, message) of those that carry an error or nothing instead."""
    said = docs.withColumn("message__", F.when(F.col("doc").isNull(), F.lit("no answer")).otherwise(feed_error(F.col("doc"))))
    return said.where("message__ is null").drop("message__"), said.where("message__ is not null").select(key, F.col("message__").alias("message"))


def retried(first: DataFrame, second: DataFrame, key: str = "sym") -> DataFrame:
    """The first pass's documents with data, and the second pass's for the keys that the first one lacks."""
    good, _ = parted(first, key)
    return good.unionByName(second.join(good.select(key), key, "left_anti").select(*good.columns))


def health(requested: DataFrame, docs: DataFrame, key: str = "sym") -> DataFrame:
    """One row: total (keys asked for), fetched (with data), failed, and the failures' messages (sorted, distinct)."""
    good, bad = parted(docs, key)
    state = requested.select(key).distinct().join(good.select(key, F.lit(True).alias("ok")).distinct(), key, "left").join(bad.groupBy(key).agg(F.max("message").alias("message")), key, "left")
    ok = F.coalesce("ok", F.lit(False))
    why = F.when(~ok, F.coalesce("message", F.lit("no answer")))
    return state.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("fetched"), F.count_if(~ok).alias("failed"), F.array_join(F.array_sort(F.collect_set(why)), "; ").alias("messages"))


def observed(docs: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The documents with data, and an observation of all: total, fetched, failed. It is filled by the first job that reads the documents."""
    seen, message = Observation(name), F.col("message__")
    said = docs.withColumn("message__", F.when(F.col("doc").isNull(), F.lit("no answer")).otherwise(feed_error(F.col("doc"))))
    said = said.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(message.isNull()).alias("fetched"), F.count_if(message.isNotNull()).alias("failed"))
    return said.where(message.isNull()).drop("message__"), seen


def listings(symbols: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Adds s, EXCHANGE:SYMBOL in the form with a point, null where no exchange is known; (sym, exchange) may write share classes with
    a dash or a point, and of a symbol that it has twice the first exchange by name holds."""
    known = exchanges.groupBy(same_class(F.col("sym")).alias("class__")).agg(F.min("exchange").alias("exchange__"))
    rows = symbols.withColumn("class__", same_class(F.col("sym"))).join(known, "class__", "left")
    return rows.withColumn("s", F.when(F.col("exchange__").isNotNull(), listed(F.col("exchange__"), F.col("sym")))).drop("class__", "exchange__")


def asked_again(asked: DataFrame, first: DataFrame, ask, key: str = "s") -> tuple[DataFrame, DataFrame]:
    """The first answer with what `ask` gives for the names that it lacks, and those names. Each name is asked for once more at most;
    a null name is none, and what was never asked for isn't let in by the second answer."""
    lacking = asked.where(F.col(key).isNotNull()).select(key).distinct().join(first.select(key), key, "left_anti")
    more = ask(lacking).join(lacking, key, "left_semi").dropDuplicates([key])
    return first.unionByName(more.select(*first.columns)), lacking


def daily_closes(docs: DataFrame, series: str, field: str, digits: int | None = None) -> DataFrame:
    """(sym, doc) -> (sym, d, close) from documents keyed by date. Rows without a number are left out."""
    days = F.from_json(F.get_json_object("doc", f"$['{series}']"), DAILY)
    rows = docs.select("sym", F.explode(days).alias("day", "bar"))
    close = parsed(F.col("bar")[field])
    return rows.select("sym", F.to_date("day").alias("d"), (close if digits is None else rounded(close, digits)).alias("close")).where("d is not null and close is not null")


def index_bars(docs: DataFrame) -> DataFrame:
    """(sym, doc) -> (sym, d, open, high, low, close) from a `data` array."""
    bars = F.from_json(F.get_json_object("doc", "$.data"), "array<struct<date:string,open:string,high:string,low:string,close:string>>")
    rows = docs.select("sym", F.explode(bars).alias("b"))
    return rows.select("sym", F.to_date("b.date").alias("d"), *[parsed(f"b.{c}").alias(c) for c in ("open", "high", "low", "close")]).where("d is not null and close is not null")


def full_bars(docs: DataFrame, series: str = "Time Series (Daily)") -> DataFrame:
    """(sym, doc) -> bars with raw and adjusted closes; volume and dividend default to 0, prices have four digits."""
    rows = docs.select("sym", F.explode(F.from_json(F.get_json_object("doc", f"$['{series}']"), DAILY)).alias("day", "bar"))
    names = {"open": "1. open", "high": "2. high", "low": "3. low", "raw_close": "4. close", "adj_close": "5. adjusted close"}
    prices = [rounded(parsed(F.col("bar")[k]), 4).alias(c) for c, k in names.items()]
    volume = F.coalesce(parsed(F.col("bar")["6. volume"]).cast("long"), F.lit(0).cast("long")).alias("volume")
    dividend = F.coalesce(parsed(F.col("bar")["7. dividend amount"]), F.lit(0.0)).alias("dividend")
    return rows.select("sym", F.to_date("day").alias("d"), *prices, volume, dividend).where("d is not null and adj_close is not null")


def point_quotes(docs: DataFrame) -> DataFrame:
    """(sym, doc) -> (sym, price, prev_close, change_percent); the quote's key is matched by its beginning."""
    top = F.from_json("doc", DAILY)
    quote = F.map_values(F.map_filter(top, lambda k, v: F.startswith(k, F.lit("Global Quote"))))
    q = docs.select("sym", F.try_element_at(quote, F.lit(1)).alias("q"))
    return q.select("sym", parsed(F.col("q")["05. price"]).alias("price"), parsed(F.col("q")["08. previous close"]).alias("prev_close"), parsed(F.replace(F.col("q")["10. change percent"], F.lit("%"), F.lit(""))).alias("change_percent"))


def newest_first(docs: DataFrame) -> DataFrame:
    """(name, doc) -> (name, value, previous): the first two numbers of a `data` array of (date, value)."""
    data = F.from_json(F.get_json_object("doc", "$.data"), "array<struct<date:string,value:string>>")
    good = F.filter(F.transform(data, lambda x: F.struct(F.to_date(x["date"]).alias("d"), parsed(x["value"]).alias("v"))), lambda x: x["v"].isNotNull())
    rows = docs.select("name", F.slice(F.sort_array(good, asc=False), 1, 2).alias("two"))
    return rows.select("name", F.try_element_at("two", F.lit(1))["v"].alias("value"), F.try_element_at("two", F.lit(2))["v"].alias("previous"))


def put_call(docs: DataFrame, days: DataFrame, last: int = 18) -> DataFrame:
    """Readings (d, put_call_ratio_full_chain) of the last `last` trading days; what isn't a number is left out."""
    wanted = days.select("d").distinct().orderBy(F.desc("d")).limit(last)
    return docs.join(wanted, "d").select("d", parsed("put_call_ratio_full_chain").alias("y")).where("y is not null")


def screener(rows: DataFrame) -> DataFrame:
    """(s, d array) -> named columns by position."""
    at = lambda k: F.try_element_at("d", F.lit(k))
    return rows.select(F.col("s").alias("ticker"), at(1).alias("name"), *[parsed(at(k)).alias(c) for k, c in ((2, "high"), (3, "low"), (4, "high_all"), (5, "low_all"))])


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): files as they lie, zipped or plain."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def archived_lines(files: DataFrame, key: str = "path", batch: int = 20_000) -> DataFrame:
    """(key, content) -> (key, line): the data lines of each file's text, or of the first file in it where it is a zip archive.

    The header is the first line that begins with a comma and a name; data runs from there to the first line whose key isn't eight digits; blank
    lines count for nothing. A text is unpacked and read line by line, `batch` lines go out at a time, and reading ends with the data, so a task holds
    an archive as packed, never its text. No content, an archive without files and a text without a header have no lines; an archive that
    breaks off is an error of its own (`isolation.isolated` takes such a part aside)."""

    def data(content: bytes) -> Iterator[str]:
        if content[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                inner = next((i for i in z.infolist() if not i.is_dir()), None)
                if inner is not None:
                    with z.open(inner) as f:
                        yield from body(f)
        else:
            yield from body(io.BytesIO(content))

    def body(raw) -> Iterator[str]:
        begun = False
        for line in io.TextIOWrapper(raw, "utf-8", "replace"):
            line = line.rstrip("\r\n")
            if not begun:
                begun = HEADER.match(line) is not None
            elif line.strip():
                if not DAY_KEY.fullmatch(line.split(",", 1)[0].strip()):
                    return
                yield line

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, content in zip(frame[key], frame["content"], strict=True):
                lines = data(bytes(content or b""))
                while some := list(islice(lines, batch)):
                    yield pd.DataFrame({key: [k] * len(some), "line": some})

    kind = dict(files.dtypes)[key]
    return files.select(key, "content").mapInPandas(read, f"`{key}` {kind}, line string")


def dated_rows(lines: DataFrame, columns: list[str], key: str = "path") -> DataFrame:
    """(key, line) -> (key, d, columns): cells by place, null where a cell is missing or no number; a day that doesn't exist is null."""
    cells = F.split("line", ",")
    return lines.select(key, F.try_to_timestamp(F.trim(cells[0]), F.lit("yyyyMMdd")).cast("date").alias("d"), *[parsed(F.try_element_at(cells, F.lit(k + 2))).alias(c) for k, c in enumerate(columns)])


def bars_between(trades: DataFrame, sym: str, first: str, last: str) -> DataFrame:
    """Daily bars of one symbol between two days, both included, from (sym, at, key, price). The parameters are checked, then bound to markers of
    the SQL text, never pasted into it, and reach the scan as filters. Bars open and close with the least and the largest key of the day."""
    if not re.fullmatch(r"[A-Z0-9.\-]{1,10}", sym):
        raise ValueError(f"not a symbol: {sym!r}")
    days = [dt.date.fromisoformat(d) for d in (first, last)]
    if days[0] > days[1]:
        raise ValueError(f"{first} is after {last}")
    kind = trades.schema["at"].dataType.simpleString()
    text = f"""
        SELECT sym, CAST(at AS DATE) AS d, min_by(price, key) AS open, max(price) AS high, min(price) AS low, max_by(price, key) AS close
        FROM {{trades}} WHERE sym = :sym AND at >= CAST(:first AS {kind}) AND at < CAST(:after AS {kind}) GROUP BY sym, CAST(at AS DATE)"""
    return trades.sparkSession.sql(text, args={"sym": sym, "first": days[0], "after": days[1] + dt.timedelta(1)}, trades=trades)


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A snapshot, or None where none was written yet."""
    from pyspark.errors import AnalysisException

    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
