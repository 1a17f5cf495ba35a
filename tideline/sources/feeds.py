"""Scans: line-delimited and nested JSON, columnar JSON, facts, vintages, CSV, text, framed binary files, generated bars.

All schemas are stated, none is inferred; malformed input fails the read unless
said otherwise.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BAR = "symbol string, t string, o bigint, h bigint, l bigint, c bigint, v bigint"


def ndjson(spark: SparkSession, path: str, schema: str = BAR) -> DataFrame:
    """One JSON object per line; a line that doesn't parse fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bar_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages ``{"bars": {symbol: [bar, ...]}}`` flattened; prices stay decimals."""
    bar = "array<struct<t:string,o:decimal(38,18),h:decimal(38,18),l:decimal(38,18),c:decimal(38,18),v:bigint>>"
    pages = spark.read.schema(f"bars map<string, {bar}>").option("mode", "FAILFAST").json(path)
    return pages.select(F.explode("bars").alias("symbol", "b")).select("symbol", F.inline("b"))


def columnar_json(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Documents of parallel arrays, one row per place; arrays of unequal length fail the read."""
    df = spark.read.schema(", ".join(f"{k} array<{t}>" for k, t in fields.items())).option("mode", "FAILFAST").json(path)
    sizes = [F.size(k) for k in fields]
    same: Column = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    checked = df.where(F.assert_true(same, F.lit("parallel arrays differ in length")).isNull())
    return checked.select(F.inline(F.arrays_zip(*fields)))


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """taxonomy -> concept -> unit -> observations, flattened."""
    obs = "array<struct<end:string,val:decimal(38,6),filed:string>>"
    df = spark.read.schema(f"entity bigint, facts map<string, map<string, map<string, {obs}>>>").option("mode", "FAILFAST").json(path)
    a = df.select("entity", F.explode("facts").alias("taxonomy", "x"))
    b = a.select("entity", "taxonomy", F.explode("x").alias("concept", "y"))
    c = b.select("entity", "taxonomy", "concept", F.explode("y").alias("unit", "z"))
    return c.select("entity", "taxonomy", "concept", "unit", F.inline("z"))


def vintage_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of observations (date, realtime_start, realtime_end, value); a lone point is a missing value."""
    df = spark.read.schema("observations array<struct<date:string,realtime_start:string,realtime_end:string,value:string>>").option("mode", "FAILFAST").json(path)
    r = df.select(F.inline("observations"))
    return r.select(F.to_date("date").alias("date"), F.to_date("realtime_start").alias("known_from"), F.to_date("realtime_end").alias("known_to"), F.when(F.col("value") != ".", F.col("value").cast("decimal(38,6)")).alias("value"))


def strict_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header that must name the schema's columns; a bad cell fails the read."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file as symbols with their place; ``state`` tells the first from repeated and invalid ones."""
    from pyspark.sql import Window

    from tideline.functions.text import is_symbol

    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\r?\n")).alias("place", "line")).where(F.trim("line") != "")
    s = lines.select("place", F.trim("line").alias("symbol"))
    again = F.row_number().over(Window.partitionBy("symbol").orderBy("place")) > 1
    return s.select("place", "symbol", F.when(~is_symbol("symbol"), "INVALID").when(again, "DUPLICATE").otherwise("OK").alias("state"))


def replay_files(spark: SparkSession, folder: str) -> DataFrame:
    """Binary objects beside their ``.meta.json``: path, bytes and the sidecar's symbol and date, in path order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select(F.regexp_replace("path", r"\.bin$", "").alias("name"), "content")
    meta = spark.read.schema("symbol string, day string, sha256 string").json(f"{folder}/*.meta.json").select(F.regexp_replace(F.col("_metadata.file_path"), r"\.meta\.json$", "").alias("name"), "symbol", "day", "sha256")
    j = files.join(meta, "name", "left")
    return j.withColumn("authentic", F.sha2("content", 256) == F.col("sha256")).orderBy("name")


#: Frame of a journal: length, ordinal, CRC-32 of the body, then the body. The chain is SHA-256 over previous digest and body.
_HEAD = "<IQI"


def journal_bytes(bodies: list[bytes], first: int = 0) -> bytes:
    return b"".join(struct.pack(_HEAD, len(b), first + i, zlib.crc32(b)) + b for i, b in enumerate(bodies))


def journal(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of journal segments: segment, sequence, body, state (OK, BAD_CHECKSUM, TORN), chain digest.

    A segment is decoded front to back in one task; a torn tail ends it with one
    TORN row, all whole frames before it are kept. Order across segments is
    (segment, sequence).
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                at, digest, rows = 0, b"", []
                name = path.rsplit("/", 1)[-1]
                while at < len(data):
                    if at + struct.calcsize(_HEAD) > len(data):
                        rows.append((name, None, None, "TORN", None))
                        break
                    n, seq, crc = struct.unpack_from(_HEAD, data, at)
                    body = bytes(data[at + struct.calcsize(_HEAD) : at + struct.calcsize(_HEAD) + n])
                    if len(body) < n:
                        rows.append((name, seq, None, "TORN", None))
                        break
                    digest = hashlib.sha256(digest + body).digest()
                    rows.append((name, seq, body.decode("utf-8", "replace"), "OK" if zlib.crc32(body) == crc else "BAD_CHECKSUM", digest.hex()))
                    at += struct.calcsize(_HEAD) + n
                yield pd.DataFrame(rows, columns=["segment", "sequence", "body", "state", "chain"]).astype({"sequence": "Int64"})

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(decode, "segment string, sequence long, body string, state string, chain string")


#: A capture: magic, number of packets, packets of time and length, SHA-256 of all before it.
_MAGIC, _COUNT, _PACKET = b"CAP1", "<I", "<QI"


def capture_bytes(packets: list[tuple[int, bytes]]) -> bytes:
    data = _MAGIC + struct.pack(_COUNT, len(packets)) + b"".join(struct.pack(_PACKET, t, len(b)) + b for t, b in packets)
    return data + hashlib.sha256(data).digest()


def capture(spark: SparkSession, folder: str) -> DataFrame:
    """Packets of capture files: file, place, time_ns, body, state of the file.

    State is OK, BAD_HASH (the footer isn't the hash of what is before it), TRUNCATED
    (the file ends before its last packet or footer) or BAD_HEADER. Whole packets are
    given in any case but the last; a file without one gives a row with nulls, so no
    file goes missing. A file is decoded in one task and must fit into it.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                data, name = bytes(data), path.rsplit("/", 1)[-1]
                rows, state, head = [], "OK", len(_MAGIC) + struct.calcsize(_COUNT)
                if data[: len(_MAGIC)] != _MAGIC or len(data) < head:
                    state = "BAD_HEADER"
                else:
                    (n,) = struct.unpack_from(_COUNT, data, len(_MAGIC))
                    at = head
                    for k in range(n):
                        if at + struct.calcsize(_PACKET) > len(data):
                            state = "TRUNCATED"
                            break
                        t, size = struct.unpack_from(_PACKET, data, at)
                        at += struct.calcsize(_PACKET)
                        if at + size > len(data):
                            state = "TRUNCATED"
                            break
                        rows.append((k, t, data[at : at + size].decode("utf-8", "replace")))
                        at += size
                    if state == "OK":
                        footer = data[at:]
                        state = "TRUNCATED" if len(footer) < 32 else "OK" if footer == hashlib.sha256(data[:at]).digest() else "BAD_HASH"
                rows = [(name, *r, state) for r in rows] or [(name, None, None, None, state)]
                yield pd.DataFrame(rows, columns=["file", "place", "time_ns", "body", "state"]).astype({"place": "Int64", "time_ns": "Int64"})

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(decode, "file string, place long, time_ns long, body string, state string")


def verified_parquet(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """Parquet read by a stated schema, whose rows ascend strictly by ``order`` within ``key``; a breach fails the read."""
    from pyspark.sql import Window

    df = spark.read.schema(schema).parquet(path)
    before = F.lag(order).over(Window.partitionBy(key).orderBy(order))
    checked = df.withColumn("__ok", F.coalesce(before < F.col(order), F.lit(True)))
    return checked.where(F.assert_true("__ok", F.lit(f"{order} repeats within {key}")).isNull()).drop("__ok")


def by_name():
    """A window over the files of one folder by name; a row per file."""
    from pyspark.sql import Window

    return Window.orderBy("file")


def file_digests(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """file, bytes and SHA-256 of each file of a folder; a file is read by one task and must fit into it (Spark's limit is 2 GB)."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def authenticated(spark: SparkSession, folder: str, manifest: DataFrame, schema) -> DataFrame:
    """The folder's parquet rows with ``file`` and ``state``: AUTHENTIC where the file's hash and size are the manifest's, ALTERED, or UNLISTED.

    ``manifest``: file, bytes, sha256. A state joins to files, not to rows' contents,
    so column pruning and predicates still reach the scan.
    """
    told = file_digests(spark, folder).join(manifest.select("file", F.col("bytes").alias("b"), F.col("sha256").alias("h")), "file", "left")
    state = F.when(F.col("h").isNull(), "UNLISTED").when((F.col("h") == F.col("sha256")) & (F.col("b") == F.col("bytes")), "AUTHENTIC").otherwise("ALTERED")
    files = told.select("file", state.alias("state"))
    rows = spark.read.schema(schema).parquet(folder).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return rows.join(files, "file")


class _BarPartition(InputPartition):
    def __init__(self, symbol: str, day: str):
        self.symbol, self.day = symbol, day


class _BarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.symbols = options["symbols"].split(",")
        self.first, self.last = date.fromisoformat(options["first"]), date.fromisoformat(options["last"])
        self.seed, self.minutes = int(options.get("seed", 7)), int(options.get("minutes", 390))

    def partitions(self) -> list[InputPartition]:
        days = [self.first + timedelta(i) for i in range((self.last - self.first).days + 1)]
        return [_BarPartition(s, d.isoformat()) for d in days if d.weekday() < 5 for s in self.symbols]

    def read(self, partition: _BarPartition) -> Iterator[tuple]:
        price = 10_000
        for m in range(self.minutes):
            h = hashlib.sha256(f"{self.seed}|{partition.symbol}|{partition.day}|{m}".encode()).digest()
            price = max(100, price + h[0] % 21 - 10)
            yield partition.symbol, partition.day, m, price, price + h[1] % 5, max(1, price - h[2] % 5), price, int.from_bytes(h[3:5], "big")


class SyntheticBars(DataSource):
    """``spark.read.format("synthetic_bars")``: weekdays x symbols of deterministic minutes, one partition each; options symbols, first, last, seed, minutes."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_bars"

    def schema(self) -> str:
        return "symbol string, day string, minute int, o long, h long, l long, c long, v long"

    def reader(self, schema) -> DataSourceReader:
        return _BarReader(self.options)


def dated_universe(spark: SparkSession, first: str, last: str, symbols: DataFrame) -> DataFrame:
    """Weekdays in a range times a list of symbols."""
    days = spark.sql("select explode(sequence(to_date(:a), to_date(:b))) as day", args={"a": first, "b": last}).where(F.dayofweek("day").between(2, 6))
    return symbols.crossJoin(F.broadcast(days))


def scan(spark: SparkSession, kind: str, path: str, **more) -> DataFrame:
    """The scan for a kind of data set."""
    kinds = {"ndjson": ndjson, "pages": bar_pages, "facts": company_facts, "vintages": vintage_pages, "csv": strict_csv, "symbols": symbol_list, "journal": journal, "capture": capture, "replay": replay_files, "columnar": columnar_json}
    if kind not in kinds:
        raise ValueError(f"no scan for {kind!r}; there are {', '.join(sorted(kinds))}")
    return kinds[kind](spark, path, **more)
