"""Sources with the tolerance that catalogue feeds need."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, must_contain: str | None = None) -> DataFrame:
    """JSON lines, gzipped or not, with `bad` true where a line doesn't parse. `must_contain` drops lines before they are parsed."""
    lines = spark.read.text(path)
    if must_contain is not None:
        lines = lines.where(F.col("value").contains(must_contain))
    parsed = lines.where(F.trim("value") != "").select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNull().alias("bad"))
    return parsed.select("r.*", "bad", F.when(F.col("bad"), F.col("value")).alias("line"))


def bind(patterns: Mapping[str, str], cells: Sequence[str]) -> dict[str, int] | None:
    """A cell of its own for each pattern that occurs in it, whatever the case; None if there aren't enough."""
    place: dict[str, int] = {}

    def settle(name: str, tried: set[int]) -> bool:
        for k, cell in enumerate(cells):
            if k not in tried and re.search(patterns[name], cell, re.IGNORECASE):
                tried.add(k)
                holder = next((n for n, at in place.items() if at == k), None)
                if holder is None or settle(holder, tried):
                    place[name] = k
                    return True
        return False

    return place if all(settle(name, set()) for name in patterns) else None


def read_csv_with_header_below(spark: SparkSession, path: str, required: Sequence[str] | Mapping[str, str], columns: int = 64) -> DataFrame:
    """Rows of CSV files whose header is not the first line: the first line in which each of the `required` patterns finds a cell of its own; names
    without patterns stand for whole cells, in any order or case. Lines before it are a preamble. A file without such a line gives no rows, an empty cell is null.

    Spark's reader parses the lines; only those in which all patterns occur at all are looked at as headers. Each file has its own header, so its columns may be in an order of their own. Lines
    have at most `columns` cells.
    """
    patterns = dict(required) if isinstance(required, Mapping) else {r: rf"^\s*{re.escape(r)}\s*$" for r in required}
    read = spark.read.option("multiLine", True).option("escape", '"').schema(", ".join(f"c{k} string" for k in range(columns))).csv(path)
    cells = F.transform(F.array(*(f"c{k}" for k in range(columns))), lambda c: F.regexp_replace(c, "^\ufeff", ""))
    lines = read.select(F.filter(cells, lambda c: c.isNotNull()).alias("filled"), cells.alias("cells"), F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    lines = lines.where(F.size("filled") > 0)
    likely = F.lit(True)
    for has in [(lambda p: lambda c: c.rlike(f"(?i){p}"))(p) for p in patterns.values()]:
        likely = likely & F.exists("filled", has)

    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = [bind(patterns, [c or "" for c in row.as_py()]) for row in column]
            yield pa.array([None if f is None else [f[c] for c in patterns] for f in found], pa.list_(pa.int32()))

    heads = lines.where(likely).select("file", "at", F.arrow_udf(places, "array<int>").asNondeterministic()(F.col("cells")).alias("place")).where("place IS NOT NULL")
    first = heads.groupBy(F.col("file").alias("of")).agg(F.min_by(F.struct("at", "place"), "at").alias("head"))  # a row for each file
    below = lines.join(first, (F.col("file") == F.col("of")) & (F.col("at") > F.col("head.at")))
    return below.select(*(F.get("cells", F.get("head.place", F.lit(k))).alias(c) for k, c in enumerate(patterns)))


def find_column(columns: Sequence[str], patterns: Sequence[str]) -> str | None:
    """The first column that the first pattern matches, else the second, and so on; None if none does."""
    return next((c for p in patterns for c in columns if re.search(p, c, re.IGNORECASE)), None)


def with_columns_found(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns of any names under the names of `wanted`, each found by its patterns in order; null where there is none."""
    return df.select(*((F.col(f"`{c}`") if (c := find_column(df.columns, patterns)) else F.lit(None).cast("string")).alias(name) for name, patterns in wanted.items()))


def pick(record: Column, patterns: Sequence[str]) -> Column:
    """Of a record held as a map, the first value that isn't blank under a key that the first pattern matches, in the order of keys, else the second pattern, and so on."""
    entries = F.array_sort(F.map_entries(record))

    def first(pattern: str) -> Column:
        return F.get(F.filter(entries, lambda e: e["key"].rlike(f"(?i){pattern}") & (F.trim(F.coalesce(e["value"], F.lit(""))) != "")), F.lit(0))["value"]

    return F.coalesce(*map(first, patterns))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and doubled quotes; cells may hold line breaks. Everything is text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def read_zip_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """archive, member, content of the files in ZIP archives."""

    def members(batches):
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                    for m in archive.namelist():
                        if m.endswith(suffix) and not m.endswith("/"):
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([m]), pa.array([archive.read(m)], pa.binary())], names=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(members, "archive string, member string, content binary")
