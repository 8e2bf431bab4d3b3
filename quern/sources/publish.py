"""Several tables published together: readers see all of a version or none of it.

Tables of a version are staged in a folder of their own; a manifest that names them is written last, under a name that no other version has, by a rename that the file system
does whole. Readers take the manifest with the highest number. A run that breaks leaves staged tables that nobody reads; run again under the same name, it keeps those
that are complete and goes on.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Publication:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def stage(self, run: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """Write a table of the version `run`, unless an earlier attempt has written all of it."""
        path = f"{self.root}/staged/{run}/{name}"
        if not self._exists(f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def publish(self, run: str, names: list[str]) -> int:
        """Make the staged tables `names` the newest version; its number. Two that publish at once get numbers of their own, or one of them fails."""
        missing = [n for n in names if not self._exists(f"{self.root}/staged/{run}/{n}/_SUCCESS")]
        if missing:
            raise ValueError(f"not staged: {missing}")
        number = (self.versions() or [0])[-1] + 1
        waiting, final = self._path(f"{self.root}/staged/{run}/_manifest-{number}"), self._path(f"{self.root}/manifests/{number}.json")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(waiting, True)
        out.write(bytearray(json.dumps({"run": run, "tables": {n: f"staged/{run}/{n}" for n in names}}).encode()))
        out.close()
        if not self._fs.rename(waiting, final):
            raise RuntimeError(f"version {number} was published by another run")
        return number

    def manifest(self, version: int | None = None) -> dict:
        number = version or (self.versions() or [0])[-1]
        if not number:
            return {"run": None, "tables": {}}
        rows = self.spark.read.option("wholetext", True).text(f"{self.root}/manifests/{number}.json").collect()
        return json.loads(rows[0][0])

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.manifest(version)['tables'][name]}")


def converted(rows: DataFrame, types: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows that convert, rows that don't): text columns as the types named; a text that is there and doesn't convert refuses its row, which comes out as it was with `reason`, the columns at fault."""
    bad = F.array_compact(F.array(*(F.when(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS {t})").isNull(), f"{c} is no {t}") for c, t in types.items())))
    judged = rows.withColumn("_bad", bad)
    good = judged.where(F.size("_bad") == 0).select(*(F.expr(f"try_cast(`{c}` AS {types[c]})").alias(c) if c in types else F.col(c) for c in rows.columns))
    return good, judged.where(F.size("_bad") > 0).withColumn("reason", F.array_join("_bad", "; ")).drop("_bad")


def ingest(publication: Publication, run: str, feed: DataFrame, types: Mapping[str, str], tables: Mapping[str, Callable[[DataFrame], DataFrame]]) -> int:
    """Convert a feed, derive `tables` from the rows that convert, and publish them with the refused rows as `refused`, all at once; the version's number."""
    publication.stage(run, "refused", lambda: converted(feed, types)[1])
    good = publication.stage(run, "_converted", lambda: converted(feed, types)[0])
    for name, derive in tables.items():
        publication.stage(run, name, lambda derive=derive: derive(good))
    return publication.publish(run, [*tables, "refused"])
