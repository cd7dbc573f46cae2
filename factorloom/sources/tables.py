"""Tables by symbol: one sorted file a bucket of symbols, so that windows by symbol need no shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import files

#: Buckets of a new table.
BUCKETS = 32

_BUCKET = re.compile(r"_(\d{5})(?:\.[^/]*)?$")


def bucket_of(n: int) -> Column:
    """The bucket in which Spark puts a symbol."""
    return F.pmod(F.hash("symbol"), F.lit(n))


class SymbolTable:
    """Rows of (symbol, date, ...) in files bucketed by symbol and sorted by symbol and date.

    ``replace`` rewrites the buckets that hold touched symbols, and no others. Their new files are written
    beside the table first and moved in when they are complete; a run that breaks off in between leaves them
    whole, and ``recover`` puts them in place. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.new_buckets = spark, path.rstrip("/"), schema, buckets
        self.pending = self.path + "__pending"

    def exists(self) -> bool:
        return self.buckets(None) is not None

    def buckets(self, default: int | None = 0) -> int | None:
        """How many buckets the table has, which is fixed when it is made."""
        found = [int(x.partition("=")[2]) for x in files.names(self.spark, self.path) if x.startswith("_buckets=")]
        return found[0] if found else (self.new_buckets if default == 0 else default)

    def _catalog(self, path: str) -> str:
        return "by_symbol_" + sha256(f"{path} {self.schema.json()}".encode()).hexdigest()[:24]

    def read(self) -> DataFrame:
        """All rows, by a scan that knows the buckets; no rows if there is no table."""
        if not self.exists():
            return self.spark.createDataFrame([], self.schema)
        name, n = self._catalog(self.path), self.buckets()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (symbol) SORTED BY (symbol, date) INTO {n} BUCKETS LOCATION '{self.path}'")
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _files(self, path: str) -> dict[str, int]:
        return {f: int(m.group(1)) for f in files.names(self.spark, path) if f.startswith("part-") and (m := _BUCKET.search(f))}

    def rows_of(self, buckets: set[int]) -> DataFrame:
        """Rows of some buckets; no other file is opened."""
        own = [f"{self.path}/{f}" for f, b in self._files(self.path).items() if b in buckets]
        return self.spark.read.schema(self.schema).parquet(*own) if own else self.spark.createDataFrame([], self.schema)

    def touched(self, symbols: DataFrame) -> set[int]:
        """Buckets that hold the symbols."""
        return {r[0] for r in symbols.select(bucket_of(self.buckets()).alias("b")).distinct().collect()}

    def replace(self, fresh: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> set[int]:
        """Puts ``combine(old rows of the touched buckets, fresh)`` in their place; gives the buckets."""
        self.recover()
        touched = self.touched(fresh)
        if touched:
            n, name = self.buckets(), self._catalog(self.pending)
            out = combine(self.rows_of(touched), fresh).select(*self.schema.names)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            files.remove(self.spark, self.pending)
            rows = out.repartition(n, "symbol").write.format("parquet").bucketBy(n, "symbol").sortBy("symbol", "date").option("path", self.pending)
            rows.mode("overwrite").saveAsTable(name)
            self.spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
            self.recover()
        return touched

    def recover(self) -> bool:
        """Finishes a write that broke off after its files were complete beside the table; True if there was one."""
        if not files.exists(self.spark, f"{self.pending}/_SUCCESS"):
            return False
        files.mark(self.spark, f"{self.path}/_buckets={self.buckets()}")
        fresh = self._files(self.pending)
        for f, b in fresh.items():
            for old, ob in self._files(self.path).items():
                if ob == b:
                    files.remove(self.spark, f"{self.path}/{old}")
            files.move(self.spark, f"{self.pending}/{f}", f"{self.path}/{f}")
        files.remove(self.spark, self.pending)
        return True
