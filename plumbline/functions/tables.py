"""Tables that are written batch by batch, such as micro-batches: a folder for each, and a ledger of those that are whole.

A batch counts once its mark is in the ledger, and the mark is set after its data is written, so what a failed write left
behind is never read. A batch that is delivered again loses its mark, replaces itself and gets the mark back. Old batches
are put together into one folder now and then; the newest one never is, since only it can be delivered again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: So many batches lie apart before they are put together.
APART = 64


class Landing:
    """The table of a stream below a path. Batches below `ledger/` are done; `whole=n` has all rows of batches up to n."""

    def __init__(self, spark: SparkSession, path: str, apart: int = APART) -> None:
        self.spark, self.path, self.apart = spark, path, apart
        self._place = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._place(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marks(self, kind: str) -> list[int]:
        folder = self._place(f"{self.path}/ledger")
        names = [x.getPath().getName() for x in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(int(n.removeprefix(f"{kind}=")) for n in names if n.startswith(f"{kind}="))

    def _mark(self, name: str) -> None:
        self._files.create(self._place(f"{self.path}/ledger/{name}"), True).close()

    def _drop(self, name: str) -> None:
        """The mark goes before the data."""
        self._files.delete(self._place(f"{self.path}/ledger/{name}"), False)
        self._files.delete(self._place(f"{self.path}/{name}"), True)

    def upto(self) -> int:
        """The last batch that is in the folder of old batches; -1 if there is none."""
        return max(self._marks("whole"), default=-1)

    def batches(self) -> list[int]:
        """The batches that lie apart and are done, in order."""
        upto = self.upto()
        return [n for n in self._marks("batch") if n > upto]

    def done(self, number: int) -> bool:
        return number <= self.upto() or number in self._marks("batch")

    def write(self, rows: DataFrame, number: int, by: list[str] = (), **options: object) -> None:
        """Writes a batch, in place of what it wrote before, partitioned by columns."""
        if number <= self.upto():
            return
        self._drop(f"batch={number}")
        rows.write.options(**options).partitionBy(*by).mode("overwrite").parquet(f"{self.path}/batch={number}")
        self._mark(f"batch={number}")
        if len(self.batches()) > self.apart:
            self.compact()

    def folders(self) -> list[str]:
        upto = self.upto()
        return [f"{self.path}/whole={upto}"] * (upto >= 0) + [f"{self.path}/batch={n}" for n in self.batches()]

    def read(self, schema: StructType) -> DataFrame:
        folders = self.folders()
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def batch(self, number: int, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/batch={number}")

    def compact(self) -> None:
        """Puts all batches but the newest together."""
        numbers = self.batches()[:-1]
        if numbers:
            rows = self.spark.read.parquet(*[f for f in self.folders() if not f.endswith(f"/batch={self.batches()[-1]}")])
            self.fold(rows.coalesce(max(1, rows.rdd.getNumPartitions() // 8)), numbers[-1])

    def fold(self, rows: DataFrame, last: int, by: list[str] = ()) -> None:
        """Puts rows in the place of all batches up to the last, at once: by the mark of the folder that has them."""
        old = self.upto()
        gone = [f"whole={old}"] * (old >= 0) + [f"batch={n}" for n in self.batches() if n <= last]
        rows.write.partitionBy(*by).mode("overwrite").parquet(f"{self.path}/whole={last}")
        self._mark(f"whole={last}")
        for name in gone:
            self._drop(name)

    def empty(self) -> None:
        """Drops all there is."""
        for kind in ("whole", "batch"):
            for n in self._marks(kind):
                self._drop(f"{kind}={n}")

    def keep_last(self, number: int) -> None:
        """Drops the batches before a number: for tables whose last batch says all."""
        for n in self._marks("batch"):
            if n < number:
                self._drop(f"batch={n}")
