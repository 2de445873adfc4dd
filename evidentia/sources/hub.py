"""Paging through a hub: a keyed table (seq, line) that many devices append to, read a page at a time.

A landed page is a folder named by the hub and by the cursor that the page began after; it holds lines with their
seq. The cursor is the largest seq of the last complete page, so it is stored with the page and never apart from it: a run
that stops before its page is complete reads the same page again into the same folder, and one that stops
later goes on behind it. Cursors of different hubs don't meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_ROWS = 2000


class HubReader:
    """Pages of a hub below path. rows(after): DataFrame of (seq, line); a JDBC table is one with the cursor as its predicate."""

    def __init__(self, spark: SparkSession, rows, hub: str, path: str, page_rows: int = PAGE_ROWS):
        self.spark, self.rows, self.page_rows = spark, rows, page_rows
        self.path = f"{path.rstrip('/')}/{hub.encode().hex()}"
        self.fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def pages(self) -> list[str]:
        """Folders of the complete pages, in order."""
        if not self.fs.exists(self._at(self.path)):
            return []
        found = (f.getPath() for f in self.fs.listStatus(self._at(self.path)))
        return sorted(str(p) for p in found if self.fs.exists(self._at(f"{p}/_SUCCESS")))

    def cursor(self) -> int:
        """The seq that the next page begins after; 0 before the first."""
        pages = self.pages()
        if not pages:
            return 0
        return self.spark.read.schema("seq long").parquet(pages[-1]).agg(F.max("seq")).first()[0]

    def page(self) -> bool:
        """Land the next page; whether there was one that was full, so that more may wait."""
        after = self.cursor()
        rows = self.rows(after).filter(F.col("seq") > after).orderBy("seq").limit(self.page_rows).select("seq", "line")
        if rows.isEmpty():
            return False
        folder = f"{self.path}/after={after:020d}"
        rows.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema("seq long").parquet(folder).count() == self.page_rows

    def drain(self) -> DataFrame:
        """Land all pages that wait; the lines of all pages."""
        while self.page():
            pass
        return self.lines()

    def lines(self) -> DataFrame:
        pages = self.pages()
        shape = "seq long, line string"
        return self.spark.read.schema(shape).parquet(*pages) if pages else self.spark.createDataFrame([], shape)


def jdbc_rows(spark: SparkSession, url: str, table: str, **options):
    """For HubReader: rows of a database table after a seq; predicate, order and limit reach the database."""
    return lambda after: spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(F.col("seq").cast("long").alias("seq"), F.col("line").cast("string").alias("line")).filter(F.col("seq") > after)
