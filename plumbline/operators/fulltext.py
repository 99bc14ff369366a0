"""A full-text index that is kept: postings in buckets by term, read by the buckets of the terms that are asked for.

`path/postings` has a generation for each time that documents were written. Within it `bucket=b` has the postings (term, id,
tf) of the terms whose hash falls there, sorted by term, so that a search reads a few folders and, by the files'
statistics, a few pieces of them. A frequent term lies in `spread` files. A document that is written again or removed
leaves its old postings where they are; `path/gone` says from which generation on they no longer count, until the index is
put together anew. Both are tables with a ledger: a generation counts, with what it puts out of count, once its postings
are whole, so one that failed halfway changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import checkpointed, fresh_path, kept_path, small
from ..functions.tables import Landing

BUCKETS, SPREAD = 64, 8
#: Characters of texts whose postings one task counts and sorts.
SORTED = 16_000_000
#: So many terms stand in the filter itself; more are joined.
LISTED = 1000


def words(text: str = "text"):
    """The lower-case words of two characters or more."""
    every = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)
    return F.filter(every, lambda w: F.length(w) >= 2)


def bucket_of(term: str, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class TextIndex:
    """The index below a path. Documents are (id, text)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, spread: int = SPREAD, id_type: str = "long") -> None:
        self.spark, self.path, self.buckets, self.spread, self.id_type = spark, path, buckets, spread, id_type
        self._postings = Landing(spark, f"{path}/postings", apart=1 << 30)
        self._gone = Landing(spark, f"{path}/gone", apart=1 << 30)

    def generation(self) -> int:
        """The last generation; -1 of an index that has none."""
        return max(self._postings.batches(), default=self._postings.upto())

    def _sorted(self, rows: DataFrame, partitions: int) -> DataFrame:
        """Postings as they are written: a task sorts about `SORTED` characters' worth of them, however many there are."""
        spread = max(self.spread, -(-self.spread * partitions // self.buckets))
        dealt = rows.withColumn("bucket", bucket_of("term", self.buckets)).repartition(partitions, "bucket", F.pmod(F.xxhash64("id"), F.lit(spread)))
        return dealt.sortWithinPartitions("bucket", "term", "id")

    def _partitions(self, characters: int | None) -> int:
        return max(self.buckets, -(-(characters or 0) // SORTED))

    def _sorted_of(self, docs: DataFrame) -> DataFrame:
        characters = docs.agg(F.sum(F.length("text").cast("long"))).collect()[0][0]
        return self._sorted(self._counted(docs, self._partitions(characters)), self._partitions(characters))

    @staticmethod
    def _counted(docs: DataFrame, partitions: int) -> DataFrame:
        """Words counted by document: all of an id are dealt to one task, so each is sent once and as a text."""
        own = docs.select("id", "text").repartition(partitions, "id")
        return own.select("id", F.explode(words()).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))

    def build(self, docs: DataFrame) -> TextIndex:
        """A new index of all documents. Rows of one id are one document."""
        for table in (self._gone, self._postings):
            table.empty()
        self._postings.write(self._sorted_of(docs), 0, ["bucket"])
        return self

    def update(self, docs: DataFrame) -> TextIndex:
        """Writes documents anew, in place of what their ids had."""
        generation = self.generation() + 1
        docs = checkpointed(docs.select("id", "text"))
        self._gone.write(docs.select("id").distinct().withColumn("before", F.lit(generation)), generation)
        self._postings.write(self._sorted_of(docs.where("text is not null")), generation, ["bucket"])
        return self

    def remove(self, ids: DataFrame) -> TextIndex:
        return self.update(ids.select("id", F.lit(None).cast("string").alias("text")))

    def _read(self, *filters) -> DataFrame:
        """Postings that count, after filters on bucket and term."""
        out = self.spark.createDataFrame([], f"term string, id {self.id_type}, tf long, generation int")
        for folder in self._postings.folders():
            rows = self.spark.read.schema(f"term string, id {self.id_type}, tf long, bucket int").parquet(folder)
            for f in filters:
                rows = f(rows)
            out = out.unionByName(rows.select("term", "id", "tf", F.lit(int(folder.rpartition("=")[2])).alias("generation")))
        counts = set(self._postings.batches())
        if numbers := [n for n in self._gone.batches() if n in counts]:
            gone = self.spark.read.parquet(*[f"{self._gone.path}/batch={n}" for n in numbers]).groupBy(F.col("id").alias("gone_id")).agg(F.max("before").alias("before"))
            out = out.join(small(gone), (F.col("id") == F.col("gone_id")) & (F.col("generation") < F.col("before")), "left_anti")
        return out.drop("generation")

    def postings(self, terms: DataFrame) -> DataFrame:
        """(term, id, tf) of the terms (term): only the folders of their buckets are read."""
        terms = checkpointed(terms.select("term").distinct())
        asked = [r["bucket"] for r in terms.select(bucket_of("term", self.buckets).alias("bucket")).distinct().collect()]  # as many as there are buckets at most
        listed = [r["term"] for r in terms.limit(LISTED + 1).collect()]
        near = small(terms)
        own = (lambda rows: rows.where(F.col("term").isin(listed))) if len(listed) <= LISTED else (lambda rows: rows.join(near, "term", "left_semi"))
        return self._read(lambda rows: rows.where(F.col("bucket").isin(asked)), own)

    def search(self, queries: DataFrame, n: int) -> DataFrame:
        """(query_id, id, score, rank): the score adds tf / (tf + 1) over a query's terms. queries: query_id, text."""
        from .retrieval import best_by_words, query_words

        terms = query_words(queries)
        return best_by_words(self.postings(terms.select(F.col("q").alias("term"))), terms, n)

    def compact(self) -> TextIndex:
        """Puts all generations together; what no longer counts goes."""
        if self._postings.batches():
            whole = fresh_path(self.spark, "postings")
            self._read().write.parquet(whole)  # not onto what is being read
            rows = self.spark.read.schema(f"term string, id {self.id_type}, tf long").parquet(whole)
            self._postings.fold(self._sorted(rows, self._partitions(8 * rows.count())), self.generation(), ["bucket"])
            self._gone.empty()
        return self


def index_of(docs: DataFrame, name: str, columns: tuple[str, str]) -> TextIndex:
    """The index of a table of files, built when it is asked for first and again once its files have changed."""
    index = TextIndex(docs.sparkSession, kept_path(docs, f"text-{name}"), id_type=docs.schema[columns[0]].dataType.simpleString())
    if index.generation() < 0:
        index.build(docs.select(F.col(columns[0]).alias("id"), F.col(columns[1]).alias("text")))
    return index
