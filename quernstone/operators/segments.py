"""A lexical index that is kept up to date: segments, tombstones, statistics that are merged on read.

Each change is one commit, numbered from 1, in a folder of its own: the postings
of added texts, the ids that it removes from all earlier commits, and what it
adds to and takes from document frequencies and lengths. The manifest of a
commit lists the commits that count; a reader takes the last manifest that is
complete, so a change shows at once or not at all. Compaction writes what is
alive as one commit. Commits of one index follow one another: of two writers
at the same time, the second fails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, tokens
from ..session import beside
from ..sources.tables import exists
from .index import LexicalIndex, postings_of, term_weights


@dataclass
class SegmentedIndex:
    """The folder ``path`` of an index of (id, text); it may be new. ``id_kind`` is the type of ids."""

    spark: SparkSession
    path: str
    id_kind: str = "bigint"
    tokenize: Tokenizer = tokens

    def commits(self) -> list[int]:
        """The commits that count, oldest first."""
        if not exists(self.spark, f"{self.path}/manifest"):
            return []
        listed = self.spark.read.schema("commit long, version long").parquet(f"{self.path}/manifest")
        last = listed.agg(F.max("version")).first()[0]
        return sorted(r["commit"] for r in listed.where(F.col("version") == last).collect()) if last is not None else []  # a row a commit

    def _next(self) -> int:
        seen = [self.spark.read.schema("commit long, version long").parquet(f"{self.path}/manifest").agg(F.max("version")).first()[0]] if exists(self.spark, f"{self.path}/manifest") else [0]
        return (seen[0] or 0) + 1

    def _table(self, name: str, commits: list[int], schema: str) -> DataFrame:
        """A table of some commits, with the number of its commit."""
        found = None
        for c in commits:
            part = self.spark.read.schema(schema).parquet(f"{self.path}/commit={c}/{name}").withColumn("commit", F.lit(c).cast("long"))
            found = part if found is None else found.unionByName(part)
        return found if found is not None else self.spark.createDataFrame([], schema + ", commit long")

    def _alive(self, name: str, commits: list[int], schema: str) -> DataFrame:
        """Rows by id that no later commit removed."""
        gone = self._table("gone", commits, f"id {self.id_kind}").groupBy("id").agg(F.max("commit").alias("removed"))
        rows = self._table(name, commits, schema).join(beside(gone, gone), "id", "left")
        return rows.where("removed IS NULL OR removed <= commit").drop("removed", "commit")

    def texts(self) -> DataFrame:
        """(id, dl) of the texts that are alive."""
        return self._alive("texts", self.commits(), f"id {self.id_kind}, dl long")

    def _postings(self, commits: list[int]) -> DataFrame:
        return self._alive("postings", commits, f"term string, id {self.id_kind}, tf long, dl long")

    def _commit(self, postings: DataFrame, texts: DataFrame, ids: DataFrame) -> int:
        """Write one change: new rows, and ``ids`` that leave all commits before."""
        before, now = self.commits(), self._next()
        to = f"{self.path}/commit={now}"
        alive = self._alive("texts", before, f"id {self.id_kind}, dl long")
        alive.join(beside(ids, ids), "id", "left_semi").select("id").distinct().write.mode("overwrite").parquet(f"{to}/gone")
        gone = self.spark.read.schema(f"id {self.id_kind}").parquet(f"{to}/gone")
        postings.repartitionByRange("term", "id").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{to}/postings")
        texts.write.mode("overwrite").parquet(f"{to}/texts")
        own = self._table("postings", [now], f"term string, id {self.id_kind}, tf long, dl long")
        lost = self._postings(before).join(beside(gone, gone), "id", "left_semi")
        change = own.select("term", F.lit(1).alias("by")).unionByName(lost.select("term", F.lit(-1).alias("by")))
        change.groupBy("term").agg(F.sum("by").alias("df")).where("df <> 0").write.mode("overwrite").parquet(f"{to}/frequencies")
        less = alive.join(beside(gone, gone), "id", "left_semi").select(-F.col("dl"), F.lit(-1))
        sizes = self._table("texts", [now], f"id {self.id_kind}, dl long").select("dl", F.lit(1)).union(less).toDF("dl", "n")
        sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total")).write.mode("overwrite").parquet(f"{to}/sizes")
        self._publish([*before, now], now)
        return now

    def _publish(self, commits: list[int], version: int) -> None:
        """The manifest is one file, which shows when it is whole; it must not exist yet."""
        self.spark.createDataFrame([(c,) for c in commits], "commit long").coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/version={version}")

    def add(self, texts: DataFrame, text: str = "text") -> int:
        """Add (id, text), in place of earlier texts of these ids; the number of the commit.

        Of several texts of one id the largest by order of strings counts. Rows
        with a null id are left out; null and empty texts have no terms, but count for the mean length.
        """
        once = texts.where("id IS NOT NULL").groupBy("id").agg(F.max(text).alias(text))
        size = once.select("id", F.coalesce(F.size(self.tokenize(F.col(text))), F.lit(0)).cast("long").alias("dl"))
        return self._commit(postings_of(once, "id", self.tokenize(F.col(text))).select("term", "id", "tf", "dl"), size, once.select("id"))

    def delete(self, ids: DataFrame) -> int:
        """Remove the texts of some (id); ids that are not there are passed over."""
        none = self.spark.createDataFrame([], f"term string, id {self.id_kind}, tf long, dl long")
        return self._commit(none, none.select("id", "dl"), ids.select("id").where("id IS NOT NULL").distinct())

    def index(self) -> LexicalIndex:
        """The index as it is now: its hits are those of an index built of the living texts."""
        commits = self.commits()
        df = self._table("frequencies", commits, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        sizes = self._table("sizes", commits, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
        corpus = sizes.select("n", (F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("avgdl"))
        return LexicalIndex(self._postings(commits), term_weights(df, sizes.select("n")), corpus)

    def compact(self) -> int:
        """Write what is alive as one commit, which replaces all others."""
        before, now = self.commits(), self._next()
        to, form = f"{self.path}/commit={now}", f"id {self.id_kind}, dl long"
        self._postings(before).repartitionByRange("term", "id").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{to}/postings")
        self._alive("texts", before, form).write.mode("overwrite").parquet(f"{to}/texts")
        self.spark.createDataFrame([], f"id {self.id_kind}").write.mode("overwrite").parquet(f"{to}/gone")
        df = self._table("frequencies", before, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        df.write.mode("overwrite").parquet(f"{to}/frequencies")
        sizes = self._table("sizes", before, "n long, total long")
        sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).write.mode("overwrite").parquet(f"{to}/sizes")
        self._publish([now], now)
        return now

    def vacuum(self) -> list[int]:
        """Delete the folders of commits that the last manifest no longer lists; their numbers. Readers of older manifests must be done."""
        kept, last = set(self.commits()), self._next() - 1
        old = [c for c in range(1, last + 1) if c not in kept and exists(self.spark, f"{self.path}/commit={c}")]
        for c in old:
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commit={c}")
            hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        return old
