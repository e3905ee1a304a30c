"""Mix sources to target weights with hash thresholds found in histograms; no row is sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidy

HASH_BITS, LEVEL_BITS = 60, 15
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def key_hash(key: str = "doc_id", text: str = "text"):
    """60 bits of a digest of id and text, nulls as empty: rows that share an id, or have none, differ by their texts."""
    both = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes, dealt by weight, at most ``cap`` times a source's size.

    Water filling in closed form: with sources in order of cap to weight, the
    level is that of the first source which its equal share does not overflow,
    which is the highest of those that fit.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    weighted = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = (
        weighted.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("below", F.coalesce(F.sum("source_size").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (share * F.col("total") - cap * F.col("below")) / F.col("open"))
        .withColumn("fits", F.when(F.col("level") * F.col("weight") <= cap * F.col("source_size"), F.col("level")))
        .withColumn("level", F.max("fits").over(everything))
    )
    most = F.lit(cap) * F.col("source_size")
    return filled.select("source", "source_size", F.least(most, F.coalesce(F.col("level") * F.col("weight"), most)).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, times, below): each row counts ``times``, and once more if its hash is under ``below``.

    The extra budget is spent on a prefix of hash values, up to the value that
    brings the sum nearest. Each level sums sizes by source and the next bits of
    the hash; rows outside the boundary bucket are settled and left out of later
    sums, though each level scans the sizes (three numbers a row) to find those inside.
    """
    with tidy() as keep:
        state = keep(_thresholds(sizes, targets))
    return state.select("source", "source_size", "target", "times", F.col("low").alias("below"))


def _thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    state = targets.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("times"),
        F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("taken"),
    ).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
    state = materialize(state, "mix-state")
    for level in range(HASH_BITS // LEVEL_BITS):
        width = 1 << (HASH_BITS - LEVEL_BITS * (level + 1))
        here = state.select(F.col("source").alias("s"), "low")
        inside = sizes.join(here, F.col("source").eqNullSafe(F.col("s")))
        if level:
            inside = inside.where((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + width * (1 << LEVEL_BITS)))
        sums = inside.groupBy("s", F.expr(f"hash div {width}L").alias("bucket")).agg(F.sum("size").alias("sum"))
        before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 2^LEVEL_BITS rows at most
        sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
        last = width == 1
        bound = F.col("taken") + F.col("before") + (F.col("sum") / 2 if last else F.col("sum"))
        crossing = (
            state.join(sums, F.col("source").eqNullSafe(F.col("s")))
            .where(bound > F.col("budget"))
            .groupBy("source")
            .agg(F.min_by(F.struct((F.col("bucket") * width).alias("low"), (F.col("taken") + F.col("before")).alias("taken")), "bucket").alias("next"))
            .select(F.col("source").alias("s"), "next")
        )
        state = (
            state.join(crossing, F.col("source").eqNullSafe(F.col("s")), "left")
            .select("source", "source_size", "target", "times", F.coalesce("next.low", F.lit((1 << HASH_BITS) - 1 if not level else None).cast("long"), F.col("low") + width * (1 << LEVEL_BITS)).alias("low"), F.coalesce("next.taken", "taken").alias("taken"), "budget")
        )
        state = materialize(state, "mix-state")
    return state


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    size is the number of words (null text: 0); sources weigh ``weights`` in turn
    by code point, null last. copies is how often the mix takes the document,
    taken = size * copies. Repeated rows of one id and text are taken
    together. Columns other than doc_id, source and text are not looked at,
    whatever their names. A source without words takes nothing; an empty table gives none.
    """
    sizes = materialize(docs.select("doc_id", "source", word_count().alias("size"), key_hash().alias("hash")), "mix-sizes")
    found = thresholds(sizes, source_targets(sizes, weights, share, cap)).withColumnRenamed("source", "s")
    copies = F.col("times") + (F.col("hash") < F.col("below")).cast("long")
    return sizes.join(found, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it.

    A row finds its copies by its own source and hash, not by its id: rows with a
    null id and repeated ids come out as often as they are counted.
    """
    sizes = materialize(docs.select("source", word_count().alias("size"), key_hash().alias("hash")), "mix-sizes")
    found = thresholds(sizes, source_targets(sizes, weights, share, cap)).select(F.col("source").alias("_source"), F.col("times").alias("_times"), F.col("below").alias("_below"))
    copies = F.col("_times") + (key_hash() < F.col("_below")).cast("long")
    joined = docs.join(found, F.col("source").eqNullSafe(F.col("_source")))
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(True), copies.cast("int"))).alias("_copy")).select(docs.columns)


ORACLE = """
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighted AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM per
), filled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT max(level) FROM filled WHERE level * weight <= 2.0::DOUBLE * source_size) * weight, 2.0::DOUBLE * source_size)) AS target FROM filled
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM targets
), ranked AS (
  SELECT s.doc_id, s.source, s.size, b.source_size, b.target, b.times,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash) - (sum(s.size) OVER (PARTITION BY s.source, s.hash)) / 2.0
           <= b.target - b.times * b.source_size AS more
  FROM sizes s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, size, source_size, target, (times + more::BIGINT)::BIGINT AS copies, (size * (times + more::BIGINT))::BIGINT AS taken FROM ranked
"""
