"""Resumable enrichment of pages: what is left to do, progress, and merging results."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import json_reply, json_text
from ..plugins import ModelError, with_retries
from ..sources.tables import added, earlier_parquet

KEY = ["filename", "page"]


def tasks_from_images(files: DataFrame) -> DataFrame:
    """(filename, page, path) from image paths like name_page_7.png; others are left out, the last _page_ counts."""
    stem = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(.*)\.png$", 1)
    page = F.regexp_extract(stem, r"^(.*)_page_(\d+)$", 2)
    return files.select(F.regexp_extract(stem, r"^(.*)_page_(\d+)$", 1).alias("filename"), page.try_cast("long").alias("page"), "path").where("page is not null")


def capped(tasks: DataFrame, per_file: int) -> DataFrame:
    """The first tasks of each file in page order, before anything is skipped."""
    return tasks.withColumn("_n", F.row_number().over(Window.partitionBy("filename").orderBy("page"))).where(F.col("_n") <= per_file).drop("_n")


def progress(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """(filename, total, done, remaining)."""
    total = tasks.groupBy("filename").agg(F.count("*").alias("total"))
    ready = done.groupBy("filename").agg(F.count("*").alias("done"))
    n = F.coalesce("done", F.lit(0)).cast("long")
    return total.join(ready, "filename", "left").select("filename", "total", n.alias("done"), F.greatest(F.lit(0).cast("long"), F.col("total") - n).alias("remaining"))


def pending(tasks: DataFrame, done: DataFrame, start_page: int = 0, redo: bool = False) -> DataFrame:
    """Tasks from ``start_page`` on without a result; failed results count as results."""
    left = tasks.where(F.col("page") >= start_page)
    return left if redo else left.join(done.select(*KEY).distinct(), KEY, "left_anti")


#: What a page's reply holds; further keys are dropped.
CHART = "page_summary string, has_charts boolean, has_tables boolean, charts array<string>, tables array<string>"
RESULT = f"filename string, page long, {CHART}, raw_response string, error string"
#: What a failed page's summary says: fixed values.
UNPARSED = "JSONDecodeError: 无法解析 VLM 响应"
FAILED = "提取失败: "


def read_chart(raw: Column) -> Column:
    """struct of the five keys from a reply; absent keys get empty values; null where no JSON can be read."""
    found = json_reply(raw, CHART)
    return F.when(found.isNotNull(), F.struct(*(F.coalesce(found[k], v).alias(k) for k, v in _nothing().items())))


def read_variant(raw: Column) -> Column:
    """A reply as VARIANT, objects in it as they are; null where no JSON object can be read."""
    return F.try_parse_json(json_text(raw))


def chart_items(results: DataFrame, kind: str = "charts", reply: str = "reply", fields: dict[str, str] | None = None) -> DataFrame:
    """(filename, page, pos, item, and ``fields`` of it by name and type): each object of an array of a reply, without a Python worker.

    Fields are paths below the object, like ``title`` or ``values[0]``; what is
    absent or of another type is null. Replies that are no JSON, and those without the array, give no rows.
    """
    items = F.try_variant_get(read_variant(F.col(reply)), f"$.{kind}", "array<variant>")
    rows = results.select(*KEY, F.posexplode(items).alias("pos", "item"))
    return rows.withColumns({name.split("[")[0].replace(".", "_"): F.try_variant_get("item", f"$.{name}", type_) for name, type_ in (fields or {"title": "string"}).items()})


def _nothing() -> dict[str, Column]:
    none = F.array().cast("array<string>")
    return {"page_summary": F.lit(""), "has_charts": F.lit(False), "has_tables": F.lit(False), "charts": none, "tables": none}


def extract(tasks: DataFrame, call: Callable[[str], str], attempts: int = 3, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep, exists: Callable[[str], bool] | None = None, delay: float = 0.0) -> DataFrame:
    """RESULT rows: each task's image (``path``) through a model.

    A call that fails or says nothing is repeated after ``pause``, twice that and
    so on; after the last attempt the row holds the error. A reply that is no
    JSON becomes a placeholder with the raw text. Tasks whose image is not there
    give no row. A task waits ``delay`` seconds between its calls.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def answer(path: str) -> str:
            text = call(path)
            if not text:
                raise ValueError("empty reply")
            return text

        calls = 0
        for batch in batches:
            out = []
            for filename, page, path in zip(batch["filename"], batch["page"], batch["path"], strict=True):
                if exists is None or exists(path):
                    if delay and calls:
                        sleep(delay)
                    calls += 1
                    try:
                        out.append((filename, page, with_retries(lambda path=path: answer(path), attempts, pause, sleep), None))
                    except ModelError as e:
                        out.append((filename, page, None, str(e)))
            if out:
                yield pd.DataFrame(out, columns=[*KEY, "reply", "error"])

    said = tasks.select(*KEY, "path").mapInPandas(run, "filename string, page long, reply string, error string")
    read = said.withColumn("c", read_chart(F.col("reply")))
    summary = F.when(F.col("error").isNotNull(), F.concat(F.lit(FAILED), "error")).otherwise(F.coalesce("c.page_summary", F.lit(UNPARSED)))
    rest = [F.coalesce(F.col("c")[k], v).alias(k) for k, v in _nothing().items() if k != "page_summary"]
    raw = F.when(F.col("c").isNull(), F.col("reply"))
    return read.select(*KEY, summary.alias("page_summary"), *rest, raw.alias("raw_response"), "error")


def plan(tasks: DataFrame, done: DataFrame, images: DataFrame | None = None, per_file: int | None = None, start_page: int = 0) -> DataFrame:
    """What a job has left to do: tasks capped by file, with an image among ``images``, from ``start_page`` on and without a result."""
    tasks = capped(tasks, per_file) if per_file is not None else tasks
    tasks = tasks if images is None else tasks.join(images.select(*KEY).distinct(), KEY, "left_semi")
    return pending(tasks, done, start_page)


def run(tasks: DataFrame, path: str, call: Callable[[str], str], images: DataFrame | None = None, per_file: int | None = None, start_page: int = 0, max_pages: int | None = None, redo: bool = False, wave: int = 10_000, tasks_at_once: int | None = None, delay: float = 0.0, **options) -> DataFrame:
    """Enrich what is pending, and return all results of the folder ``path``, with the time of their wave as ``done_at``.

    Tasks (filename, page, path) are capped by file first; then those without an
    image among ``images``, before ``start_page`` or with a result go (``redo``
    keeps the last). They run in waves of ``wave``, in order; each is added to
    the folder, so a job that is stopped goes on where it was. What is pending is
    numbered and written once; a wave reads its own numbers. Its calls are spread
    over ``tasks_at_once`` tasks (as many as there are cores unless given), each
    of which waits ``delay`` seconds between calls: together they set the rate that a service sees. No wave begins
    once ``max_pages`` pages have succeeded; failed ones don't count, and later
    runs don't try them again.
    """
    spark = tasks.sparkSession
    form = RESULT + ", done_at timestamp"
    began = spark.sql("SELECT current_timestamp()").first()[0]
    mine = F.col("done_at") >= F.lit(began)
    done = earlier_parquet(spark, path, form)
    left, total = numbered(plan(tasks, done.where(mine) if redo else done, images, per_file, start_page).select(*KEY, "path"), f"{path}-pending")
    spread = tasks_at_once or spark.sparkContext.defaultParallelism
    good = at = 0
    while at < total and (max_pages is None or good < max_pages):
        size = wave if max_pages is None else min(wave, max_pages - good)
        part = left(at, size).repartition(spread, *KEY)
        added(extract(part, call, delay=delay, **options).withColumn("done_at", F.current_timestamp()), path)
        at += size
        if max_pages is not None:
            good = earlier_parquet(spark, path, form).where(mine & F.col("error").isNull()).count()
    return earlier_parquet(spark, path, form)


def numbered(rows: DataFrame, path: str) -> tuple[Callable[[int, int], DataFrame], int]:
    """``rows`` in the order of their keys, written to ``path``: a function that gives rows first .. first + n - 1, and how many there are.

    Rows are sorted by range; numbers follow from the sizes of the ranges, so no
    task sees them all, and reading some numbers reads the files of their ranges alone.
    """
    spark = rows.sparkSession
    marks = [F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")]
    rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).select("*", *marks).write.mode("overwrite").parquet(path)
    table = spark.read.schema(rows.select("*", *marks).schema).parquet(path)
    sizes = {r["_part"]: r["n"] for r in table.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    begin, total = {}, 0
    for p in sorted(sizes):
        begin[p], total = total, total + sizes[p]

    def part(first: int, n: int) -> DataFrame:
        inside = {p: a for p, a in begin.items() if a < first + n and first < a + sizes[p]}
        number = F.element_at(F.create_map(*(F.lit(x) for kv in inside.items() for x in kv)), F.col("_part")) + F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
        chosen = table.where(F.col("_part").isin(list(inside)))
        return chosen.where((number >= first) & (number < first + n)).drop("_part", "_at")

    return part, total


def merge_charts(pages: DataFrame, results: DataFrame, order: str) -> DataFrame:
    """Pages with ``chart_descriptions``: the five keys of their last result by ``order``; without one, empty values."""
    five = F.struct(*(F.coalesce(F.col(k), v).alias(k) for k, v in _nothing().items()))
    last = results.groupBy(*KEY).agg(F.max_by(five, order).alias("chart_descriptions"))
    nothing = F.struct(*(v.alias(k) for k, v in _nothing().items()))
    return pages.join(last, KEY, "left").withColumn("chart_descriptions", F.coalesce("chart_descriptions", nothing))


def read_typed(raw: Column) -> Column:
    """struct of the five keys from a reply, charts and tables as arrays of VARIANT; absent keys and values of other types get empty values; null where no JSON can be read."""
    said, none = read_variant(raw), F.array().cast("array<variant>")
    kinds = {"page_summary": ("string", F.lit("")), "has_charts": ("boolean", F.lit(False)), "has_tables": ("boolean", F.lit(False)), "charts": ("array<variant>", none), "tables": ("array<variant>", none)}
    return F.when(said.isNotNull(), F.struct(*(F.coalesce(F.try_variant_get(said, f"$.{k}", kind), empty).alias(k) for k, (kind, empty) in kinds.items())))


def merge_typed(pages: DataFrame, replies: DataFrame, order: str, reply: str = "reply") -> DataFrame:
    """Pages with ``chart_descriptions`` as ``read_typed`` reads their last reply by ``order``; empty values without one, or where it is no JSON.

    Paths reach into its charts and tables without parsing again:
    ``try_variant_get(chart_descriptions.charts[0], '$.title', 'string')``.
    """
    last = replies.groupBy(*KEY).agg(F.max_by(reply, order).alias("_reply"))
    empty = read_typed(F.lit("{}"))
    return pages.join(last, KEY, "left").withColumn("chart_descriptions", F.coalesce(read_typed(F.col("_reply")), empty)).drop("_reply")


def merge(pages: DataFrame, results: DataFrame, order: str, value: str = "description") -> DataFrame:
    """Pages with their last result by ``order``, or an empty string."""
    last = results.groupBy(*KEY).agg(F.max_by(value, order).alias(value))
    return pages.join(last, KEY, "left").withColumn(value, F.coalesce(value, F.lit("")))
