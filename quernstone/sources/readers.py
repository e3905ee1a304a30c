"""Reading questions, pages, results, images and indexes."""

from __future__ import annotations

import importlib.util
import os
import shutil
import subprocess
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.enrich import tasks_from_images
from ..operators.parse import extract_tables, split_pages
from . import pdf
from .tables import exists

PAGE = "filename string, page int, text string, tables array<string>"
QUESTION = "filename string, page int, question string, answer string"


@dataclass(frozen=True)
class Settings:
    """Defaults of retrieval and generation."""

    dense_top_k: int = 10
    bm25_top_k: int = 10
    channel_top_k: int = 5
    final_top_k: int = 3
    coarse_k: int = 50
    fine_k: int = 20
    mmr_weight: float = 0.7
    rrf_k: int = 60
    chunk_size: int = 500
    overlap: int = 100
    max_new_tokens: int = 512
    temperature: float = 0.0

    @classmethod
    def load(cls, spark: SparkSession | None = None, environ: Mapping[str, str] = os.environ, **given) -> Settings:
        """Each value as given; else from the session's quernstone.<name>; else from QUERNSTONE_<NAME>; else the default."""
        found = {}
        for f in fields(cls):
            raw = given.get(f.name)
            if raw is None and spark is not None:
                raw = spark.conf.get(f"quernstone.{f.name}", None)
            if raw is None:
                raw = environ.get(f"QUERNSTONE_{f.name.upper()}")
            if raw is not None:
                found[f.name] = type(f.default)(raw)
        return cls(**found)


ANSWER = """question string, filename string, page long, answer string, question_type string,
  citations array<struct<filename: string, page: long>>, has_citations boolean,
  self_check struct<verdict: string, num_support_ratio: double, keyword_overlap_ratio: double, feedback: struct<action: string, reason: string, suggestion: string>>"""


def answers(spark: SparkSession, path: str) -> DataFrame:
    """A submission or gold answers: a JSON array or JSON lines; keys that are absent are null. ``ord`` is the row's place."""
    rows = spark.read.schema(ANSWER).json(path, multiLine=_is_array(spark, path))
    return rows.withColumn("ord", F.monotonically_increasing_id())


def _is_array(spark: SparkSession, path: str) -> bool:
    """Whether JSON is more than a line an object: an array, or an object over several lines."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    return bool(first) and (first["value"].lstrip().startswith("[") or not first["value"].rstrip().endswith("}"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(filename, page, question, answer) from a JSON list, JSON lines, an object with a list ``questions``, or one object."""
    raw = spark.read.json(path, multiLine=_is_array(spark, path))
    if "questions" in raw.columns:
        raw = raw.select(F.explode("questions").alias("q")).select("q.*")
    return raw.select(*((F.col(c) if c in raw.columns else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in QUESTION.split(", "))))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from a JSON array or JSON lines; a missing path is an error."""
    return spark.read.schema(PAGE).json(path, multiLine=_is_array(spark, path))


def earlier_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results of a former run; no path or broken files give no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED").dropna("all")


def images(spark: SparkSession, folder: str, suffix: str = ".png") -> DataFrame:
    """(filename, page, image_path) of page images; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    return tasks_from_images(files).withColumnRenamed("path", "image_path")


def parser_available(command: str, modules: tuple[str, ...] = ()) -> bool:
    """Whether a PDF parser can be used: its modules import, its command is there, and ``--version`` ends well in 30 seconds."""
    try:
        if any(importlib.util.find_spec(m) is None for m in modules):
            return False
    except ImportError:  # a parent package that fails to import
        return False
    if shutil.which(command) is None:
        return False
    try:
        return subprocess.run([command, "--version"], capture_output=True, timeout=30, check=False).returncode == 0
    except (OSError, subprocess.SubprocessError):
        return False


PdfParser = Callable[[bytes], list[str]]


def choose_parser(parse: PdfParser | None = None, command: str = "", modules: tuple[str, ...] = ()) -> PdfParser:
    """``parse`` if its command and modules are available; else plain text extraction."""
    return parse if parse is not None and (not command or parser_available(command, modules)) else plain_pages


def _each_pdf(batches: Iterator[pd.DataFrame], one: Callable[[str, bytes], pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """``one`` for each file; a file that fails becomes a row of nulls with its error."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            stem = path.rsplit("/", 1)[-1].removesuffix(".pdf")
            try:
                yield one(stem, content)
            except Exception as e:
                yield pd.DataFrame([{**dict.fromkeys(columns), columns[0]: stem, "error": str(e)}])


def parsed_pdfs(spark: SparkSession, folder: str, parse: PdfParser | None = None) -> DataFrame:
    """(filename, page, text, error): each PDF's pages by a parser; a file that fails is a row with its error.

    Without a parser the data source of ``pdf`` reads them: large files by
    several tasks, and of a file with a page that cannot be decoded all others.
    Stores that only Spark opens are read whole, a file a task.
    """
    if parse is None or parse is plain_pages:
        if "://" not in folder or folder.startswith("file:"):
            pdf.register(spark)
            return spark.read.format("pdf_pages").load(folder).select("filename", F.col("page").cast("long").alias("page"), "text", "error")

        def plain(stem: str, content: bytes) -> pd.DataFrame:
            return pd.DataFrame(list(pdf.read_pages(content)), columns=["page", "text", "error"]).assign(filename=stem)

        return _pdfs(spark, folder).mapInPandas(lambda b: _each_pdf(b, plain, ["filename", "page", "text"]), "filename string, page long, text string, error string")

    def one(stem: str, content: bytes) -> pd.DataFrame:
        found = parse(content)
        return pd.DataFrame({"filename": stem, "page": range(1, len(found) + 1), "text": found, "error": None})

    return _pdfs(spark, folder).mapInPandas(lambda b: _each_pdf(b, one, ["filename", "page", "text"]), "filename string, page long, text string, error string")


def _pdfs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")


def parse_index(parsed: DataFrame) -> DataFrame:
    """(filename, pages, error): what parsing gave for each file."""
    return parsed.groupBy("filename").agg(F.count("page").alias("pages"), F.max("error").alias("error"))


def rendered_pdfs(spark: SparkSession, folder: str, render: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(filename, page, name, content, error): PNG pages of each PDF, named stem_page_n.png, by a renderer plug-in; a file that fails is a row with its error."""

    def one(stem: str, content: bytes) -> pd.DataFrame:
        shots = render(content)
        pages_ = range(1, len(shots) + 1)
        return pd.DataFrame({"filename": stem, "page": pages_, "name": [f"{stem}_page_{i}.png" for i in pages_], "content": shots, "error": None})

    return _pdfs(spark, folder).mapInPandas(lambda b: _each_pdf(b, one, ["filename", "page", "name", "content"]), "filename string, page long, name string, content binary, error string")


def plain_pages(content: bytes) -> list[str]:
    """Text of each page by the reader of ``pdf``; a page that cannot be decoded is an error."""
    found = list(pdf.read_pages(content))
    if wrong := [f"page {page}: {error}" for page, _, error in found if error]:
        raise ValueError("; ".join(wrong))
    return [text or "" for _, text, _ in found]


def page_index(files: DataFrame, pdfs: DataFrame | None = None) -> DataFrame:
    """(filename, page, text, tables) from Markdown files (pdf, path, text).

    Several files of one PDF are a page each, numbered by their names (else 1);
    a single file is cut at its page marks. If there are no files at all, the
    pages of ``pdfs`` (filename, page, text, error) stand in as they are, without tables.
    """
    if pdfs is not None and files.isEmpty():
        return pdfs.where("error is null").select("filename", "page", "text", F.array().cast("array<string>").alias("tables"))
    n = F.count("*").over(Window.partitionBy("pdf"))
    counted = files.withColumn("_n", n)
    number = F.regexp_extract("path", r"_page_(\d+)\.md$", 1).try_cast("long")
    many = counted.where("_n > 1").select(F.col("pdf").alias("filename"), F.coalesce(number, F.lit(1)).cast("long").alias("page"), strip(F.col("text")).alias("text"), extract_tables(F.col("text")).alias("tables"))
    one = split_pages(counted.where("_n = 1").select(F.col("pdf").alias("filename"), "text"))
    return many.unionByName(one)


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """(pdf, path, text): Markdown files in a folder per PDF."""
    text = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select("_metadata.file_path", F.col("value").alias("text"))
    return text.select(F.element_at(F.split("file_path", "/"), -2).alias("pdf"), F.col("file_path").alias("path"), "text")
