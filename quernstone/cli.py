"""Command line: python -m quernstone.cli <command> ...

Commands: parse, index, search, generate, answer, evaluate, enrich. Models are
named by module:object, an instance or a class that takes no arguments; without
one the offline stand-ins serve.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plugins
from .operators import enrich, evaluate, generate
from .plans import pipeline
from .session import session, ship
from .sources import readers, writers
from .sources.readers import Settings


def plugin(name: str | None, default):
    """The object called module:object; a class is made into an instance."""
    if not name:
        return default
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found() if isinstance(found, type) else found


def numbered(questions: DataFrame) -> DataFrame:
    """Questions with a number each, in the order they are read."""
    return questions.where(F.col("question").isNotNull()).withColumn("query_id", F.monotonically_increasing_id()).select("query_id", "question")


def _settings(spark: SparkSession, args: argparse.Namespace) -> Settings:
    return Settings.load(spark, **{f.name: getattr(args, f.name, None) for f in fields(Settings)})


def _options(args: argparse.Namespace) -> dict:
    return {"encoder": plugin(args.encoder, None), "scorer": plugin(args.scorer, None), "multi": args.multi, "staged": args.staged}


def do_parse(spark: SparkSession, args: argparse.Namespace) -> None:
    """PDFs, or a folder of Markdown files per PDF, to pages; also the index of what was parsed."""
    parsed = None
    if args.pdfs:
        parsed = readers.parsed_pdfs(spark, args.pdfs, readers.choose_parser(plugin(args.parser, None), args.command_name or ""))
        readers.parse_index(parsed).coalesce(1).write.mode("overwrite").json(f"{args.output}/parse_index")
    if args.markdown:
        pages = readers.page_index(readers.markdown_files(spark, args.markdown), parsed)
    else:
        pages = readers.page_index(spark.createDataFrame([], "pdf string, path string, text string"), parsed)
    pages.write.mode("overwrite").json(f"{args.output}/pages")


def do_index(spark: SparkSession, args: argparse.Namespace) -> None:
    pages = readers.pages(spark, args.pages)
    pipeline.build_indexes(pages, plugin(args.encoder, None), args.semantic, _settings(spark, args)).save(args.index, args.cells, args.blocks)


def do_search(spark: SparkSession, args: argparse.Namespace) -> None:
    asked = spark.createDataFrame([(0, args.query)], "query_id long, question string")
    hits = pipeline.search(pipeline.Indexes.load(spark, args.index), asked, settings=_settings(spark, args), **_options(args))
    hits.orderBy("rank").select("rank", "id", "score", "filename", "page", "content").show(args.final_top_k or Settings().final_top_k, truncate=200)


def do_generate(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = spark.createDataFrame([(args.question, args.context)], "question string, context string")
    settings = _settings(spark, args)
    made = generate.generate(rows, plugin(args.model, plugins.EchoModel()), temperature=settings.temperature, max_tokens=settings.max_new_tokens)
    made.select("answer", "question_type", "citations").show(truncate=False)


def do_answer(spark: SparkSession, args: argparse.Namespace) -> None:
    asked = numbered(readers.questions(spark, args.questions))
    images = readers.images(spark, args.images) if args.images else None
    rows = pipeline.answer(pipeline.Indexes.load(spark, args.index), asked, plugin(args.model, plugins.EchoModel()), images, _settings(spark, args), **_options(args))
    writers.submission(rows.drop("query_id"), args.output)


def do_evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    scores = evaluate.answer_scores(readers.answers(spark, args.pred).withColumnRenamed("ord", "id"), readers.answers(spark, args.gold))
    report = evaluate.evaluate(scores)
    writers.report(report, args.output)
    report.show(truncate=False)


def do_enrich(spark: SparkSession, args: argparse.Namespace) -> None:
    images = readers.images(spark, args.images)
    tasks = images.withColumnRenamed("image_path", "path")
    results = enrich.run(tasks, args.output, plugin(args.model, None), None, args.per_file, args.start_page, args.max_pages, args.redo, tasks_at_once=args.tasks_at_once, delay=args.delay or 0.0)
    enrich.progress(tasks, results.select("filename", "page").distinct()).orderBy("filename").show(1000, truncate=False)
    if args.pages:
        enrich.merge_charts(readers.pages(spark, args.pages), results, "done_at").write.mode("overwrite").json(args.merged)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quernstone")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *needed: str, **rest) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=run.__doc__)
        made.set_defaults(run=run)
        for n in needed:
            made.add_argument(f"--{n}", required=True)
        for n, kind in rest.items():
            made.add_argument(f"--{n}", **({"action": "store_true"} if kind is bool else {"type": kind}))
        return made

    models = {"encoder": str, "scorer": str, "multi": bool, "staged": bool}
    cuts = {f.name: type(f.default) for f in fields(Settings)}
    command("parse", do_parse, "output", pdfs=str, markdown=str, parser=str, command_name=str)
    command("index", do_index, "pages", "index", encoder=str, semantic=bool, cells=bool, blocks=bool, **cuts)
    command("search", do_search, "index", "query", **models, **cuts)
    command("generate", do_generate, "question", "context", model=str, **cuts)
    command("answer", do_answer, "questions", "index", "output", model=str, images=str, **models, **cuts)
    command("evaluate", do_evaluate, "pred", "gold", "output")
    enriched = command("enrich", do_enrich, "images", "output", "model", per_file=int, max_pages=int, redo=bool, pages=str, merged=str, tasks_at_once=int, delay=float)
    enriched.add_argument("--start_page", type=int, default=1)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or session()
    ship(spark)
    args.run(spark, args)


if __name__ == "__main__":
    main()
