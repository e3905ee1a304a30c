"""Prompts, model calls and query rewriting; models are plug-ins (see plugins)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import answers as A
from ..plugins import LanguageModel, ModelError, with_retries

#: Our own wording, by question type; {question} and {context} are filled in.
TEMPLATES = {
    "fact_extraction": "根据下列材料，准确给出问题所问的数值或事实。\n材料：\n{context}\n\n问题：{question}",
    "analysis_summary": "阅读下列材料，归纳要点并说明依据。\n材料：\n{context}\n\n问题：{question}",
    "chart_understanding": "结合下列材料中的图表信息作答。\n材料：\n{context}\n\n问题：{question}",
    "comparison": "依据下列材料，逐项比较后给出结论。\n材料：\n{context}\n\n问题：{question}",
}
CITATION_NOTE = "\n请在末尾注明出处，格式为：[来源: 文件名 第X页]；有多处出处时全部列出。\n"
REWRITE = "请把下面的问题改写成{n}种不同说法，每行一种：\n{question}"
DECOMPOSE = "请把下面的问题拆成若干子问题，每行一个：\n{question}"
HYPOTHETICAL = "请写一段可能出现在报告中、能够回答下面问题的文字：\n{question}"


def template(question_type: Column) -> Column:
    """The template of a type; an unknown type gets that of fact extraction."""
    pick = F.lit(TEMPLATES["fact_extraction"])
    for name, text in TEMPLATES.items():
        pick = F.when(question_type == name, F.lit(text)).otherwise(pick)
    return pick


def prompt(question: Column, context: Column, question_type: Column) -> Column:
    """The template with the citation note, then the context and the question put in."""
    head = F.split(F.concat(template(question_type), F.lit("\n" + CITATION_NOTE)), r"\{context\}")
    tail = F.split(F.get(head, F.lit(1)), r"\{question\}")
    return F.concat(F.get(head, F.lit(0)), F.coalesce(context, F.lit("")), F.get(tail, F.lit(0)), F.coalesce(question, F.lit("")), F.get(tail, F.lit(1)))


def ask(rows: DataFrame, prompts: str, reply: str, model: LanguageModel, attempts: int = 1, sleep: Callable[[float], None] = time.sleep, errors: str | None = None, temperature: float = 0.0, max_tokens: int = 512) -> DataFrame:
    """Add the model's stripped reply to each row's prompt; None counts as ''.

    A failed call raises ModelError, or goes to the column ``errors`` if one is named.
    """
    schema = StructType(list(rows.schema.fields)).add(reply, "string")
    if errors:
        schema = schema.add(errors, "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies, failed = [], []
            for p in batch[prompts]:
                try:
                    text = with_retries(lambda p=p: model.complete(p, temperature=temperature, max_tokens=max_tokens), attempts, sleep=sleep)
                    replies.append((text or "").strip())
                    failed.append(None)
                except ModelError as e:
                    if not errors:
                        raise
                    replies.append(None)
                    failed.append(str(e))
            batch[reply] = replies
            if errors:
                batch[errors] = failed
            yield batch

    return rows.mapInPandas(run, schema)


def generate(questions: DataFrame, model: LanguageModel, errors: str | None = None, temperature: float = 0.0, max_tokens: int = 512) -> DataFrame:
    """Rows (question, context[, question_type]) with question_type, prompt, answer and citations.

    A type that is given must be one of the four.
    """
    if "question_type" in questions.columns:
        bad = ~F.col("question_type").isin(*TEMPLATES)
        questions = questions.withColumn("question_type", F.when(bad, F.raise_error(F.concat(F.lit("unknown question type "), "question_type"))).otherwise(F.coalesce("question_type", A.classify(F.col("question")))))
    else:
        questions = questions.withColumn("question_type", A.classify(F.col("question")))
    asked = questions.withColumn("prompt", prompt(F.col("question"), F.col("context"), F.col("question_type")))
    return ask(asked, "prompt", "answer", model, errors=errors, temperature=temperature, max_tokens=max_tokens).withColumn("citations", A.citations(F.col("answer")))


class Rewriter:
    """Query rewriting by a model; without one, every query stays as it is."""

    def __init__(self, model: LanguageModel | None = None, temperature: float = 0.3, max_tokens: int = 512):
        self.model, self.temperature, self.max_tokens = model, temperature, max_tokens

    def _asked(self, queries: DataFrame, text: str) -> DataFrame:
        return ask(queries.withColumn("_prompt", F.replace(F.lit(text), F.lit("{question}"), F.col("question"))), "_prompt", "_reply", self.model, temperature=self.temperature, max_tokens=self.max_tokens)

    def rewrite(self, queries: DataFrame, n: int = 3) -> DataFrame:
        """Adds variants: the question and the model's lines, without repeats; n is a wish in the prompt."""
        if self.model is None:
            return queries.withColumn("variants", F.array("question"))
        return self._asked(queries, REWRITE.replace("{n}", str(n))).withColumn("variants", A.rewrites(F.col("question"), F.col("_reply"))).drop("_prompt", "_reply")

    def decompose(self, queries: DataFrame) -> DataFrame:
        if self.model is None:
            return queries.withColumn("parts", F.array("question"))
        return self._asked(queries, DECOMPOSE).withColumn("parts", A.sub_questions(F.col("question"), F.col("_reply"))).drop("_prompt", "_reply")

    def hypothetical(self, queries: DataFrame) -> DataFrame:
        if self.model is None:
            return queries.withColumn("passage", F.col("question"))
        return self._asked(queries, HYPOTHETICAL).withColumnRenamed("_reply", "passage").drop("_prompt")
