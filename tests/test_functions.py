"""Literal cases that pin the exact semantics of text and answer functions."""

import pytest
from pyspark.sql import functions as F

from quernstone.functions import answers as A
from quernstone.functions import patterns as P
from quernstone.functions import text as T


@pytest.fixture(scope="module")
def value(spark):
    def run(build, *texts):
        df = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
        got = df.select(build(*(F.col(f"c{i}") for i in range(len(texts)))).alias("v")).first()["v"]
        return got

    return run


@pytest.mark.parametrize(("text", "want"), [("2023", ["202", "3"]), ("1,234.5", ["1,234.5"]), ("-5%", ["-5%"]), ("12345.6%", ["123", "45.6%"]), ("none", []), ("", [])])
def test_signed_numbers(value, text, want):
    assert value(T.numbers, text) == want


def test_plain_numbers(value):
    assert value(lambda x: T.numbers(x, P.NUMBER_PLAIN), "2023 and 1,234 at -5%") == ["2023", "1", "234", "5%"]


def test_strip_takes_wide_spaces(value):
    assert value(T.strip, "　 a b \n　") == "a b"


def test_bigrams(value):
    assert value(T.tokens, "营收增长Abc-12 好") == ["营收", "收增", "增长", "abc", "12", "好"]
    assert value(T.plain_tokens, "营收增长Abc-12 好") == ["营收增长abc", "12", "好"]
    assert (value(T.tokens, ""), value(T.tokens, "A b a"), value(T.tokens, "2024年")) == ([], ["a", "b", "a"], ["2024", "年"])


def test_normalize_keeps_inner_space(value):
    assert value(T.normalize, " A, b。C “x” ") == "a bc “x”"


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 1.0), ("", "x", 0.0), ("abc", "abc", 1.0), ("aab", "abb", 2 / 3)])
def test_char_f1(value, a, b, want):
    assert value(T.char_f1, a, b)["f1"] == pytest.approx(want)


@pytest.mark.parametrize(("a", "b", "want"), [("abcde", "ace", 3), ("", "x", 0), ("x" * 300, "x" * 299, 299), ("ab", "ba", 1)])
def test_lcs(value, a, b, want):
    assert value(T.lcs_length, a, b) == want


def test_rouge_is_symmetric(value):
    assert value(T.rouge_l, "the cat sat", "cat sat down")["f1"] == pytest.approx(value(T.rouge_l, "cat sat down", "the cat sat")["f1"])


def test_number_f1(value):
    assert value(T.number_f1, "a", "b") == 1.0
    assert value(T.number_f1, "50", "50.0") == 0.0
    assert value(T.number_f1, "1 2 2", "2") == pytest.approx(2 / 3)


@pytest.mark.parametrize(("question", "want"), [("营收是多少", "fact_extraction"), ("请分析原因", "analysis_summary"), ("根据图3", "chart_understanding"), ("与同业相比", "comparison"), ("hello", "fact_extraction"), ("分析 对比", "analysis_summary")])
def test_classify(value, question, want):
    assert value(A.classify, question) == want


def test_citations(value):
    got = value(A.citations, "x [来源: a-b c 第5页] [来源: a-b c 第5页] [来源:e 第12页] [来源: d 第x页]")
    assert [tuple(c) for c in got] == [("a-b c", 5), ("e", 12)]
    assert value(A.has_citations, "[来源:  第5页]") is True
    assert value(A.without_citations, " a [来源: b 第1页] ") == "a"


@pytest.mark.parametrize(("n", "dot", "want"), [(500, None, 500), (501, None, 503), (600, 450, 451), (600, 400, 503), (600, 401, 402), (5, None, 5)])
def test_control_length(value, n, dot, want):
    text = list("x" * n)
    if dot is not None:
        text[dot] = "。"
    assert len(value(A.control_length, "".join(text))) == want


def test_postprocess(value):
    got = value(A.postprocess, "约 50 % 与 3 亿元", "50")
    assert (got["answer"], got["was_empty"], got["was_truncated"], got["unsupported_numbers"]) == ("约 50% 与 3亿元", False, False, ["3"])
    assert value(A.postprocess, " 不知道 ", "x")["answer"] == P.EMPTY_MESSAGE
    assert value(A.postprocess, None, "x")["was_empty"] is True
    assert value(A.postprocess, "y" * 502, "x")["was_truncated"] is False


@pytest.mark.parametrize(
    ("answer", "context", "want"),
    [("", "x", "Neutral"), ("无法确定 5", "5", "Neutral"), ("5 and 6", "5 6", "Support"), ("1 2 3", "9", "Contradict"), ("alpha beta", "alpha beta gamma", "Support"), ("a b c d e f g", "z", "Contradict"), ("a b c d", "a", "Neutral"), (None, "x", "Neutral")],
)
def test_check_support(value, answer, context, want):
    assert value(A.check_support, answer, context) == want


def test_self_check_ratios(value):
    got = value(A.self_check, "a 1 2", "a 1")
    assert (got["num_support_ratio"], got["verdict"], got["feedback"]["action"]) == (0.5, "Support", "keep")
    assert value(A.self_check, "，", "x")["num_support_ratio"] == 1.0


def test_replies(value):
    assert value(A.rewrites, "q", " a \n\nb\na\nq") == ["q", "a", "b"]
    assert value(A.sub_questions, "q", " \n") == ["q"]
    assert value(A.sub_questions, "q", "a\na") == ["a", "a"]


@pytest.mark.parametrize(("raw", "want"), [('{"k": 1}', 1), ('```json\n{"k": 2}\n```', 2), ('so {"k": 3} ok', 3), ("none", None)])
def test_json_reply(value, raw, want):
    got = value(lambda x: A.json_reply(x, "k bigint")["k"], raw)
    assert got == want
