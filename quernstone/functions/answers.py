"""Questions and answers as Column builders: classification, citations, checks, post-processing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import Tokenizer, let, numbers, strip, token_set, tokens


def type_scores(question: Column) -> Column:
    """struct of the number of matching patterns by question type."""
    hit = lambda p: F.coalesce(question.rlike("(?U)" + p).cast("long"), F.lit(0))
    return F.struct(*(sum((hit(p) for p in ps), F.lit(0).cast("long")).alias(name) for name, ps in P.QUESTION_PATTERNS.items()))


def classify(question: Column) -> Column:
    """The type with most matching patterns; ties in the order of the types, none: fact extraction, the first."""
    names = F.array(*map(F.lit, P.QUESTION_PATTERNS))
    ordered = lambda s: F.array(*(s[n] for n in P.QUESTION_PATTERNS))
    best = lambda s: F.element_at(names, F.array_position(s, F.array_max(s)).cast("int"))
    return let(let(type_scores(question), ordered), best)


def citations(answer: Column) -> Column:
    """array<struct<filename, page>>: markers in order, blank names skipped, repeats dropped."""
    find = lambda g: F.regexp_extract_all(answer, F.lit("(?U)" + P.CITATION), F.lit(g))
    both = F.zip_with(find(1), find(2), lambda f, p: F.struct(strip(f).alias("filename"), p.cast("long").alias("page")))
    return F.array_distinct(F.filter(both, lambda c: c["filename"] != ""))


def has_citations(answer: Column) -> Column:
    return answer.rlike("(?U)" + P.CITATION_ANY)


def format_citation(filename: Column, page: Column) -> Column:
    return F.concat(F.lit("[来源: "), filename, F.lit(" 第"), page.cast("string"), F.lit("页]"))


def without_citations(answer: Column) -> Column:
    return strip(F.regexp_replace(answer, "(?U)" + P.CITATION_ANY, ""))


def unsupported_numbers(answer: Column, context: Column) -> Column:
    """Numbers of the answer that the context lacks, sorted."""
    return F.array_sort(F.array_except(numbers(answer), numbers(context)))


def normalize_format(x: Column) -> Column:
    """No white space between a number and its unit."""
    for unit in P.UNITS:
        x = F.regexp_replace(x, rf"(?U)(\d+(?:\.\d+)?)\s*{unit}", f"$1{unit}")
    return x


def handle_empty(answer: Column) -> Column:
    bare = strip(F.coalesce(answer, F.lit("")))
    return F.when((bare == "") | bare.isin(P.EMPTY_PHRASES), P.EMPTY_MESSAGE).otherwise(answer)


def control_length(x: Column, low: int = 10, high: int = 500) -> Column:
    """Cut past ``high`` characters: at the last full stop if that keeps more than 80 %, else with dots."""
    upto = lambda h: F.length(F.regexp_extract(h, r"(?s)^(.*[。.])", 1))
    cut = let(F.substring(x, 1, high), lambda h: F.when(upto(h) - 1 > high * 0.8, F.substring(h, F.lit(1), upto(h))).otherwise(F.concat(h, F.lit("..."))))
    return F.when(F.length(x) < low, x).when(F.length(x) > high, cut).otherwise(x)


def postprocess(answer: Column, context: Column, low: int = 10, high: int = 500) -> Column:
    """struct(answer, unsupported_numbers, was_truncated, was_empty)."""
    settled = handle_empty(answer)
    empty = ~settled.eqNullSafe(answer)
    tidy = lambda x: F.struct(x.alias("tidy"), control_length(x, low, high).alias("cut"))
    parts = F.struct(settled.alias("settled"), empty.alias("empty"), let(normalize_format(answer), tidy).alias("t"), unsupported_numbers(answer, context).alias("lost"))
    return let(
        parts,
        lambda s: F.struct(
            F.when(s["empty"], s["settled"]).otherwise(s["t"]["cut"]).alias("answer"),
            F.when(s["empty"], F.array().cast("array<string>")).otherwise(s["lost"]).alias("unsupported_numbers"),
            (~s["empty"] & (F.length(s["t"]["cut"]) < F.length(s["t"]["tidy"]))).alias("was_truncated"),
            s["empty"].alias("was_empty"),
        ),
    )


def _facts(answer: Column, context: Column, tokenize: Tokenizer) -> Column:
    """What checks compare: texts, numbers and words of both, and the sizes of what they share."""
    answer, context = F.coalesce(answer, F.lit("")), F.coalesce(context, F.lit(""))
    found = lambda x: F.array_distinct(numbers(x, P.NUMBER_PLAIN))
    raw = F.struct(
        answer.alias("a"), context.alias("c"), found(answer).alias("an"), found(context).alias("cn"),
        token_set(answer, P.STOP_WORDS, tokenize).alias("aw"), token_set(context, P.STOP_WORDS, tokenize).alias("cw"),
    )
    size = lambda s: F.struct(
        s["a"].alias("a"), s["c"].alias("c"), F.array_sort(s["an"]).alias("an"), F.array_sort(s["cn"]).alias("cn"), F.size(s["an"]).alias("n"), F.size(F.array_intersect(s["an"], s["cn"])).alias("hit"),
        F.size(s["aw"]).alias("w"), F.size(s["cw"]).alias("cw"), F.size(F.array_intersect(s["aw"], s["cw"])).alias("shared"),
    )
    return let(raw, size)


def _verdict(s: Column) -> Column:
    hits, overlap = s["hit"] / F.nullif(s["n"], F.lit(0)), s["shared"] / F.nullif(s["w"], F.lit(0))
    comparable = (s["w"] > 0) & (s["cw"] > 0)
    return (
        F.when((s["a"] == "") | (s["c"] == "") | s["a"].rlike(P.NO_INFORMATION), "Neutral")
        .when((s["n"] > 0) & (hits >= 0.8), "Support")
        .when((s["n"] >= 3) & ((s["n"] - s["hit"]) / F.nullif(s["n"], F.lit(0)) >= 0.75), "Contradict")
        .when(comparable & (overlap >= 0.5), "Support")
        .when(comparable & (overlap <= 0.15), "Contradict")
        .otherwise("Neutral")
    )


def check_support(answer: Column, context: Column, tokenize: Tokenizer = tokens) -> Column:
    """Support, Contradict or Neutral: numbers first, then shared words."""
    return let(_facts(answer, context, tokenize), _verdict)


def feedback(verdict: Column) -> Column:
    """struct(action, reason, suggestion) for a verdict."""
    pick = lambda i: F.when(verdict == "Contradict", P.FEEDBACK["Contradict"][i]).when(verdict == "Support", P.FEEDBACK["Support"][i]).otherwise(P.FEEDBACK["Neutral"][i])
    return F.struct(*(pick(i).alias(n) for i, n in enumerate(("action", "reason", "suggestion"))))


def self_check(answer: Column, context: Column, tokenize: Tokenizer = tokens) -> Column:
    """struct(verdict, feedback, num_support_ratio, keyword_overlap_ratio, answer_numbers, context_numbers)."""
    share = lambda part, whole, none: F.round(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(none)), 4)
    report = lambda s: F.struct(
        _verdict(s).alias("verdict"), share(s["hit"], s["n"], 1.0).alias("num_support_ratio"), share(s["shared"], s["w"], 0.0).alias("keyword_overlap_ratio"), s["an"].alias("answer_numbers"), s["cn"].alias("context_numbers")
    )
    advised = lambda s: F.struct(s["verdict"].alias("verdict"), feedback(s["verdict"]).alias("feedback"), *(s[n].alias(n) for n in ("num_support_ratio", "keyword_overlap_ratio", "answer_numbers", "context_numbers")))
    return let(let(_facts(answer, context, tokenize), report), advised)


def reply_lines(reply: Column) -> Column:
    """Non-empty stripped lines of a model's reply."""
    return F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), strip), lambda x: x != "")


def rewrites(question: Column, reply: Column) -> Column:
    """The question, then the reply's lines, without repeats."""
    return F.array_distinct(F.concat(F.array(question), reply_lines(reply)))


def sub_questions(question: Column, reply: Column) -> Column:
    """The reply's lines, repeats included; the question if there are none."""
    lines = reply_lines(reply)
    return F.when(F.size(lines) == 0, F.array(question)).otherwise(lines)


def json_text(raw: Column) -> Column:
    """The JSON object in a model's reply: fences dropped; else from the first { to the last }; else null."""
    bare = strip(raw)
    bare = F.regexp_replace(bare, r"^```[^\n]*\n", "")
    bare = F.regexp_replace(bare, r"\n```\s*$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)

    def good(x: Column) -> Column:
        """``x`` if it is one object and nothing behind it: a parser alone would stop at the object's end."""
        alone = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
        return F.when(x.rlike(r"(?s)^\s*\{.*\}\s*$") & alone.isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull(), x)

    return F.coalesce(good(bare), good(inner))


def json_reply(raw: Column, schema: str) -> Column:
    """A struct parsed from a model's reply, see ``json_text``."""
    return F.from_json(json_text(raw), schema)
