"""Rows that stand in for questions, answers and Markdown documents, built alike by Spark and DuckDB from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import dealt

PRICE = "cast(cast(o_totalprice AS decimal(18, 2)) AS string)"

ANSWERS = f"""
SELECT o_orderkey AS qid,
  CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 13 = 1 THEN ' 无法回答 ' WHEN o_orderkey % 13 = 2 THEN '根据材料无法确定营收'
    ELSE concat('营收', {PRICE}, ' 亿元，占比 ', cast(o_custkey % 100 AS string), ' %，增长', cast(o_custkey AS string), '.5%。status ', o_orderstatus, ' [来源: ', o_orderpriority, ' 第', cast(o_custkey AS string), '页]',
      CASE WHEN o_orderkey % 5 = 0 THEN ' [来源:  第5页]' ELSE '' END,
      CASE WHEN o_orderkey % 3 = 0 THEN concat(' [来源: ', o_orderpriority, ' 第', cast(o_custkey AS string), '页] [来源: a-b 第7页]') ELSE '' END,
      CASE WHEN o_orderkey % 11 = 0 THEN repeat(concat(' 订单金额较大。detail ', cast(o_custkey AS string)), 60) WHEN o_orderkey % 11 = 1 THEN repeat('x', 520) ELSE '' END) END AS answer,
  CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('报告：营收', cast(cast(o_totalprice + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS decimal(18, 2)) AS string), '亿元，增长', cast(o_custkey + o_orderkey % 2 AS string), '.5%，status ', o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN ' detail 占比' ELSE '' END) END AS context
FROM {{orders}}
"""

QUESTIONS = """
SELECT o_orderkey AS qid, concat(CASE o_orderkey % 8
    WHEN 0 THEN '营收是多少' WHEN 1 THEN '请分析风险与前景' WHEN 2 THEN '根据图3，趋势如何' WHEN 3 THEN '与同业相比有何差异' WHEN 4 THEN '请说明主要的产品' WHEN 5 THEN 'hello' WHEN 6 THEN '表12中数据高于行业平均吗' ELSE '哪个业务更优，孰优' END,
  ' ', o_orderpriority, '？') AS question
FROM {orders}
"""

REPLIES = f"""
SELECT qid, question, CASE qid % 4 WHEN 0 THEN '' WHEN 1 THEN concat(question, chr(10), '  变体一 ', chr(10), chr(10), '变体二', chr(10), '变体一') WHEN 2 THEN concat(' ', chr(10), '单行') ELSE concat('甲', chr(10), '乙', chr(10), '甲') END AS reply
FROM ({QUESTIONS.strip()}) q
"""

MARKDOWN = f"""
SELECT concat('doc', cast(o_orderkey AS string)) AS filename, concat(
  '# 订单 ', cast(o_orderkey AS string), ' 概览', chr(10), '客户评级：', o_orderpriority, chr(10),
  '本季度营收为', {PRICE}, '亿元。 The buyer rated this order ', o_orderpriority, '。The buyer rated it again ', o_orderpriority, '！增长；', chr(10),
  CASE WHEN o_orderkey % 3 = 0 THEN concat('| 项目 | 数值 |', chr(10), '|---|---|', chr(10), '| 营收 | ', {PRICE}, ' |', chr(10), '| 客户 | ', cast(o_custkey AS string), ' |', chr(10)) ELSE '' END,
  CASE WHEN o_orderkey % 2 = 0 THEN concat(chr(10), '<!-- Page 2 -->', chr(10), '行业展望与公司战略', chr(10), '盈利预测与估值..........', chr(10), '因此我们维持评级', chr(10),
    '管理层认为需求将在下半年回升，because orders of status ', o_orderstatus, ' keep rising; price ', {PRICE}, '。',
    CASE WHEN o_orderkey % 6 = 0 THEN repeat('Revenue of the segment grew again this year and margins held up well。Costs fell。', 9) ELSE '' END, chr(10), '| 单行 | 表 |', chr(10)) ELSE '' END,
  CASE WHEN o_orderkey % 5 = 0 THEN concat(chr(10), '<!--Page 7-->', chr(10), cast(o_custkey AS string), chr(10), '---', chr(10), '尾注') ELSE '' END) AS text
FROM {{orders}}
"""

PREDICTIONS = """
SELECT c_custkey AS id, concat('客户', cast(c_custkey % 1400 AS string), '的余额是多少？ ') AS question, cast(concat('nation', cast(c_nationkey AS string)) AS string) AS filename, c_mktsegment AS question_type,
  CASE c_custkey % 5 WHEN 0 THEN concat('余额为', cast(cast(c_acctbal AS decimal(18, 2)) AS string), '元，属于', c_mktsegment, '。')
    WHEN 1 THEN concat('余额 ', cast(cast(c_acctbal AS decimal(18, 2)) AS string), ' 元') WHEN 2 THEN concat('About ', cast(cast(c_acctbal + 1 AS decimal(18, 2)) AS string), ', ', c_mktsegment) WHEN 3 THEN '' ELSE concat('The SEGMENT is ', c_mktsegment, '!') END AS answer
FROM {customer}
"""

GOLD = """
SELECT c_custkey AS ord, concat(CASE WHEN c_custkey % 29 = 0 THEN ' ' ELSE concat(' 客户', cast(c_custkey % 1400 AS string), '的余额是多少？') END) AS question,
  CASE WHEN c_custkey % 10 = 3 THEN '' WHEN c_custkey % 10 = 4 THEN concat('the segment is ', c_mktsegment) ELSE concat('余额为', cast(cast(c_acctbal AS decimal(18, 2)) AS string), '元，属于', c_mktsegment, '。') END AS answer
FROM {customer}
"""


TITLE_QUESTIONS = """
SELECT n_nationkey AS query_id, concat('客户评级 ', CASE n_nationkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END, ' 订单 ', cast(n_nationkey * 7 AS string)) AS question
FROM {nation}
"""


def spark_rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the statements above over the tables in ``sf_dir``.

    A row becomes a text of ten times its size, and a row group is read by one
    task, so rows are dealt evenly however the files are cut.
    """
    names = [n for n in ("orders", "customer", "nation") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: dealt(spark.read.parquet(f"{sf_dir}/{n}.parquet")) for n in names})


def duck(sql: str) -> str:
    return "(" + sql.format(orders="orders", customer="customer", nation="nation").strip() + ")"


SEGMENT_QUESTIONS = """
SELECT n_nationkey AS query_id, concat('属于', CASE n_nationkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'AUTOMOBILE' WHEN 2 THEN 'MACHINERY' WHEN 3 THEN 'HOUSEHOLD' ELSE 'FURNITURE' END, '的余额是多少，第', cast(n_nationkey AS string), '家？') AS question
FROM {nation}
"""

TITLE_QUESTIONS_DUCK = duck(TITLE_QUESTIONS)
