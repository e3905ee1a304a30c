"""Fixed values that results depend on: patterns, word lists and phrases, as plain text."""

# Question patterns by type; a type scores one for each pattern that matches.
QUESTION_PATTERNS = {
    "fact_extraction": [
        "是多少", "多少", "几个", "几年", "何时", "什么时候", "哪年", "哪一年", "多少钱", "营收", "利润", "收入", "增长率", "同比增长",
        "同比下降", "占比", "比例", "达到", "规模", "金额", "数值", "数据", "什么.*业务", "哪些", "哪家", "哪个", "主要.*产品", "核心.*业务",
    ],
    "analysis_summary": [
        "分析", "评估", "总结", "概括", "简述", "概述", "说明", "描述", "介绍", "阐述", "解释", "原因", "因素", "影响", "驱动", "逻辑",
        "优势", "劣势", "风险", "机遇", "挑战", "战略", "布局", "发展.*方向", "趋势", "如何.*看待", "怎么.*看", "观点", "前景", "展望", "未来",
    ],
    "chart_understanding": [
        "图表", r"图\d+", r"表\d+", "如图", "见表", "图中", "表中", "数据图", "折线图", "柱状图", "饼图", "趋势图", "根据图", "从图", "上图", "下图",
    ],
    "comparison": [
        "对比", "比较", "相比", "相对于", "不同于", "区别于", "差异", "异同", "孰优", "哪个.*更", "高于", "低于", "优于", "不如",
        "与.*相比", "和.*比", "同.*比较", "行业.*对比", "同业.*比较", "竞争.*对比",
    ],
}
DEFAULT_TYPE = "fact_extraction"

# Numbers in answers and gold texts (signed, thousands), and in self-checks (plain).
NUMBER_SIGNED = r"-?\d{1,3}(?:,\d{3})*(?:\.\d+)?%?|-?\d+(?:\.\d+)?%?"
NUMBER_PLAIN = r"\d+(?:\.\d+)?%?"
UNITS = ["%", "亿", "万", "元"]

# Citation markers.
CITATION = r"\[来源:\s*(.+?)\s*第(\d+)页\]"
CITATION_ANY = r"\[来源:\s*.+?\s*第\d+页\]"

# Phrases of answers without content, and what replaces them.
EMPTY_PHRASES = ["无法回答", "不知道", "未提及", "没有相关信息"]
EMPTY_MESSAGE = "根据提供的信息无法回答。"
NO_INFORMATION = "无法回答|未找到|没有相关|信息不足|无法确定"

# Words that self-checks leave out.
STOP_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一",
    "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着",
    "没有", "看", "好", "自己", "这", "那", "他", "她", "它", "们",
    "与", "及", "而", "或", "但", "被", "把", "让", "从", "对", "向",
    "将", "以", "为", "所", "其", "之", "等", "中", "已", "还", "又",
    "可以", "需要", "应该", "能够", "可能", "已经", "以及", "并且",
]

# Lines that are no headings.
BOILERPLATE_PREFIXES = ["免责声明", "分析师声明", "正文目录", "插图目录", "表格目录"]
COMPANY_LINE = r"^[一-鿿·]{2,10}\s*\(\d{4,6}\s*CH\)"
RUNNING_TEXT = r"^(我们认为|我们认[为是]|首先|其次|再次|最后|一方面|另一方面|因此|所以|但是|然而|不过)"
CLAUSE_JOIN = r"[，；][但并因所于而在从被把让使为与和或者]"
DATA_LINE = r"^[一-鿿]{1,6}\s*[\d%]"
MARKDOWN_HEAD = r"^#{1,4}\s+"

# Punctuation that scoring removes (ASCII marks, then full-width ones).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + "，。？！；：（）【】《》、"

# References to figures and tables in passages.
CHART_REFERENCE = r"图\d+|表\d+|如图|见图|图表|上图|下图"

# Markdown tables and page marks.
TABLE_BLOCK = r"(\|[^\n]+\|\n(?:\|[-:| ]+\|\n)?(?:\|[^\n]+\|\n)*)"
PAGE_MARK = r"<!--\s*Page\s+(\d+)\s*-->"

# What a verdict of the self-check suggests.
FEEDBACK = {
    "Contradict": ("expand_retrieval", "生成答案可能包含未被检索上下文支持的幻觉信息", "扩大检索范围（增加 top-k、使用查询改写、尝试多路召回）"),
    "Support": ("keep", "答案内容被检索上下文充分支持", "可直接采纳该答案"),
    "Neutral": ("review", "无法明确判断答案是否充分被上下文支持", "建议人工审核或尝试不同角度重新检索"),
}
