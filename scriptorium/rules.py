"""Word lists, thresholds and column names that results depend on.

Everything here is a fixed value: changing one changes what the operators
return.  Each list can be replaced by the caller, so corpora in other languages
bring their own rules.
"""

# --- fixed values: metadata columns ---------------------------------------
METADATA_ALIASES = {
    "题名": "title",
    "标题": "title",
    "作者": "author",
    "关键词": "keywords",
    "摘要": "abstract",
    "DOI": "doi",
    "CN": "cn",
    "作者单位": "affiliation",
    "刊名": "source",
    "来源": "source",
    "ISSN": "issn",
    "页码": "pages",
    "核心类型": "db_class",
    "数据库类别": "db_class",
    "中图分类号": "subject_code",
    "分类号": "subject_code",
    "序号": "serial",
}
METADATA_COLUMNS = (
    "serial", "title", "author", "keywords", "abstract", "doi", "cn",
    "affiliation", "source", "issn", "pages", "db_class", "subject_code",
)
JOURNAL_HEADERS = (
    "序号", "题名", "作者", "关键词", "摘要", "DOI", "CN",
    "作者单位", "刊名", "ISSN", "页码", "核心类型", "中图分类号",
)
THESIS_CLASS = "学位论文"
CORE_MARKERS = ("北大核心", "CSSCI", "CSCD", "EI", "SCI")

# --- fixed values: field weights and BM25 ---------------------------------
FIELDS = ("title", "keywords", "abstract", "research_design", "body")
FIELD_COLUMNS = {
    "title": "title",
    "keywords": "keywords",
    "abstract": "abstract",
    "research_design": "research_design_text",
    "body": "raw_body",
}
FIELD_WEIGHTS = {"title": 8.0, "keywords": 5.0, "abstract": 3.0, "research_design": 4.0, "body": 1.0}
FIELD_MASKS = {
    "all": FIELDS,
    "theme": ("title", "keywords", "abstract"),
    "title_or_keywords": ("title", "keywords"),
    "title": ("title",),
    "keywords": ("keywords",),
    "abstract": ("abstract",),
}
LOOKUP_FIELDS = ("author", "first_author", "affiliation", "doi")
BM25_K1 = 1.5
BM25_B = 0.75
TITLE_MISS_FACTOR = 0.7
RRF_K = 60
VECTOR_FLOOR = 0.60

# --- fixed values: paragraph noise and design section ---------------------
NOISE_EXACT = ("万方数据",)
PAGE_NUMBER_PATTERN = r"^[\s\-—–·.]*[0-9]{1,4}[\s\-—–·.]*$"
FOOTNOTE_MARKERS = (
    "收稿日期", "修回日期", "基金项目", "作者简介", "通信作者", "通讯作者", "第一作者",
    "文章编号", "文献标识码", "中图分类号", "DOI:", "DOI：", "doi:", "doi：",
)
DESIGN_START = ("研究设计", "研究方法", "数据来源", "实验设计", "模型构建")
DESIGN_END = ("模型分析", "实证分析", "结果分析", "实验结果", "数据分析", "讨论与结论")

# --- fixed values: headings -----------------------------------------------
CN_NUMERALS = "零一二三四五六七八九十百两"
CN_DIGITS = {
    "零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5,
    "六": 6, "七": 7, "八": 8, "九": 9, "十": 10,
}
HEADING_MAX_CHARS = 40
HEADING_BAD_END = "。！？!?；;：:，,、"
HEADING_KEYWORDS = (
    "摘要", "引言", "绪论", "前言", "结语", "结论", "总结", "参考文献",
    "致谢", "附录", "文献综述", "相关工作", "研究方法", "研究设计",
    "讨论与结论", "结论与展望", "总结与展望", "研究展望",
)
HEADING_KEYWORD_SLACK = 8
TOC_RUN = 3
FRONT_MATTER = "前置内容"

# --- fixed values: section roles, first matching rule wins -----------------
ROLE_OTHER = "其他"
ROLE_CONCEPT = "概念解释"
ROLE_BACKGROUND = "背景说明"
ROLE_METHOD = "方法依据"
ROLE_EVIDENCE = "经验证据"
ROLE_GAP = "研究空白"
ANSWER_ROLES = (ROLE_CONCEPT, ROLE_BACKGROUND, ROLE_METHOD, ROLE_EVIDENCE, ROLE_GAP)
ROLE_RULES = (
    (ROLE_OTHER, ("参考文献", "致谢", "附录", "攻读", "作者简介", "个人简历")),
    (ROLE_CONCEPT, (
        "文献综述", "研究综述", "相关工作", "相关研究", "研究现状", "国内外现状",
        "理论基础", "理论分析", "概念界定", "概念", "界定", "定义", "内涵", "述评", "综述")),
    (ROLE_GAP, (
        "结论与展望", "总结与展望", "研究展望", "展望", "不足", "局限",
        "未来", "结论", "结语", "总结", "讨论", "对策", "建议", "启示", "路径", "进路")),
    (ROLE_METHOD, (
        "实验设计", "研究设计", "模型构建", "数据来源", "变量", "指标体系",
        "研究方法", "方法", "模型", "算法", "框架", "构建", "测度", "量表")),
    (ROLE_EVIDENCE, ("实证", "实验", "结果", "案例", "检验", "调查", "数据分析", "发现", "分析")),
    (ROLE_BACKGROUND, (
        "引言", "绪论", "前言", "背景", "问题提出", "问题的提出", "动因", "缘起",
        "摘要", "挑战", "困境", "现实问题")),
)

# --- fixed values: packing ------------------------------------------------
CHUNK_BASE = 500
CHUNK_MAX = 620
CHUNK_MIN_TAIL = 120
WINDOW_SIZE = 500
WINDOW_OVERLAP = 100
SEGMENT_MIN = 3
SEGMENT_MAX = 15

# --- fixed values: model output clean-up and prompt texts ------------------
PREAMBLE_MARKERS = (
    "好的", "作为", "以下是", "以下，", "我将", "我会",
    "根据您", "根据你", "首先，我", "明白", "收到",
)
PREAMBLE_MAX_CHARS = 50
NOT_PROVIDED = "（未提供）"
NO_FULL_TEXT = "（未提供全文）"
UNKNOWN_YEAR = "未知"
UNKNOWN_CHAPTER = "未知章节"
UNLABELLED_ROLE = "未标注"
MATCHED_BOTH = "关键词+语义"
MATCHED_VECTOR = "语义"
MATCHED_KEYWORD = "关键词"
CORE_YES = "核心期刊"
CORE_NO = "非核心"
