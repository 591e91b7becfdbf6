"""Patterns and literal marks that results must agree on.

Java regular expressions; ``(?U)`` makes ``\\s``, ``\\d``, ``\\w`` and ``\\b`` Unicode-aware.
"""

# Structure marks of statutes and regulations (matched at the start of a block).
PART = r"(?U)^\s*(제\s*\d+\s*편\b(?:\s+[^\n]+)?)"
CHAPTER = r"(?U)^\s*(제\s*\d+\s*장\b(?:\s+[^\n]+)?)"
SECTION = r"(?U)^\s*(제\s*\d+\s*절\b(?:\s+[^\n]+)?)"
SUBSECTION = r"(?U)^\s*(제\s*\d+\s*관\b(?:\s+[^\n]+)?)"
ADDENDUM = r"(?U)^\s*(부\s*칙\b(?:\s+[^\n]+)?)"
ARTICLE = r"(?U)^\s*(제\s*\d+\s*조(?:의\s*\d+)?)(?:\s*\(([^)]+)\))?"
APPENDIX = r"(?U)^\s*(\[(?:별표|별지)(?:\s*제?\d+호?(?:의\d+)?)?\]|\b별표\s*\d+|\b별지\s*제?\d+호(?:\s*서식)?)"

# Outline numbers of ordinary documents.
ROMAN = r"(?U)^\s*(?:[IVXLCDM]+|[Ⅰ-Ⅻ])[\.\s]"
DECIMAL_SUB = r"(?U)^\s*\d+\.\d+"
DECIMAL = r"(?U)^\s*\d+[\.\s]"
HANGUL_LETTER = r"(?U)^\s*[가-하][\.\s]"
PAREN_NUMBER = r"(?U)^\s*\(\d+\)"

# Unit boundaries: line ends, sentence ends, and for statutes numbered clauses and items.
SENTENCE_BREAK = r"\n|(?<=[.!?])(?:(?<=(?:다|음|함|임|됨)\.)\s+|\s+(?=[A-Z가-힣0-9]))"
CLAUSE_BREAK = (
    r"(?=[①-⑳])"
    r"|(?<=\n)\s*(?=\d+\.\s|[가-하]\.\s)"
    r"|(?<=[.:]\s)\s*(?=\d+\.\s|[가-하]\.\s)"
)
SOFT_BREAK = r"(?<=[;,])\s+"
HYPHEN_AT_LINE_END = r"(?U)-\s*[\r\n]"
HYPHEN_BREAK = r"(?U)(\w)-\s*[\r\n]+\s*(\w+)"
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

# A line that keeps its own line in context text.
STRUCTURAL_LINE = r"(?:[①-⑳]|\d+\.|\(\d+\)|\[[^\]\n]+\]|제[^\S\n]*\d+[^\S\n]*조|[-*•※#])"

# Words in a title that mark a legal document.
LEGAL_TITLE = r"규정|지침|기준|법률|조례|훈령|전문"

# Literal texts written into results.
TABLE_MARK = "표"
TABLE_COLUMNS_LABEL = "컬럼: "
TABLE_ROWS_LABEL = "주요 데이터:"
TABLE_SUMMARY_LABEL = "내용 요약: "
FOOTNOTE_LABEL = "주"
BIG_TABLE_SUFFIX = " - 대형 표"
CONTINUED_SUFFIX = " (계속)"
FALLBACK_GROUP_TITLE = "독립 / 미분류 그룹"
UNTITLED_DOCUMENT = "문서"

# Metadata keys owned by the system: never touched by custom metadata edits.
RESERVED_METADATA_KEYS = (
    "page",
    "page_start",
    "page_end",
    "pages",
    "chunk_id",
    "parent_chunk_id",
    "section_id",
    "id",
    "has_image",
    "image_path",
    "image_url",
    "is_table",
    "is_atomic_table",
)
IMAGE_METADATA_KEYS = ("has_image", "image_path", "image_url")

# Budgets, in estimated tokens.
CHILD_BUDGET = 512
PARENT_BUDGET = 2048
MIN_CHILD_TOKENS = 20
TABLE_COLUMNS = 10
TABLE_ROWS = 6
TABLE_SUMMARY_CHARS = 300

# Every character that counts as white space when a text is stripped.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Name spaces and prefix of the deterministic ids.
UUID_NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
UUID_NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"
DOC_URN_PREFIX = "urn:mineru:doc:"
PIPELINE_FOLDER = r"^mineru_([a-zA-Z0-9-]+)_([a-zA-Z0-9-]+)_"
PARSE_METHOD_FOLDERS = ("auto", "ocr", "txt")
