"""Fixed values that results depend on: enumerations, thresholds and word lists of the document schema."""

SCHEMA_VERSION = 2
CATEGORIES = ["政策", "通知", "FAQ"]
SOURCE_TYPES = ["official_policy", "official_notice", "official_guide", "student_guide", "third_party", "unknown"]
AUTHORITY_LEVELS = ["university", "department", "college", "student", "external", "unknown"]
REVIEW_STATUSES = ["needs_review", "verified", "rejected"]
REQUIRED_TEXT = ["title", "source_org", "maintainer"]
NON_EMPTY_LISTS = ["tags", "applies_to", "campuses", "colleges"]
OPTIONAL_DATES = ["last_checked_at", "effective_from", "effective_until"]
CAMPUSES = ["紫金港", "玉泉", "西溪", "华家池", "之江", "舟山", "海宁"]
UNSPECIFIED = "未明确"
DEPARTMENTS = ["本科生院", "研究生院", "教务处", "学工部", "信息技术中心", "图书馆"]
UNIVERSITY = "浙江大学"
PUBLISHED_FOLDERS = ["FAQ", "政策", "通知"]

TOP_K = 8
CANDIDATES = 20
MAX_CHUNK_CHARS = 350
COVER_MIN_SCORE = 0.5
COVER_MAX_EXTRA = 3
PROMPT_MIN_SCORE = 0.15
FALLBACK_SCORE = 0.3
FALLBACK_TOP_N = 4

#: Fixed values of rendered pages: file endings that are attachments, what attachments and images are called, the mark of an
#: embedded PDF, and the class and attribute of players that embed one.
FILE_ENDINGS = ("doc", "docx", "xls", "xlsx", "ppt", "pptx", "pdf", "zip", "rar", "7z", "wps")
ATTACHMENT, FILE, PICTURE, PDF_MARK = "附件", "文件", "图片", "@PDFIFRAME@"
PDF_PLAYER, PDF_SOURCE = "wp_pdf_player", "pdfsrc"

#: Fixed value: the tag of documents without any.
UNTAGGED = "未分类"
