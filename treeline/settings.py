"""They decide results, so they are stated once, as plain text."""

from __future__ import annotations

# --- files -----------------------------------------------------------------
SKIPPED_DIRECTORIES = (".git", ".svn", "__pycache__", "node_modules", ".venv")
C_SUFFIXES = (".h", ".hpp", ".hh", ".hxx", ".c", ".cc", ".cpp", ".cxx")
PYTHON_SUFFIXES = (".py",)
MARKDOWN_SUFFIXES = (".md",)
ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "latin-1")

# --- module catalog --------------------------------------------------------
SERVICE_CONFIG = "conf/serv_info.conf"
EVENT_DIRECTORY_SUFFIXES = ("_event_center", "_event_serv")
ENTRY_PATTERNS = ("**/main.cpp",)
DOC_NAME_PATTERNS = ("*.md", "*.txt")
CONFIG_FIELDS = ("module_type", "module_name")
DIRECTORY_SIGNALS = {"has_src": "src", "has_core_utils": "src/core/utils"}
FILENAME_SIGNALS = {
    "has_global_serv": "global_serv.h",
    "has_event_process": "event_process.h",
    "has_rank_node": "rank_node.h",
    "has_conf_loader": "*_conf.h",
}
KEY_FILE_NAMES = ("global_serv.h", "event_process.h")

# --- symbols ---------------------------------------------------------------
PREFERRED_KINDS = (
    "class", "struct", "namespace", "enum", "function",
    "member", "macro", "enumerator", "prototype",
)
REPORTED_KINDS = ("class", "function", "member", "macro", "enum", "namespace")
CONTEXT_CHARS = 200
COMMENT_WINDOW = 30
SYMBOL_COMMENT_CHARS = 1000
MODULE_COMMENT_CHARS = 5000

# --- result caps -----------------------------------------------------------
MAX_SEARCH_MATCHES = 50
MAX_LIST_ITEMS = 80
MAX_FILENAME_MATCHES = 40
MAX_READ_LINES = 200
PREVIEW_LINES = 40
RETRIEVE_TOP = 8
SAMPLE_REFS = 20
TOP_NAMES = 10
MAX_RESULT_CHARS = 12_000
RESULT_CHAR_LIMITS = {"list_symbols_in_module": 100_000}
MAX_HISTORY_TOKENS = 200_000

# --- retrieval -------------------------------------------------------------
PER_SIDE = 20
RRF_CONSTANT = 60
SCORE_DECIMALS = 4
DEFAULT_TOP_K = 10
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
EMBED_BATCH = 16

# --- evaluation ------------------------------------------------------------
SCENARIOS = ("consult", "retrieval", "bug", "modify")
INDEX_TOOLS = (
    "resolve_term", "list_modules", "query_include_graph",
    "find_symbol_definition", "list_symbols_in_module", "find_symbol_references",
)
WRITE_TOOLS = ("replace_text_in_file", "write_text_file")
READ_TOOLS = ("read_text_file",)
CLAIM_WORDS = ("已修改", "已写入", "已创建", "已新增")
PRICE_PER_1K_INPUT = 0.002
PRICE_PER_1K_OUTPUT = 0.08
KAPPA_THRESHOLD = 0.6
ATTRIBUTIONS = {
    "max_loops_exceeded": "循环超限：模型在最大循环数内未收敛（可能检索未收敛、工具结果截断或任务描述不清）",
    "error": "运行异常：执行中抛出异常",
}
UNKNOWN_ATTRIBUTION = "未知状态"
LABEL_SYNONYMS = {"正确": "对", "部分": "部分对", "部分正确": "部分对", "错误": "错"}
