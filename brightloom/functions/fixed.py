"""Word lists, patterns, constants and formats.

These decide results, so they are stated here once, as plain text.
"""

# --- fixed values: word lists -------------------------------------------------

ANSWER_STOP_WORDS = (
    "a an and are as at be by do does for from how in is it of on or that the "
    "this to was we what when where which who why with you your"
).split()

SEARCH_STOP_WORDS = (
    "a an and are as at be behind by can do does for from how in is it its key "
    "main of on or that the their this to what when where which why with"
).split()

JUDGE_STOP_WORDS = (
    "a an and are as at be but by for from has have if in into is it its of on "
    "or that the their there this to was were what which who will with would "
    "you your not does did do"
).split()

COVERAGE_STOP_WORDS = (
    "a an and are as at be by for from has have i in is it its of on or that "
    "the then this to was we were will with your you"
).split()

# --- fixed values: white space and line breaks (Unicode definition) ------------

SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

# --- fixed values: token and text patterns ------------------------------------

WORD = r"[a-z0-9]+"
CONTRACTION_WORD = r"[a-z0-9]+(?:'[a-z]+)?"
DOTTED_WORD = r"[a-z0-9.]+"
HEADING = r"^(#{1,6})\s+(.*\S)\s*$"
LIST_MARK = r"^(?:\d+\s*[.)]\s*|[-*]\s+)"
SCORE_FIELD = r"(?i)score\s*[:=]\s*(\d+(?:\.\d+)?)"
VERDICT_SCORE = r"SCORE:\s*([01](?:\.\d+)?)"
VERDICT_RATIONALE = r"RATIONALE:\s*(.+)"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?<![\w.])(?:\+?\d{1,3}[-.\s]?)?(?:\(\d{3}\)|\d{3})[-.\s]\d{3}[-.\s]\d{4}(?![\w-])"
EMAIL_MARK = "[EMAIL]"
PHONE_MARK = "[PHONE]"

# --- fixed values: retrieval ---------------------------------------------------

EMBEDDING_DIM = 512
RRF_K = 60
CANDIDATE_POOL = 20
FUSION_WEIGHT = 0.5
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
NO_CONTEXT_ANSWER = "No relevant context was found in the knowledge base."
NO_SOURCES = "No sources found."
NO_ANSWER = "No relevant sources were available to answer this sub-question."
NO_FINDINGS = "- No findings were available."

# --- fixed values: daily series ------------------------------------------------

LAGS = (1, 2, 3, 7, 14, 28)
ROLL_WINDOWS = (7, 28)
SEASON = 7
DAYS_PER_YEAR = 365.25
MAD_TO_SIGMA = 1.4826
ANOMALY_WINDOW = 56
ANOMALY_Z = 3.0
MIN_SERIES_DAYS = 60

# --- fixed values: customer features and decisions -----------------------------

TENURE_EDGES = (6, 12, 24, 48)
TENURE_LABELS = ("0-6m", "6-12m", "12-24m", "24-48m", "48m+")
CALLS_PER_YEAR_CAP = 24.0
THRESHOLD_GRID = 199
OFFER_COST = 50.0
CHURN_LOSS = 600.0
SAVE_RATE = 0.4

# --- fixed values: drift and promotion ------------------------------------------

PSI_FLOOR = 1e-4
PSI_BINS = 10
PSI_WARN = 0.10
PSI_ALERT = 0.25
KS_ALPHA = 0.05
RETRAIN_ALERTS = 2
PROMOTION_MARGIN = 0.005
PROMOTION_MIN_AUC = 0.70
PROMOTION_MAX_BRIER = 0.20

# --- fixed values: run evaluation -----------------------------------------------

# model -> (USD per million prompt tokens, USD per million completion tokens)
MODEL_PRICES = {
    "sim-small": (0.15, 0.60),
    "sim-large": (2.50, 10.00),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4o": (2.50, 10.00),
    "claude-3-5-haiku": (0.80, 4.00),
    "claude-sonnet-4": (3.00, 15.00),
}
FALLBACK_MODEL = "sim-small"
COST_BUDGET_USD = 0.005
LATENCY_BUDGET_S = 5.0

# --- fixed values: chat formats ---------------------------------------------------

DEFAULT_SYSTEM_PROMPT = (
    "You are an experienced IT helpdesk agent. Given a support ticket, "
    "reply with a clear, numbered resolution."
)
LLAMA3_FORMAT = (
    "<|begin_of_text|>"
    "<|start_header_id|>system<|end_header_id|>\n\n{system}<|eot_id|>"
    "<|start_header_id|>user<|end_header_id|>\n\n{user}<|eot_id|>"
    "<|start_header_id|>assistant<|end_header_id|>\n\n{assistant}<|eot_id|>"
)
CHATML_FORMAT = (
    "<|im_start|>system\n{system}<|im_end|>\n"
    "<|im_start|>user\n{user}<|im_end|>\n"
    "<|im_start|>assistant\n{assistant}<|im_end|>\n"
)

# --- fixed values: report rubric: (pattern that satisfies, min hits, weight, issue)

REPORT_RUBRIC = (
    (r"## References", 1, 3, "Add a numbered references section."),
    (r"### ", 2, 2, "Organize findings into one subsection per sub-question."),
    (r"\[\d+\]", 1, 2, "Cite sources inline using [n] markers."),
    (r"## Limitations", 1, 3, "Add a section on limitations and further research."),
)
REPORT_MIN_CHARS = 400
REPORT_BRIEF_WEIGHT = 1
REPORT_BRIEF_ISSUE = "Expand the report; it is too brief to be useful."

# --- fixed values: reasons of a promotion decision --------------------------------

PROMOTION_LOW_AUC = "candidate auc %.4f below floor {min_auc:.2f}"
PROMOTION_HIGH_BRIER = "candidate brier %.4f above cap {max_brier:.2f}"
PROMOTION_FIRST = "no production model - first promotion"
PROMOTION_BEATS = "candidate auc %.4f beats production %.4f + margin {margin:.3f}"
PROMOTION_BEHIND = "candidate auc %.4f < required %.4f (production %.4f + margin {margin:.3f})"

# --- fixed values: rationale of the keyword judge -----------------------------------

JUDGE_NO_KEYWORDS = "No reference keywords; graded on non-empty answer."
JUDGE_COVERED, JUDGE_KEYWORDS, JUDGE_MISSING = "Covered ", " reference keywords.", " Missing: "
JUDGE_LISTED = 6
