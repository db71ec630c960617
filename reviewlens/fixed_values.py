"""Fixed values the results depend on.

FIXED VALUES — these must stay exactly as written for results to match the
behaviour this library reproduces (patterns, word lists, labels, limits).
They are plain data; every operator reads them from here.

Regex notes: the patterns run on the JVM (java.util.regex) and on the SQL
oracle (RE2). ``\\d`` is ASCII in both; ``\\s`` differs only on vertical tab;
``\\b`` treats non-ASCII letters as word characters on the JVM only.
"""

# --- redaction (applied in this order, each on the previous result) --------
REDACTION_MARKER = "[REDACTED]"
# A dash or one white-space character, Unicode separators (no-break space) included.
SEPARATOR = r"[-\t\n\x0B\f\r\x1C-\x1F \x{85}\p{Z}]?"
PII_PATTERNS = [
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("phone", rf"(?:\+?\d{{1,3}}{SEPARATOR})?\(?\d{{3}}\)?{SEPARATOR}\d{{3}}{SEPARATOR}\d{{4}}"),
    ("tax_id", r"(?i)[A-Z]{5}[0-9]{4}[A-Z]{1}"),
    ("national_id", rf"\b\d{{4}}{SEPARATOR}\d{{4}}{SEPARATOR}\d{{4}}\b"),
    ("payment_handle", r"[a-zA-Z0-9._-]+@[a-zA-Z]{3,}"),
]

# --- quality gate -----------------------------------------------------------
MIN_WORDS = 8
# Characters Python's str.split() treats as separators: ASCII controls
# \t \n \v \f \r, the file/group/record/unit separators, NEL and Unicode Z*.
WHITESPACE_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\p{Z}]"
WORD_PATTERN = r"[^\t\n\x0B\f\r\x1C-\x1F \x{85}\p{Z}]+"
# Code points with the Emoji property (Unicode emoji data), without digits, # and *;
# symbols of the same blocks that are no emoji (stars, arrows, notes) are not listed.
EMOJI_CLASS = (
    r"[\x{231A}\x{231B}\x{2328}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}"
    r"\x{2600}-\x{2604}\x{260E}\x{2611}\x{2614}\x{2615}\x{2618}\x{261D}\x{2620}\x{2622}\x{2623}\x{2626}\x{262A}"
    r"\x{262E}\x{262F}\x{2638}-\x{263A}\x{2640}\x{2642}\x{2648}-\x{2653}\x{265F}\x{2660}\x{2663}\x{2665}\x{2666}"
    r"\x{2668}\x{267B}\x{267E}\x{267F}\x{2692}-\x{2697}\x{2699}\x{269B}\x{269C}\x{26A0}\x{26A1}\x{26A7}\x{26AA}\x{26AB}"
    r"\x{26B0}\x{26B1}\x{26BD}\x{26BE}\x{26C4}\x{26C5}\x{26C8}\x{26CE}\x{26CF}\x{26D1}\x{26D3}\x{26D4}\x{26E9}\x{26EA}"
    r"\x{26F0}-\x{26F5}\x{26F7}-\x{26FA}\x{26FD}"
    r"\x{2702}\x{2705}\x{2708}-\x{270D}\x{270F}\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}\x{2733}\x{2734}"
    r"\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}\x{2763}\x{2764}\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}"
    r"\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}"
    r"\x{1F004}\x{1F0CF}\x{1F170}\x{1F171}\x{1F17E}\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}\x{1F1E6}-\x{1F1FF}"
    r"\x{1F201}\x{1F202}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}\x{1F250}\x{1F251}\x{1F300}-\x{1F321}\x{1F324}-\x{1F393}"
    r"\x{1F396}\x{1F397}\x{1F399}-\x{1F39B}\x{1F39E}-\x{1F3F0}\x{1F3F3}-\x{1F3F5}\x{1F3F7}-\x{1F4FD}\x{1F4FF}-\x{1F53D}"
    r"\x{1F549}-\x{1F54E}\x{1F550}-\x{1F567}\x{1F56F}\x{1F570}\x{1F573}-\x{1F57A}\x{1F587}\x{1F58A}-\x{1F58D}\x{1F590}"
    r"\x{1F595}\x{1F596}\x{1F5A4}\x{1F5A5}\x{1F5A8}\x{1F5B1}\x{1F5B2}\x{1F5BC}\x{1F5C2}-\x{1F5C4}\x{1F5D1}-\x{1F5D3}"
    r"\x{1F5DC}-\x{1F5DE}\x{1F5E1}\x{1F5E3}\x{1F5E8}\x{1F5EF}\x{1F5F3}\x{1F5FA}-\x{1F64F}\x{1F680}-\x{1F6C5}"
    r"\x{1F6CB}-\x{1F6D2}\x{1F6D5}-\x{1F6D7}\x{1F6DC}-\x{1F6E5}\x{1F6E9}\x{1F6EB}\x{1F6EC}\x{1F6F0}\x{1F6F3}-\x{1F6FC}"
    r"\x{1F7E0}-\x{1F7EB}\x{1F7F0}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1F9FF}\x{1FA70}-\x{1FA7C}"
    r"\x{1FA80}-\x{1FA8A}\x{1FA8E}-\x{1FAC6}\x{1FAC8}\x{1FACD}-\x{1FADC}\x{1FADF}-\x{1FAEA}\x{1FAEF}-\x{1FAF8}"
    r"\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}"
    r"\x{21A9}\x{21AA}\x{24C2}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}"
    r"\x{2934}\x{2935}\x{3030}\x{303D}\x{3297}\x{3299}\x{20E3}]"
)
# Wide ranges that hold every character of EMOJI_CLASS.
EMOJI_ENCLOSING = r"[\x{00A9}\x{00AE}\x{203C}-\x{3299}\x{1F004}-\x{1FAF8}]"
ACCEPTED_LANGUAGE = "en"

# --- ingest -----------------------------------------------------------------
FULL_DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].+)?$"  # a time without its full date is not parsed
# ISO times without separators, and how they read with them.
BASIC_TIMES = (
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})[T ]([0-9]{2})([0-9]{2})(Z|[+-][0-9]{2}:?[0-9]{2})?$", "$1-$2-$3T$4:$5:00$6"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})[T ]([0-9]{2})([0-9]{2})([0-9]{2})([.][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?$",
     "$1-$2-$3T$4:$5:$6$7$8"),
)
DEFAULT_WINDOW_WEEKS = 12
DEFAULT_MAX_REVIEWS = 2000
SORT_MODES = ("newest", "rating", "most_relevant")  # unknown -> newest

# --- clustering -------------------------------------------------------------
NOISE_LABEL = -1
REPRESENTATIVES_PER_CLUSTER = 5
TOP_CLUSTERS = 5
MIN_CLUSTER_SIZE = 10
MIN_SAMPLES = 5

# --- themes -----------------------------------------------------------------
MAX_ATTEMPTS = 3
COMPLETION_BUFFER_TOKENS = 500
TOKEN_BUDGET_CAP = 100_000
REQUESTS_PER_DAY = 1_000
REQUESTS_PER_MINUTE = 30
TOKENS_PER_MINUTE = 12_000
MESSAGE_OVERHEAD_TOKENS = 3
REPLY_PRIMING_TOKENS = 3
CHARS_PER_TOKEN = 4
REVIEW_BLOCK_SEPARATOR = "\n---\n"
QUOTES_SHOWN = 3

# --- explorer ---------------------------------------------------------------
PAGE_SIZE = 10
CLAMP_CHARS = 200
# First matching rule wins; patterns are case-insensitive substring tests.
THEME_RULES = [
    # (priority, name, color, min_rating, max_rating, pattern)
    (1, "Trading Issues", "red", None, 2, r"trad|execut|order|lag|stuck|glitch"),
    (2, "Poor Customer Support", "red", None, 2, r"support|customer.?care|respond|agent|call"),
    (3, "Feature Requests", "amber", None, None, r"add|please|feature|request|indicator|option|allow|chart"),
    (4, "Good Investment App", "green", 4, None, r"invest|good|best|excel|great|love|sip|mutual"),
    (5, "Easy Interface", "green", 4, None, r"easy|simple|ui|interface|beginner|use"),
]
# Fallback when no rule matches: by rating.
FALLBACK_POSITIVE = ("Good Investment App", "green")   # rating >= 4
FALLBACK_NEGATIVE = ("Trading Issues", "red")          # rating <= 2
FALLBACK_NEUTRAL = ("Feature Requests", "amber")       # otherwise
# What an extractive theme suggests, by the tag of its representatives.
THEME_ACTIONS = {
    "Trading Issues": ("Stabilise order flow", "Trace the reported failures and delays."),
    "Poor Customer Support": ("Answer faster", "Review open support cases of these users."),
    "Feature Requests": ("Plan requested features", "Rank the requests by how many users ask."),
    "Good Investment App": ("Keep what works", "Show these strengths to new users."),
    "Easy Interface": ("Keep it simple", "Test new screens against these praises."),
}
SENTIMENT_ACTIONS = {"pos": "Thank User", "neg": "Escalate", "neu": "Reply"}
STATUS_LABELS = {"appended": "Appended", "draft_created": "Draft Created"}  # document, mail

# --- delivery / receipts ----------------------------------------------------
DOC_URL_PREFIX = "https://docs.google.com/document/d/"
DOC_SITE_ROOT = "https://docs.google.com/"
DOC_DONE = "appended"
MAIL_DONE = "drafted"
PENDING = "pending"
FAILED = "failed"
DRY_RUN = "dry_run"

# --- report text (I1, I2): line formats -------------------------------------
REPORT_HEADING = "{product} — {title} ({week})\n\n"
REPORT_PERIOD = "Period: {weeks} weeks ending {week}\n\n"
REPORT_THEME_LINE = "{rank}. {name} ({count} reviews, Avg Rating: {avg})\n   {description}\n\n"
REPORT_QUOTES_HEADER = "   Real User Quotes:\n"
REPORT_QUOTE_LINE = '   > "{text}" ({rating}/5)\n'
REPORT_ACTIONS_HEADER = "   Action Ideas:\n"
REPORT_ACTION_LINE = "   - {title}: {detail}\n"
REPORT_END = "---\n\n"
MISSING_THEME_TEXT = "Unknown Theme"
MISSING_THEME_PAYLOAD = "Unknown"
MISSING_QUOTE_RATING_TEXT = "?"
EMAIL_SUBJECT = "{product} {title} — {week}"
EMAIL_GREETING = "Hi Team,\n"
EMAIL_INTRO = "Here are the top themes from our {product} user reviews for {week}:\n"
EMAIL_THEME_LINE = "- {name} ({count} reviews)"
EMAIL_LINK_LINE = "\nRead full report → {link}"
EMAIL_HTML_GREETING = "<p>Hi Team,</p>"
EMAIL_HTML_INTRO = "<p>Here are the top themes from our {product} user reviews for <strong>{week}</strong>:</p>"
EMAIL_HTML_THEME = "  <li><strong>{name}</strong> ({count} reviews)</li>"
EMAIL_HTML_LINK = '<p><a href="{link}">Read full report &rarr;</a></p>'
