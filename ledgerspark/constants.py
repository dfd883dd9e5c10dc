"""Fixed values that results depend on: labels, patterns, word lists and settings.

Patterns are written for Java regular expressions.  ``WORD`` and ``SPACE`` spell out the Unicode
classes of the original word and whitespace shorthands, so ``\\b`` and ``(?U)`` are never needed.
"""

TARGET = "category"
ID = "transaction_id"
SEED = 42
N_FOLDS = 5

# Columns a transaction file must have.
REQUIRED_COLUMNS = ["transaction_id", "date", "description", "amount", "day_of_week"]
REQUIRED_TRAIN_COLUMNS = REQUIRED_COLUMNS + [TARGET]

# The ten expense categories.
CATEGORIES = [
    "Food & Dining",
    "Groceries",
    "Transportation",
    "Entertainment",
    "Shopping",
    "Bills & Utilities",
    "Health & Fitness",
    "Miscellaneous",
    "Subscriptions",
    "Travel",
]

# Character classes (contents of a bracket expression).
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A run of anything else.  U+001C to U+001F count as white space here, but not for the pattern language.
NON_SPACE_RUN = r"(?U)[^\s\x1c-\x1f]+"

# Merchant patterns, matched on upper-cased trimmed text.
MERCHANT_PREFIX = (
    rf"(?<![{WORD}])(?:SQ[{SPACE}]*\*|SQUARE[{SPACE}]*\*|AMZN[{SPACE}]*MKTP[{SPACE}]*\*?"
    rf"|AMAZON[{SPACE}]*\*?|WMT[{SPACE}]*#?)[{SPACE}]*([A-Z0-9][A-Z0-9 &.'-]{{1,30}})"
)
MERCHANT_BRAND = (
    rf"(?<![{WORD}])(?:UBER|LYFT|SPOTIFY|NETFLIX|WHOLE[{SPACE}]+FOODS|TARGET|WALMART|COSTCO|CVS"
    rf"|SHELL|CHEVRON)(?![{WORD}])"
)
MERCHANT_FIRST_TOKEN = r"(?U)^[^\s\x1c-\x1f*#]*"  # up to whitespace, * or #
MERCHANT_TRIM_CHARS = " *#.-"
MERCHANT_MAX_LENGTH = 40
UNKNOWN_MERCHANT = "UNKNOWN"

# US state codes.
STATE_CODES = (
    "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|"
    "NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"
)
STATE_PATTERN = rf"(?<![A-Z])(?:{STATE_CODES})(?![A-Z])"

# Keyword alternations behind the has_*_keyword columns.
KEYWORD_PATTERNS = {
    "has_grocery_keyword": rf"grocery|groceries|whole[{SPACE}]+foods|walmart|safeway|kroger|aldi"
    rf"|trader[{SPACE}]+joe|supercenter|market",
    "has_food_keyword": "restaurant|food|cafe|coffee|starbucks|chipotle|mcdonald|pizza|doordash|grubhub",
    "has_transport_keyword": "uber|lyft|taxi|shell|chevron|exxon|fuel|gas|parking|toll|transit|train",
    "has_transfer_keyword": "transfer|payment|paypal|venmo|zelle|wire|withdrawal|deposit",
    "has_travel_keyword": "air|airline|hotel|motel|flight|booking|travel|airport|expedia|airbnb",
}

# Extended keyword lists (upper-case substrings).
SUBSCRIPTION_KEYWORDS = [
    "NETFLIX", "SPOTIFY", "AMAZON PRIME", "HULU", "DISNEY", "HBOMAX",
    "SUBSCRIPTION", "MONTHLY", "RECURRING", "RENEWAL", "AUTO-PAY", "MEMBERSHIP",
]
ENTERTAINMENT_KEYWORDS = [
    "CINEMA", "MOVIE", "CONCERT", "THEATER", "BOWLING", "AMUSEMENT", "ARCADE",
    "PARK", "ZOO", "MUSEUM", "GALLERY", "FESTIVAL", "EVENT", "SHOW",
]
ENTERTAINMENT_MERCHANT_PATTERN = "CINEMA|MOVIE|THEATER|BOWLING|AMUSEMENT|ARCADE"
SUBSCRIPTION_AMOUNTS = [9.99, 12.99, 14.99, 19.99]

# Ambiguous terms of the error report (case-insensitive whole words).
AMBIGUOUS_TERMS = {
    "market": ["market"],
    "payment": ["payment"],
    "booking": ["booking"],
    "target": ["target"],
    "amazon": ["amazon", "amzn"],
    "cvs": ["cvs"],
}

# Suggested post-processing rules.
FIXED_RULES = [
    ("IRS or TAX in description", "Bills & Utilities",
     "Tax-related payments are usually utilities or bills."),
    ("UBER or LYFT in description", "Transportation",
     "Ride-share merchants are transport transactions."),
]
KEYWORD_RULES = {"amazon": "Shopping", "cvs": "Health & Fitness", "booking": "Travel"}
KEYWORD_RULE_MIN_ERROR_RATE = 0.10
# Texts of the learned rules; the rate stands between the two parts of the reason.
KEYWORD_RULE_SUFFIX = " in description"
KEYWORD_RULE_REASON = ("Observed error rate is ", "; merchant keyword is actionable.")

# Weekday names in calendar order.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Date formats tried in this order; "mixed" accepts any of them per value.
DATE_FORMATS = ["mixed", "yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d"]
DATE_MAX_FAILURE_RATIO = 0.05

# What an amount may look like as text.
DECIMAL_NUMBER = r"(?i)^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"

# Date forms that the mixed parse also takes, with or without a time of day.
MIXED_DATE_FORMATS = ["MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "yyyyMMdd"]

# Texts a CSV reader takes as missing.
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Model inputs treated as categorical, and columns never used as inputs.
CATEGORICAL_FEATURES = ["day_of_week", "month", "quarter", "month_period", "amount_bins", "store_name"]
NON_FEATURES = ["date", "transaction_id", TARGET]

# Candidate columns of the exploratory report.
CANDIDATE_COLUMNS = [
    "description_word_count", "description_char_count", "description_digit_count",
    "description_special_char_count", "month", "quarter", "is_weekend", "day_of_month",
    "log_amount", "amount_bins",
]

# Text vectoriser and model settings.
CHAR_NGRAMS = (3, 5)
WORD_NGRAMS = (1, 2)
MAX_TERMS = 50_000  # of character n-grams; words are not bounded
TARGET_ENCODING_SMOOTHING = 10.0
BOOSTED_SETTINGS = {"iterations": 500, "learning_rate": 0.1, "depth": 6, "early_stop": 50}
LEAFWISE_SETTINGS = {
    "iterations": 500, "learning_rate": 0.1, "leaves": 31, "subsample": 0.8, "colsample": 0.8, "min_leaf": 20, "early_stop": 50,
}
SEARCH_SPACE = {
    "boosted_iterations": ("int", 300, 1000),
    "boosted_learning_rate": ("log", 0.01, 0.3),
    "boosted_depth": ("int", 4, 8),
    "boosted_l2": ("log", 1.0, 10.0),
    "boosted_subsample": ("float", 0.6, 1.0),
    "leafwise_iterations": ("int", 300, 1000),
    "leafwise_learning_rate": ("log", 0.01, 0.3),
    "leafwise_leaves": ("int", 15, 50),
    "leafwise_subsample": ("float", 0.6, 1.0),
    "leafwise_colsample": ("float", 0.6, 1.0),
    "leafwise_min_leaf": ("int", 5, 30),
}
SEARCH_TRIALS = 25
SEARCH_STARTUP_TRIALS = 5
SEARCH_WARMUP_STEPS = 1
MULTIPLIER_BOUNDS = (0.1, 10.0)
ENSEMBLE_WEIGHTS = (0.5, 0.5)

# Spark's default English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only
own same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd
she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't
haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could
here's how's let's ought that's there's what's when's where's who's why's would
""".split()
