"""Word lists, lookup tables and texts the answers depend on.

Everything here is a FIXED VALUE: results only agree with the expected ones if
these match exactly, so they are kept as plain data in their declared order.
Each list has its DataFrame form in :mod:`harvestline.schema`, and every
operator takes the list (or the table) as a parameter.
"""

from __future__ import annotations

# Commodity aliases, first match in this order wins.
COMMODITY_ALIASES = [
    ("tomato", "Tomato"),
    ("टमाटर", "Tomato"),
    ("टोमेटो", "Tomato"),
    ("tamatar", "Tomato"),
    ("soybean", "Soybean"),
    ("सोयाबीन", "Soybean"),
    ("soya", "Soybean"),
    ("rice", "Rice"),
    ("चावल", "Rice"),
    ("राइस", "Rice"),
    ("chawal", "Rice"),
    ("onion", "Onion"),
    ("प्याज", "Onion"),
    ("अनियन", "Onion"),
    ("pyaj", "Onion"),
    ("wheat", "Wheat"),
    ("गेहूं", "Wheat"),
    ("व्हीट", "Wheat"),
    ("gehu", "Wheat"),
]
DEFAULT_COMMODITY = "Wheat"

# Location aliases, first match in this order wins; no default.
LOCATION_ALIASES = [
    ("bhopal", "Bhopal"),
    ("भोपाल", "Bhopal"),
    ("indore", "Indore"),
    ("इंदौर", "Indore"),
    ("ujjain", "Ujjain"),
    ("उज्जैन", "Ujjain"),
    ("punjab", "Punjab"),
    ("पंजाब", "Punjab"),
    ("maharashtra", "Maharashtra"),
    ("महाराष्ट्र", "Maharashtra"),
]

PRICE_ROUTE = "price_agent"
SCHEME_ROUTE = "rag_agent"
ERROR_ROUTE = "error"

# Intent keywords; the lowest priority number that matches wins.
SCHEME_KEYWORDS = [
    "pmfby", "pm-kisan", "pm kisan", "pmkisan", "insurance", "subsidy",
    "eligible", "eligibility", "scheme", "rules", "premium", "kharif", "rabi",
    "पात्र", "योजना", "बीमा", "ಅರ್ಹತೆ",
]
PRICE_KEYWORDS = [
    "price", "prices", "mandi", "rate", "modal", "quintal", "trend", "bhav",
    "भाव", "दाम", "ट्रेंड", "प्राइस", "सोयाबीन", "गेहूं", "टमाटर", "bhopal", "punjab",
]
PRICE_SYMBOLS = ["₹"]
INTENT_RULES = (
    [(1, word, SCHEME_ROUTE) for word in SCHEME_KEYWORDS]
    + [(2, word, PRICE_ROUTE) for word in PRICE_KEYWORDS]
    + [(3, word, PRICE_ROUTE) for word in PRICE_SYMBOLS]
)

# Code-point ranges of the seven scripts of the letter detector.
LETTER_SCRIPTS = [
    ("hi", 0x0900, 0x097F),
    ("kn", 0x0C80, 0x0CFF),
    ("te", 0x0C00, 0x0C7F),
    ("ta", 0x0B80, 0x0BFF),
    ("pa", 0x0A00, 0x0A7F),
    ("gu", 0x0A80, 0x0AFF),
    ("bn", 0x0980, 0x09FF),
]

# The nine scripts of the priority detector, in priority order.
PRIORITY_SCRIPTS = [
    ("hi", 0x0900, 0x097F),
    ("bn", 0x0980, 0x09FF),
    ("pa", 0x0A00, 0x0A7F),
    ("gu", 0x0A80, 0x0AFF),
    ("or", 0x0B00, 0x0B7F),
    ("ta", 0x0B80, 0x0BFF),
    ("te", 0x0C00, 0x0C7F),
    ("kn", 0x0C80, 0x0CFF),
    ("ml", 0x0D00, 0x0D7F),
]

# Latin-letter words that mark romanised Hindi.
ROMANISED_HINDI = [
    "kya", "hai", "hain", "kitna", "kitne", "kaisa", "kaise", "mein", "ka",
    "ki", "ke", "batao", "bhai", "paisa", "rupaye", "daam", "bhav", "kar",
    "sakta", "skta", "hu", "mai", "mujhe", "chahiye", "kaun", "konsa",
    "yojna", "yojana",
]

# Language names used in prompts; anything else is English.
LANGUAGE_NAMES = {
    "hi": "Hindi (Devanagari script)",
    "kn": "Kannada (Kannada script)",
    "te": "Telugu (Telugu script)",
    "ta": "Tamil (Tamil script)",
    "pa": "Punjabi (Gurmukhi script)",
    "gu": "Gujarati (Gujarati script)",
    "bn": "Bengali (Bengali script)",
    "en": "English",
}
DEFAULT_LANGUAGE_NAME = "English"

# Texts used when no model answer is available.
BUSY_TEXTS = {
    "hi": "क्षमा करें, सर्वर व्यस्त है। कृपया कुछ क्षण बाद पुनः प्रयास करें।",
    "pa": "ਮਾਫ ਕਰਨਾ, ਸਰਵਰ ਵਿਅਸਤ ਹੈ। ਕਿਰਪਾ ਕਰਕੇ ਬਾਅਦ ਵਿੱਚ ਕੋਸ਼ਿਸ਼ ਕਰੋ।",
    "kn": "ಕ್ಷಮಿಸಿ, ಸರ್ವರ್ ಬಿಡುವಿಲ್ಲದಿದೆ. ದಯವಿಟ್ಟು ಸ್ವಲ್ಪ ಸಮಯದ ನಂತರ ಪ್ರಯತ್ನಿಸಿ.",
}
DEFAULT_BUSY_TEXT = "Sorry, the server is busy. Please try again later."

CONTEXT_SEPARATOR = "\n\n---\n\n"

# Prompt wording; {language}, {context} and {question} are filled
# in as column values.
GROUNDED_PROMPT = (
    "\nYou are a friendly agricultural scheme advisor for Indian farmers.\n"
    "Answer the user's question using ONLY the context below. If the context does\n"
    "not contain the answer, say so honestly instead of guessing or making up numbers.\n"
    "The user asked in {language}. You MUST answer strictly in {language}. Do NOT output English.\n"
    "\nContext:\n{context}\n"
    "\nUser Question: {question}\n"
)
UNGROUNDED_PROMPT = (
    "\nYou are a friendly agricultural scheme advisor for Indian farmers.\n"
    "No reference document context was available for this question, so answer\n"
    "briefly from general knowledge and clearly tell the user this specific answer\n"
    "is not verified against the official scheme documents. The user asked in\n"
    "{language}. You MUST answer strictly in {language}. Do NOT output English.\n"
    "\nUser Question: {question}\n"
)

# Answer, badge and message texts.
ALL_REGIONS = "All Regions"
NO_DATA_TEXT = "No data found for this query."
NO_DATA_TEXT_HI = "इस सवाल के लिए कोई डेटा नहीं मिला।"
QUERY_ERROR_LABEL = "Query error"
QUERY_ERROR_LABEL_HI = "क्वेरी में त्रुटि"
EMPTY_QUESTION_ERROR = "Empty question provided."
SYSTEM_ERROR_TEXT = "Internal server error processing your request. Please try again."
PRICE_BADGE = "Mandi Prices & Analytics"
SCHEME_BADGE = "Scheme Intelligence"
ERROR_BADGE = "System Error"
CHAT_PRICE_BADGE = "📈 Mandi Prices"
CHAT_SCHEME_BADGE = "📋 Scheme Info"
DELTA_SUFFIX = "over recent records"
DELTA_SUFFIX_HI = "हाल के रिकॉर्ड में"
EXPLANATION_START = "Query executed for commodity='"
EXPLANATION_PLACE = "', location='"
EXPLANATION_EVERYWHERE = "' across available regions."
CHART_TITLE = "Price Trend & Moving Average ("
AVERAGE_TEXT = "Average modal price: **"
AVERAGE_UNIT = "** per quintal."
FORECAST_TEXT = "\n\n🔮 **14-Day Trend Forecast:** ₹"
FORECAST_UNIT = "/quintal ("
FORECAST_END = " trajectory)."
FINDER_STEM = "Which government schemes am I eligible for as a farmer"

# Cell texts that mean "missing" when a price file is read.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Analytics parameters.
MOVING_AVERAGE_ROWS = 7
MIN_FIT_ROWS = 3
FORECAST_DAYS = 14
TREND_SLOPE = 0.5
TOP_K = 3
DISPLAY_ROWS = 15
SAMPLE_ROWS = 5
