"""Patterns, word lists and names the results depend on.

All regular expressions are written for Java's engine.  ``U`` switches the
shorthand classes (``\\w \\s \\b``) to Unicode, which is what users of Python
patterns expect.
"""

U = "(?U)"

# --- fixed values -----------------------------------------------------------
ISO_DATE = "ISO (YYYY-MM-DD)"
DATE_FORMATS = {
    "ISO (YYYY-MM-DD)": r"^\d{4}-\d{2}-\d{2}$",
    "US (MM/DD/YYYY)": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "EU (DD-MM-YYYY)": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "long (Month DD, YYYY)": r"^[A-Z][a-z]+ \d{1,2},? \d{4}$",
    "compact (YYYYMMDD)": r"^\d{8}$",
    "slash-ISO (YYYY/MM/DD)": r"^\d{4}/\d{1,2}/\d{1,2}$",
}
INTL_PHONE = "intl (+639XXXXXXXXX)"
PHONE_FORMATS = {
    "local (09XXXXXXXXX)": r"^09\d{9}$",
    "intl (+639XXXXXXXXX)": r"^\+639\d{9}$",
    "dashed (63-9XX-XXX-XXXX)": r"^63-9\d{2}-\d{3}-\d{4}$",
    "spaced (0917 123 4567)": r"^09\d{2} \d{3} \d{4}$",
}
# Both look at a cell without the white space at its ends.
CURRENCY_CELL = r"^(?:₱|PHP|Php|php|\$|USD)\s*[\d,]+(?:\.\d+)?$"
CURRENCY_PARTS = r"^(₱|PHP|Php|php|\$|USD)?\s*(-?[\d,]+(?:\.\d+)?)$"
NUMERIC_CELL = r"^-?[\d,]+(?:\.\d+)?$"
BOOL_WORDS = ["true", "false", "yes", "no", "y", "n", "t", "f"]
TRUE_WORDS = ["true", "yes", "y", "t", "1"]
FALSE_WORDS = ["false", "no", "n", "f", "0"]

EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PH_PHONE = r"(?:\+?63|0)[\s.-]?9\d{2}[\s.-]?\d{3}[\s.-]?\d{4}"
PERSON_NAME = r"\b([A-Z][a-z]+)(\s+(?:[A-Z][a-z]+|[A-Z]\.)){1,3}\b"
SENSITIVE_COLUMN = (
    r"(?i)(name|email|phone|mobile|contact|address|street|birth|dob|ssn|tin"
    r"|passport|id_?number)"
)
KEY_COLUMN = r"(?i)id|key|code"

# Words a CSV reader takes for a missing cell.
NULL_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# --- end of fixed values ----------------------------------------------------

# Text that a plain number parser accepts (no thousands separators).
PLAIN_NUMBER = (r"^[+-]?(?:(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf(?:inity)?))$")
