"""Patterns and word lists, in the dialect of java.util.regex.

Unicode classes are asked for with (?U) where text can hold letters beyond ASCII.
"""

# ---- fixed values ---------------------------------------------------------------------------

CURRENCY_CODES = [
    "USD", "EUR", "GBP", "CHF", "JPY", "CNY", "INR", "PKR", "AED", "SAR", "CAD", "AUD", "NZD", "SEK", "NOK", "DKK",
    "PLN", "CZK", "HUF", "RON", "TRY", "ZAR", "BRL", "MXN", "SGD", "HKD", "KRW",
]
CURRENCY_PREFIXES = [
    ("CA$", "CAD"), ("C$", "CAD"), ("A$", "AUD"), ("AU$", "AUD"), ("US$", "USD"), ("NZ$", "NZD"), ("HK$", "HKD"), ("S$", "SGD"),
]
CURRENCY_SYMBOLS = [("$", "USD"), ("€", "EUR"), ("£", "GBP")]

NUMBER_TOKEN = r"^\(?-?[$€£]?\d[\d.,]*%?\)?\z"
CURRENCY_SIGNS = ["$", "€", "£"]
NUMBER_HEAD = r"^[$€£]?\d{1,3}\z"
NUMBER_TAIL = r"^\d{3}([.,]\d{1,2})?\z"

INVOICE_NO = r"(?iU)\b(?:invoice|inv|receipt|bill)\s*(?:no\.?|number|num\.?|nr\.?|#)(?![A-Za-z])\s*[:#.\-]?\s*([A-Z0-9][A-Z0-9\-/]*)"
DATE_FIELD = r"(?iU)\b(?:invoice\s*)?date(?:\s*of\s*issue)?\b\s*[:.]?\s*(.+)$"
DUE_FIELD = r"(?iU)\b(?:payment\s*)?due(?:\s*date)?\b\s*[:.]?\s*(.+)$"
#: What a line must hold for any of these three.
FIELD_WORD = r"(?iU)inv|receipt|bill|date|due"
NOT_ISSUE_DATE = r"(?iU)\bdue\b|date\s*paid|paid\s*date|date\s*of\s*payment|service\s*date"

SELLER_ROLES = ["seller", "vendor", "supplier"]
SELLER_PREFIXES = ["from", "sold by", "issued by"]
PARTY_LABEL = (
    r"(?iU)^(?:(from|to|bill(?:ed)?\s*to|sold\s*by|issued\s*by|issued\s*to|invoice\s*to|ship\s*to)\s*)?"
    r"(?:\(?\s*(seller|vendor|supplier|buyer|client|customer)\s*\)?)?\s*:?$"
)
FIELD_LINE = r"(?iU)^(invoice\s*(no|number|nr|#|date)|date|due\s*date|service\s*period|period|currency|po\s*(no|number)|order)\b"
TAX_ID = r"(?iU)^(?:(?:vat|tax|gst|ust)[\s-]*(?:id|nr|no|number|reg\w*)\b|tin\b|ntn\b|gstin\b|abn\b|acn\b|trn\b|ein\b)\.?\s*[:#]?\s*(.*)$"
TAX_ID_SHORT = r"(?iU)^(?:vat|tax)\s*:\s*(.*)$"
EMAIL = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
IBAN_LINE = r"(?iU)^iban\W*(.*)$"
ITEMS_LINE = r"(?iU)^items?\W*$"
TITLE = r"(?iU)^(?:tax\s+)?(?:invoice|receipt|credit\s*note|bill)\b"
TITLE_WORD = r"(?iU)\b(invoice|receipt)\b|\bINVOI"
PHONE = r"(?iU)^(?:tel|phone|ph|mob|mobile|fax|call)\b|^[+\d][\d\s()+.-]{7,}$"
LICENCE = r"(?i)^lic"
SEGMENT_BREAK = r"(?U)\s*[|·•]\s*"

PAYMENT_KEYS = [
    ("reference", r"(?iU)^(?:(?:payment\s*)?reference|ref\.?)\z"),
    ("beneficiary", r"(?iU)^(?:beneficiary|account\s*(?:holder|name))\z"),
    ("bank", r"(?iU)^bank(?:\s*name)?\z"),
    ("iban", r"(?iU)^iban\z"),
    ("bic", r"(?iU)^(?:bic|swift)(?:\s*/\s*(?:bic|swift))?(?:\s*code)?\z"),
    ("account_number", r"(?iU)^account\s*(?:number|no\.?)\z"),
]
PAYMENT_LINE = r"^([A-Za-z /.]+?)(?U)\s*:\s*(.+)$"

HEADER_NOUN = r"(?i)^(descr|item|product|article|particulars|service)"
HEADER_KEY = r"(?i)^(qty|quantity|price|total|amount|net|gross|vat|tax|rate|um|uom|unit|units)"
HEADER_WRAP = r"^[A-Za-z%\[\]./]+\z"
#: Column kinds in the order in which a label is tried.
COLUMN_KINDS = [
    ("index", r"^(no\.?|#|pos\.?|nr\.?|sl\.?|sr\.?|item\s*(no\.?|#|code)|sku|code)$"),
    ("description", r"^(descr.*|item|item name|items|product|product name|article|particulars|service|details)\z"),
    ("quantity", r"^(qty|quantity|qnty|units?\s*sold|hours)"),
    ("unit", r"^(um|uom|unit|units)$"),
    ("gross_amount", r"gross"),
    ("unit_price", r"^(net\s*)?(unit\s*)?(price|rate|cost)"),
    ("vat_percent", r"^(vat|tax|gst)"),
    ("net_amount", r"^(net\s*(worth|amount|total)|amount|total|line\s*total|subtotal)"),
]
TABLE_END = r"(?i)^(summary|sub\s?-?total|total|sales\s*tax|tax|vat|shipping|discount|balance|amount\s*due|items?\s*:|no\.?\s*of\s*items)"
SUMMARY_TAIL = r"^[$€£]$|^[A-Z]{3}$"
#: Kinds of summary rows in the order in which a label is tried.
SUMMARY_KINDS = [
    ("subtotal", r"^sub\s?-?total"),
    ("tax", r"^(sales\s*)?(tax|vat|gst|pst|hst|qst)\b"),
    ("discount", r"^discount"),
    ("charge", r"^(shipping|handling|freight|delivery|fee|surcharge)"),
    ("amount_due", r"^(amount|balance)\s*due|^balance\b"),
    ("amount_paid", r"^(amount\s*)?paid\b|^payment\s*received|^deposit"),
    ("total", r"^(grand\s*)?total\b"),
]
#: Gaps between rows, in line heights, in the order in which they are tried.
ROW_GAPS = [1.7, 1.5, 1.9, 1.35, 2.1, 1.25, 2.4]
LETTERHEAD_LINES = 4

ISO_DATE = r"^\d{4}-\d{2}-\d{2}\z"
REQUEST_ID = r"^[A-Za-z0-9._-]{1,64}\z"
# ---------------------------------------------------------------------------------------------
