"""Fixed values of the offer rules: word lists, thresholds and patterns.

Results depend on these values, so they are stated as they are and used everywhere by
name.  Patterns use the spelling that Java and RE2 share; ``functions.regex`` gives them
their Unicode meaning on the JVM.
"""

UNKNOWN_STORE = "UNKNOWN_STORE"
GENERIC = "generic"
SITE = "retailmenot"
SITE_DOMAINS = ("retailmenot.com", "www.retailmenot.com")

MIN_CONFIDENCE = 0.4
SITE_MIN_CONFIDENCE = 0.4
KEEP_CONFIDENCE = 0.3
FALLBACK_THRESHOLD = 0.6
MULTI_SIGNAL_BONUS = 0.08
TOP_FOR_PAGE_CONFIDENCE = 5
PREVIEW = 10
SNIPPET_CHARS = 500
STORE_CHARS = 80
STEM_CHARS = 80
MIN_LINE_CHARS = 4
MAX_LINE_CHARS = 400
MIN_SITE_OFFER_CHARS = 6

# --- characters stripped from both ends -------------------------------------------
STRIP_PLAIN = " -*|>#"
STRIP_GENERIC = " -*|>#:\u2022"
STRIP_CLEANED = " |-"
STRIP_CODE = " .,:;()[]{}"

# --- call-to-action phrases removed from a line -----------------------------------
CTA_GENERIC = (
    "show code", "get deal", "get reward", "see details", "copy code", "shop now",
    "activate deal",
)
CTA_SITE = ("show code", "get deal", "get reward", "see details")
INTERESTED_USERS = r"\b\d+\s+interested users?\b"
ADDED_BY = r"\badded by\s+[a-z0-9._-]+\b"

# --- noise ------------------------------------------------------------------------
QUESTION_PREFIXES = (
    "how ", "what ", "are ", "does ", "do ", "can ", "is ", "why ", "when ", "where ",
    "which ",
)
NOISE_PHRASES = (
    "accept cookies", "added by", "all stores", "customer care", "customer support",
    "contact support", "download app", "email support", "faq", "featured articles",
    "frequently asked questions", "help center", "latest arrivals", "learn more",
    "loading your offer", "log in", "new arrivals", "newsletter", "payment options",
    "popular stores", "privacy policy", "return and refund policy", "return policy",
    "see details", "share this", "shipping and delivery policy", "sign in",
    "similar stores", "store info", "submit a coupon", "support@",
    "terms and conditions", "track your order", "updated by", "view all",
    "why trust us",
)
DEAL_HEADINGS = (
    "coupon", "coupons", "discount", "discounts", "deal", "deals", "offer", "offers",
    "promo", "promo codes", "sale", "sales",
)
NAVIGATION_WORDS = ("home", "menu", "search", "back", "next", "previous", "close")
SITE_QUESTION_PREFIXES = (
    "how ", "what ", "are ", "does ", "do ", "can ", "is ", "why ", "when ",
)
SITE_NOISE_PHRASES = (
    "learn how we verify coupons", "submit a coupon", "why trust us",
    "featured articles", "store info", "frequently asked questions", "customer care",
    "return and refund policy", "shipping and delivery policy", "payment options",
    "how can i reach", "updated by", "content writer", "see bio", "popular stores",
    "similar stores", "view all", "all stores", "loading your offer",
)
CODE_STOPWORDS = (
    "APPLY", "CHECKOUT", "CLICK", "CODE", "COUPON", "DEAL", "DETAILS", "DISCOUNT",
    "HERE", "NOW", "OFFER", "ONLINE", "ORDER", "ORDERS", "PROMO", "PURCHASE", "SALE",
    "SHOP", "SITEWIDE", "STORE", "STOREWIDE", "TODAY", "VALID",
)

# --- offer types, lowest priority first -------------------------------------------
OFFER_TYPES = ("SALE", "SHIPPING", "REWARD", "BOGO", "COUPON")

# --- patterns shared by both extractors -------------------------------------------
PERCENT_OFF = r"(\d+(?:\.\d+)?)\s*%\s+off\b"
AMOUNT_OFF = r"([$]\d+(?:\.\d{1,2})?)\s+off\b"
UP_TO_AMOUNT_OFF = r"\bup to\s+([$]\d+(?:\.\d{1,2})?)\s+off\b"
CASHBACK = r"(\d+(?:\.\d+)?)\s*%\s+(?:cash\s*back|back)\b"
BOGO = r"\bbuy\s+\d+,\s*get\s+\d+\b|\bbogo\b"

# --- English ----------------------------------------------------------------------
EN_FREE_SHIPPING = r"\bfree shipping\b"
EN_CODE = (
    r"\b(?:code|coupon|promo(?:\s*code)?|use(?:\s+code)?|apply(?:\s+code)?)[:\s]+"
    r"([a-z0-9][a-z0-9-]{2,19})\b"
)
EN_EXTRA_OFF = r"\b(?:extra|additional)\s+(\d+(?:\.\d+)?)\s*%\s*off\b"
EN_UP_TO_PERCENT = r"\bup\s+to\s+(\d+(?:\.\d+)?)\s*%\s*off\b"
EN_SAVE_AMOUNT = r"\bsave\s+([$€£¥₹₩]\s?\d+(?:[.,]\d{1,2})?)\b"
EN_MIN_SPEND = (
    r"\b(?:with|on|over|orders?\s+over|purchase(?:s)?\s+over|spend"
    r"|min(?:imum)?\s+purchase(?:\s+of)?|when you spend)\s+"
    r"([$€£¥₹₩]?\s?\d+(?:[.,]\d{1,2})?\+?)"
)
EN_AMOUNT_OFF_MIN_SPEND = (
    r"[$€£¥₹₩]\s?\d+(?:[.,]\d{1,2})?\s+off\s+"
    r"(?:orders?\s+over|on|with|when you spend)\s+"
    r"([$€£¥₹₩]?\s?\d+(?:[.,]\d{1,2})?\+?)"
)
EN_SHIPPING_MIN_SPEND = (
    r"\bfree shipping on orders?\s+([$€£¥₹₩]?\s?\d+(?:[.,]\d{1,2})?\+?)"
)
EN_DEAL_WORD = (
    r"\b(?:coupon|coupons|promo|promo code|discount|deal|sale|offer|offers|sitewide"
    r"|storewide|clearance)\b"
)

# --- Chinese ----------------------------------------------------------------------
ZH_ZHE = r"(\d+(?:\.\d+)?)\s*折"
ZH_EXTRA_ZHE = r"额外\s*(\d+(?:\.\d+)?)\s*折"
ZH_LOW_ZHE = r"低至\s*(\d+(?:\.\d+)?)\s*折"
ZH_CASHBACK = r"(\d+(?:\.\d+)?)\s*%?\s*返利"
ZH_CODE = r"(?:优惠码|折扣码|优惠券)[：:\s]*([a-z0-9][a-z0-9-]{2,19})"
ZH_FREE_SHIPPING = ("免邮", "包邮", "免运费")
ZH_FULL_MINUS = (
    r"满\s*([$€£¥￥]?\d+(?:\.\d{1,2})?)\s*减\s*([$€£¥￥]?\d+(?:\.\d{1,2})?)"
)
ZH_DEAL_WORDS = (
    "优惠", "折扣", "特价", "促销", "大促", "清仓", "打折", "秒杀", "限时", "闪购",
)
ZH_BUY_GET = r"买\s*\d+\s*(?:送|赠)\s*\d+"

# --- Korean -----------------------------------------------------------------------
KO_PERCENT = r"(\d+)\s*%\s*(?:할인|세일|off)"
KO_CODE = r"(?:쿠폰|할인코드|프로모)[：:\s]*([a-z0-9][a-z0-9-]{2,19})"
KO_FREE_SHIPPING = r"무료\s*배송"

# --- Japanese ---------------------------------------------------------------------
JA_PERCENT = r"(\d+)\s*%\s*(?:オフ|off|引き)"
JA_CODE = r"(?:クーポン|割引コード)[：:\s]*([a-z0-9][a-z0-9-]{2,19})"
JA_FREE_SHIPPING = "送料無料"

# --- Spanish and Portuguese -------------------------------------------------------
ES_PERCENT = r"(\d+)\s*%\s*(?:descuento|dto|de descuento|off)\b"
ES_CODE = r"\b(?:c[oó]digo|cup[oó]n|cupom)[:\s]+([a-z0-9][a-z0-9-]{2,19})\b"
ES_FREE_SHIPPING = r"\benv[ií]o\s*(?:gratis|gratuito)\b"

# --- expiry -----------------------------------------------------------------------
EXPIRY_DATE = r"\b([A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})\b"
EXPIRY_RELATIVE = r"\b(expiring soon|limited time|today only|ends? today|ends? soon)\b"

# --- site rules -------------------------------------------------------------------
SITE_STORE_HEADING = r"^(.*?)\s+Coupons?\s*&\s*Promo Codes?$"
SITE_EXPIRY_DATE = r"\b([A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4})\b"
SITE_EXPIRY_RELATIVE = r"\b(expiring soon|limited time)\b"
SITE_MIN_SPEND = (
    r"\b(?:with|on|over|orders?\s+over|purchase|spend)\s+([$]\d+(?:\.\d{1,2})?\+?)"
)
SITE_AMOUNT_OFF_MIN_SPEND = r"[$]\d+(?:\.\d{1,2})?\s+off\s+[$](\d+(?:\.\d{1,2})?\+?)"
SITE_RAW_TYPE = r"'offerType':\s*'([^']+)'"

# --- deduplication ----------------------------------------------------------------
KEY_LEAD_INS = r"^(?:flash sale!|labor day savings!|today only|limited time offer)\s*"
KEY_PERCENT_OFF = r"\b\d+(?:\.\d+)?%\s+off\b"
KEY_AMOUNT_OFF = r"[$]\d+(?:\.\d{1,2})?\s+off\b"

# --- store names ------------------------------------------------------------------
STORE_PATH_PREFIXES = ("store/", "view/", "coupons/", "brand/", "shop/")
STORE_SUFFIXES = (
    r"^(.*?)\s+(?:Coupons?|Promo(?:\s*Codes?)?|Deals?|Discounts?|Offers?)\b",
    r"^(.*?)\s+(?:优惠|折扣|特价|促销)\b",
    r"^(.*?)\s*[（(]",
)

# --- HTML cleaning ----------------------------------------------------------------
REMOVED_TAGS = ("script", "style", "noscript", "svg", "canvas", "iframe")
STRUCTURAL_TAGS = ("nav", "footer", "header", "aside")
HIDDEN_STYLES = ("display:none", "visibility:hidden", "opacity:0")
NOISE_ATTRIBUTE_WORDS = (
    "header", "footer", "nav", "navbar", "menu", "sidebar", "sbar", "toolbar", "popup",
    "popover", "modal", "dialog", "cookie", "banner", "subscribe", "newsletter",
    "social", "share", "breadcrumb", "pagination", "pager", "related", "recommend",
    "hot-sale", "hotword", "download-app", "app-download", "notification", "alert",
    "chat", "support", "help-center", "footer__", "header__",
)
NOISE_ROLES = (
    "navigation", "banner", "contentinfo", "complementary", "dialog", "alertdialog",
)
EMPTY_WRAPPER_TAGS = ("div", "span", "section")
NON_EMPTY_MARKERS = ("img", "video", "iframe", "a", "button", "input", "textarea")

# --- DOM containers ---------------------------------------------------------------
CONTAINER_CLASS_WORDS = (
    "coupon", "deal", "offer", "promo", "discount", "voucher", "code-", "savings",
    "reward",
)
CONTAINER_DATA_ATTRIBUTES = (
    "data-coupon", "data-code", "data-offer", "data-deal", "data-promo",
    "data-discount",
)

# --- URL lists and URL errors -----------------------------------------------------
URL_HEADERS = (
    "url", "urls", "link", "links", "website", "web_url", "page_url", "source_url",
    "deal_url", "merchant_url",
)
URL_EMPTY = "URL cannot be empty."
URL_BAD_SCHEME = "URL must use http or https."
URL_NO_DOMAIN = "URL is missing a valid domain."
EMPTY_PAGE_PREFIX = "No usable content was extracted from "

# --- model fallback tables --------------------------------------------------------
FALLBACK_PROMPT_PREFIX = (
    "Extract only deals and coupons from the text below. "
    "Ignore headers, footers, navigation, and unrelated site chrome.\n\n"
)
NO_DEALS = "NO_DEALS_FOUND"
NO_TITLE = "(no title)"

# --- output columns ---------------------------------------------------------------
RECORD_FIELDS = (
    "store", "offer", "source", "offer_type", "coupon_code", "discount_percent",
    "discount_amount", "max_discount_amount", "cashback_percent", "min_spend",
    "discount_type", "expiry", "expiry_type", "confidence", "reasons",
)
CSV_FIELDS = (
    "store", "offer", "source", "offer_type", "coupon_code", "discount_percent",
    "discount_amount", "max_discount_amount", "cashback_percent", "min_spend",
    "expiry", "expiry_type", "confidence",
)
SUMMARY_FIELDS = (
    "row_number", "requested_url", "status", "final_url", "title", "status_code",
    "elapsed_ms", "overall_confidence", "candidate_count", "used_llm_fallback",
    "fallback_error", "top_offer", "top_offer_type", "html_path", "text_path",
    "deals_path", "error",
)
