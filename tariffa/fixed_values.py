"""Word lists, patterns, names and thresholds that results depend on.

Every value in this file is a constant of the data format. Operators take most of
them as default parameters, so a caller can pass other lists.
"""

# ---------------------------------------------------------------- statuses
STATUSES = (
    "available", "blank", "sold_out", "no_flex", "room_na", "not_loaded",
    "third_party_only", "one_guest_only", "los_restricted",
)
EXCLUDED_STATUSES = (
    "sold_out", "los_restricted", "room_na", "blank", "not_loaded", "no_flex",
    "third_party_only", "one_guest_only",
)
STATUS_WORDS = (
    ("sold out", "sold_out"),
    ("no flex", "no_flex"),
    ("room n/a", "room_na"),
    ("room na", "room_na"),
    ("3rd party only", "third_party_only"),
    ("1 guest only", "one_guest_only"),
)
NOT_LOADED_MARK = "--"
LOS_WORD = r"^(?i)los(\d+)$"
UNKNOWN_STATUS_PREFIX = "unknown_sentinel:"

# ---------------------------------------------------------------- wide sheets
SHEET_METADATA_HEADERS = ("Day", "Date", "My OTB", "Market OTB", "Market demand")
SHEET_DATE_HEADER = "Date"
SHEET_REQUIRED_HEADERS = ("Date", "Market demand", "Market OTB")
SHEET_LOS_PATTERN = r"(?i)_los(\d+)_"
SHEET_AS_OF_PATTERN = r"(\d{4}-\d{2}-\d{2})"
SHEET_UPDATED_PATTERN = r"^\s*(\d{1,2})/(\d{1,2})\s+\d{1,2}:\d{2}\s*$"
SERIAL_DAY_ORIGIN = "1899-12-30"

# ---------------------------------------------------------------- refundability
REFUNDABLE, NON_REFUNDABLE, UNKNOWN = "REFUNDABLE", "NON_REFUNDABLE", "UNKNOWN"
NON_REFUNDABLE_PHRASES = ("non-refundable", "non refundable", "nonrefundable")
REFUNDABLE_PHRASES = ("free cancellation", "fully refundable", "refundable")
NON_REFUNDABLE_LABELS = (
    "non-refund", "non refund", "nonrefund", "prepay", "pre-pay", "pre paid", "prepaid",
    "pay now", "pay-now", "advance purchase", "advance-purchase",
)
REFUNDABLE_LABELS = ("free cancellation", "fully refundable", "pay flex", "pay-flex")
FLAG_OFF_PHRASES = ("non-refund", "non refund", "nonrefund")

# Member and card labels: the labels that rule a plan out as the posted rate, without
# the non-refundable words (those plans are candidates).
MEMBER_OR_CARD_LABELS = (
    "member-only", "member only", "genius",
    "marriott bonvoy", "hilton honors", "world of hyatt",
    "visa offer", "mastercard offer", "amex offer",
    "mobile-only", "mobile only", "mobile app", "app-only", "app only", "app deal",
    "aaa ", "aaa rate", "aarp", "senior ", "government rate", "gov rate",
    "family pack", "package", "opaque",
)

# ---------------------------------------------------------------- rate plan buckets
RATE_PLAN_BUCKETS = (
    "BAR_NON_REF", "BAR_FLEX", "BUNDLED_PARKING_NON_REF", "BUNDLED_PARKING_FLEX",
    "MEMBER_OR_CARD_OFFER",
)
BUNDLE_ANCHOR = r"(?:\+|\bincludes?\b|\bincl\.?|\bwith)\s*(?:\d+\s+)?"
# (pattern after the anchor, name, words of which a matching label holds one)
BUNDLE_WORDS = (
    (r"(?:parking|valet)\b", "parking", ("parking", "valet")),
    (r"(?:wi[\s-]?fi|internet)\b", "wifi", ("fi", "internet")),
    (r"breakfast\b", "breakfast", ("breakfast",)),
    (r"(?:resort|dining|f\s*&\s*b)\s+credit\b", "credit", ("credit",)),
    (r"(?:transfer|airport\s+shuttle)\b", "transfer", ("transfer", "shuttle")),
)

# Reservation-system rate metadata
CRS_NON_REFUNDABLE = r"\b(?:non[\s-]?refund\w*|non[\s-]?cancel\w*|no[\s-]?refund\w*)\b"
CRS_PAY_NOW = r"\bpay\s+now\b"
CRS_FLEXIBLE = r"\b(?:flexible|free\s+cancellation|fully\s+refundable)\b"
CRS_CANCEL_WORD = r"\bcancel\w*\b"

# ---------------------------------------------------------------- promo signals
# (kind, pattern, group holding a percentage or 0, words of which every match holds one)
PROMO_PATTERNS = (
    ("PAY_NOW_AND_SAVE", r"\bpay\s+now\s+and\s+(?:save|enjoy\s+savings)\s+up\s+to\s+(\d{1,3})", 1, ("pay",)),
    ("PAY_NOW_AND_SAVE", r"\bpay\s+now,?\s+stay\s+\d+\+?\s+and\s+save", 0, ("pay",)),
    ("PERCENT_OFF_BANNER", r"\b(\d{1,3})\s*%\s*off\b", 1, ("%",)),
    ("PERCENT_OFF_BANNER", r"\bsave\s+up\s+to\s+(\d{1,3})\s*p?c?t\b", 1, ("save",)),
    ("WEEKLY_RATE_DISCLOSURE", r"\breduced\s+weekly\s+rate\b", 0, ("weekly",)),
    ("VISA_MC_OFFER",
     r"(?:visa|mastercard|\bmc\b|amex|american\s+express|world\s+of\s+hyatt)[^.\n]{0,120}up\s+to\s+(\d{1,3})\s*p?c?t", 1,
     ("visa", "mastercard", "mc", "amex", "american", "hyatt")),
    ("VISA_MC_OFFER", r"\bup\s+to\s+(\d{1,3})\s*p?c?t\s+off\s+best\s+flexible\s+rate\b", 1, ("flexible",)),
    ("MEMBER_GATED_OFFER", r"\bsign\s+in\s+to\s+(?:see|save|unlock|view)[^\n.]{0,120}", 0, ("sign",)),
    ("MEMBER_GATED_OFFER", r"\bmembers?\s+only\s+rate\b", 0, ("member",)),
)
POSTED_PROMO_KINDS = ("PAY_NOW_AND_SAVE", "PERCENT_OFF_BANNER", "WEEKLY_RATE_DISCLOSURE")
FENCED_PROMO_KINDS = ("VISA_MC_OFFER", "MEMBER_GATED_OFFER")
WEEKLY_DISCLOSURE = r"weekly\s*rate\s*-?\s*\$[\d,]+(?:\.\d{2})?[^\n]*(?:reduced\s+weekly\s+rate[^\n]*)?"
WEEKLY_DISCLOSURE_HINT, MEMBER_GATE_HINTS = "weekly", ("sign", "member")
MEMBER_GATE = (
    r"\bsign\s+in\s+to\s+(?:see|save|unlock|view)|members?\s+only\s+rate|"
    r"sign\s+in\s+for\s+(?:a\s+)?(?:member|genius|loyalty)\s+(?:price|rate|discount)"
)

# ---------------------------------------------------------------- page gates
BLOCK_SIGNATURES = (
    "captcha-delivery", "we can't tell if you're a human", "access denied",
    "pardon our interruption", "please verify you are a human", "checking your browser",
    "something isn't quite right", "enable javascript and cookies to continue",
    "just a moment", "cloudflare ray id", "403 forbidden", "request unsuccessful",
    "you have been blocked", "bot or not", "powered and protected by", "![akamai]",
    "request blocked",
)
NO_INVENTORY_SIGNATURES = (
    "we have no availability here between", "not available on our site for your dates",
    "no availability", "sold out", "no rooms available",
)
BROKEN_PAGE_SIGNATURES = (
    "404 not found", "page not found", "this page doesn't exist", "we couldn't find",
    "could not find", "hotel not found",
)
BLOCKED_CELL_WORDS = (
    "http_404", "http_410", "http_5xx", "url_broken", "bot_blocked", "datadome",
    "imperva", "captcha",
)
PLACEHOLDER_NAME = r"(?i)\b(example|sample|demo)\b|^\s*test\s*$"
MIN_RATE, MAX_RATE, PLACEHOLDER_CEILING = 100.0, 10000.0, 250.0
YEAR_TOKENS = (2026, 2027)
DECLARED_ROOMS = r"(?i)Showing\s+(\d+)\s+of\s+(\d+)\s+rooms?"
VARIANCE_PATTERNS = (
    ("H Street View", r"(?:###|\|\s*\[)[^\n|]*h\s*street\s*view", r"h\s*street\s*view"),
    ("Platinum Suite", r"(?:###|\|\s*\[)[^\n|]*platinum\s*suite", r"platinum\s*suite"),
    ("Penthouse", r"(?:###|\|\s*\[)[^\n|]*penthouse", r"penthouse"),
    ("Private Terrace", r"(?:###|\|\s*\[)[^\n|]*private\s*terrace", r"private\s*terrace"),
    ("Duplex", r"(?:###|\|\s*\[)[^\n|]*duplex", r"duplex"),
    ("Accessible", r"(?:###|\|\s*\[)[^\n|]*(?:accessible|mobility)", r"accessible|mobility"),
)
EXPECTED_ROOMS = (("direct", 18), ("booking", 12), ("hotels_com", 17), ("expedia", 18))

# ---------------------------------------------------------------- tier rows of a room block
TIER_ROW = (
    r"(?i)(Non-Refundable|Fully refundable(?:\s+before\s+[A-Za-z0-9, ]+?)?)\s*\n"
    r"\\\+\s*\$([\d,]+)(Reserve now, pay (?:deposit|later))"
)
LEAD_IN_NIGHTLY = r"(?i)\$([\d,]+)\s*nightly"
STAY_TOTAL = r"(?i)(?:current price is|price is)\s+\$([\d,]+)\s*total"
PHOTO_HEADING = "view all photos for"
BLOCK_END = r"(?m)^##\s+(?:Have a question\?|Similar properties)"

# ---------------------------------------------------------------- cell statuses
PICK_SENTINELS = ("FAIL_NO_BARE_NON_REF", "FAIL_NO_BAR_FLEX")
SENTINELS = PICK_SENTINELS + ("FAIL_ROOM_COUNT_SHORT",)
EXTRACTED_STATUSES = ("ok", "extract_incomplete", "compression_short", "no_inventory")
FAILED_KINDS = ("http_error", "extract_failed", "bot_blocked")
OUTCOME_KINDS = (
    "ok", "bot_blocked", "extract_failed", "extract_incomplete", "http_error", "no_url",
    "no_inventory", "FAIL_URL_BROKEN",
)
CREDITS_BASIC, CREDITS_STEALTH, CREDIT_CEILING = 5, 25, 5500

# ---------------------------------------------------------------- analysis thresholds
CORR_DEMAND_MIN, CORR_DEMAND_LOW_N = 0.30, 30
CORR_DIFF_MIN, CORR_DIFF_LOW_N = 0.10, 100
CORR_LEVEL_MIN, CORR_LEVEL_LOW_N = 0.20, 100
WEEK_RANGE_MIN, WEEK_RANGE_LOW_N = 0.10, 30
FLAT_MIN_DAYS, FLAT_MAX_STEP = 10, 0.05
FLAT_COMBOS = (
    ("default", 10, 0.05), ("tightened", 10, 0.03), ("loosened", 10, 0.10), ("longer", 14, 0.05),
)
SHOULDER_FROM, HIGH_FROM = 0.50, 0.80
NOISE_USD, YIELDS_USD, MIN_HIGH_ROWS = 25.0, 50.0, 5
HIGH_DEMAND = 0.90
DIAGNOSTIC_GAP, ANTI_YIELD = 0.20, -0.10
GREEN_FROM, YELLOW_FROM, RATE_TOLERANCE = 0.95, 0.80, 0.02
SPREAD_LABELS = (
    ("YIELDS_WITH_MARKET", "Yields with market"),
    ("PARTIALLY_DYNAMIC", "Partially yields with market"),
    ("ANCHORED", "Anchored — flat vs comp set across demand buckets"),
    ("ANTI_YIELDS", "Anti-yields — discount widens on compression"),
    ("INSUFFICIENT_DEMAND_WINDOW", "Insufficient high-demand sample (n < 5)"),
)

# ---------------------------------------------------------------- verification fields
# field: (expected keys, actual keys)
VERIFY_FIELDS = {
    "bar_non_ref_nightly_allin": (("bar_non_ref_nightly_allin",), ("bar_non_ref_nightly_allin",)),
    "promo_banner_text": (("promo_banner_text_contains", "promo_banner_text"), ("promo_banner_text",)),
    "promo_banner_pct": (("promo_banner_pct",), ("promo_banner_pct",)),
    "weekly_rate_disclosure_present": (
        ("weekly_rate_disclosure_present",), ("weekly_rate_disclosure_present", "weekly_rate_disclosure")),
    "bundle_inclusions": (("bundle_inclusions",), ("bundle_inclusions",)),
    "marketing_name_verbatim": (
        ("marketing_name_verbatim",), ("marketing_name_verbatim", "marketing_name_actual", "marketing_name")),
    "member_rate_gated": (("member_rate_gated",), ("member_rate_gated",)),
    "min_rate_rows_visible": (
        ("min_rate_rows_visible", "expected_min_rate_rows"), ("min_rate_rows_visible", "rate_rows_visible")),
    "room_type_canonical_present": (
        ("room_type_canonical_present",), ("room_type_canonical_present", "room_canonical_resolved")),
    "rate_plan_label": (("rate_plan_label",), ("rate_plan_label",)),
}
TRACKED_FIELDS = (
    "bar_non_ref_nightly_allin", "promo_banner_text", "promo_banner_pct",
    "weekly_rate_disclosure_present", "bundle_inclusions", "marketing_name_verbatim",
    "member_rate_gated", "min_rate_rows_visible", "room_type_canonical_present",
)
CRITICAL_FIELDS = ("bar_non_ref_nightly_allin", "marketing_name_verbatim", "room_type_canonical_present")
TRUTH_FIELDS = (
    "bar_non_ref_nightly_allin", "marketing_name_verbatim", "room_type_canonical_present",
    "promo_banner_text", "promo_banner_pct", "rate_plan_label",
)

# ---------------------------------------------------------------- room names to SKUs
ROOM_SKUS = {
    "1 King Bed": "hr_king",
    "2 Queen Beds": "hr_2queen",
    "1 King Bed Bay View": "hr_king_bay",
    "2 Queen Beds Bay View": "hr_2queen_bay",
    "1 King Bed Bay View Balcony": "hr_king_bay_balcony",
    "1 King Bay View High Floor Balcony": "hr_king_bay_balcony_high",
    "2 Queen Beds City View Balcony": "hr_2queen_city_balcony",
    "1 King Water View": "hr_king_water",
    "1 King Bed Club Access": "hr_king_club",
    "2 Double Beds Club Access": "hr_2double_club",
    "Accessible 1 King Bed with Tub": "hr_ada_king_tub",
    "Accessible 1 King Bed with Shower": "hr_ada_king_shower",
    "Accessible 2 Queen Beds with Tub": "hr_ada_2queen_tub",
    "Accessible 2 Queen Beds with Shower": "hr_ada_2queen_shower",
    "Bay View Studio Suite": "hr_suite_bay_studio",
    "Balcony Suite": "hr_suite_balcony",
    "Luxury Suite": "hr_suite_luxury",
    "Presidential Suite": "hr_suite_presidential",
    "King Room": "hr_king",
    "Queen Room with Two Queen Beds": "hr_2queen",
    "King Room with Bay View": "hr_king_bay",
    "King Room with Balcony and Bay View": "hr_king_bay_balcony",
    "King Room with Balcony and Bay View - High Floor": "hr_king_bay_balcony_high",
    "Two Queens Room with Balcony and City View": "hr_2queen_city_balcony",
    "King Room with Water View": "hr_king_water",
    "King Room - Club Access": "hr_king_club",
    "Double Room with Two Double Beds - Club Access": "hr_2double_club",
    "King Room with Accessible Tub - Disability Access": "hr_ada_king_tub",
    "Queen Room with Two Queen Beds and Accessible Tub": "hr_ada_2queen_tub",
    "Queen Room with Two Queen Beds and Accessible Shower": "hr_ada_2queen_shower",
    "Room, 1 King Bed": "hr_king",
    "Room, 2 Queen Beds": "hr_2queen",
    "Room, 1 King Bed, Bay View": "hr_king_bay",
    "Room, 1 King Bed, Balcony, Bay View": "hr_king_bay_balcony",
    "Room, 1 King Bed, Balcony, Bay View (High Floor)": "hr_king_bay_balcony_high",
    "Room, 2 Queen Beds, Balcony, City View": "hr_2queen_city_balcony",
    "Room, 1 King Bed (Ferry View)": "hr_king_water",
    "Club Room, 1 King Bed (Regency Club Breakfast)": "hr_king_club",
    "Club Room, 2 Double Beds (Regency Club Breakfast)": "hr_2double_club",
    "Room, 1 King Bed, Accessible, Bathtub": "hr_ada_king_tub",
    "Room, 2 Queen Beds, Accessible, Bathtub": "hr_ada_2queen_tub",
    "Room, 2 Queen Beds, Accessible (Shower)": "hr_ada_2queen_shower",
    "Studio, Bay View": "hr_suite_bay_studio",
}
