"""Lists, patterns and thresholds that decide results. Change them and results change."""

# --- images ------------------------------------------------------------------------------
IMAGE_EXT = r"(?i)\.(png|jpe?g|webp|gif|svg|avif)(\?|$)"
LAZY_ATTRS = ["src", "data-src", "data-original", "data-lazy-src"]

# ordered: the first needle found decides
ROLE_HINTS = [
    ("favicon", "icon"),
    ("partenaire", "partner"),
    ("partner", "partner"),
    ("sponsor", "partner"),
    ("exposant", "partner"),
    ("hero", "hero"),
    ("key-visual", "hero"),
    ("slide", "hero"),
    ("banner", "banner"),
    ("logo-salon", "logo"),
    ("logo-site", "logo"),
    ("brand", "logo"),
    ("actu", "card"),
    ("news", "card"),
    ("card", "card"),
    ("vignette", "card"),
    ("thumb", "card"),
    ("teaser", "card"),
    ("icon", "icon"),
    ("logo", "partner"),
]
DEFAULT_ROLE = "content"

MIME_BY_EXT = [
    ("png", "image/png"),
    ("gif", "image/gif"),
    ("webp", "image/webp"),
    ("svg", "image/svg+xml"),
]
DEFAULT_MIME = "image/jpeg"

# --- markup ------------------------------------------------------------------------------
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
TEXT_TAGS = ["p", "li", "blockquote"]
CHROME_TAGS = ["script", "style", "nav", "footer", "header"]
ITEM_MARKERS = [
    "card",
    "vignette",
    "mosaic-item",
    "partner-item",
    "popin-item",
    "tab-pane",
    "accordion-item",
    "speaker",
    "conference-item",
]
FIELD_PREFIX = "field-"
LAYOUT_CLASS = (
    r"^(component|component-content|container|container-fluid|row|col|col-\w+|mb-\d+|mt-\d+|"
    r"p-\d+|px-\d+|py-\d+|g-\d+|gap-\d+|d-\w+|text-\w+|fw-\w+|fs-\w+|w-\d+|h-\d+|align-\w+|"
    r"justify-\w+)$"
)
INVENTORY_LAYOUT_CLASS = (
    r"^(component-content|container|container-fluid|row|col|col-\w+|mb-\d+|mt-\d+|mx-\w+|my-\w+|"
    r"m-\d+|px-\d+|py-\d+|p-\d+|pt-\d+|pb-\d+|ps-\d+|pe-\d+|ms-\w+|me-\w+|g-\d+|gap-\d+|align-\w+|"
    r"align-items-\w+|justify-\w+|justify-content-\w+|d-\w+|d-md-\w+|d-lg-\w+|d-md-down-none|"
    r"text-\w+|fs-\w+|fw-\w+|w-\d+|h-\d+|mw-\d+|height0|parent-row|clearfix|initialized|active|"
    r"show|first|last|odd|even|rel-level\d|level\d|item\d+|submenu|background-img)$"
)
BRAND_ICONS = ["fa-instagram", "fa-facebook-f", "fa-linkedin-in", "fa-x-twitter", "fa-youtube"]
CARD_CLASS = r"(card|push-item|grid-)"
BLOCK_CLASS = r'(?i)class="[^"]*(block|section|card|hero|grid)'
ERROR_MARKERS = (
    r"(?i)(?:node type does not exist|invalidqueryexception|repositoryexception|"
    r"pathnotfoundexception|itemnotfoundexception|javax\.jcr\.[a-z]+exception|"
    r"error rendering [^<]*)[^<]*"
)

# --- source platforms: ordered, ties go to the earlier one -----------------------------------
SIGNATURES = [
    ("sitecore-sxa", [r"/-/media/", r'class="[^"]*\bcomponent\b', r"field-", r"data-sc-", r"\bsxa\b"]),
    ("drupal", [r"drupal-settings-json", r"/sites/default/files", r"data-drupal", r"\bDrupal\b"]),
    ("wordpress", [r"/wp-content/", r"/wp-json/", r"/wp-includes/", r'class="[^"]*\bwp-']),
    ("aem", [r"/etc\.clientlibs/", r"/content/dam/", r"\bcq:", r"data-sly-", r"\bgranite\b"]),
]
MIN_SIGNATURE_HITS = 2

# --- fetching ----------------------------------------------------------------------------
CHALLENGE = (
    r"(?i)just a moment|cf-chl|attention required|access denied|enable javascript and cookies|"
    r"__cf_chl|cf-browser-verification"
)
BLOCK_CODES = [403, 429, 500, 502, 503, 520, 521, 522, 523, 524]
THROTTLE_CODES = [403, 429, 503, 520, 522]

# --- names -------------------------------------------------------------------------------
LOCALE_ROOT = r"^[a-z]{2}(-[A-Z]{2})?$"
DEBRIS_NAME = r"^(test|untitled|copy-of|temp)|-old"
PARTNER_CATEGORIES = [
    ("Logo-Instit", "institutionnels"),
    ("Logo-Animations", "animations"),
    ("Logo-Media", "medias"),
    ("Nouveaux-logos-medias", "medias"),
    ("Logo-Salon", "salons"),
    ("Logo-Insight", "insights"),
]
DEFAULT_PARTNER_CATEGORY = "medias"

# --- load planning -----------------------------------------------------------------------
IMAGE_PROPERTIES = ["image", "backgroundImage", "logo", "photo", "icon"]
GATE_IMAGE_PROPERTIES = [
    "image",
    "backgroundImage",
    "logo",
    "photo",
    "visual",
    "bannerImage",
    "thumbnailImage",
]
AREA_NAMES = [("mainNav", "nav"), ("footer", "footer"), ("topBar", "topBar")]

# --- style sheets ------------------------------------------------------------------------
CSS_BLOCK = r"\{([^{}]*)\}"
COLOR = r"(?i)#(?:[0-9a-f]{8}|[0-9a-f]{6}|[0-9a-f]{4}|[0-9a-f]{3})\b|rgba?\([^)]*\)"
COLOR_LEGACY = r"(?i)#(?:[0-9a-f]{8}|[0-9a-f]{4}|[0-9a-f]{3})\b|rgba?\([^)]*\)"
FONT_FAMILY = r"(?i)font-family\s*:\s*([^;]+)"
NEUTRAL_BELOW_SATURATION = 0.15
LIGHT_ABOVE = 0.80
DARK_BELOW = 0.22
SEMANTIC_COLORS = ["primary", "secondary", "accent", "text", "bg"]

# --- gates -------------------------------------------------------------------------------
HEADING_MIN_PCT = 85
HEADING_MIN_COUNT = 3
MIN_IMAGES = 5
MIN_CARDS = 4
MIN_TEXT_CHARS = 500
IMPORT_MIN_RATE = 0.6
TRANSLATION_MAX_GAP = 0.2
LISTING_MIN_RATIO = 0.5

MONTHS = {
    "en": [
        "January", "February", "March", "April", "May", "June",
        "July", "August", "September", "October", "November", "December",
    ],
    "fr": [
        "janvier", "février", "mars", "avril", "mai", "juin",
        "juillet", "août", "septembre", "octobre", "novembre", "décembre",
    ],
    "de": [
        "Januar", "Februar", "März", "April", "Mai", "Juni",
        "Juli", "August", "September", "Oktober", "November", "Dezember",
    ],
}
