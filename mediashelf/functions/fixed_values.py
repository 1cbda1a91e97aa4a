"""Word lists, lookup tables and thresholds whose exact content defines the results."""

# --- uploads -------------------------------------------------------------------------------------
IMAGE_MIME = r"^image/(jpeg|png|gif|webp|bmp|heic|heif|avif|tiff)$"
DOCUMENT_MIME = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".txt": "text/plain",
    ".md": "text/markdown",
}
MAX_IMAGE_MB = 25
MAX_DOC_MB = 50
PROVIDERS = {1: "gdrive", 2: "dropbox", 4: "koofr", 5: "pcloud"}

# --- passages ------------------------------------------------------------------------------------
CHUNK_WORDS = 300
CHUNK_OVERLAP = 50
SNIPPET_WORDS = 40
EXCERPT_CHARS = 400
TITLE_CHARS = 300
COVERAGE_STOP_WORDS = (
    "the", "and", "for", "with", "about", "from", "that", "this",
    "what", "how", "are", "was", "pdf", "pdfs", "doc", "docs",
)

# --- file names and capture facts ----------------------------------------------------------------
FILENAME_NOISE = (
    "img", "image", "dsc", "dcim", "pxl", "photo", "pic", "screenshot", "copy", "final",
    "edited", "jpg", "jpeg", "png", "heic", "webp", "whatsapp", "wa", "signal", "scan",
)
FILENAME_DATE = r"(20\d{2})[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12]\d|3[01])"
HOLIDAY_WORDS = {
    "12-24": "christmas eve holidays",
    "12-25": "christmas day holidays",
    "12-31": "new year's eve nye holidays",
    "01-01": "new year's day holidays",
    "02-14": "valentine's day",
    "10-31": "halloween",
}

# --- query language ------------------------------------------------------------------------------
KINDS = ("photo", "screenshot", "document", "receipt", "illustration", "chart", "meme")
KIND_WORDS = {
    "screenshot": "screenshot", "screenshots": "screenshot",
    "screen shot": "screenshot", "screen shots": "screenshot",
    "receipt": "receipt", "receipts": "receipt", "bill": "receipt", "bills": "receipt",
    "invoice": "receipt", "invoices": "receipt",
    "document": "document", "documents": "document", "scan": "document", "scans": "document",
    "pdf": "document", "pdfs": "document", "doc": "document", "docs": "document",
    "illustration": "illustration", "illustrations": "illustration",
    "drawing": "illustration", "drawings": "illustration",
    "chart": "chart", "charts": "chart", "diagram": "chart", "diagrams": "chart",
    "meme": "meme", "memes": "meme",
}
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
MONTH_ALIASES = {"sept": 9}  # besides the three-letter forms
SEASON_MONTHS = {"spring": (3, 5), "summer": (6, 8), "autumn": (9, 11), "fall": (9, 11), "winter": (12, 2)}
PREPOSITION = r"(?:\b(?:in|at|from|during|on|of|with|near|around|taken)\s+)?"
FILLER_WORDS = (
    r"\b(show me|find me|find|search for|search|look for|show|give me|get me|all( of)? my|all|my|our|some|any|the)\b"
)
GENERIC_WORDS = r"\b(photos?|pictures?|pics?|images?|shots?|snaps?)\b"
EDGE_WORDS = "of|from|in|at|on|with|during|taken|and"
NAME_SIMILARITY = 0.75
LETTERS_BY_RARITY = "zqxjkvbpygfwmucldrhsnioate"  # rarest first; any order gives the same pairs of words

# --- ranking -------------------------------------------------------------------------------------
STRONG_MARGIN = 0.05
GOOD_MARGIN = 0.03
MIN_MARGIN = 0.015
BM25_K1 = 1.2
BM25_B = 0.75
RERANK_TOP_N = 12

# --- geography -----------------------------------------------------------------------------------
EARTH_KM = 6371.0
CITY_KM = 40.0
REGION_KM = 160.0
METRO_KM = 25.0
METRO_POPULATION = 500_000
METRO_RATIO = 5

# --- faces and queues ----------------------------------------------------------------------------
FACE_THRESHOLD = 0.42
FACE_NEIGHBOURS = 5
FACES_PER_FILE = 20
MAX_PRIORITY = 2_097_151
SCALING_RULES = (
    # service, stages, target backlog per replica, min, max
    ("worker", ("upload", "embed", "faces", "finalize"), 20, 1, 8),
    ("ml", ("embed", "faces"), 10, 1, 3),
)
