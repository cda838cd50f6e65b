"""Constants, patterns and formats that results depend on."""

# Every character that counts as white space, as a class for Java's and RE2's patterns.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# The same characters as a string.
WS_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# Identity formats.
FINGERPRINT_CHARS = 12
URL_HASH_CHARS = 8
SELECTOR_PREFIX = "#acg-chunk-"
AUTO_SELECTOR = "#acg-auto"
PROTOCOL = "ACG/1.0"

# Abbreviations whose dots end no sentence, and the stand-in for those dots.
ABBREVIATIONS = ("Mr.", "Mrs.", "Dr.", "Prof.", "Sr.", "Jr.", "vs.", "etc.", "e.g.", "i.e.")
DOT = "@@@"

# Marker formats.
CLAIM_MARKER = r"\[C([0-9]+):([a-f0-9]{12}):css=([^\]]+)\]"
RELATION_TYPES = ("SUMMARY", "CONTRADICTION", "EXTENSION", "CAUSAL", "ANALOGY")
RELATION_MARKER = r"\(R([0-9]+):(SUMMARY|CONTRADICTION|EXTENSION|CAUSAL|ANALOGY):(C[0-9]+(?:,C[0-9]+)*)\)"

# What tells a page that is drawn by scripts.
SCRIPT_SIGNS = (
    'id="root"', 'id="__next"', 'id="app"', 'id="__nuxt"', "data-server-rendered", "ng-app", "ng-view",
    "react-root", "vue-app", '<div id="root"', '<div id="__next"', '<div id="app"',
    'class="theme-doc-markdown"', "data-docusaurus",
)

# Links that are no pages.
SKIPPED_SCHEMES = ("javascript", "mailto", "tel", "sms", "data", "file")
SKIPPED_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".tar", ".gz", ".rar", ".7z",
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".ico", ".webp", ".mp3", ".mp4", ".avi", ".mov",
    ".wmv", ".flv", ".exe", ".dmg", ".msi", ".deb", ".rpm", ".woff", ".woff2", ".ttf", ".eot",
)

# Subtrees without text of the page, and the order entities are decoded in.
DROPPED_TAGS = ("script", "style", "noscript", "iframe", "svg", "nav", "footer")
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
