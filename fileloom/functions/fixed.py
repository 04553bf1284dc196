"""Names, extensions and patterns whose meaning is part of the results."""

# --- fixed values: system junk of the cross-folder duplicate finder
JUNK_NAMES = [".ds_store", "thumbs.db", "desktop.ini", ".localized", ".spotlight-v100"]
JUNK_EXTENSIONS = [".tmp", ".temp", ".download", ".crdownload", ".part"]

# --- fixed values: junk of the resolver
RESOLVER_JUNK_NAMES = ["desktop.ini", "thumbs.db", ".ds_store", "icon\r", ".picasa.ini"]

# --- fixed values: file types of the routing rules
MEDIA_EXTENSIONS = [
    ".mp4", ".mov", ".avi", ".mkv", ".webm", ".flv", ".wmv", ".m4v", ".mpg", ".mpeg", ".m2ts", ".mts", ".prores",
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tiff", ".tif", ".heic", ".raw", ".cr2", ".nef", ".arw", ".dng",
    ".mp3", ".wav", ".aif", ".aiff", ".flac", ".m4a", ".aac", ".ogg",
    ".psd", ".ai", ".indd", ".eps", ".svg", ".sketch", ".fig", ".xd", ".aep", ".prproj", ".fcpx", ".c4d", ".blend",
]
BUSINESS_EXTENSIONS = [
    ".doc", ".docx", ".pdf", ".xls", ".xlsx", ".ppt", ".pptx", ".csv", ".txt", ".rtf", ".odt", ".ods", ".odp",
    ".pages", ".numbers", ".key", ".msg", ".eml", ".one",
]
TRIVIAL_NAMES = [".ds_store", "thumbs.db", "desktop.ini", "icon\r", ".localized"]
TRIVIAL_EXTENSIONS = [".tmp", ".temp", ".log", ".bak", ".old", ".cache", ".part", ".crdownload", ".~lock"]
LOW_VALUE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".psd", ".ai", ".eps"]
OBSOLETE_YEARS = 4.0

# --- fixed values: project and framework paths
STRUCTURAL_SEGMENTS = [
    "wwwroot", "views", "node_modules", ".git", "vendor", "bin", "obj", "packages", "dist", "build", ".next",
    "silverstripe-cache", "cache", "sapphire", "_prfiles", "adobe premiere pro auto-save",
    "adobe premiere pro video previews", "adobe premiere pro audio previews", ".vs", "__pycache__", "site-packages",
    "lib", "libs", "assets", "framework", "themes", "modules", "plugins",
]
STRUCTURAL_SUFFIX = r"(?i)\.(cshtml|aspx|ascx|master|config|dll|so|dylib|min\.js|min\.css)$"

# --- fixed values: markers in names
PAREN_COPY = r" \(\d+\)(\.[^.]+)?$"
REVISION_MARK = r"(?i)-at-\d[\d\-t:_.z]*"
TRANSFER_SEGMENT = r"(?i)[^\\/]+[’'](?:s)? files(?:[\\/]|$)"
CJK = "[㐀-鿿豈-﫿]"
REVISION_TAIL = r"-at-\d[\d\-t:_.z]*(?:-p[a-z]*)?(\.[a-z0-9]{1,7})?$"
REVISION_STUB = r"-at-?$"
PINNED_NAME = r"(?i)-pinned\.[^.]+$"
PINNED_STAMP = r"(?i)-at-\d{4}-\d\d-\d\dt[\d_.]+z-pinned$"
PINNED_END = r"(?i)-pinned$"
LEADING_DATE = r"^\s*(\d{2,4}[.\-_]\d{1,2}[.\-_]\d{1,2})"
LEAD_INS = r"(?:live\s+webinar|webinar|hplive\s+webinar|hpl\s+live)\s*[-:.\s]*"

# --- fixed values: kinds of files for naming conventions
TYPE_GROUPS = {
    "image": [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tiff", ".tif", ".heic", ".svg"],
    "raw_image": [".cr2", ".cr3", ".nef", ".arw", ".dng", ".raf", ".orf", ".rw2"],
    "video": [".mp4", ".mov", ".avi", ".mkv", ".webm", ".flv", ".wmv", ".m4v", ".mpg", ".mpeg"],
    "audio": [".mp3", ".wav", ".m4a", ".aac", ".flac", ".ogg", ".wma"],
    "document": [".doc", ".docx", ".odt", ".rtf", ".txt", ".md", ".pages"],
    "spreadsheet": [".xls", ".xlsx", ".xlsm", ".csv", ".tsv", ".ods", ".numbers"],
    "presentation": [".ppt", ".pptx", ".odp", ".key"],
    "pdf": [".pdf"],
    "graphic": [".psd", ".ai", ".eps", ".indd", ".sketch", ".fig", ".xd", ".afphoto", ".afdesign"],
    "archive": [".zip", ".rar", ".7z", ".tar", ".gz"],
}
#: How a file is read for analysis, by its ending, and how much of it.
READ_CLASSES = {
    "image": [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tiff", ".svg"],
    "video": [".mp4", ".avi", ".mov", ".mkv", ".webm", ".flv", ".wmv", ".m4v"],
    "document": [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx"],
    "text": [
        ".txt", ".md", ".csv", ".json", ".xml", ".yaml", ".yml", ".toml", ".py", ".js", ".ts", ".jsx", ".tsx", ".html", ".css", ".scss", ".java", ".c", ".cpp", ".h", ".hpp", ".rs", ".go",
        ".rb", ".php", ".sh", ".bat", ".ps1", ".sql", ".r", ".swift", ".kt", ".scala", ".ini", ".cfg", ".conf", ".env", ".log",
    ],
}
READ_TEXT_CHARACTERS = 100_000
READ_VIDEO_BYTES = 25 * 1024 * 1024
RISK_THRESHOLDS = {"rename": 0.80, "move": 0.90, "delete": 0.95}
ILL_NAMED = (
    r"(?i)^(img[_\-]?\d+|dsc[_\-]?\d+|dscf?\d+|p\d{6,}|pxl_\d+|screen ?shot.*|screenshot.*|photo[_\- ]?\d*|image[_\- ]?\d*|"
    r"untitled.*|document\d*|new ?document.*|scan[_\-]?\d+|capture.*|[0-9a-f]{16,}|\d{6,}|copy of.*|final\d*|new\d*|temp\d*|download.*)$"
)
GENERIC_NAME = r"(?i)^(untitled|document\d*|presentation\d*|visual materials|webinar visual|slides?|deck|final|copy|new|image\d*|img\d*|photo\d*|banner\d*|\d+)$"
TITLE_EXTENSIONS = [".pptx", ".docx", ".pdf", ".key", ".txt", ".md"]

# --- fixed values: sidecars of exports
CLUTTER_NAMES = ["archive_browser.html", "workspaces.json"]
SIDECAR_INNER = [
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv", "txt", "rtf", "odt", "ods", "odp", "html", "htm",
    "jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "heic", "webp", "svg", "psd", "ai", "eps",
    "mp4", "mov", "m4v", "avi", "mkv", "wmv", "webm", "mpg", "mpeg", "mp3", "m4a", "wav", "aac", "flac", "ogg", "wma",
    "zip", "rar", "7z", "gz", "gdoc", "gsheet", "gslides", "gform", "gdraw", "gsite", "gmap", "gscript",
    "prproj", "aep", "als", "wig",
]
SIDECAR_TAIL = r"-(?:info|inf|in|i)?(?:\(\d+\))?\.json$"
BOOKMARK_MARKS = ["netscape-bookmark-file", "it will be read and overwritten"]

# --- fixed values: archives
ARCHIVE_SUFFIXES = [".zip", ".tar", ".tar.gz", ".tgz", ".gz", ".bz2", ".7z", ".rar"]
ARCHIVE_END = r"(?i)\.(zip|tar\.gz|tgz|tar|gz)$"

# --- fixed values: answers of a busy service
RATE_LIMIT_SIGNS = [
    "429", "ratelimitexceeded", "userratelimitexceeded", "quotaexceeded", "rate limit", "too many requests",
    "backendror", "backend error", "sharingratelimitexceeded",
]

# --- fixed values: cloud types
FOLDER_TYPE = "application/vnd.google-apps.folder"
SHORTCUT_TYPE = "application/vnd.google-apps.shortcut"
OFFICE_TYPES = {"document": "docx", "spreadsheet": "xlsx", "presentation": "pptx", "drawing": "pdf"}

# --- fixed values: thresholds
SMALL_FILE = 52_428_800
SAMPLE_BYTES = 262_144

#: A folder's leading date and label, the numbered event that a title may begin with, and what a
#: cut name ends in (fixed values).
DATED_LABEL = r"^\s*([\d]{1,4}[.\-/][\d]{1,2}[.\-/][\d]{1,4}\s*[-–]?\s*(?:[A-Za-z ]{0,24}[-–]\s*)?)"
NUMBERED_EVENT = r"(?i)^\d+(st|nd|rd|th)?\s*(webinar)?\s*[\(\-:]?\s*"
CUT_END = r"[_\-\s]+$"

#: Media types by extension (fixed values).
MEDIA_TYPES = {
    ".txt": "text/plain", ".html": "text/html", ".htm": "text/html", ".csv": "text/csv", ".css": "text/css", ".xml": "text/xml", ".md": "text/markdown", ".py": "text/x-python",
    ".js": "text/javascript", ".json": "application/json", ".pdf": "application/pdf", ".zip": "application/zip", ".tar": "application/x-tar", ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".ppt": "application/vnd.ms-powerpoint",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", ".rtf": "application/rtf",
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp", ".tiff": "image/tiff", ".tif": "image/tiff",
    ".svg": "image/svg+xml", ".heic": "image/heic", ".mp3": "audio/mpeg", ".wav": "audio/x-wav", ".mp4": "video/mp4", ".mov": "video/quicktime", ".avi": "video/x-msvideo",
    ".mkv": "video/x-matroska", ".webm": "video/webm", ".mpg": "video/mpeg", ".mpeg": "video/mpeg", ".wmv": "video/x-ms-wmv",
}
#: Folders of an extracted account that are never laid out (fixed values).
SKIPPED_CHILDREN = ["trash"]
