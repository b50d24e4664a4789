"""Column functions over requests and uploads: clients, user agents, MIME types, content scans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of automated user agents in order; those in FREE_LEFT / FREE_RIGHT may have letters before / after.
BOT_WORDS = ("python-requests", "scrapy", "curl", "headless", "selenium", "wget", "httpx", "aiohttp", "go-http-client", "axios", "okhttp", r"request\.py", "bot", "spider", "crawler")
FREE_LEFT, FREE_RIGHT = ("bot",), ("headless",)
# MIME types by extension and by first bytes, accepted types, malicious patterns with what they show, accepted upload extensions.
EXTENSION_MIME = {
    "csv": "text/csv", "tsv": "text/tab-separated-values", "pdf": "application/pdf", "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "txt": "text/plain", "htm": "text/html", "html": "text/html", "json": "application/json", "xml": "text/xml",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "zip": "application/zip", "rar": "application/x-rar-compressed",
    "gz": "application/gzip", "tar": "application/x-tar", "js": "text/javascript", "exe": "application/x-msdownload", "sh": "application/x-sh", "py": "text/x-python",
}
MAGIC_MIME = {"89504E47": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "25504446": "application/pdf", "504B0304": "application/zip", "D0CF11E0": "application/msword"}
ALLOWED_MIME = (
    "application/pdf", "application/msword", EXTENSION_MIME["docx"], "application/vnd.ms-excel", EXTENSION_MIME["xlsx"], "application/vnd.ms-powerpoint", EXTENSION_MIME["pptx"], "text/plain", "text/csv", "text/html",
    "application/json", "application/xml", "text/xml", "image/jpeg", "image/png", "image/gif", "image/webp", "image/svg+xml", "application/zip", "application/x-rar-compressed", "application/gzip", "application/x-tar", "text/tab-separated-values",
)
MALICIOUS = {
    "PHP open tag detected": r"<\?(?:php|=)",
    "Inline JS event handler": r"\bon\w+\s*=\s*[\"']?\s*javascript:",
    "Embedded <script> tag": r"<script\b",
    "Shell shebang": r"(?:^|\n)\s*(?:/bin/(?:ba|z)?sh|/bin/bash|/usr/bin/)\s*\S*",
    "SQL injection probe": r"(?:union\s+select|/\*!|\bOR\s+['\"]?\d['\"]?\s*=\s*['\"]?\d)",
}
LONG_BASE64 = "Suspiciously long Base64 string"
UPLOAD_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "csv", "zip")
MAX_UPLOAD = 50 * 1024 * 1024


def client_ip(forwarded: Column, host: Column) -> Column:
    """The first forwarded address, else the peer, else 'unknown'."""
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.coalesce(F.nullif(first, F.lit("")), host, F.lit("unknown"))


def bot_pattern(user_agent: Column, words=BOT_WORDS) -> Column:
    """The first bot word in the user agent, bounded by non-letters; null if none, or for no user agent."""

    def pattern(w: str) -> str:
        return "(?i)" + ("" if w in FREE_LEFT else "(?:^|[^a-zA-Z])") + w + ("" if w in FREE_RIGHT else "(?:$|[^a-zA-Z])")

    chosen = F.when(user_agent.rlike(pattern(words[0])), words[0])
    for w in words[1:]:
        chosen = chosen.when(user_agent.rlike(pattern(w)), w)
    return chosen


def bot_reason(user_agent: Column, words=BOT_WORDS) -> Column:
    """Why a user agent counts as a bot's, null if it doesn't."""
    return F.concat(F.lit("UA matches bot pattern: "), bot_pattern(user_agent, words))


def file_extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1))


def resolve_mime(filename: Column, content: Column, content_type: Column) -> Column:
    """Declared type, else by extension, else by the first bytes, else application/octet-stream."""
    declared = F.when(content_type.contains("/"), F.lower(F.trim(F.get(F.split(content_type, ";"), F.lit(0)))))
    by_ext = F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSION_MIME.items() for x in kv]), file_extension(filename))
    head = F.hex(F.substring(content, 1, 4))
    by_magic = None
    for k, v in MAGIC_MIME.items():
        ok = head.startswith(k) & (F.octet_length(content) >= 4)
        by_magic = F.when(ok, v) if by_magic is None else by_magic.when(ok, v)
    return F.coalesce(declared, by_ext, by_magic, F.lit("application/octet-stream"))


def malicious_scan(text: Column, patterns: dict[str, str] = MALICIOUS) -> Column:
    """What the first matching pattern shows, else the note of a long base64 run, else null."""
    chosen = None
    for what, p in patterns.items():
        ok = text.rlike("(?im)" + p)
        chosen = F.when(ok, what) if chosen is None else chosen.when(ok, what)
    long_run = text.rlike("[A-Za-z0-9+/=]{300,}")
    return F.when(long_run, LONG_BASE64) if chosen is None else chosen.when(long_run, LONG_BASE64)


def is_text_mime(mime: Column) -> Column:
    return mime.startswith("text/") | mime.isin("application/json", "application/xml", "application/javascript")


def upload_allowed(filename: Column) -> Column:
    return file_extension(filename).isin(*UPLOAD_EXTENSIONS)


def validate_upload(filename: Column, content: Column, content_type: Column, max_bytes: int = MAX_UPLOAD, allowed=ALLOWED_MIME, strict_extension: bool = False) -> Column:
    """struct<status, mime, size, message>: the first failure in the order empty, size, MIME, extension, content; else 'ok'."""
    mime, size = resolve_mime(filename, content, content_type), F.octet_length(content)
    by_ext = F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSION_MIME.items() for x in kv]), file_extension(filename))
    found = F.when(is_text_mime(mime), malicious_scan(F.decode(content, "UTF-8")))
    status = F.when(F.coalesce(size, F.lit(0)) == 0, "empty_file").when(size > max_bytes, "size_exceeded").when(~mime.isin(*allowed), "mime_not_allowed")
    if strict_extension:
        status = status.when(by_ext.isNotNull() & (by_ext != mime), "extension_mismatch")
    status = status.when(found.isNotNull(), "malicious_content").otherwise("ok")
    message = F.when(status == "ok", "").when(status == "malicious_content", found).otherwise(status)
    return F.struct(status.alias("status"), mime.alias("mime"), F.coalesce(size, F.lit(0)).alias("size"), message.alias("message"))
