"""Column functions on texts: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions by kind, formats by MIME type, and language names.
CODE = "rs py js ts go java c cpp h hpp cs rb sh bash zsh swift kt scala zig lua pl r m php ex erl hs ml clj v sv vhd s asm sql proto thrift graphql tf nix jsx tsx vue svelte css scss less sass".split()
DATA = "json yaml yml toml ini properties csv tsv xml xsd wsdl avro parquet".split()
EMAIL = "eml mbox pst".split()
FORMATS = {"text/html": "html", "text/plain": "txt", "text/csv": "csv", "text/xml": "xml", "application/json": "json", "application/pdf": "pdf"}
LANGUAGES = {
    "arabic": "ar", "catalan": "ca", "chinese": "zh", "czech": "cs", "danish": "da", "dutch": "nl", "english": "en", "finnish": "fi", "french": "fr", "german": "de", "greek": "el", "hebrew": "he", "hindi": "hi", "hungarian": "hu", "indonesian": "id", "italian": "it",
    "japanese": "ja", "korean": "ko", "latin": "la", "malay": "ms", "norwegian": "no", "polish": "pl", "portuguese": "pt", "romanian": "ro", "russian": "ru", "spanish": "es", "swedish": "sv", "thai": "th", "turkish": "tr", "ukrainian": "uk", "vietnamese": "vi",
}
LANGUAGE_CODE = r"^[a-z]{2,3}(-[a-zA-Z0-9]{2,8})*$"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def kind_of(path: Column, mime: Column | None = None) -> Column:
    """code, data, email or document: by extension, else by MIME type."""
    e = extension(path)
    out = F.when(e.isin(*CODE), "code").when(e.isin(*DATA), "data").when(e.isin(*EMAIL), "email")
    if mime is not None:
        out = out.when(mime.startswith("text/x-") | mime.contains("x-source") | mime.contains("x-script"), "code")
        out = out.when(mime.isin("text/csv", "text/tab-separated-values", "application/json") | mime.contains("yaml") | (mime.contains("xml") & ~mime.contains("html")), "data")
        out = out.when((mime == "message/rfc822") | mime.contains("mbox") | mime.contains("outlook-pst"), "email")
    return out.otherwise("document")


def format_of(path: Column, mime: Column | None = None) -> Column:
    """The lower-cased extension, else the MIME type's format, else null."""
    out = empty_as_null(extension(path))
    if mime is None:
        return out
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.coalesce(out, F.try_element_at(known, mime), F.when(mime.contains("markdown"), "md"))


def empty_as_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def known_or(x: Column, values: list[str], default: str) -> Column:
    return F.when(x.isin(*values), x).otherwise(default)


def strip_lines(text: Column, first: int, last: int) -> Column:
    """Without the first and last lines; CRLF becomes LF."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    return F.array_join(F.slice(lines, first + 1, F.greatest(F.size(lines) - first - last, F.lit(0))), "\n")


def replace_text(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, pattern if pattern.startswith("(?") else "(?m)" + pattern, to)


def extract_meta(text: Column, pattern: str, before: Column | None = None) -> Column:
    """Group 1, trimmed; what is there already wins."""
    found = empty_as_null(F.trim(F.regexp_extract(text, pattern, 1)))
    return found if before is None else F.coalesce(before, found)


def merge_tags(existing: Column, config: Column) -> Column:
    return F.concat_ws(", ", empty_as_null(existing), empty_as_null(config))


def lang_code(x: Column) -> Column:
    """A code: of a name, or as it stands, with its case kept after the first hyphen; else of the first of a list; null if neither."""
    names = F.create_map(*[F.lit(v) for pair in LANGUAGES.items() for v in pair])
    trimmed = F.trim(x)
    at = F.instr(trimmed, "-")
    whole = F.when(at > 0, F.concat(F.lower(F.substr(trimmed, F.lit(1), at - 1)), F.substr(trimmed, at))).otherwise(F.lower(trimmed))
    first = F.trim(F.element_at(F.split(whole, "[;,/]"), 1))
    code = lambda one: F.coalesce(F.try_element_at(names, one), F.when(one.rlike(LANGUAGE_CODE), one))
    return F.coalesce(code(whole), code(first))


def html_strip(html: Column) -> Column:
    return F.replace(F.regexp_replace(html, r"<[^>]*(>|$)", ""), F.lit(">"), F.lit(""))


def html_title(html: Column) -> Column:
    return empty_as_null(F.trim(F.regexp_extract(html, r"(?s)<title>([^<]*)</title>", 1)))


def clean_body(body: Column) -> Column:
    return F.rtrim(F.replace(body, F.lit("\r"), F.lit("")))


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no slash at the end."""
    p = r"^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*)(.*)$"
    scheme, host, rest = F.lower(F.regexp_extract(url, p, 1)), F.lower(F.regexp_extract(url, p, 2)), F.regexp_extract(url, p, 3)
    host = F.when(scheme == "http://", F.regexp_replace(host, ":80$", "")).when(scheme == "https://", F.regexp_replace(host, ":443$", "")).otherwise(host)
    return F.when(scheme == "", url).otherwise(F.concat(scheme, host, F.regexp_replace(rest, "/$", "")))


def is_text(content: Column) -> Column:
    """The first 32 KB are UTF-8 (a character cut at the end is allowed) and have no NUL."""
    head = F.substring(content, 1, 32768)
    hexed = F.hex(head)
    ok = F.is_valid_utf8(head.cast("string"))
    for k in (1, 2, 3):
        ok = ok | ((F.length(content) > 32768) & F.is_valid_utf8(F.substring(content, 1, 32768 - k).cast("string")))
    return ok & ~hexed.rlike("^(..)*00")


def maildir_flags(path: Column) -> Column:
    """Tags of the flags after `:2,`, comma-joined; a trashed message has the tag trashed."""
    flags = F.regexp_extract(path, r":2,([A-Z]*)$", 1)
    tags = [F.when(F.contains(flags, F.lit(f)), t) for f, t in (("S", "seen"), ("R", "replied"), ("F", "flagged"), ("T", "trashed"), ("D", "draft"), ("P", "passed"))]
    return F.concat_ws(", ", *tags)


def fresh_until(fetched: Column, cache_control: Column, default_s: int = 3600) -> Column:
    """When a cached page ends: max-age, nothing for no-store, or the default."""
    age = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(cache_control, r"max-age=(\d+)", 1), F.lit("")), F.lit("9999999999")).cast("long"), F.lit(default_s).cast("long"))
    return F.when(F.lower(cache_control).contains("no-store"), fetched).otherwise(F.timestamp_seconds(F.unix_seconds(fetched) + age))
