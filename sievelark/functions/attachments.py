"""Facts about attachments from file name, declared type and bytes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .suffixes import let

# Magic prefixes in order of test, extension lists and type families that results depend on.
MAGIC = [
    ("255044462D", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"),
    ("7F454C46", "application/x-executable"), ("4D5A", "application/x-dosexec"), ("504B0304", "application/zip"), ("504B0506", "application/zip"),
    ("526172211A07", "application/x-rar-compressed"), ("377ABCAF271C", "application/x-7z-compressed"), ("1F8B", "application/gzip"), ("425A68", "application/x-bzip2"),
    ("FD377A585A00", "application/x-xz"), ("D0CF11E0A1B11AE1", "application/x-ole-storage"), ("7B5C727466", "application/rtf"),
]
ARCHIVE_TYPES = ["application/zip", "application/x-rar-compressed", "application/x-7z-compressed", "application/gzip", "application/x-bzip2", "application/x-xz"]
ARCHIVE_EXTENSIONS = ["zip", "rar", "7z", "gz", "tar", "bz2", "xz", "cab"]
EXECUTABLE_TYPES = ["application/x-dosexec", "application/x-executable"]
DANGEROUS_EXTENSIONS = [
    "exe", "scr", "com", "pif", "bat", "cmd", "msi", "dll", "cpl", "js", "jse", "vbs", "vbe", "wsf", "wsh", "hta", "ps1", "psm1", "jar", "lnk", "iso", "img", "vhd", "vhdx",
    "one", "onepkg", "xll", "chm", "url", "scf", "reg", "msc", "inf", "sct", "wsc", "appx", "appxbundle", "msix", "msixbundle", "application", "gadget", "iqy", "slk",
    "settingcontent-ms", "library-ms", "search-ms",
]
HTML_EXTENSIONS = ["html", "htm", "shtml", "xhtml", "mht", "mhtml", "svg", "svgz"]
HTML_TYPES = ["text/html", "application/xhtml+xml", "image/svg+xml", "multipart/related", "message/rfc822+mhtml"]
OOXML_MACRO_EXTENSIONS = ["docm", "dotm", "xlsm", "xltm", "xlam", "pptm", "potm", "ppam", "ppsm", "sldm", "xlsb"]
LEGACY_MACRO_EXTENSIONS = ["doc", "dot", "xls", "xlt", "xla", "ppt", "pot", "pps", "ppa"]
OOXML_EXTENSIONS = ["docx", "dotx", "xlsx", "xltx", "pptx", "potx", "ppsx", *OOXML_MACRO_EXTENSIONS]
DECLARED_FAMILIES = {
    "pdf": ["application/pdf"],
    "rtf": ["application/rtf", "text/rtf"],
    "image": ["image/png", "image/jpeg", "image/gif"],
    "zip": [
        "application/zip", "application/x-zip-compressed",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
        "application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/vnd.ms-word.document.macroenabled.12",
        "application/vnd.ms-excel.sheet.macroenabled.12", "application/vnd.ms-powerpoint.presentation.macroenabled.12",
    ],
    "archive": ["application/gzip", "application/x-rar-compressed", "application/x-7z-compressed"],
    "ole": ["application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint", "application/vnd.ms-office"],
    "html": ["text/html", "application/xhtml+xml", "image/svg+xml"],
}
DETECTED_FAMILIES = {
    "pdf": ["application/pdf"],
    "rtf": ["application/rtf"],
    "image": ["image/png", "image/jpeg", "image/gif"],
    "zip": ["application/zip"],
    "archive": ["application/x-rar-compressed", "application/x-7z-compressed", "application/gzip", "application/x-bzip2", "application/x-xz"],
    "executable": ["application/x-dosexec", "application/x-executable"],
    "ole": ["application/x-ole-storage"],
    "html": ["text/html", "image/svg+xml"],
}
EXTENSION_FAMILIES = {"pdf": ["pdf"], "image": ["png", "jpg", "jpeg", "gif"], "ole": ["doc", "xls", "ppt"], "rtf": ["rtf"], "html": ["html", "htm", "svg"]}
BIDI = "\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"


def _family(value: Column, families: dict[str, list[str]]) -> Column:
    out = F.lit(None).cast("string")
    for family, members in families.items():
        out = F.when(value.isin(members), family).otherwise(out)
    return out


def detected_type(content: Column) -> Column:
    """By leading bytes; markup within the first 1,024 (after a byte-order mark, an XML declaration, comments and blanks)."""
    return let(content, _detected)


def _detected(content: Column) -> Column:
    out = None
    for prefix, kind in MAGIC:
        test = F.startswith(content, F.unhex(F.lit(prefix)))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    head = F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    head = F.regexp_replace(head, r"^(?:ï»¿)?(?:\s|<\?xml[^>]*>|(?s:<!--.*?-->))*", "")
    out = out.when(head.startswith("<!doctype html") | head.startswith("<html"), "text/html").when(head.startswith("<svg"), "image/svg+xml")
    # an archive's directory may lie behind a prefix, as in self-extracting files
    return F.coalesce(out, F.when(_has_directory(content), "application/zip"))


def _has_directory(content: Column) -> Column:
    """Whether an end-of-directory record begins, on a byte boundary, in the last 65,557 bytes."""
    tail = F.hex(F.substring(content, F.greatest(F.lit(1), F.octet_length(content) - 65556), F.lit(65557)))
    return F.coalesce(F.regexp_like(tail, F.lit("^(?:..)*?504B0506")), F.lit(False))


def extensions(name: Column) -> Column:
    """Lower-case parts after the first dot; dots and blanks at the end don't count."""
    pieces = F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[.\s]+$", ""), r"\.")
    return let(pieces, lambda p: F.slice(p, F.lit(2), F.size(p)))


def last_extension(name: Column) -> Column:
    return F.try_element_at(extensions(name), F.lit(-1))


def flags(name: Column, declared: Column, detected: Column, encrypted: Column) -> Column:
    """The flags that hold, in their fixed order."""
    given = F.struct(name.alias("name"), F.lower(F.coalesce(declared, F.lit(""))).alias("declared"), detected.alias("detected"), encrypted.alias("encrypted"), extensions(name).alias("parts"))
    return let(given, lambda g: _flags(g["name"], g["declared"], g["detected"], g["encrypted"], g["parts"]))


def _flags(name: Column, declared: Column, detected: Column, encrypted: Column, parts: Column) -> Column:
    last = F.try_element_at(parts, F.lit(-1))
    yes = lambda c: F.coalesce(c, F.lit(False))
    is_archive = (detected.isin(ARCHIVE_TYPES) & ~yes(last.isin(OOXML_EXTENSIONS))) | yes(last.isin(ARCHIVE_EXTENSIONS))
    bidi = F.regexp_like(F.coalesce(name, F.lit("")), F.lit(f"[{BIDI}]"))
    found = _family(detected, DETECTED_FAMILIES)
    differs = yes(_family(declared, DECLARED_FAMILIES) != found) | yes(_family(last, EXTENSION_FAMILIES) != found)
    tests = [
        ("archive", yes(is_archive)),
        ("macro_capable", yes(last.isin(OOXML_MACRO_EXTENSIONS + LEGACY_MACRO_EXTENSIONS))),
        ("executable", yes(detected.isin(EXECUTABLE_TYPES)) | yes(last.isin(DANGEROUS_EXTENSIONS))),
        ("html", yes(last.isin(HTML_EXTENSIONS)) | declared.isin(HTML_TYPES) | yes(detected.isin("text/html", "image/svg+xml"))),
        ("double_extension", bidi | ((F.size(parts) >= 2) & yes(last.isin(DANGEROUS_EXTENSIONS + HTML_EXTENSIONS)))),
        ("type_mismatch", differs),
        ("password_protected", yes(encrypted)),
    ]
    return F.filter(F.array(*[F.when(test, F.lit(flag)) for flag, test in tests]), lambda x: x.isNotNull())


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB, with one decimal from KB up (ties to even)."""
    scaled = lambda k: F.format_string("%.1f", F.bround(size / F.lit(1024.0**k), 1))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, F.concat(scaled(1), F.lit(" KB"))).when(size < 1024**3, F.concat(scaled(2), F.lit(" MB"))).otherwise(F.concat(scaled(3), F.lit(" GB")))


def is_embedded_mail(name: Column, declared: Column) -> Column:
    return F.coalesce(F.startswith(F.lower(declared), F.lit("message/")), F.lit(False)) | F.coalesce(last_extension(name).isin("eml", "msg"), F.lit(False))
