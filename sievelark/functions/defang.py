"""Making indicators inert and back, as column expressions.

All are idempotent: separators in brackets already are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .suffixes import let


def bracket_dots(value: Column) -> Column:
    return F.regexp_replace(value, r"(?<!\[)\.(?!\])", "[.]")


def defang_domain(value: Column) -> Column:
    return bracket_dots(value)


def defang_ipv4(value: Column) -> Column:
    return bracket_dots(value)


def defang_ipv6(value: Column) -> Column:
    return F.regexp_replace(value, r"(?<!\[):(?!\])", "[:]")


def defang_email(value: Column) -> Column:
    return bracket_dots(F.replace(value, F.lit("@"), F.lit("[at]")))


def browser_reading(value: Column) -> Column:
    """A link as a browser reads it: tabs and line ends deleted, controls and blanks before it ignored."""
    return F.regexp_replace(F.regexp_replace(value, "[\t\n\r]", ""), r"^[\x00-\x20]+", "")


def defang_url(value: Column) -> Column:
    """hxxp(s) for http(s); any other scheme's colon in brackets; dots in brackets."""
    plain = browser_reading(value)
    web = F.regexp_replace(F.regexp_replace(plain, r"^(?i:http)(?=://)", "hxxp"), r"^(?i:https)(?=://)", "hxxps")
    return bracket_dots(F.regexp_replace(web, r"^(?i)(?!hxxps?:)([a-z][a-z0-9+.\-]*):(?!\])", r"$1[:]"))


def defang(value: Column, kind: Column) -> Column:
    """By indicator type; hashes stay as they are."""
    return (
        F.when(kind == "url", defang_url(value)).when(kind.isin("ipv4", "domain"), bracket_dots(value))
        .when(kind == "ipv6", defang_ipv6(value)).when(kind == "email", defang_email(value)).otherwise(value)
    )


def refang(value: Column) -> Column:
    for old, new in (("[.]", "."), ("(.)", "."), ("{.}", "."), ("[:]", ":"), ("[at]", "@"), ("[@]", "@")):
        value = F.replace(value, F.lit(old), F.lit(new))
    return F.regexp_replace(F.regexp_replace(value, r"(?i)hxxps://", "https://"), r"(?i)hxxp://", "http://")


def clean(value: Column) -> Column:
    """Without control characters other than tab and line ends."""
    return F.regexp_replace(value, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")


#: Tokens of prose that are rewritten, in this order: links, www hosts, mail addresses, IPv4 addresses.
_TOKENS = [
    (r"(?i)(?<![a-z0-9+.\-])[a-z][a-z0-9+.\-]*://[^\s<>\"'`]+", defang_url),
    (r"(?i)(?<![a-z0-9.\-])www\.[^\s<>\"'`]+", bracket_dots),
    (r"(?U)(?<![\w.%+\-])[\w.%+\-]+@(?:[\w\-]+\.)+[\w\-]{2,}", defang_email),
    (r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)", defang_ipv4),
]


def defang_text(text: Column) -> Column:
    """Prose with its links, hosts, addresses and IPs made inert, the rest as it was.

    Text is cut at each kind of token in turn; the tokens are rewritten as an array and zipped with what lies between. No Python runs.
    """
    for pattern, rewrite in _TOKENS:
        text = let(text, _rewriting(pattern, rewrite))
    return text


def _rewriting(pattern: str, rewrite: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda text: _rewritten(text, pattern, rewrite)


def _rewritten(text: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), rewrite)
    # between tokens there is always one part more than tokens
    woven = F.zip_with(F.split(text, pattern, -1), F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.array_join(woven, "")).otherwise(text)
