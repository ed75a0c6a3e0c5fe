"""Links rewritten by mail protection services, decoded offline to their targets. Nothing is fetched."""

from __future__ import annotations

import base64
import html
import re
import string
from urllib.parse import parse_qs, unquote, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Services by host, the run tokens' lengths, and the limits.
SERVICES = (
    ("safelinks.protection.outlook.com", "safelinks"), ("urldefense.proofpoint.com", "proofpoint"), ("urldefense.com", "proofpoint"),
    ("mimecast.com", "mimecast"), ("cudasvc.com", "barracuda"), ("secure-web.cisco.com", "cisco"),
)
LAYERS = 5
LONGEST = 16 * 1024
_RUNS = {c: k + 2 for k, c in enumerate(string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_")}


def _parts(url: str):
    try:
        return urlsplit(url)
    except ValueError:
        return None


def service(url: str) -> str | None:
    """The service that wrapped a link, or None. Browsers read a backslash otherwise than the services, so such links count as plain."""
    parts = None if "\\" in url else _parts(url)
    if parts is None:
        return None
    host = parts.netloc.rpartition("@")[2].partition(":")[0].casefold().rstrip(".")
    for domain, name in SERVICES:
        if host == domain or host.endswith("." + domain):
            return name if name != "mimecast" or parts.path.startswith("/s/") else None
    return None


def _parameter(url: str, name: str) -> str | None:
    """A query parameter as it stands, still encoded."""
    parts = _parts(url)
    return next((f[len(name) + 1 :] for f in parts.query.split("&") if f.startswith(name + "=")), None) if parts else None


def _web(url: str | None) -> str | None:
    return url if url and url.casefold().startswith(("http://", "https://")) else None


def _run_tokens(url: str) -> str | None:
    """Third-version links: characters replaced by run tokens, listed in a base64 trailer."""
    found = re.search(r"/v3/__(.*?)__;(.*?)!", url, re.DOTALL)
    if not found:
        return None
    target = unquote(re.sub(r"^([a-z0-9+.\-]+:/)([^/])", r"\1/\2", found[1], count=1, flags=re.IGNORECASE))
    try:
        letters = base64.urlsafe_b64decode(found[2] + "=" * (-len(found[2]) % 4)).decode("utf-8") if found[2] else ""
    except ValueError:
        return None
    pieces, used, last = [], 0, 0
    for token in re.finditer(r"\*(?:\*.)?", target):
        size = 1 if token[0] == "*" else _RUNS.get(token[0][-1], 0)
        if used + size > len(letters):
            return None
        pieces += [target[last : token.start()], letters[used : used + size]]
        used, last = used + size, token.end()
    return "".join(pieces) + target[last:]


def decode(url: str, name: str) -> str | None:
    """One layer taken off, or None."""
    if name == "safelinks":
        parts = _parts(url)
        return (parse_qs(parts.query).get("url") or [None])[0] if parts else None
    if name == "proofpoint":
        parts = _parts(url)
        version = re.match(r"/(v[123])/", parts.path) if parts else None
        if not version:
            return None
        if version[1] == "v3":
            return _run_tokens(url)
        value = _parameter(url, "u")
        if version[1] == "v2" and value:
            value = value.replace("-", "%").replace("_", "/")
        return html.unescape(unquote(value)) if value else None
    if name == "barracuda":
        value = _parameter(url, "a")
        return _web(unquote(value)) if value else None
    if name == "cisco":
        parts = _parts(url)
        own = [s for s in parts.path.split("/") if s] if parts else []
        return _web(unquote(own[-1])) if len(own) > 1 else None
    return None


def disclosed_domain(url: str) -> str | None:
    """The domain that an undecodable link still names."""
    value = unquote(_parameter(url, "domain") or "").strip().casefold().rstrip(".")
    return value if "." in value and "/" not in value else None


def unwrap(url: str) -> tuple[str, str | None, str | None, bool, str | None]:
    """(value, wrapped, wrapper, unresolved, target_domain); wrapper is None for a plain link."""
    outer, current, seen = None, url, set()
    for _ in range(LAYERS):
        name = None if current in seen else service(current)
        if not name:
            break
        seen.add(current)
        inner = None if name == "mimecast" or len(current) > LONGEST else decode(current, name)
        if not inner or inner == current:
            return current, url, outer or name, True, disclosed_domain(current) if name == "mimecast" else None
        outer, current = outer or name, inner
    if outer is None:
        return url, None, None, False, None
    return current, url, outer, service(current) is not None, None


_TEXT = ("value", "wrapped", "wrapper")
SCHEMA = T.StructType([*(T.StructField(n, T.StringType()) for n in _TEXT), T.StructField("unresolved", T.BooleanType()), T.StructField("target_domain", T.StringType())])


@F.pandas_udf(SCHEMA)
def unwrap_url(urls: pd.Series) -> pd.DataFrame:
    rows = [unwrap(u) if isinstance(u, str) else (None,) * 5 for u in urls]
    return pd.DataFrame(rows, columns=["value", "wrapped", "wrapper", "unresolved", "target_domain"])
