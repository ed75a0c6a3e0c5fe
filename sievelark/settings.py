"""Scoring settings: defaults, YAML overrides, validation, and the small frames that plans join with."""

from __future__ import annotations

import copy
import difflib
import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Rule weights, verdict bands and word lists whose values results depend on.
WEIGHTS: dict[str, float] = {
    "auth.spf_fail": 15, "auth.spf_softfail": 8, "auth.dkim_fail": 12, "auth.dkim_none": 5, "auth.dmarc_fail": 18, "auth.results_missing": 8,
    "identity.display_name_brand_mismatch": 20, "identity.return_path_mismatch": 10, "identity.reply_to_mismatch": 12, "identity.sender_mismatch": 8,
    "identity.freemail_role": 12, "identity.display_name_is_email": 8, "identity.multiple_from": 20,
    "url.punycode": 12, "url.idn_homograph": 18, "url.lookalike": 18, "url.anchor_href_mismatch": 16, "url.raw_ip_host": 12, "url.shortener": 6,
    "url.credential_keywords": 8, "url.wrapped_divergence": 10,
    "attach.macro_capable": 14, "attach.double_extension": 22, "attach.type_mismatch": 16, "attach.executable": 22,
    "attach.password_protected_archive": 14, "attach.archive": 10, "attach.html": 14,
    "content.urgency_keywords": 4,
    "enrichment.virustotal.detections": 45, "enrichment.urlscan.malicious": 20, "enrichment.abuseipdb.confidence": 25,
    "enrichment.rdap.young_domain": 18, "enrichment.shodan.exposed": 6,
}
BANDS = [(19, "Few signals — safety undetermined"), (39, "Low suspicion"), (64, "Suspicious — analyst review"), (84, "High suspicion"), (100, "Very high suspicion")]
FREEMAIL = ["gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "yahoo.com", "ymail.com", "aol.com", "icloud.com", "me.com", "proton.me", "protonmail.com", "gmx.com", "mail.com", "zoho.com", "yandex.com"]
SHORTENERS = ["bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly", "rebrand.ly", "cutt.ly", "rb.gy", "shorturl.at", "tiny.cc", "bit.do", "t.ly"]
CREDENTIAL_WORDS = ["login", "signin", "sign-in", "verify", "verification", "secure", "account", "password", "passwd", "credential", "confirm", "update", "validate", "authenticate", "webscr", "recover", "unlock"]
URGENCY_WORDS = [
    "urgent", "immediately", "act now", "action required", "verify now", "suspended", "account locked", "account has been locked", "final notice", "last warning",
    "failure to comply", "within 24 hours", "within 48 hours", "your account will be", "confirm your account", "unusual activity", "unauthorized", "past due", "overdue",
    "payment failed", "wire transfer",
]
ROLE_WORDS = [
    "support", "helpdesk", "help desk", "service desk", "it department", "billing", "invoicing", "accounts payable", "accounts receivable", "finance department", "payroll",
    "human resources", "hr department", "security team", "administrator", "mail administrator", "webmaster", "postmaster", "customer service", "compliance", "legal department",
]
BRANDS = {
    "microsoft": ["microsoft.com", "outlook.com", "office.com", "office365.com", "live.com", "microsoftonline.com"],
    "paypal": ["paypal.com", "paypal.me"],
    "apple": ["apple.com", "icloud.com", "me.com"],
    "amazon": ["amazon.com", "amazon.co.uk", "aws.amazon.com"],
    "google": ["google.com", "gmail.com", "googlemail.com"],
    "netflix": ["netflix.com"],
    "facebook": ["facebook.com", "fb.com"],
    "instagram": ["instagram.com"],
    "linkedin": ["linkedin.com"],
    "docusign": ["docusign.com", "docusign.net"],
    "dropbox": ["dropbox.com"],
    "chase": ["chase.com"],
    "wells fargo": ["wellsfargo.com"],
    "bank of america": ["bankofamerica.com", "bofa.com"],
}
#: Words that make a lure of a brand name hyphenated with them.
LURES = [
    "access", "alert", "alerts", "auth", "billing", "case", "claim", "com", "customer", "help", "id", "invoice", "limited", "login", "logon", "net", "notice", "org",
    "password", "payment", "portal", "recovery", "refund", "reset", "resolution", "reward", "secure", "security", "service", "services", "signin", "support", "suspended",
    "unlock", "update", "validate", "verify", "wallet",
]
#: Score floors of the severity slugs.
SEVERITIES = [(0, "minimal"), (20, "low"), (40, "elevated"), (65, "high"), (85, "critical")]


class SettingsError(ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    bands: list[tuple[int, str]] = field(default_factory=lambda: list(BANDS))
    freemail_domains: list[str] = field(default_factory=lambda: list(FREEMAIL))
    url_shorteners: list[str] = field(default_factory=lambda: list(SHORTENERS))
    credential_keywords: list[str] = field(default_factory=lambda: list(CREDENTIAL_WORDS))
    urgency_keywords: list[str] = field(default_factory=lambda: list(URGENCY_WORDS))
    role_keywords: list[str] = field(default_factory=lambda: list(ROLE_WORDS))
    brands: dict[str, list[str]] = field(default_factory=lambda: copy.deepcopy(BRANDS))
    org_domains: list[str] = field(default_factory=list)

    def weight(self, rule: str) -> float:
        return float(self.weights.get(rule, 0.0))

    @property
    def lures(self) -> list[str]:
        """The lure words: the fixed ones and the words over two letters of the credential and role phrases."""
        more = {w for phrase in [*self.credential_keywords, *self.role_keywords] for w in phrase.replace("-", " ").split() if len(w) > 2}
        return sorted(set(LURES) | more)

    @property
    def targets(self) -> list[str]:
        """Domains that a lookalike may imitate."""
        return sorted(set(self.org_domains) | {d for own in self.brands.values() for d in own})

    def weights_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, float(v)) for k, v in self.weights.items()], "rule_id string, weight double")

    def bands_frame(self, spark: SparkSession) -> DataFrame:
        edges = [-1, *(top for top, _ in self.bands)]
        return spark.createDataFrame([(edges[k] + 1, top, verdict) for k, (top, verdict) in enumerate(self.bands)], "lo int, hi int, verdict string")

    def brands_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(b, d) for b, own in self.brands.items() for d in own], "brand string, domain string")

    def words_frame(self, spark: SparkSession) -> DataFrame:
        lists = {"freemail": self.freemail_domains, "shortener": self.url_shorteners, "credential": self.credential_keywords, "urgency": self.urgency_keywords, "role": self.role_keywords}
        return spark.createDataFrame([(kind, w) for kind, own in lists.items() for w in own], "kind string, value string")


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Maps merge key by key; lists and single values replace."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(out.get(key), dict) and isinstance(value, dict) else value
    return out


def domain_pattern(value: str) -> str:
    """`*.X.` as `x`."""
    return value.strip().casefold().removeprefix("*.").strip(".")


def _near(word: str, known) -> str:
    close = difflib.get_close_matches(word, list(known), 1)
    return f"; did you mean {close[0]!r}?" if close else ""


def validated(raw: dict[str, Any]) -> Settings:
    """Settings of a plain dict (defaults where a key is missing); SettingsError names the first fault."""
    base: dict[str, Any] = {**vars(Settings()), "bands": [{"max": m, "verdict": v} for m, v in BANDS]}
    if unknown := sorted(set(raw) - set(base)):
        raise SettingsError(f"unknown key {unknown[0]!r}{_near(unknown[0], base)}")
    full = merged(base, raw)
    for rule, weight in full["weights"].items():
        if rule not in WEIGHTS and not rule.startswith("enrichment."):
            raise SettingsError(f"unknown rule {rule!r}{_near(rule, WEIGHTS)}")
        if isinstance(weight, bool) or not isinstance(weight, int | float) or not 0 <= weight <= 100:
            raise SettingsError(f"weight of {rule!r} must be a number from 0 to 100")
    bands = sorted(((b["max"], b["verdict"]) for b in full["bands"]), key=lambda b: b[0])
    if len({m for m, _ in bands}) < len(bands) or not bands or bands[-1][0] != 100:
        raise SettingsError("bands need distinct maxima, the last of them 100")
    for key in ("freemail_domains", "url_shorteners", "credential_keywords", "urgency_keywords", "role_keywords", "org_domains"):
        if not isinstance(full[key], list) or not all(isinstance(x, str) for x in full[key]):
            raise SettingsError(f"{key} must be a list of strings")
        full[key] = [x.casefold() for x in full[key]]
    full["org_domains"] = [domain_pattern(x) for x in full["org_domains"]]
    return Settings(**{**full, "bands": bands})


def load(path: str | None = None, env: str = "SIEVELARK_SETTINGS", **over: Any) -> Settings:
    """Defaults, then the YAML file that `env` names, then `path`'s, then keyword arguments."""
    import yaml

    raw: dict[str, Any] = {}
    for name in (os.environ.get(env), path):
        if name:
            with open(name, encoding="utf-8") as file:
                own = yaml.safe_load(file) or {}
            if not isinstance(own, dict):
                raise SettingsError(f"{name}: a map of settings is needed")
            raw = merged(raw, own)
    return validated(merged(raw, over))
