"""Public suffixes: the list that Spark's own HTTP client carries, and registrable domains by it.

The list is read on the driver from the jar beside the session's other jars (or from `path`), once; it has
a fixed size (about 14,000 rules), so it is broadcast to the executors. Snapshots differ over time, so a rare suffix may be judged differently from another reader's.
"""

from __future__ import annotations

import glob
import os
import zipfile
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import pyspark
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Used where no list can be read.
FALLBACK = ("com", "net", "org", "edu", "gov", "int", "io", "co", "uk", "co.uk", "org.uk", "ac.uk", "de", "fr", "es", "it", "nl", "jp", "co.jp", "au", "com.au", "ca", "me", "gy", "ly", "at", "cc", "do", "github.io", "*.ck", "!www.ck")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mapped(values: pd.Series, function: Callable[[str], object]) -> pd.Series:
    """function of each text, made once for each different one; null stays null."""
    seen = {v: function(v) for v in set(values.dropna())}
    return pd.Series([seen[v] if isinstance(v, str) else None for v in values], dtype=object)


def normalized(host: str) -> str:
    return host.strip().strip(".").casefold()


@lru_cache(maxsize=4)
def rules(path: str | None = None) -> frozenset[str]:
    """The list's rules, `*.` and `!` as written."""
    if path:
        with open(path, encoding="utf-8") as file:
            text = file.read()
    else:
        home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
        jars = sorted(glob.glob(os.path.join(home, "jars", "httpclient-*.jar")))
        if not jars:
            return frozenset(FALLBACK)
        with zipfile.ZipFile(jars[0]) as jar:
            text = jar.read("mozilla/public-suffix-list.txt").decode("utf-8")
    return frozenset(line.split()[0] for line in text.splitlines() if line.strip() and not line.startswith("//"))


def split_host(host: str, known: frozenset[str]) -> tuple[str, str]:
    """(label left of the public suffix, suffix); the suffix is empty for an unknown one."""
    labels = normalized(host).split(".")
    size = 0
    for k in range(len(labels)):
        rest = labels[k:]
        if "!" + ".".join(rest) in known:
            size = len(rest) - 1
            break
        if ".".join(rest) in known or (len(rest) > 1 and "*." + ".".join(rest[1:]) in known):
            size = len(rest)
            break
    if not size:
        return labels[-1], ""
    return (labels[-size - 1] if len(labels) > size else ""), ".".join(labels[-size:])


def registrable(host: str, known: frozenset[str]) -> str:
    """The domain an organisation registers; the whole host where it has no public suffix or is one."""
    label, suffix = split_host(host, known)
    return f"{label}.{suffix}" if label and suffix else normalized(host)


def registrable_domain(host: Column, path: str | None = None) -> Column:
    shared = SparkSession.getActiveSession().sparkContext.broadcast(rules(path))

    @F.pandas_udf("string")
    def run(hosts: pd.Series) -> pd.Series:
        return mapped(hosts, lambda h: registrable(h, shared.value))

    return run(host)


def registrable_label(host: Column, path: str | None = None) -> Column:
    shared = SparkSession.getActiveSession().sparkContext.broadcast(rules(path))

    @F.pandas_udf("string")
    def run(hosts: pd.Series) -> pd.Series:
        return mapped(hosts, lambda h: split_host(h, shared.value)[0])

    return run(host)


def host_suffixes(host: Column) -> Column:
    """The host and every domain above it, as an array: an equi-join on its elements is a subdomain test."""
    return let(F.split(host, r"\."), _suffixes)


def _suffixes(labels: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def in_domain(host: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    return F.coalesce(F.arrays_overlap(host_suffixes(host), F.array(*[F.lit(d) for d in domains])) if domains else F.lit(False), F.lit(False))
