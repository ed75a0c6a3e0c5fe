"""License scans: MinHash bands over overlapping text windows find templates, exact shingle containment verifies. DataFrame functions only.

1. Words are lower-case runs of letters and digits; five in a row are a shingle (fewer words: all of them), as a 64-bit hash.
2. Templates are sorted by size: class c holds those of 2**c to 2**(c+1)-1 shingles. Its windows have 3 * 2**c shingles and
   begin every 2**c, so any such passage lies whole in a window and makes up a third of it or more. Windows and templates
   have `BANDS` minimum hashes, one row a band: a window that holds a whole template meets it in a band with
   probability 1/3 or more, in any of 16 with at least 1 - (2/3)**16 = 99.8 % (for one-shingle templates, windows have one shingle and meet surely).
3. A minimum can only equal a template's if the window holds the template's shingle of that minimum. So windows without any
   shingle of a template are passed over before their minima are made; this changes no result.
4. Candidates are verified: of the template's distinct shingles, the window must hold `containment` or more, exactly.

Templates are a parameter; their shingles (MOST at most in one scan, longer lists are scanned in parts) are literals of the plan,
so nothing is shuffled but the few matches.

Defined cases: null and empty texts match nothing; null doc_ids match like others, under null; rows that repeat a doc_id are one; a template that comes
several times in a document gives one row, its best window (the first of equal ones); an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut

BANDS = 16
WORDS = 5
#: Shingles of templates in one scan.
MOST = 5_000

#: License notes that corpora carry in single lines and short headers.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "bsd-3-clause-header": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
}


def _held(frame: DataFrame, name: str, value: Column, *others: str) -> DataFrame:
    """`frame` with a value made once a row: a generator's output is not made again inside what uses it."""
    return frame.select(*others, F.explode(F.array(value)).alias(name))


def shingled(texts: DataFrame, *others: str) -> DataFrame:
    """`others` and s, the hashes of the shingles of `text` in order."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    hashed = _held(texts.where("text is not null"), "h", F.transform(words, lambda x: F.xxhash64(x)), *others)
    runs = F.transform(F.sequence(F.lit(0), F.size("h") - WORDS), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WORDS)]))
    own = F.when(F.size("h") >= WORDS, runs).when(F.size("h") > 0, F.array(F.xxhash64("h"))).otherwise(F.array().cast("array<bigint>"))
    return _held(hashed, "s", own, *others)


def minima(shingles: Column) -> Column:
    """BANDS minimum hashes of an array of shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b))))


def _span(c: int) -> tuple[int, int]:
    """Length and step of the windows of class c."""
    return (3 << c, 1 << c) if c else (1, 1)


def scan(documents: DataFrame, templates: DataFrame, containment: float = 0.8) -> DataFrame:
    """doc_id, license, first_word, found, containment of each template found in a document.

    templates: license, text; a list that fits the driver.
    """
    known = shingled(templates, "license").where("size(s) > 0").select("license", F.array_distinct("s").alias("s")).collect()
    parts: list[list] = [[]]
    for row in sorted(known, key=lambda r: r.license):
        if parts[-1] and sum(len(r.s) for r in parts[-1]) + len(row.s) > MOST:
            parts.append([])
        parts[-1].append(row)
    out = None
    for part in parts:
        found = _scan(documents, part, containment)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(documents: DataFrame, known: list, containment: float) -> DataFrame:
    spark = documents.sparkSession
    every = sorted({x for r in known for x in r.s})
    values = F.array(*[F.lit(x) for x in every]).cast("array<bigint>")
    rows = shingled(documents.select("doc_id", "text"), "doc_id").where(F.arrays_overlap("s", values))
    at = _held(rows, "hits", F.filter(F.transform("s", lambda x, i: F.when(F.array_contains(values, x), i)), lambda i: i.isNotNull()), "doc_id", "s")
    at = cut(at)  # the documents with any template's shingle: few, and read once for each class of windows
    template = spark.createDataFrame([(r.license, list(r.s), len(r.s), max(0, len(r.s).bit_length() - 1)) for r in known], "license string, t array<bigint>, n int, c int")
    bands = template.select("license", "c", "t", "n", F.posexplode(minima(F.col("t"))).alias("band", "low"))
    windows = None
    for c in sorted({max(0, len(r.s).bit_length() - 1) for r in known}):
        length, step = _span(c)
        starts = F.flatten(F.transform("hits", lambda i: F.transform(F.sequence(F.greatest(F.lit(0), F.floor((i - length + step) / step)).cast("int"), F.floor(i / step).cast("int")), lambda k: k * step)))  # noqa: B023
        own = at.select("doc_id", "s", F.explode(F.array_distinct(starts)).alias("start")).select("doc_id", "start", F.slice("s", F.col("start") + 1, F.lit(length)).alias("w")).withColumn("c", F.lit(c))
        windows = own if windows is None else windows.unionByName(own)
    signed = windows.select("doc_id", "start", "w", "c", F.posexplode(minima(F.col("w"))).alias("band", "low"))
    met = signed.join(F.broadcast(bands), ["c", "band", "low"]).select("doc_id", "license", "start", "w", "t", "n").distinct()  # MOST shingles and BANDS values a template at most
    shared = met.select("doc_id", "license", "start", "n", F.size(F.array_intersect("w", "t")).alias("found"), F.array_position(F.transform("w", lambda x: F.array_contains("t", x)), True).alias("first"))
    good = shared.where(F.col("found") >= F.lit(containment) * F.col("n"))
    best = good.groupBy("doc_id", "license").agg(F.max_by(F.struct((F.col("start") + F.col("first") - 1).cast("bigint").alias("first_word"), "found", "n"), F.struct("found", -(F.col("start") + F.col("first")))).alias("b"))
    return best.select("doc_id", "license", "b.first_word", F.col("b.found").cast("bigint").alias("found"), (F.col("b.found") / F.col("b.n")).alias("containment"))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, text string")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, first_word (the passage's first word, from 0), found (template shingles), containment, of all `documents`."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_templates(spark))
