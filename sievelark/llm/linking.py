"""Groups of rows that are linked through shared tokens, without making all pairs of a large group.

Rows that share a token are candidates; `verify` says which pairs are links. What is asked for is the
connected components of all links, so a pair within one component need not be looked at. Rounds: first,
each token's most central row is paired with the token's other rows; components of the links found are formed; the next
rounds pair only rows of different components, again as stars but of the rows that were no centre before, and the last one makes all
such pairs, whatever the stars found. It is left out only where no token has rows of several components. A group of n near
copies thus costs about n pairs, while no link between two components is left unverified.

In the last round only rows of like size meet: each token is split by `band`, and rows meet those of their own band and the next. A token of
many rows is dealt out further: its rows form parts of about `cell` rows, and each two parts meet under a key of their own, so no task has all pairs of a token.
Rows that share a passage share a dozen tokens of very many rows; they meet under one of them: each knows its `KNOWN` largest tokens, and two rows that both know a larger one
in common leave their pair to that.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .lineage import cut, discard, release, written

#: From more rows on, a token of the last round is one by which rows tell that they have met, and so many of them a row knows.
LARGE, KNOWN = 256, 4

Fits = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def band(size: Column, similarity: float) -> Column:
    """A number for a size, such that sizes of which the less is `similarity` of the greater or more have the same or neighbouring numbers."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / math.log(1.01 / similarity)).cast("int")


def _met(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("id", "other_id").alias("u"), F.greatest("id", "other_id").alias("v")).distinct()


def _other(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(f"other_{c}") for c in rows.columns if c not in keys])


def _star_pairs(rows: DataFrame, centres: DataFrame, fits: Fits) -> DataFrame:
    return _met(rows.join(_other(centres, "token"), "token").where(fits(F.col, lambda c: F.col(f"other_{c}"))))


def _told(rows: DataFrame) -> DataFrame:
    """Those `rows` of large tokens (held: the rows of a token), and earlier: which of the row's largest tokens come before this one."""
    # rows of one id that differ in anything that `fits` may read do not speak for each other
    own = F.xxhash64(*[c for c in rows.columns if c not in ("token", "held")])
    large = rows.where(F.col("held") > LARGE).withColumn("own", own)
    # a row has no more tokens than its text has pieces: few in a window
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("held"), "token"))
    each = Window.partitionBy("own").orderBy(F.desc("held"), "token").rowsBetween(Window.unboundedPreceding, -1)
    return large.withColumn("rank", rank).withColumn("earlier", F.collect_list(F.when(F.col("rank") <= KNOWN, F.col("token"))).over(each)).drop("own", "rank")


def _all_pairs(rows: DataFrame, fits: Fits, cell: int) -> DataFrame:
    """Pairs of rows (with held) that share a token; each two parts i, j of a large token meet under (token, i, j)."""
    # columns in the order that _other gives them: both sides are one shuffle then
    small = rows.where(F.col("held") <= LARGE).select("token", *[c for c in rows.columns if c not in ("token", "held")])
    few = small.join(_other(small, "token"), "token").where((F.col("comp") < F.col("other_comp")) & (F.abs(F.col("band") - F.col("other_band")) <= 1))
    few = few.where(fits(F.col, lambda c: F.col(f"other_{c}"))).select("id", "other_id")
    parts = _told(rows).withColumn("parts", F.ceil(F.col("held") / cell).cast("int")).drop("held").withColumn("part", F.pmod(F.xxhash64("id", "token"), F.col("parts")).cast("int"))

    def dealt(own: DataFrame, to: str) -> DataFrame:
        # most tokens are of one part: their rows stay one each
        several = own.where("parts > 1").withColumn(to, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return own.where("parts = 1").withColumn(to, F.lit(0)).unionByName(several).drop("part", "parts").withColumn("level", F.col("band"))

    first, second = dealt(parts.withColumn("i", F.col("part")), "j"), dealt(parts.withColumn("j", F.col("part")), "i")
    # two rows of neighbouring bands meet once, in the lower one; two of one band in both orders
    second = second.unionByName(second.withColumn("level", F.col("band") - 1))
    joined = first.join(_other(second, "token", "level", "i", "j"), ["token", "level", "i", "j"])
    near = joined.where((F.col("band") < F.col("other_band")) | (F.col("comp") < F.col("other_comp"))).where(fits(F.col, lambda c: F.col(f"other_{c}")))
    return _met(near.where(~F.arrays_overlap("earlier", "other_earlier")).select("id", "other_id").unionByName(few))


def _mixed(rows: DataFrame) -> DataFrame:
    """token, rows and p, the most central row, of each token whose rows lie in several components."""
    cols = [c for c in rows.columns if c not in ("token", "central", "id")]
    best = rows.groupBy("token").agg(F.max(F.struct("central", "id", *cols)).alias("p"), F.count("*").alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return best.where("lo <> hi").select("token", "rows", "p")


def _last(now: DataFrame) -> DataFrame:
    """Those `now` (with held) whose token has rows of several components. Only large tokens are asked: the pairs of a small one are soon looked at."""
    large = now.where(F.col("held") > LARGE)
    several = large.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    return now.where(F.col("held") <= LARGE).unionByName(large.join(several, "token").select(*now.columns))


def link(rows: DataFrame, fits: Fits, verify: Callable[[DataFrame], DataFrame], given: DataFrame | None = None, tried: DataFrame | None = None, stars: int = 2, cell: int = 2048, spent: Sequence[DataFrame] = ()) -> DataFrame:
    """node, component of every row with a link.

    rows: token, id, central (for stars), perhaps band and held (how many rows the token has; without stars only), and whatever columns `fits` compares. given: links u, v known before.
    tried: pairs u, v that `verify` has seen for these.
    verify: of distinct pairs u < v to those that are links. cell: rows of a token that meet in one place in the last round.
    spent: what `rows` reads, if nothing else does: deleted when it has been.
    """
    apart: Fits = lambda a, b: (a("comp") != b("comp")) & fits(a, b)
    rows = rows if "band" in rows.columns else rows.withColumn("band", F.lit(0))
    own = [c for c in rows.columns if c != "token"]
    nothing = rows.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)
    label, links = None, given
    for k in range(stars + 1):
        if links is not None:
            label, links = components(links), None
        release(rows.sparkSession)
        if label is not None:
            now = rows.join(label.select(F.col("node").alias("id"), F.col("component")), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        else:
            now = rows.withColumn("comp", F.col("id"))
        mixed = None
        if k == stars and "held" in rows.columns:
            now = written(now)
            discard(*spent)
            spent = [now]
            release(rows.sparkSession)
        else:
            mixed = cut(_mixed(now))
        if mixed is not None and mixed.isEmpty():
            break
        if k < stars:
            pairs = _star_pairs(now, mixed.select("token", "p.*"), apart)
        else:
            # written once, as it is read several times: a table, so that joins with itself shuffle it once
            last = written(_last(now) if mixed is None else now.drop("central").join(mixed.select("token", F.col("rows").alias("held")), "token"))
            discard(*spent)
            release(rows.sparkSession)
            pairs = _all_pairs(last, apart, cell)
        pairs = cut(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"))
        if k < stars:
            # a centre has met all rows of its token, and a token of one component has no pairs to make: neither is needed again
            left = mixed.where("rows > 2").select("token", F.xxhash64(*[f"p.{c}" for c in own]).alias("centre"))
            rows = cut(now.join(left, "token").where(F.xxhash64(*own) != F.col("centre")).select("token", *own))
            discard(*spent)
            spent = [rows]
        else:
            discard(last)
            release(rows.sparkSession)
        if pairs.isEmpty():
            continue  # nothing new from these stars; the last round still makes all pairs
        found = cut(verify(pairs))
        release(rows.sparkSession)
        links = found if label is None else label.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
    if links is not None:
        label = components(links)
    return nothing if label is None else label
