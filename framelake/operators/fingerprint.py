"""Perceptual hashes of videos and their comparison."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..plans.planner import schedule


def fingerprints(frames: DataFrame, video: str = "video", pixels: str = "pixels") -> DataFrame:
    """(video, bits, n_frames): a bit per position by majority of the frames; ties are 0.

    A frame's bit is set where a pixel exceeds the frame's mean. Counts are added
    up before the shuffle, so a long video costs a row per task and position.
    """
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(pixels)
    voted = frames.withColumn("__m", mean).select(video, F.posexplode(F.transform(pixels, lambda x: (x.cast("double") > F.col("__m")).cast("int"))).alias("pos", "bit"))
    counts = voted.groupBy(video, "pos").agg(F.sum("bit").alias("ones"), F.count("*").alias("n"))
    bit = F.when(F.col("ones") * 2 > F.col("n"), "1").otherwise("0")
    joined = counts.groupBy(video).agg(F.array_sort(F.collect_list(F.struct("pos", bit.alias("b")))).alias("__x"), F.max("n").alias("n_frames"))
    return joined.select(video, F.array_join(F.transform("__x", lambda s: s["b"]), "").alias("bits"), "n_frames")


def frame_bits(pixels: Column) -> Column:
    """The bits of one frame as a string."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(pixels)
    return F.array_join(F.transform(F.transform(pixels, lambda x: F.struct(x.cast("double").alias("x"), mean.alias("m"))), lambda s: F.when(s["x"] > s["m"], "1").otherwise("0")), "")


def similarity(a: Column, b: Column) -> Column:
    """The share of equal places of two bit strings; 0.0 if either is empty or their lengths differ."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), same / F.length(a)).otherwise(0.0)


def find_similar(prints: DataFrame, reference: str, key: str = "video", bits: str = "bits", threshold: float = T.SIMILARITY_THRESHOLD) -> DataFrame:
    """(key, similarity) of all others at least as similar to one reference; one row is sent to all tasks."""
    one = prints.where(F.col(key) == F.lit(reference)).agg(F.min(bits).alias("__r"))
    scored = prints.where(F.col(key) != F.lit(reference)).crossJoin(F.broadcast(one)).select(key, similarity(F.col(bits), F.col("__r")).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)


def ranked(similar: DataFrame, order: str = "video") -> DataFrame:
    """Adds rank: the most similar first, equal ones in the order of the candidates (a number)."""
    return schedule(similar, "similarity", order).withColumnRenamed("position", "rank")


#: Bytes of hashes that may be sent to all tasks.
BROADCAST = 32_000_000


def probe_plan(n: int, most: int, keys: int = 4096) -> list[tuple[int, int, int]]:
    """(begin, width, radius) of pieces of n bits such that strings with at most ``most`` differences have a piece within its radius.

    If every piece differed in more places than its radius, the differences would
    add up to more than ``most``. Fewer and longer pieces let fewer pairs meet, so
    the fewest are taken for which a piece has at most ``keys`` strings near it.
    """
    for p in range(1, n + 1):
        spare = most - p + 1
        radius = [spare // p + (i < spare % p) if spare >= 0 else 0 for i in range(p)]
        cuts = [n * i // p for i in range(p + 1)]
        plan = [(cuts[i], cuts[i + 1] - cuts[i], radius[i]) for i in range(p)]
        if all(w <= 62 and sum(comb(w, j) for j in range(r + 1)) <= keys for _, w, r in plan):
            return plan[: most + 1]  # more pieces than differences: one of the first is equal
    return [(i, 1, 0) for i in range(n)]


def masks(width: int, radius: int) -> list[int]:
    """All numbers of ``width`` bits with at most ``radius`` of them set."""
    return [sum(1 << i for i in c) for r in range(min(width, radius) + 1) for c in combinations(range(width), r)]


def near_pairs(prints: DataFrame, key: str = "video", bits: str = "bits", threshold: float = T.SIMILARITY_THRESHOLD) -> DataFrame:
    """(a, b, similarity) of all pairs of different hashes at least so similar, and of each hash's first key with every other.

    One side has each piece of a hash as a number, the other all numbers near it
    (``probe_plan``); pairs that meet are compared word by word within the join,
    and only at their first piece that is near. Equal hashes are one entry: the
    pairs are of their smallest keys, and each further key has a pair with its
    hash's smallest. The lengths of hashes (one, as a rule) and their counts are
    asked for first.
    """
    spark = prints.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    entries = prints.where(F.length(bits) > 0).groupBy(bits).agg(F.min(key).alias("k"))
    shared = members(prints.where(F.length(bits) > 0), key, bits).where(F.col(key) != F.col("representative"))
    out = shared.select(F.col("representative").alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("similarity"))
    sizes = entries.groupBy(F.length(bits).alias("n")).count().collect()
    for n, count in sorted(map(tuple, sizes)):
        plan = probe_plan(n, most := int(n * (1.0 - threshold) + 1e-9))
        cuts = plan if sum(w for _, w, _ in plan) == n else [*plan, *((i, min(62, n - i), 0) for i in range(plan[-1][0] + plan[-1][1], n, 62))]
        number = lambda i, w: F.conv(F.substring(F.col(bits), i + 1, w), 2, 10).cast("long")
        own = entries.where(F.length(bits) == n).select("k", *[number(i, w).alias(f"p{c}") for c, (i, w, _) in enumerate(cuts)]).repartition(parts, "k")
        apart = lambda c: F.bit_count(F.col(f"a.p{c}").bitwiseXOR(F.col(f"b.p{c}")))
        total = reduce(lambda x, y: x + y, map(apart, range(len(cuts))))
        for i, (_, width, radius) in enumerate(plan):
            # the side without the near numbers is the small one: sent to all tasks if it fits, else both are dealt by number
            a = own.withColumn("n", F.col(f"p{i}")).hint("broadcast" if count * 8 * (len(cuts) + 4) <= BROADCAST else "shuffle_hash").alias("a")
            b = own.withColumn("m", F.explode(F.lit(masks(width, radius)))).withColumn("n", F.col(f"p{i}").bitwiseXOR(F.col("m"))).alias("b")
            first = [apart(j) > plan[j][2] for j in range(i)]
            met = a.join(b, reduce(lambda x, y: x & y, first, (F.col("a.n") == F.col("b.n")) & (F.col("a.k") < F.col("b.k")) & (total <= most)))
            out = out.union(met.select("a.k", "b.k", ((F.lit(n) - total) / F.lit(n)).alias("similarity")))
    return out


def members(prints: DataFrame, key: str = "video", bits: str = "bits") -> DataFrame:
    """(key, representative): the smallest key with the same hash."""
    least = prints.groupBy(bits).agg(F.min(key).alias("representative"))
    return prints.join(least, bits).select(key, "representative")
