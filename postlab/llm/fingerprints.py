"""Bottom-k fingerprints of documents: mergeable sketches of their word shingles.

A shingle is five consecutive words (a shorter text is one shingle), a word is a
maximal run of non-white-space, lower-cased. A fingerprint is the ascending array
of the ``k`` smallest distinct shingle hashes. From two of them follow estimates
of resemblance and containment, from one the number of distinct shingles; the
fingerprint of several parts is the bottom k of their fingerprints.

Only DataFrame functions are used. Null and empty texts, and texts of white space
alone, have the empty fingerprint. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlab.functions.binding import let
from postlab.session import join_sized, numbered, settle

SHINGLE_WORDS = 5
K = 128
NEIGHBOURS = 6  # ids that agree above these bits share a bucket
CROWD = 4096  # rows of a bucket, beyond which it is split by hash
HASH_BITS = 20


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """One hash per shingle, in text order, from one hash per word.

    Hashes of runs of words are combined by doubling, so five words cost three
    combinations per position instead of joining strings.
    """
    def pair(runs: Column, others: Column, gap: int) -> Column:
        size = F.greatest(F.size(others) - gap, F.lit(0))
        return F.zip_with(F.slice(runs, F.lit(1), size), F.slice(others, F.lit(gap + 1), size),
                          lambda a, b: F.xxhash64(a, b))

    def runs(length: int, hashes: Column) -> Column:
        if length == 1:
            return hashes
        half = length // 2
        return let(runs(half, hashes), lambda r: pair(
            r, r if half * 2 == length else runs(length - half, hashes), half))

    def grown(hashes: Column) -> Column:
        whole = F.array(F.aggregate(hashes, F.lit(42).cast("bigint"), lambda a, h: F.xxhash64(a, h)))
        short = F.when(F.size(hashes) == 0, F.slice(hashes, 1, 0)).otherwise(whole)
        return F.when(F.size(hashes) < words, short).otherwise(runs(words, hashes))

    split = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), " ")
    return let(F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w)), grown)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def fingerprint(text: Column, k: int = K) -> Column:
    return bottom(shingle_hashes(text), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of two parts together."""
    return bottom(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of common shingles, from 0 to 1; two empty fingerprints are alike."""
    def share(both: Column) -> Column:
        common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))

    return let(merge(a, b, k), share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below ``k``, else estimated from the k-th smallest hash."""
    reach = (F.element_at(a, -1).cast("double") + 2.0 ** 63) / 2.0 ** 64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of ``a``'s shingles that ``b`` has too; an empty ``a`` is contained in all."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def merge_groups(df: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """``key, fingerprint`` of all rows of a key; a hot key is cut to k hashes before the shuffle."""
    hashes = df.select(key, F.explode(sketch).alias("hash")).distinct()
    ranked = hashes.withColumn("rank", F.row_number().over(
        Window.partitionBy(key).orderBy("hash"))).filter(F.col("rank") <= k)
    kept = ranked.groupBy(key).agg(F.sort_array(F.collect_set("hash")).alias("fingerprint"))
    return df.select(key).distinct().join(kept, key, "left").withColumn(
        "fingerprint", F.coalesce("fingerprint", F.array().cast("array<bigint>")))


def with_following(df: DataFrame, id: str, payload: list[str]) -> DataFrame:
    """Each row with the payload of the next row by ascending id (``next_*``), the last with the first's.

    ``id`` must be an integer; nulls come first, equal ids follow one another in the
    order of the payload's hash. Rows are moved once, by a bucket of neighbouring ids;
    just the last row of a bucket looks up the first of the next bucket. A bucket that
    repeated or null ids crowd is split by id and leading bits of the hash.
    """
    # Null ids share the bucket in front of all others.
    bucket = F.coalesce(F.shiftright(F.col(id).cast("bigint"), NEIGHBOURS),
                        F.lit(-(1 << (63 - NEIGHBOURS)) - 1))
    hashed = F.xxhash64(*payload)
    crowds = settle(df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n"))
                    .filter(F.col("n") > CROWD).select("_bucket", F.lit(True).alias("_crowd")))
    rows = df.select(id, *payload).withColumn("_bucket", bucket)
    if crowds.isEmpty():
        rows = rows.withColumn("_slice", F.lit(0).cast("bigint"))
    else:
        inside = F.coalesce(F.col(id).cast("bigint").bitwiseAND(F.lit((1 << NEIGHBOURS) - 1)), F.lit(0))
        leading = F.shiftright(hashed, 64 - HASH_BITS) + (1 << (HASH_BITS - 1))
        # In the order of ids and hashes.
        part = F.shiftleft(inside, HASH_BITS) + leading
        rows = join_sized(rows, crowds, "_bucket", "left").withColumn(
            "_slice", F.when(F.col("_crowd"), part).otherwise(F.lit(0))).drop("_crowd")
    cell = ["_bucket", "_slice"]
    order = Window.partitionBy(*cell).orderBy(F.asc_nulls_first(id), hashed, *payload)
    follow = {f"next_{c}": F.lead(c).over(order) for c in payload}
    # Not by row number: a rank limit would keep the three branches from sharing one exchange.
    near = rows.withColumns(follow | {"_less": F.lag(F.lit(True)).over(order),
                                      "_more": F.lead(F.lit(True)).over(order)})
    inner = near.filter("_more")
    ends = near.filter("_more IS NULL").drop(*follow)
    heads = near.filter("_less IS NULL").select(*cell, *payload).toDF(
        "_next_bucket", "_next_slice", *follow)
    ring = numbered(rows.select(*cell).distinct(), *map(F.col, cell))
    size = ring.count()
    following = ring.select(
        F.col("_bucket").alias("_next_bucket"), F.col("_slice").alias("_next_slice"),
        F.pmod(F.col("position") - 1, F.lit(max(size, 1))).alias("position"))
    return inner.select(id, *payload, *follow).unionByName(
        ends.join(ring.join(following, "position").drop("position"), cell)
        .join(heads, ["_next_bucket", "_next_slice"]).select(id, *payload, *follow))
