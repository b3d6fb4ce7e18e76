"""Near-duplicate classes by SimHash, found by meet-in-the-middle ball hashing.

1. Each text gives a 64-bit fingerprint: a bit is set if over half of the hashes
   of its shingles, repeats included, have it.  Equal fingerprints are one class.
2. Two fingerprints link at ``RADIUS`` = 3 differing bits or fewer.  The word is
   cut into thirds.  Of a pair's differing bits at least one lies in some third,
   so at most two lie outside it, and half of that is one: each fingerprint emits,
   for each third, all variants of the other 42 or 43 bits with none or one bit
   turned, 131 in all.  A pair that differs in two bits there meets on the
   variant half-way between, one that differs in one bit on either of the two.
3. Variants are shuffled.  Where one is emitted by a single fingerprint it is
   dropped.  Up to ``GROUP`` fingerprints on one variant are verified in
   place, and a spanning forest of their links leaves the task, never the pairs.
4. A variant with more of them is opened: they emit the variants of the left-out
   third as well, within what remains of the radius, and are shuffled again, on
   whole 64-bit variants.  At most 2,081 fingerprints lie within two bits of one
   variant, so these groups are bounded.  All link to the one nearest to the variant, if
   that is within one bit: by the triangle inequality they are within three of it, and
   every pair within three bits has such a variant.  Links are verified all the same.

Edge cases: a null or empty text, or one without words, has the fingerprint zero,
which links like any other.  Fewer words than a shingle make one shingle.  A row
without an id has a fingerprint but takes no part: its component is null.  Rows
that share an id are one document with all their texts' links; every row is
returned.  Other columns do not matter, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .skew import join_counted
from .store import Scratch, materialize

RADIUS = 3
SEED = 42
#: Fingerprints that are compared with each other on one variant.
GROUP = 512
THIRDS = [range(0, 21), range(21, 42), range(42, 64)]

#: Eight counters of a byte each, one for each bit of a byte.
_LANES = np.array([sum(1 << (8 * i) for i in range(8) if x >> i & 1) for x in range(256)], np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: (left-out third, turned bits) of the variants that each fingerprint emits.
_WAYS = [(m, flip) for m, own in enumerate(THIRDS) for flip in [0, *(1 << b for b in range(64) if b not in own)]]
_OUTSIDE = [sum(1 << b for b in range(64) if b not in own) for own in THIRDS]


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    """The 64-bit majority of the hashes of all shingles; no words give zero."""
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum(np.array([len(w) for w in words]) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    k = min(shingle, len(words))
    ranges = zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist())
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in ranges), np.uint64, len(words) - k + 1)
    lanes = np.add.reduceat(_LANES[h.astype("<u8").view(np.uint8).reshape(-1, 8)], np.arange(0, len(h), 255), axis=0)
    count = lanes.astype("<u8").view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text, as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint((x.as_py() or b"").lower().split(), shingle) for x in pc.cast(batch.column(1), pa.binary())), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.mapInArrow(run, "id long, fp long")


def variants(classes: DataFrame) -> DataFrame:
    """(key, fp, way): each fingerprint under its variants outside each third."""
    flips = F.array(*(F.lit(_signed(flip)) for _, flip in _WAYS))
    masks = F.array(*(F.lit(_signed(_OUTSIDE[m])) for m, _ in _WAYS))
    third = F.array(*(F.lit(m) for m, _ in _WAYS))
    rows = classes.select("fp", F.posexplode(flips).alias("way", "flip"))
    at = F.col("way") + 1
    # equal hashes of different variants bring strangers together, who are verified like all others
    key = F.xxhash64(F.element_at(third, at), F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.element_at(masks, at)))
    return rows.select(key.alias("key"), "fp", "way")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within each variant; a group over ``GROUP`` passes on row by row, as (fp, null, way).

    Rows come sorted by variant.  At most ``GROUP`` rows are held over from one batch to the next.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("way", pa.int32())])
    link = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int32())], schema=schema)
    rest, large = np.zeros((3, 0), np.int64), None
    for batch in batches:
        rows = np.concatenate([rest, np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])], axis=1)
        start = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]])) if rows.shape[1] else np.zeros(0, np.int64)
        size = np.diff(np.append(start, rows.shape[1]))
        opened = size > GROUP
        if len(start):
            opened[0] |= large is not None and rows[0, 0] == large
            if opened[-1]:
                large, keep = int(rows[0, -1]), rows.shape[1]
            else:
                large, keep = None, int(start[-1])
            rest = rows[:, keep:]
            ended = start < keep
            start, size, opened = start[ended], size[ended], opened[ended]
        yield from _resolve(rows, start, size, opened, link, schema)
    if rest.shape[1]:
        yield from _resolve(rest, np.zeros(1, np.int64), np.array([rest.shape[1]]), np.zeros(1, bool), link, schema)


def _resolve(rows, start, size, opened, link, schema) -> Iterator[pa.RecordBatch]:
    fp = rows[1].view(np.uint64)
    two = start[(size == 2) & ~opened]
    two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS] if len(two) else two
    if len(two):
        yield link(rows[1, two], rows[1, two + 1])
    a, b = [], []
    for s, n in zip(start[(size > 2) & ~opened].tolist(), size[(size > 2) & ~opened].tolist()):
        own = fp[s : s + n]
        near = np.bitwise_count(own[:, None] ^ own[None, :]) <= RADIUS
        free = np.ones(n, bool)
        for root in range(n):
            if free[root]:
                free[root], front = False, [root]
                while front:
                    at = front.pop()
                    met = np.flatnonzero(near[at] & free)
                    free[met] = False
                    front += met.tolist()
                    a += [int(rows[1, s + at])] * len(met)
                    b += rows[1, s + met].tolist()
    if a:
        yield link(a, b)
    for s, n in zip(start[opened].tolist(), size[opened].tolist()):
        yield pa.RecordBatch.from_arrays([pa.array(rows[1, s : s + n]), pa.nulls(n, pa.int64()), pa.array(rows[2, s : s + n].astype(np.int32))], schema=schema)


def _opened(rows: DataFrame) -> DataFrame:
    """Links (a, b) of the members (fp, way) of large groups, by whole variants."""
    one = [[1 << b for b in own] for own in THIRDS]
    # two turned bits of the third are left only where none is turned outside it
    inner = [[0, *bits] + ([x | y for i, x in enumerate(bits) for y in bits[:i]] if deep else []) for bits in one for deep in (False, True)]
    arrays = [F.array(*(F.lit(_signed(x)) for x in some)) for some in inner]
    third = F.element_at(F.array(*(F.lit(m) for m, _ in _WAYS)), F.col("way") + 1)
    flip = F.element_at(F.array(*(F.lit(_signed(x)) for _, x in _WAYS)), F.col("way") + 1)
    choice: Column = F.lit(None).cast("array<bigint>")
    for k, some in enumerate(arrays):
        choice = F.when((third == k // 2) & ((flip == 0) == F.lit(bool(k % 2))), some).otherwise(choice)
    met = rows.select("fp", F.col("fp").bitwiseXOR(flip).alias("base"), F.explode(choice).alias("turn")).select("fp", F.col("base").bitwiseXOR(F.col("turn")).alias("v")).distinct()
    far = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    nearest = F.min(F.struct(far("fp", "v").alias("r"), F.col("fp").alias("c"))).over(Window.partitionBy("v"))
    found = met.withColumn("near", nearest).select("fp", F.col("near.c").alias("c"), F.col("near.r").alias("r")).filter("r <= 1 and fp <> c")
    return found.filter(far("fp", "c") <= RADIUS).select(F.col("c").alias("a"), F.col("fp").alias("b")).distinct()


def links(own: Scratch, classes: DataFrame) -> DataFrame:
    """(a, b) over different fingerprints (fp): a forest that joins all that link."""
    # one member of an opened group stands under a variant once, so a variant's rows are at most one in 131 of all
    dealt = variants(classes).repartition("key").sortWithinPartitions("key", "fp")
    found = own.write(dealt.mapInArrow(_groups, "a long, b long, way int"), "links")
    near = found.filter("b is not null").select("a", "b").distinct()
    wide = found.filter("b is null").select(F.col("a").alias("fp"), "way")
    return near if wide.isEmpty() else near.union(_opened(wide))


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id), one row for each row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    found = materialize(spark, fingerprints(docs, shingle), "fingerprints")
    usable = found.filter("id is not null")
    with Scratch(spark) as own:
        classes = own.write(usable.groupBy("fp").agg(F.min("id").alias("c"), F.count("*").alias("many")), "classes")
        # rows of one id with different texts tie their fingerprints together
        twice = own.write(usable.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("top"), F.count("*").alias("many")).filter("a <> top").drop("top"), "twice")
        tied = join_counted(usable, twice, ["id"]).filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()
        comp = components(spark, links(own, classes.select("fp")).union(tied))
        label = own.write(classes.join(comp.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "c", "many", F.coalesce("component", "fp").alias("component")), "component")
        least = own.write(label.groupBy("component").agg(F.min("c").alias("component_id"), F.count("*").alias("size")), "least")
        named = join_counted(label.select("component", "fp", "many"), least.withColumnRenamed("size", "rows"), ["component"], many="rows")
        named = materialize(spark, named.select("fp", "component_id", "many"), "labels")
    known = join_counted(usable, named, ["fp"]).select("id", "fp", "component_id")
    rows = known.unionByName(found.filter("id is null").withColumn("component_id", F.lit(None).cast("long")))
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
