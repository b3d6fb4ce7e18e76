"""Near-duplicate classes by MinHash with a signature-coordinate inverted join.

1. Documents with the same shingle set form one class; only a class's smallest
   id goes on.
2. Each class posts itself under its coordinate-value pairs.  A pair of sets
   with similarity s agrees on a share s of the ``COORDINATES`` in the mean; a
   pair counts as a match from ``MATCHES`` collisions on.  By the pigeonhole
   principle such a pair meets ``SHARED`` times or more in the ``COORDINATES -
   MATCHES + SHARED`` rarest postings of each (the prefix), so a class with
   fewer postings that others are in is skipped.
3. Collisions are counted: the postings of the prefix are joined with
   themselves, every member with the ``STEPS`` members before it and with the
   posting's first, and pairs are summed over all postings in partial
   aggregates.  That is linear in a posting's length, however long it is.  Pairs
   that met ``SHARED`` times are confirmed on whole signatures; those above the
   match threshold are merged into families.
4. What this left apart is merged posting by posting, in blocks: of a pair that
   shares ``SHARED`` postings the rarest is among the ``COORDINATES - MATCHES +
   1`` rarest of both, so each class skips its longest postings, and postings
   that lie within one family are skipped as well.  No matching pair stays
   apart, and sharing a posting without matching joins nothing.
5. A family is dealt into blocks of bounded rows and shingles.  For each pair of
   blocks the exact intersections of all full sets come from one blocked matrix
   product, and what leaves the task is a spanning forest of the links found, at
   most a row for each member, never the pairs.

Tests hold the result against brute force.

Edge cases: a null or empty text, or one without words, has an empty set and is
linked with nothing.  Fewer words than a shingle make one shingle.  A row
without an id takes no part: its component is null and it is kept.  Rows that
share an id are one document with all their texts' links.  Other columns do not
matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .skew import join_counted
from .store import Scratch, materialize
from .textkernel import chunks, mix, shingle_sets

COORDINATES = 32
#: P(fewer matches | similarity 0.8) is about 3e-5; lower similarities would be lost more often.
MATCHES = 16
LEAST_PERCENT = 80
#: Postings of the prefix that a matching pair shares at least.
SHARED = 5
#: Members of a posting that each member is counted with, besides the first.
STEPS = 2
#: Members of a posting that one task orders.
PIECE = 1024
#: Rows and shingles of one side of a comparison block.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 21
#: Shingles of one step of the matrix product.
COLUMNS = 4096

_rng = np.random.Generator(np.random.PCG64(8))
_A = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, hi, lo, sig): set size, 128-bit digest of the set, coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, chunk in chunks(batch.column(1), lower=True):
                sets = list(shingle_sets(chunk, words))
                size = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                full = np.flatnonzero(size)
                at = (np.cumsum(size) - size)[full]
                sig = np.zeros((len(sets), COORDINATES), np.uint64)
                hi, lo = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if len(full):
                    for k in range(COORDINATES):
                        x = flat * _A[k] + _B[k]
                        sig[full, k] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), at)
                    hi[full] = np.add.reduceat(mix(flat), at)
                    lo[full] = np.add.reduceat(mix(flat ^ _A[0]), at)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(sig.view(np.int64).ravel()), COORDINATES).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), lists], names=["id", "n", "hi", "lo", "sig"])

    return docs.mapInArrow(run, "id long, n long, hi long, lo long, sig array<long>")


def prefix_postings(spark: SparkSession, own: Scratch, classes: DataFrame) -> DataFrame:
    """(token, c, many, near): each class under the rarest of its coordinate-value pairs.

    ``many`` is the posting's length, ``near`` whether the pair is among the rarest
    that one shared posting of a match must be in.
    """
    tokens = classes.select(F.col("id").alias("c"), F.posexplode("sig")).select("c", F.xxhash64("pos", "col").alias("token"))
    shared = own.write(tokens.groupBy("token").agg(F.count("*").alias("many")).filter("many > 1"), "tokens")
    found = join_counted(tokens, shared.withColumn("length", F.col("many")), ["token"])
    mine = Window.partitionBy("c")
    kept = found.withColumn("rank", F.row_number().over(mine.orderBy("length", "token"))).withColumn("own", F.count("*").over(mine))
    # what is posted by one class alone comes first in the order and meets nobody
    at = F.col("rank") + (COORDINATES - F.col("own"))
    kept = kept.filter((F.col("own") >= MATCHES) & (at <= COORDINATES - MATCHES + SHARED))
    return own.write(kept.select("token", "c", F.col("length").alias("many"), (at <= COORDINATES - MATCHES + 1).alias("near")), "postings")


def _linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(root, member) over the graph of links between some full sets."""
    size = np.array([len(x) for x in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, column, many = np.unique(flat, return_inverse=True, return_counts=True)
    shared = many[column] > 1
    place = np.cumsum(many > 1) - 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        s, e = np.searchsorted(column, [a, a + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[s:e], column[s:e] - a] = 1
        both += part @ part.T
    both = both.astype(np.float64)  # float32 counts are exact, a hundred times them may not be
    return _forest(100.0 * both >= percent * (size[:, None] + size[None, :] - both))


def _forest(link: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) for each component of a small graph."""
    free, out = np.ones(len(link), bool), []
    for root in range(len(link)):
        if free[root]:
            free[root], front = False, [root]
            while front:
                near = np.flatnonzero(link[front.pop()] & free)
                free[near] = False
                front += near.tolist()
                out += [(root, x) for x in near.tolist()]
    return out


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _by_unit(solve):
    """Runs ``solve`` on the batches of each unit; rows come sorted by the first three columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for s, e in zip(cut, cut[1:]):
                if e > s:
                    if now != (at := tuple(key[s].tolist())):
                        if held:
                            yield from solve(held)
                        now, held = at, []
                    held.append(batch.slice(s, e - s))
        if held:
            yield from solve(held)

    return run


def _matching(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that join the families of one block of a posting."""
    t = pa.Table.from_batches(held).combine_chunks()
    c, comp = t["c"].to_numpy(), t["comp"].to_numpy()
    sig = t["sig"].chunk(0).flatten().to_numpy().reshape(len(c), COORDINATES)
    count = np.zeros((len(c), len(c)), np.int16)
    for k in range(COORDINATES):
        count += sig[:, k][:, None] == sig[:, k][None, :]
    met, out = set(), []
    for x, y in _forest((count >= MATCHES) | (comp[:, None] == comp[None, :])):
        if comp[x] != comp[y] and comp[y] not in met:
            met.add(comp[y])
            out.append((int(c[x]), int(c[y])))
    if out:
        yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]}, _PAIR)


def _blocks(own: Scratch, rows: DataFrame, group: str, key: str) -> DataFrame:
    """``rows`` (with n, a row's shingles) with i and j: each pair of a group's blocks is a unit."""
    size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    many = own.write(rows.groupBy(group).agg(size.alias("blocks"), F.count("*").alias("many")), "many")
    dealt = join_counted(rows, many, [group]).withColumn("side", F.expr(f"cast(pmod(xxhash64({key}), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return dealt.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("blocks", "side", "other")


def collisions(postings: DataFrame) -> DataFrame:
    """(a, b): pairs of classes that meet in enough postings of the prefix, as far as they are counted."""
    piece = Window.partitionBy("token", "piece").orderBy("c")
    rows = postings.withColumn("piece", F.expr(f"cast(pmod(xxhash64(c), ceil(many / {PIECE})) as int)"))
    # the first of each piece stands for it; where a posting is one piece, it is the first of all
    head = F.when(F.row_number().over(piece) > STEPS + 1, F.first("c").over(piece))
    met = rows.select(F.array(*(F.lag("c", k).over(piece) for k in range(1, STEPS + 1)), head).alias("met"), F.col("c").alias("b"))
    near = met.select(F.explode("met").alias("a"), "b").filter("a is not null")
    return near.groupBy("a", "b").agg(F.count("*").alias("met")).filter(F.col("met") >= SHARED).select("a", "b")


def _open(own: Scratch, label: DataFrame) -> DataFrame:
    """Postings across families, of classes that have enough of them."""
    ends = label.groupBy("token").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), F.count("*").alias("many")).filter("p <> q").select("token", "many")
    ends = own.write(ends, "ends")
    rows = join_counted(label.drop("many"), ends, ["token"])
    return own.last(rows.withColumn("open", F.count("*").over(Window.partitionBy("c"))).filter(F.col("open") >= SHARED).drop("open"), "open")


def _families(spark: SparkSession, own: Scratch, postings: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) over the pairs that collide often enough."""
    sig = classes.select("id", "sig").hint("merge")
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    pairs = own.write(collisions(postings), "collisions")
    pairs = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    links = own.write(pairs.filter(agree >= MATCHES).select("a", "b"), "matches")
    comp = components(spark, links, "families")

    label = postings.join(comp.withColumnRenamed("node", "c").hint("merge"), "c", "left").select("token", "c", "near", F.coalesce("component", "c").alias("comp"))
    rest = _open(own, _open(own, own.write(label, "label")))
    if rest.isEmpty():
        return comp
    rows = _blocks(own, rest.filter("near").select("token", "c", "comp", F.lit(0).alias("n")), "token", "c").join(sig.withColumnRenamed("id", "c"), "c")
    dealt = rows.select("token", "i", "j", "c", "comp", "sig").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    found = own.write(dealt.mapInArrow(_by_unit(_matching), "a long, b long"), "matches")
    return comp if found.isEmpty() else components(spark, links.union(found), "families")


def _packed(docs: DataFrame) -> DataFrame:
    """(id, packed, size): compressed texts, which halves what the shuffles carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(x.as_py() or "").encode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64())], names=["id", "packed", "size"])

    return docs.mapInArrow(run, "id long, packed binary, size long")


def _compare(words: int, percent: int):
    """Links within each (family, i, j)."""

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sets = [x for part in held for x in part.column(3).to_pylist()], []
        for part in held:
            texts = pa.array([pa.decompress(x.as_buffer(), n.as_py(), codec="zstd", asbytes=True).decode() for x, n in zip(part.column(4), part.column(5))], pa.string())
            for _, _, chunk in chunks(texts, lower=True):
                sets += list(shingle_sets(chunk, words))
        if len(c) > 1 and (found := _linked(sets, percent)):
            yield pa.RecordBatch.from_pydict({"a": [c[x] for x, _ in found], "b": [c[y] for _, y in found]}, _PAIR)

    return _by_unit(solve)


def _family_links(spark: SparkSession, own: Scratch, docs: DataFrame, postings: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what the full sets connect."""
    family = _families(spark, own, postings, classes).select(F.col("node").alias("id"), F.col("component").alias("family"))
    family = own.write(family.join(classes.select("id", "n").hint("merge"), "id"), "family")
    plan = own.write(_blocks(own, family, "family", "id"), "blocks")
    # both sides grow with the corpus, so they meet by a shuffle at any size;
    # texts travel, not their shingles: they are smaller, and hashed where they are compared
    rows = _packed(docs).join(plan.hint("merge"), "id").select("family", "i", "j", "id", "packed", "size")
    dealt = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return own.write(dealt.mapInArrow(_compare(words, percent), "a long, b long"), "links")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each row of ``docs``."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"the coordinates find pairs of {LEAST_PERCENT} percent or more")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    found = materialize(spark, signatures(docs, words), "signatures")
    usable = found.filter("n > 0 and id is not null")
    keys = ["hi", "lo", "n"]
    by_set = materialize(spark, usable.groupBy(*keys).agg(F.min("id").alias("c"), F.count("*").alias("many")), "classes")
    with Scratch(spark) as own:
        # rows of one id with different sets: their classes are the same document
        ids = own.write(join_counted(usable.select("id", *keys), by_set, keys).select("id", "c"), "ids")
        twice = own.write(ids.groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("top"), F.count("*").alias("many")).filter("a <> top").drop("top"), "twice")
        links = own.write(join_counted(ids, twice, ["id"]).filter("a <> c").select("a", F.col("c").alias("b")).distinct(), "links")
        # of equal ids and sets one row is enough
        # a set so small that one shingle more or less ends the likeness has no other links
        some = usable.filter(100 * F.col("n") >= percent * (F.col("n") + 1))
        some = some.join(by_set.select(*keys, F.col("c").alias("id")), [*keys, "id"], "left_semi").dropDuplicates([*keys, "id"])
        classes = own.write(some.select("id", "n", "sig"), "classes")
        # a document with several sets has one row here for each: any of them may bring it into a family
        postings = prefix_postings(spark, own, classes)
        links = links.union(_family_links(spark, own, docs, postings, classes, words, percent))
        comp = components(spark, links)

    label = by_set.join(comp.withColumnRenamed("node", "c").hint("merge"), "c", "left").select(*keys, "many", F.coalesce("component", "c").alias("label"))
    label = materialize(spark, label, "labels")
    known = join_counted(found.drop("sig").filter("n > 0 and id is not null"), label, keys).select("id", "n", F.col("label").alias("component_id"))
    rows = known.unionByName(found.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id")))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
