"""Phrase collocations: sketch upper bounds, then exact counts by automata.

1. Texts are cut into pieces and words and packed into shards, runs of documents
   of one language and about ``SHARD_BYTES`` of text, in which every word has a space on
   either side and every piece ends in a line feed.
2. Every shard posts its phrases of one to ``words`` words into the cells of a
   sketch, which has a cell for each two phrase occurrences and so grows with the corpus.
   A cell's total is an upper bound of the occurrences of each phrase in it.  Cells
   are dealt into ranges; a range adds up what the shards post, with counts
   clipped at the least count asked for, and answers each shard with a bit for each
   of its cells.  No sketch is gathered or broadcast.
3. A shard compiles its candidates, the phrases in cells that reach the least
   count, with a space on either side into an Aho-Corasick automaton, scans its
   text once and counts all matches, overlapping ones too.  Spaces guard whole
   words, line feeds the ends of pieces.  Counts are summed over shards and the threshold
   is applied to the exact sums: a phrase over it is a candidate in every shard that has it.
4. A candidate's score is that of its lowest cut; a phrase inside a longer one
   that is at least half as frequent is dropped; the first ones of each language are
   ranked in steps, so that no task holds all phrases of a language.

Candidates are told apart by 64-bit hashes.  If a shard's matches are not as many as its
candidate windows, two phrases share a hash, and the automaton is compiled from the texts of all windows.

Edge cases: null and empty texts have no words.  A null language is ``und``.  All
rows count, repeated ones as often as they are there; ids do not matter, nor do
other columns, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Scratch, materialize
from .textkernel import Chunk, buffers, mix, spans

SHARD_BYTES = 2 << 20
#: Phrase occurrences for each cell of the sketch.
LOAD = 2
#: Cells of one range, as a power of two.
RANGE_BITS = 21
#: Phrases that one task ranks, and the first ones of each language.
RANKED = 100_000

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BREAKS = _ENDS.copy()
_BREAKS[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _normal(data: np.ndarray, offsets: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of words, and all pieces as `` word word \\n``, lower-cased."""
    chunk = Chunk(data, offsets, breaks=_BREAKS)
    many = len(chunk.start)
    if not many:
        return 0, np.zeros(0, np.uint8)
    ends = np.concatenate([[0], np.cumsum(_ENDS[data])])
    new = np.zeros(many, bool)
    new[1:] = (ends[chunk.start[1:]] != ends[chunk.end[:-1]]) | (chunk.word_doc[1:] != chunk.word_doc[:-1])
    size = chunk.end - chunk.start
    shift = np.arange(1, many + 1) + 2 * np.cumsum(new)
    out = np.full(int(size.sum()) + many + 2 * (int(new.sum()) + 1), 0x20, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(shift, size)] = _LOWER[data[chunk.is_word]]
    after = np.cumsum(size) + shift
    out[after[np.append(new[1:], True)] + 1] = 0x0A
    return many, out


def shards(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, words, size, packed): runs of texts of one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in pc.unique(batch.column(0)):
                data, offsets = buffers(batch.column(1).filter(pc.equal(batch.column(0), one)))
                for a, b in spans(offsets, SHARD_BYTES):
                    many, normal = _normal(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    if many:
                        yield pa.RecordBatch.from_arrays([pa.array([one.as_py()]), pa.array([many]), pa.array([len(normal)]), pa.array([pa.compress(normal, codec="zstd", asbytes=True)])], names=["lang", "words", "size", "packed"])

    rows = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("text is not null")
    return rows.mapInArrow(run, "lang string, words long, size long, packed binary")


class Windows:
    """Phrases of one to ``most`` words of a shard's text, with their sketch cells."""

    def __init__(self, lang: str, raw: bytes, most: int, bits: int):
        self.raw = raw
        data = np.frombuffer(raw, np.uint8)
        chunk = Chunk(data, np.array([0, len(data)]))
        self.start, self.end = chunk.start, chunk.end
        piece = np.concatenate([[0], np.cumsum(data == 0x0A)])[self.start]
        h, many = chunk.word_hash(), len(chunk.start)
        seed = np.uint64(hash_of(lang))
        rolled, at, last, found = np.full(many, seed), [], [], []
        for k in range(1, most + 1):
            n = max(0, many - k + 1)
            rolled = mix(rolled[:n] * np.uint64(0x100000001B3) + h[k - 1 : k - 1 + n])
            inside = np.flatnonzero(piece[:n] == piece[k - 1 : k - 1 + n]).astype(np.int32)
            at.append(inside)
            last.append(inside + np.int32(k - 1))
            found.append(rolled[inside])
        self.at, self.last, self.hash = np.concatenate(at), np.concatenate(last), np.concatenate(found)
        # a cell is the hash's first bits, so one order serves cells and phrases
        self.order = np.argsort(self.hash).astype(np.int32)
        self.sorted = self.hash[self.order]
        ranked = self.sorted >> np.uint64(64 - bits)
        self.first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        self.cell = ranked[self.first].astype(np.int64)
        self.many = np.diff(np.append(self.first, len(ranked))).astype(np.int32)
        #: Where each range's cells begin, and its number.
        home = self.cell >> RANGE_BITS
        self.cut = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
        self.range = home[self.cut]

    def parts(self) -> Iterator[tuple[int, slice]]:
        for r, a, b in zip(self.range.tolist(), self.cut.tolist(), np.append(self.cut[1:], len(self.cell)).tolist()):
            yield r, slice(a, b)

    def guarded(self, windows: np.ndarray) -> list[str]:
        """The windows' phrases with the spaces around them."""
        places = zip((self.start[self.at[windows]] - 1).tolist(), (self.end[self.last[windows]] + 1).tolist())
        return [self.raw[a:b].decode() for a, b in places]

    def counted(self, flagged: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The phrases of the flagged cells, and their matches in the text."""
        here = np.repeat(flagged, self.many)
        windows, sorted_ = self.order[here], self.sorted[here]
        phrases, times = self._scan(self.guarded(windows[np.concatenate([[True], sorted_[1:] != sorted_[:-1]])] if len(windows) else windows))
        if times.sum() != len(windows):  # two phrases share a hash
            phrases, times = self._scan(sorted(set(self.guarded(windows))))
        return phrases, times

    def _scan(self, guarded: list[str]) -> tuple[list[str], np.ndarray]:
        if not guarded:
            return guarded, np.zeros(0, np.int64)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, phrase in enumerate(guarded):
            automaton.add_word(phrase, i)
        automaton.make_automaton()
        hits = np.fromiter((i for _, i in automaton.iter(self.raw.decode())), np.int64)
        return [x[1:-1] for x in guarded], np.bincount(hits, minlength=len(guarded))


def hash_of(lang: str) -> int:
    """A fixed 64-bit number for a language."""
    data = np.frombuffer(b"." + lang.encode(), np.uint8)
    return int(Chunk(data, np.array([0, len(data)]), breaks=np.zeros(256, bool)).word_hash()[0])


def _squeezed(numbers: np.ndarray) -> bytes:
    """Rising numbers as compressed gaps, byte by byte."""
    gaps = np.diff(numbers, prepend=0).astype("<u4")
    return pa.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def _spread(cell: pa.Scalar, many: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(cell.as_buffer(), 4 * many, codec="zstd"), np.uint8).reshape(4, many)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str, bytes]]:
    for shard, lang, size, packed in zip(batch["shard"].to_pylist(), batch["lang"].to_pylist(), batch["size"].to_pylist(), batch["packed"]):
        yield shard, lang, pa.decompress(packed.as_buffer(), size, codec="zstd", asbytes=True)


def postings(rows: DataFrame, words: int, least: int, bits: int) -> DataFrame:
    """(range, shard, many, cells, times): what each shard has in each range of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, raw in _texts(batch):
                own = Windows(lang, raw, words, bits)
                out = [(r, shard, s.stop - s.start, _squeezed(own.cell[s] & ((1 << RANGE_BITS) - 1)), pa.compress(np.minimum(own.many[s], least).astype(np.uint8), codec="zstd", asbytes=True)) for r, s in own.parts()]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["range", "shard", "many", "cells", "times"])

    return rows.mapInArrow(run, "range long, shard long, many long, cells binary, times binary")


def answers(posted: DataFrame, least: int) -> DataFrame:
    """(shard, range, bits): which of a shard's cells reach the least count in all shards together."""

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RANGE_BITS, np.int32)
        for batch in held:
            for many, cells, times in zip(batch["many"].to_pylist(), batch["cells"], batch["times"]):
                total[_spread(cells, many)] += np.frombuffer(pa.decompress(times.as_buffer(), many, codec="zstd"), np.uint8)
        enough = total >= least
        for batch in held:
            bits = [np.packbits(enough[_spread(cells, many)]).tobytes() for many, cells in zip(batch["many"].to_pylist(), batch["cells"])]
            some = [i for i, x in enumerate(bits) if any(x)]
            if some:
                yield pa.RecordBatch.from_arrays([batch["shard"].take(pa.array(some)), batch["range"].take(pa.array(some)), pa.array([bits[i] for i in some])], names=["shard", "range", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            key = batch["range"].to_numpy()
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for s, e in zip(cut, cut[1:]):
                if e > s:
                    if now != key[s] and held:
                        yield from solve(held)
                        held = []
                    now = key[s]
                    held.append(batch.slice(s, e - s))
        if held:
            yield from solve(held)

    # a shard has one row in a range, a byte or two for each of its cells there
    return posted.repartition("range").sortWithinPartitions("range").mapInArrow(run, "shard long, range long, bits binary")


def phrase_counts(rows: DataFrame, found: DataFrame, words: int, least: int, bits: int) -> DataFrame:
    """(lang, phrase, f): all matches of the candidates; ``found`` has the shards' answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (_, lang, raw), answered in zip(_texts(batch), batch["answers"].to_pylist()):
                own, known = Windows(lang, raw, words, bits), {x["range"]: x["bits"] for x in answered}
                flagged = np.zeros(len(own.cell), bool)
                for r, s in own.parts():
                    if r in known:
                        flagged[s] = np.unpackbits(np.frombuffer(known[r], np.uint8), count=s.stop - s.start).view(bool)
                phrases, times = own.counted(flagged)
                yield pa.RecordBatch.from_arrays([pa.array([f"{lang}\n{x}" for x in phrases], pa.string()), pa.array(times)], names=["key", "f"])

    # a shard's answers are fewer bytes than its text
    answered = found.groupBy("shard").agg(F.collect_list(F.struct("range", "bits")).alias("answers"))
    both = rows.select("shard", "lang", "size", "packed").join(answered.hint("merge"), "shard")
    # language and phrase, which has no line feed, travel as one text
    sums = both.mapInArrow(run, "key string, f long").groupBy("key").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return sums.select(F.regexp_replace("key", r"\n[^\n]*$", "").alias("lang"), F.substring_index("key", "\n", -1).alias("phrase"), "f")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): phrases of two words or more, by their lowest cut."""
    parts, size = F.split("phrase", " "), F.size(F.split("phrase", " "))
    many = counts.filter(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("f").alias("a"), parts.alias("w"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = many.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"))
    own = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)).hint("merge")
    cuts = cuts.join(own("head", "l"), ["lang", "head"]).join(own("tail", "r"), ["lang", "tail"])
    exact = F.expr("(cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    best = cuts.withColumn("score", exact).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def inner_phrases(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longest): phrases of two words or more inside longer ones, with the highest count of these."""
    w = F.split("phrase", " ")
    deep = counts.withColumn("w", w).filter(F.size("w") > 2)
    each = F.expr("flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    return deep.select("lang", F.explode(each).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def _first(rows: DataFrame, top: int, salts: int) -> DataFrame:
    """The first ``top`` of each language with their rank; no task ranks a whole language."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    while salts > 1:
        salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("rank") <= top).drop("rank")
        salts = -(-salts * top // RANKED) if top < RANKED else 1
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def mine(spark: SparkSession, docs: DataFrame, words: int = 3, least: int = 10, percent: int = 50, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first collocations."""
    if not 2 <= least <= 255:
        raise ValueError("the least count is 2 to 255, as cells hold a byte")
    with Scratch(spark) as own:
        rows = own.write(shards(docs, lang, text).withColumn("shard", F.monotonically_increasing_id()), "shards")
        total = rows.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
        bits = max(RANGE_BITS, (words * total // LOAD).bit_length())
        found = own.write(answers(postings(rows, words, least, bits), least), "answers")
        counts = own.write(phrase_counts(rows, found, words, least, bits), "counts")
        inner = inner_phrases(counts).hint("merge")
        kept = scored(counts).join(inner, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longest") < percent * F.col("a"), F.lit(True))).drop("longest")
        kept = own.write(kept, "scored")
        size = rows.groupBy("lang").agg(F.sum("words").alias("n"))
        best = _first(kept, top, -(-kept.count() // RANKED)).join(size, "lang")
        return materialize(spark, best.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score"), "phrases")
