"""A kept inverted text index: postings by term, small segments for changes, a drift check.

Postings lie in folders by a hash of their term and, in these, in files sorted
by term, so a search reads its terms' folders and skips all row groups of other
terms.  A posting carries its document's length, so scoring joins nothing.  Every
change writes one more segment and a manifest that names the live ones; rows
that a later segment replaces or removes are told by its ``gone`` table.  Readers
see a change as a whole or not at all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import has_cjk, tokens
from ..sources.shared import Versions
from .search import K1, LEAST_IDF, B

#: Tokens of one folder of postings, and folders at most.
FOLDER_TOKENS, MOST_FOLDERS = 1_000_000, 4096
LEAST_FOLDERS = 8
#: Segments from which a change rewrites them as one.
MOST_SEGMENTS = 8
#: Tokens of a folder that one task writes.
TASK_TOKENS = 8_000_000
#: Tokens whose postings a task makes at once; one text may have more.
BATCH_TOKENS = 1_000_000

_POSTING = "term string, id long, f int, len int, segment int, bucket int"
_LENGTH = "id long, len int, segment int"
_GONE = "id long, segment int"


@dataclass(frozen=True)
class Drift:
    """Why an index no longer fits its table; empty if it does."""

    reasons: tuple[str, ...]

    def __bool__(self) -> bool:
        return bool(self.reasons)


class TextIndex:
    """An inverted index of (id, text) rows in a folder.

    Null texts count as documents without tokens; a row without an id takes no
    part; of rows of one id one text counts, the first by its hash and order.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, self.path)

    # ---- changes

    def build(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", stamp: str = "") -> TextIndex:
        """Replaces whatever the folder holds by an index of ``docs``."""
        before, mark = self.versions.current(), self.versions.begin()
        rows = _rows(docs, id_col, text)
        segment = before.get("next", 1)
        self._lengths(rows, segment).write.mode("overwrite").parquet(f"{self.path}/lengths/segment={segment}")
        docs_now, words, texts, top = self._read("lengths", _LENGTH, [segment]).agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0)), F.count("len"), F.max("id")).first()
        folders = min(MOST_FOLDERS, max(LEAST_FOLDERS, -(-words // FOLDER_TOKENS)))
        self._write_postings(rows, segment, folders, words)
        content = {"segments": [segment], "next": segment + 1, "folders": folders, "rows": docs_now, "words": words, "texts": texts, "max_id": top, "gone": False, "stamp": stamp}
        self.versions.forget()  # what earlier writers left undone is replaced as well
        self.versions.commit(content, mark, before.get("version", 0))
        for old in before.get("segments", []):
            self._drop(old)
        return self

    def add(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", stamp: str = "") -> TextIndex:
        """Adds rows, in place of those with the same ids."""
        return self._change(_rows(docs, id_col, text), stamp)

    def remove(self, ids: DataFrame, id_col: str = "doc_id", stamp: str = "") -> TextIndex:
        return self._change(ids.select(F.col(id_col).cast("long").alias("id"), F.lit(None).cast("string").alias("text")).filter("id is not null").distinct(), stamp, True)

    def _change(self, rows: DataFrame, stamp: str, only_remove: bool = False) -> TextIndex:
        now = self.versions.current()
        if not now:
            raise ValueError("there is no index here: build it first")
        mark, segment = self.versions.begin(), now["next"]
        old = self.lengths().join(rows.select("id").distinct(), "id", "left_semi")
        old.select("id").write.mode("overwrite").parquet(f"{self.path}/gone/segment={segment}")
        # read before the new manifest counts, so these are the lengths that go
        lost_rows, lost_words, lost_texts = old.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0)), F.count("len")).first()
        if only_remove:
            more, words, texts = 0, 0, 0
        else:
            self._lengths(rows, segment).write.mode("overwrite").parquet(f"{self.path}/lengths/segment={segment}")
            more, words, texts = self._read("lengths", _LENGTH, [segment]).agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0)), F.count("len")).first()
            self._write_postings(rows, segment, now["folders"], words)
        content = now | {"next": segment + 1, "segments": now["segments"] + [segment], "rows": now["rows"] + more - lost_rows, "words": now["words"] + words - lost_words, "texts": now["texts"] + texts - lost_texts, "gone": now["gone"] or lost_rows > 0, "stamp": stamp}
        content["max_id"] = self._lengths_of(content).agg(F.max("id")).first()[0]
        content.pop("version")
        self.versions.commit(content, mark, now["version"])
        if len(content["segments"]) > MOST_SEGMENTS:
            self.compact()
        return self

    def compact(self) -> TextIndex:
        """Rewrites all live postings as one segment."""
        now = self.versions.current()
        mark, segment = self.versions.begin(), now["next"]
        self.lengths().select("id", "len").write.mode("overwrite").parquet(f"{self.path}/lengths/segment={segment}")
        self._write(_packed(self.postings().select("term", "id", "f", "len", "bucket")), segment, now["folders"], now["words"])
        content = {k: v for k, v in now.items() if k != "version"} | {"segments": [segment], "next": segment + 1, "gone": False}
        self.versions.commit(content, mark, now["version"])
        for old in now["segments"]:
            self._drop(old)
        return self

    def _lengths(self, rows: DataFrame, segment: int) -> DataFrame:
        return rows.select("id", F.size(_tokens("text")).alias("len")).withColumn("len", F.when(F.col("len") >= 0, F.col("len")))

    def _write_postings(self, rows: DataFrame, segment: int, folders: int, words: int) -> None:
        self._write(_counted(rows.select("id", _tokens("text").alias("tokens")), folders), segment, folders, words)

    def _write(self, packs: DataFrame, segment: int, folders: int, words: int) -> None:
        # a folder that holds a very frequent term is several tasks
        salts = max(1, -(-words // (folders * TASK_TOKENS)))
        dealt = packs.repartition(folders * salts, "bucket", F.pmod("salt", F.lit(salts)))
        rows = _unpacked(dealt.select("bucket", "pack")).sortWithinPartitions("bucket", "term", "id")
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")

    def _drop(self, segment: int) -> None:
        for kind in ("lengths", "postings", "gone"):
            self.versions.folder.remove(f"{kind}/segment={segment}")

    # ---- reading

    def _read(self, kind: str, schema: str, segments: list[int]) -> DataFrame:
        paths = [f"{self.path}/{kind}/segment={s}" for s in segments if self.versions.folder.exists(f"{kind}/segment={s}")]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def _live(self, rows: DataFrame, now: dict) -> DataFrame:
        if not now["gone"]:
            return rows
        gone = self._read("gone", _GONE, now["segments"]).groupBy("id").agg(F.max("segment").alias("_until"))
        return rows.join(gone, "id", "left").filter(F.col("_until").isNull() | (F.col("segment") >= F.col("_until"))).drop("_until")

    def _lengths_of(self, now: dict) -> DataFrame:
        return self._live(self._read("lengths", _LENGTH, now["segments"]), now)

    def lengths(self) -> DataFrame:
        """(id, len, segment) of the live documents; a null text has no length."""
        return self._lengths_of(self.versions.current())

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """(term, id, f, len, segment, bucket) of the live documents, of some terms or all."""
        now = self.versions.current()
        rows = self._read("postings", _POSTING, now["segments"])
        if terms is not None:
            rows = rows.filter(F.col("bucket").isin(sorted({_bucket(x, now["folders"]) for x in terms}))).filter(F.col("term").isin(list(terms)))
        return self._live(rows, now)

    def drift(self, docs: DataFrame, id_col: str = "doc_id", stamp: str = "") -> Drift:
        """Why the index must be rebuilt for ``docs``: no index, a failed write, other files, count or largest id."""
        now = self.versions.current()
        if not now:
            return Drift(("no index",))
        reasons = ["failed write"] * bool(self.versions.pending())
        if stamp and now["stamp"] != stamp:
            reasons.append("other files")
        rows, top = docs.filter(F.col(id_col).isNotNull()).agg(F.count_distinct(id_col), F.max(id_col)).first()
        reasons += ["count"] * (rows != now["rows"]) + ["largest id"] * (top != now["max_id"])
        return Drift(tuple(reasons))

    def ensure(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", stamp: str = "") -> TextIndex:
        """This index, built anew if it has drifted from ``docs``."""
        return self.build(docs, id_col, text, stamp) if self.drift(docs, id_col, stamp) else self

    def bm25(self, query: Sequence[str], k: int) -> DataFrame:
        """(id, score): the k best documents for a bag of terms; repeated terms count twice.

        Document frequencies are counted first, a row for each term; each
        document's parts are then summed where they are read.
        """
        now, times = self.versions.current(), Counter(query)
        hits = self.postings(list(times))
        df = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()}  # the query's terms at most
        mean = now["words"] / now["texts"] if now["texts"] else 0.0
        weight: Column = F.lit(0.0)
        for term, n in sorted(df.items()):
            idf = math.log((now["rows"] - n + 0.5) / (n + 0.5))
            weight = F.when(F.col("term") == term, F.lit(times[term] * (idf if idf > 0 else LEAST_IDF))).otherwise(weight)
        part = weight * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
        scored = hits.select("id", part.alias("part")).groupBy("id").agg(F.round(F.sum("part"), 9).alias("score"))
        return scored.orderBy(F.desc("score"), "id").limit(k)


def _tokens(text: str) -> Column:
    """``tokens``, by one pattern where a text has no CJK character."""
    return F.when(has_cjk(text), tokens(text)).otherwise(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1))


def _bucket(term: str, folders: int) -> int:
    return crc32(term.encode()) % folders


_PACK = "bucket int, salt long, pack binary"
_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def _by_bucket(bucket: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket, sorted by term, as one compressed cell."""
    order = pc.sort_indices(pa.table({"b": bucket, "t": rows["term"], "i": rows["id"]}), [("b", "ascending"), ("t", "ascending"), ("i", "ascending")])
    rows, bucket = rows.take(order), bucket[order.to_numpy()]
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    cells = []
    for s, e in zip(start, [*start[1:], len(bucket)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=_OPTIONS) as out:
            out.write_batch(rows.slice(s, e - s))
        cells.append((int(bucket[s]), rows["id"][int(s)].as_py(), sink.getvalue().to_pybytes()))
    if cells:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in cells], pa.int32()), pa.array([x[1] for x in cells], pa.int64()), pa.array([x[2] for x in cells], pa.binary())], names=["bucket", "salt", "pack"])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of (id, tokens) in parts of ``BATCH_TOKENS``, whatever the texts' length."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().astype(np.int64))
    s = 0
    while s < len(batch):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + BATCH_TOKENS, "right")))
        yield batch.slice(s, e - s)
        s = e


def _counted(rows: DataFrame, folders: int) -> DataFrame:
    """Postings of (id, tokens) by bucket, packed: a document's terms are counted where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().astype(np.int64)
            found = batch.column(1).flatten().dictionary_encode()
            terms = found.dictionary
            many = max(1, len(terms))
            entry, f = np.unique(np.repeat(np.arange(len(batch)), size) * np.int64(many) + found.indices.to_numpy(), return_counts=True)
            doc, term = entry // many, entry % many
            bucket = np.array([_bucket(x, folders) for x in terms.to_pylist()], np.int32)
            made = pa.RecordBatch.from_arrays([terms.take(pa.array(term)), batch.column(0).take(pa.array(doc)), pa.array(f.astype(np.int32)), pa.array(size[doc].astype(np.int32))], names=["term", "id", "f", "len"])
            yield from _by_bucket(bucket[term], made)

    return rows.mapInArrow(run, _PACK)


def _packed(postings: DataFrame) -> DataFrame:
    """Postings (term, id, f, len, bucket), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _by_bucket(batch["bucket"].to_numpy(), batch.select(["term", "id", "f", "len"]))

    return postings.mapInArrow(run, _PACK)


def _unpacked(packs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, cell in zip(batch["bucket"].to_pylist(), batch["pack"]):
                for rows in pa.ipc.open_stream(cell.as_buffer()):
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(rows), bucket, np.int32))], names=["term", "id", "f", "len", "bucket"])

    return packs.mapInArrow(run, "term string, id long, f int, len int, bucket int")


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null")
    many, distinct = rows.agg(F.count("*"), F.count_distinct("id")).first()
    if many == distinct:  # texts are shuffled only where ids repeat
        return rows
    one = Window.partitionBy("id").orderBy(F.xxhash64("text"), "text")
    return rows.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
