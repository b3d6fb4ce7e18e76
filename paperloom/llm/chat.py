"""Chat formatting in budgeted windows.

A conversation's turns are laid end to end by token count.  Prefix sums cut it
into spans of ``SPAN`` tokens at turn borders: a turn belongs to the span in
which it begins, so spans are found without walking the conversation.  A window
is a span, led by the system turn and by as many whole earlier turns as begin
within ``HISTORY`` tokens before it.  The loss mask covers the texts of new
assistant turns alone; what a window repeats is masked out.

A conversation of any length is dealt over many tasks: rows are range-partitioned
by conversation and turn, each partition sums its own tokens, and only one
offset for each partition border is broadcast.  A turn longer than a span is
kept whole.

The template is ``<|turn|>role\\ntext<|end|>\\n``.  A backslash is doubled, and
one is put behind the first character of every control string inside a text
(``<|``, ``<s>``, ``</s>``, ``<unk>``, ``[INST]``, ``[/INST]``), so texts can
neither end a turn nor begin one, and reading back restores them exactly.

Edge cases: null texts and roles count as empty; turns with the same number
are ordered by role, then text, and repeated rows are turns of their own; a null
conversation id is one conversation; a conversation without a system turn has
windows without one, and one without an assistant turn has an empty mask.  Extra
columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize

WORD = r"[^\x20\x09-\x0D]+"
SPAN = 384
HISTORY = 128
#: Tokens of the marks of a turn.
TURN_TOKENS = 4

_CONTROL = re.compile(r"\\|<(?=\||/?s>|unk>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _plain_role(role: str) -> str:
    return re.sub(r"\\(\\|n)?", lambda m: {"\\": "\\", "n": "\n"}.get(m[1] or "", ""), role)


def _laid_out(spark: SparkSession, turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, begin, tokens, role, text): each turn's first token in its conversation."""
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", (F.regexp_count("text", F.lit(WORD)) + TURN_TOKENS).cast("long"))
    order = ["conv", "turn", "role", "text"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, int] = (-1, 0)
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            conv_of = pc.fill_null(batch.column(0), 0).to_numpy()
            tokens = batch.column(4).to_numpy()
            fresh = np.ones(len(tokens), bool)
            fresh[1:] = (conv_of[1:] != conv_of[:-1]) | (null[1:] != null[:-1])
            key = None if null[0] else int(conv_of[0])
            lead = held[1] if not first and key == held[0] else 0
            upto = np.cumsum(tokens)
            start = np.flatnonzero(fresh)
            base = np.repeat(upto[start] - tokens[start], np.diff(np.append(start, len(tokens))))
            begin = upto - tokens - base
            begin[: start[1] if len(start) > 1 else len(tokens)] += lead
            held, first = (None if null[-1] else int(conv_of[-1]), int(begin[-1] + tokens[-1])), False
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(begin), batch.column(4), batch.column(2), batch.column(3), batch.column(5)], names=["conv", "begin", "tokens", "role", "text", "part"])

    local = materialize(spark, dealt.mapInArrow(run, "conv long, begin long, tokens long, role string, text string, part int"), "turns")
    # of all (conversation, partition) sums only those of conversations in several
    # partitions matter: at most two for each partition
    sums = local.groupBy("conv", "part").agg(F.sum("tokens").alias("n"))
    several = sums.groupBy("conv").agg(F.count("*").alias("parts")).filter("parts > 1").withColumnRenamed("conv", "c2")
    offset = sums.join(several, F.col("conv").eqNullSafe(F.col("c2"))).select("conv", "part", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    offset = materialize(spark, offset.select(F.col("conv").alias("c2"), F.col("part").alias("p2"), "offset"), "offsets")
    found = local.join(offset, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("part") == F.col("p2")), "left")
    return found.select("conv", (F.col("begin") + F.coalesce("offset", F.lit(0))).alias("begin"), "tokens", "role", "text")


def format_windows(spark: SparkSession, turns: DataFrame, span: int = SPAN, history: int = HISTORY, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, window, formatted, repeated, loss) for every window.

    ``repeated`` counts the leading turns that the window repeats; ``loss`` holds
    the [start, end) code points of ``formatted`` that are trained on.
    """
    if not 0 <= history < span:
        raise ValueError("history must be shorter than a span")
    rows = materialize(spark, _laid_out(spark, turns, conv, turn, role, text), "laid")
    floor = lambda x: F.floor(x / F.lit(span)).cast("long")
    new = rows.select("conv", floor(F.col("begin")).alias("window"), F.lit(2).alias("kind"), "begin", "role", "text")
    # windows that may begin within reach of a turn's own beginning
    reach = F.sequence(F.greatest(floor(F.col("begin") + F.col("tokens")), floor(F.col("begin")) + 1), floor(F.col("begin") + history))
    can = floor(F.col("begin") + history) >= F.greatest(floor(F.col("begin") + F.col("tokens")), floor(F.col("begin")) + 1)
    past = rows.filter(can).select("conv", F.explode(reach).alias("window"), F.lit(1).alias("kind"), "begin", "role", "text")
    starts = new.groupBy("conv", "window").agg(F.min("begin").alias("start"))
    system = rows.filter(F.col("role") == "system").groupBy("conv").agg(F.min(F.struct("begin", "role", "text")).alias("s"))
    led = starts.join(system.withColumnRenamed("conv", "c2"), F.col("conv").eqNullSafe(F.col("c2"))).filter(F.col("s.begin") < F.col("start"))
    lead = led.select("conv", "window", F.lit(0).alias("kind"), "s.begin", "s.role", "s.text")
    every = new.unionByName(past).unionByName(lead)
    # a window holds fewer than span / TURN_TOKENS new turns, so its list is bounded
    grouped = every.groupBy("conv", "window").agg(F.sort_array(F.collect_list(F.struct("kind", "begin", "role", "text"))).alias("turns")).filter(F.exists("turns", lambda t: t["kind"] == 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, repeats, losses = [], [], []
            for row in batch.column(2).to_pylist():
                start = min(t["begin"] for t in row if t["kind"] == 2)
                lead = [t for t in row if t["kind"] == 0]
                past = [t for t in row if t["kind"] == 1 and start - t["begin"] <= history and not any(t["begin"] == s["begin"] for s in lead)]
                fresh = [t for t in row if t["kind"] == 2]
                parts, at, loss = [], 0, []
                for t in [*lead, *past, *fresh]:
                    head, body = f"<|turn|>{_role(t['role'])}\n", escape(t["text"])
                    if t["kind"] == 2 and t["role"] == "assistant":
                        loss.append([at + len(head), at + len(head) + len(body)])
                    parts += [head, body, "<|end|>\n"]
                    at += len(head) + len(body) + len("<|end|>\n")
                made.append("".join(parts))
                repeats.append(len(lead) + len(past))
                losses.append(loss)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array(repeats, pa.int32()), pa.array(losses, pa.list_(pa.list_(pa.int64())))], names=["conv", "window", "formatted", "repeated", "loss"])

    return grouped.mapInArrow(run, "conv long, window long, formatted string, repeated int, loss array<array<long>>").withColumnRenamed("conv", conv)


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what the formatted windows hold, one row for each conversation.

    A digest of a whole conversation is sequential; its windows stream through
    one task in order, which keeps one hash state and never the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state: list = []

        def row() -> list:
            return [now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            done = []
            for c, formatted, repeated, loss in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if now != (c,):
                    if now is not None:
                        done.append(row())
                    now, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in list(_TURN.finditer(formatted))[repeated:]:
                    state[0] += 1
                    state[1].update(f"{_plain_role(m[1])}\n{unescape(m[2])}\n".encode())
                for s, e in loss:
                    plain = unescape(formatted[s:e])
                    state[2] += len(plain)
                    state[3].update(plain.encode())
                state[4] += len(formatted)
            if done:
                yield _digests(done, conv)
        if now is not None:
            yield _digests([row()], conv)

    dealt = windows.select(conv, "window", "formatted", "repeated", "loss").repartition(conv).sortWithinPartitions(conv, "window")
    return dealt.mapInArrow(run, f"`{conv}` long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[list], conv: str) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names=names)
