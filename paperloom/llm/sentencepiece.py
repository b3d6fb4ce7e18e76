"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

Distinct words of equal length (beyond 16 characters, of equal length up to
padding) advance together, one character a step.  Hashes of all their substrings
probe the sorted piece keys; at each end position the best candidate over all
piece lengths is taken, and its length is the backpointer.  The model's kind decides what "best" means:

* unigram: the largest sum of piece scores;
* BPE: sums of scores do not give the merges' result, so a candidate counts
  only if merging its text together with the piece before it gives back just
  these two pieces.  For merges by rank that holds for exactly one candidate at
  each position, and the path through them is the merges' result.  No maximum
  over scores is taken here; ``Model.load`` with ``scored`` searches the same
  pieces for the largest sum instead.  Runs of spaces, whose pieces share one
  score, and words over ``LONG_WORD`` characters, of which a matrix would hold
  one, are merged directly, best merge first.

Text is prepared as the model asks for: a space in front, spaces as U+2581,
nothing else changed.  Characters without a piece become their UTF-8 bytes, or
the unknown piece where the model has no byte pieces.

Edge cases: null gives null; the empty text gives no ids and comes back empty;
U+2581 in a text is a space to the model and decodes as one; words of any
length are whole; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import map_rows, quoted
from .textkernel import Chunk, buffers, mix, spans

SPACE = "▁"
#: Bytes of text that share one search.
BATCH_BYTES = 1 << 20
#: Bytes of a batch whose results are sent on together.
SLICE_BYTES = 1 << 22
#: Words whose ids a worker remembers.
REMEMBERED = 1 << 19
#: Characters from which a word is merged by itself.
LONG_WORD = 192
#: Cells of one word matrix.
CELLS = 1 << 17
#: Ids that are decoded at a time.
DECODED = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(_BASE)
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
# word breaks: the space and every control byte, which are pieces of their own
_BREAKS = np.zeros(256, bool)
_BREAKS[:33] = True


def _powers(n: int, base: np.uint64) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.full(n, base)]).cumprod(dtype=np.uint64)


def _sums(points: np.ndarray) -> np.ndarray:
    """Running sums of code point hashes times powers of the base, by row."""
    sums = np.zeros((len(points), points.shape[1] + 1), np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(7)) * _powers(points.shape[1] - 1, _STEP), axis=1, out=sums[:, 1:])
    return sums


def _substrings(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of ``size`` code points in each row."""
    n = sums.shape[1] - 1
    return mix((sums[:, size:] - sums[:, : n - size + 1]) * _powers(n - size, _BACK) + np.uint64(size))


def _points(words: list[str], size: int) -> np.ndarray:
    return np.array(words, f"<U{size}").view(np.uint32).reshape(len(words), size)


@dataclass
class Model:
    """A vocabulary in the form that the search probes; it ships to executors."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray  # 0 normal, 1 unknown, 2 control, 3 byte
    is_bpe: bool
    keys: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        normal = [i for i, k in enumerate(self.kinds) if k == 0 and self.pieces[i]]
        by_size: dict[int, list[int]] = {}
        for i in normal:
            by_size.setdefault(len(self.pieces[i]), []).append(i)
        keys, ids = [], []
        for size, own in by_size.items():
            keys.append(_substrings(_sums(_points([self.pieces[i] for i in own], size)), size)[:, 0])
            ids.append(np.array(own))
        key, value = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(key)
        self.keys, self.ids = key[order], value[order]
        self.longest = max(by_size)
        self.sums = np.zeros(len(self.pieces), np.uint64)
        for size, own in by_size.items():
            self.sums[own] = _sums(_points([self.pieces[i] for i in own], size))[:, -1]
        self.sizes = np.array([len(p) for p in self.pieces])
        self.rank = {self.pieces[i]: float(self.scores[i]) for i in normal}
        self.id_of = {self.pieces[i]: i for i in normal}
        at = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == 3}
        self.byte_ids = np.array([at[b] for b in range(256)]) if len(at) == 256 else None
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == 1)
        self.pairs = np.zeros(0, np.int64), np.zeros(0, bool)
        self.runs: dict[int, np.ndarray] = {}
        self.left, self.right = np.full(len(self.pieces), -1), np.full(len(self.pieces), -1)
        self.whole = self.sizes == 1
        for i in normal if self.is_bpe else ():
            if len(parts := self.merged(self.pieces[i], 2)) == 2:
                self.left[i], self.right[i], self.whole[i] = self.id_of[parts[0]], self.id_of[parts[1]], True
        self.mark = hashlib.sha256("\n".join(self.pieces).encode() + self.scores.tobytes() + bytes([self.is_bpe])).digest()
        self.seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.tokens, self.begin, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @classmethod
    def load(cls, path: str, scored: bool = False) -> Model:
        """Read a model file on the driver; ``scored`` searches a BPE model's pieces by score sums."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or proto.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models without text normalisation are supported")
        kind = {1: 0, 2: 1, 3: 2, 4: 0, 5: 2, 6: 3}
        return cls([p.piece for p in proto.pieces], np.array([p.score for p in proto.pieces]), np.array([kind[p.type] for p in proto.pieces]), proto.trainer_spec.model_type == 2 and not scored)

    # ---- the merges of short texts, for pairs of pieces and runs of spaces

    def merged(self, text: str, until: int = 1) -> list[str]:
        """What merging leaves: best score first, leftmost among equals.

        Stops early when ``until`` parts are left.
        """
        parts: list[str | None] = list(text)
        left = len(parts)
        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if i >= 0 and j >= 0 and (both := parts[i] + parts[j]) in self.rank:
                heapq.heappush(queue, (-self.rank[both], i, j, both))

        for i in range(len(parts) - 1):
            offer(i)
        while queue and left > until:
            _, i, j, both = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, None, after[j]
            left -= 1
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def joins(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Do two neighbouring pieces stay as they are under the merges?"""
        key = first.astype(np.int64) << 32 | second
        if not len(self.pairs[0]):  # a slot for each 20-bit hash, made on the executor
            self.pairs = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        slot = (mix(key.view(np.uint64)) >> np.uint64(44)).astype(np.int64)
        known, answer = self.pairs
        miss = np.flatnonzero(known[slot] != key)
        out = answer[slot]
        if len(miss):
            out[miss] = self._unmerged(first[miss], second[miss])
            known[slot[miss]], answer[slot[miss]] = key[miss], out[miss]
        return out

    def _unmerged(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Walks back through both pieces' merges, the latest first.

        At each moment the parts that touch are x and y; px and py score the
        merges that consume them.  If their union is a piece whose merge comes
        before both, the two pieces would not have come about side by side.
        """
        good, row = np.ones(len(x), bool), np.arange(len(x))
        px = py = np.full(len(x), -np.inf)
        up = _powers(2 * self.longest, _STEP)
        while len(row):
            size = self.sizes[x] + self.sizes[y]
            h = mix(self.sums[x] + self.sums[y] * up[self.sizes[x]] + size.astype(np.uint64))
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            m = np.where(self.keys[at] == h, self.scores[self.ids[at]], -np.inf)
            crossed = (m > px) & (m >= py) & (m > -np.inf)
            good[row[crossed]] = False
            sx, sy = np.where(self.left[x] >= 0, self.scores[x], np.inf), np.where(self.left[y] >= 0, self.scores[y], np.inf)
            back_x = sx < sy
            go = ~crossed & (np.minimum(sx, sy) < np.inf)
            px, py = np.where(back_x, sx, px), np.where(back_x, py, sy)
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
            row, x, y, px, py = row[go], x[go], y[go], px[go], py[go]
        return good

    def run(self, n: int) -> np.ndarray:
        """The pieces of ``n`` spaces."""
        if n not in self.runs:
            if self.is_bpe:
                self.runs[n] = np.array([self.id_of[p] for p in self.merged(SPACE * n)], np.int64)
            else:
                self.runs[n] = self.search([SPACE * n])[0]  # ids of one word
        return self.runs[n]

    # ---- the search

    def search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, word after word, and how many each word has."""
        size = np.array([len(w) for w in words], np.int64)
        room = np.where(size > 16, -(-size // 16) * 16, size)
        flat, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if self.is_bpe:
            for i in np.flatnonzero(size > LONG_WORD):
                flat.append(self._merged_ids(words[i]))
                owner.append(np.full(len(flat[-1]), i))
            size = np.where(size > LONG_WORD, 0, size)
        for n in np.unique(room[size > 0]).tolist():
            same = np.flatnonzero(room == n)
            same = same[np.argsort(-size[same], kind="stable")]
            step = max(1, CELLS // n)
            for a in range(0, len(same), step):
                part = same[a : a + step]
                ids, row = self._advance([words[i] for i in part], size[part], n)
                flat.append(ids)
                owner.append(part[row])
        ids, owner = np.concatenate(flat), np.concatenate(owner)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _advance(self, words: list[str], size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, word of each id); the words come longest first."""
        sums, rows, most = _sums(_points(words, n)), len(words), min(self.longest, n)
        piece = []  # piece[k - 1][:, i]: id of the k characters from i, or -1
        for k in range(1, most + 1):
            h = _substrings(sums, k)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            piece.append(np.where(self.keys[at] == h, self.ids[at], -1))
        lost = float(self.scores[self.kinds == 0].min()) - 10.0
        best, back = np.zeros((rows, n + 1), np.float32), np.zeros((rows, n + 1), np.int32)  # single precision, as such models are scored
        last = np.full((rows, n + 1), -1, np.int64)  # -1: a character without a piece
        for j in range(1, n + 1):
            live = int(np.searchsorted(-size, -j, "right"))
            if self.is_bpe:
                todo = np.arange(live)
                for k in range(min(most, j), 0, -1):
                    cand = piece[k - 1][todo, j - k]
                    ok = cand >= 0
                    ok[ok] = self.whole[cand[ok]]
                    prev = last[todo, j - k]
                    both = np.flatnonzero(ok & (prev >= 0)) if k < j else np.zeros(0, np.int64)
                    ok[both] = self.joins(prev[both], cand[both])
                    back[todo[ok], j], last[todo[ok], j] = k, cand[ok]
                    todo = todo[~ok]
                back[todo, j] = 1
                continue
            best[:live, j] = -np.inf
            for k in range(min(most, j), 0, -1):  # of equal sums the longest last piece stays
                cand = piece[k - 1][:live, j - k]
                value = best[:live, j - k] + np.where(cand >= 0, self.scores[cand], lost if k == 1 else -np.inf).astype(np.float32)
                better = np.flatnonzero(value > best[:live, j])
                best[better, j], back[better, j], last[better, j] = value[better], k, cand[better]
        at, ids = size.copy(), np.full((rows, n), -9, np.int64)
        for j in range(n, 0, -1):
            here = np.flatnonzero(at == j)
            ids[here, j - 1] = last[here, j]
            at[here] = j - back[here, j]
        row, end = np.nonzero(ids != -9)
        out = ids[row, end]
        if (out == -1).any():
            spelled = [self._spelled(words[r][e]) if i == -1 else np.array([i]) for r, e, i in zip(row, end, out)]
            row, out = np.repeat(row, [len(x) for x in spelled]), np.concatenate(spelled)
            if self.byte_ids is None and not self.is_bpe:  # neighbouring unknown pieces are one
                again = (out[1:] == self.unknown) & (out[:-1] == self.unknown) & (row[1:] == row[:-1])
                row, out = row[np.append(True, ~again)], out[np.append(True, ~again)]
        return out, row

    def _merged_ids(self, word: str) -> np.ndarray:
        parts = self.merged(word)
        return np.concatenate([np.array([self.id_of[p]]) if p in self.id_of else self._spelled(p) for p in parts])

    def _spelled(self, char: str) -> np.ndarray:
        if self.byte_ids is None:
            return np.array([self.unknown])
        return self.byte_ids[np.frombuffer(char.encode(), np.uint8)]

    def remember(self, keys: np.ndarray, word) -> np.ndarray:
        """Positions of words in tokens, begin and many, searching the new ones.

        ``keys`` are sorted hashes; ``word(i)`` spells the one at ``keys[i]``.
        """
        if len(self.seen[0]) > REMEMBERED:
            self.seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            self.tokens, self.begin, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        known, place = self.seen
        at = np.searchsorted(known, keys)
        new = np.flatnonzero(known[np.minimum(at, len(known) - 1)] != keys) if len(known) else np.arange(len(keys))
        if len(new):
            ids, many = self.search([word(i) for i in new.tolist()])
            fresh = len(self.many) + np.arange(len(new))
            self.begin = np.concatenate([self.begin, len(self.tokens) + np.cumsum(many) - many])
            self.many, self.tokens = np.concatenate([self.many, many]), np.concatenate([self.tokens, ids])
            known, place = np.insert(known, at[new], keys[new]), np.insert(place, at[new], fresh)
            self.seen = known, place
            at = np.searchsorted(known, keys)
        return place[at]

    # ---- whole columns

    def encode(self, column: pa.Array) -> pa.Array:
        """list<int32> of ids; null stays null."""
        _, rows = buffers(column.cast(pa.string()))
        flat, counts = [], np.zeros(len(column), np.int64)
        for a, b in spans(rows, BATCH_BYTES):
            part = pc.fill_null(column.slice(a, b - a).cast(pa.string()), "")
            ids, counts[a:b] = self._encode(*buffers(pc.replace_substring(part, SPACE, " ")))
            flat.append(ids.astype(np.int32))
        values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
        return pc.if_else(pc.is_valid(column), lists, pa.scalar(None, lists.type)) if column.null_count else lists

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chunk = Chunk(data, offsets, breaks=_BREAKS)
        opens = np.zeros(len(data) + 1, bool)
        opens[offsets[:-1]] = True
        spaced = opens[chunk.start] | (data[np.maximum(chunk.start - 1, 0)] == 32) if len(data) else np.zeros(0, bool)
        key = mix(chunk.word_hash() ^ spaced.astype(np.uint64))
        keys, first, word_of = np.unique(key, return_index=True, return_inverse=True)
        raw = data.tobytes()
        at = self.remember(keys, lambda i: SPACE * int(spaced[first[i]]) + raw[chunk.start[first[i]] : chunk.end[first[i]]].decode())
        begin, many = self.begin[at], self.many[at]
        alone = np.zeros(len(at), bool)
        if self.is_bpe:  # a space that its word did not take belongs to the run before it
            alone = spaced[first] & (self.tokens[begin] == self.id_of.get(SPACE, -1))
            begin, many = begin + alone, many - alone

        # runs of spaces, with the space that stands before every text
        blank = data == 32
        fresh = blank.copy()
        fresh[1:] &= ~blank[:-1] | opens[1:-1]
        run_at = np.flatnonzero(fresh)
        stop = np.flatnonzero(~blank | opens[:-1]) if len(data) else np.zeros(0, np.int64)
        stop = np.unique(np.concatenate([stop, offsets[1:]]))
        run_end = stop[np.searchsorted(stop, run_at, "right")]
        size = run_end - run_at + opens[run_at]
        full = np.flatnonzero(np.diff(offsets) > 0)
        bare = offsets[full][~blank[offsets[full]]] if len(full) else np.zeros(0, np.int64)
        run_at, run_end, size = np.concatenate([run_at, bare]), np.concatenate([run_end, bare]), np.concatenate([size, np.ones(len(bare), np.int64)])
        order = np.argsort(run_at)
        run_at, run_end, size = run_at[order], run_end[order], size[order]
        run_doc = np.searchsorted(offsets, run_at, "right") - 1
        w = np.searchsorted(chunk.start, run_end)
        has = w < len(chunk.start)
        has[has] = (chunk.start[w[has]] == run_end[has]) & (chunk.word_doc[w[has]] == run_doc[has])
        if self.is_bpe:
            size[has] += alone[word_of[w[has]]].astype(np.int64) - 1
        else:
            size[has] -= 1

        control = np.flatnonzero(_BREAKS[data] & ~blank)
        lengths, run_of = np.unique(size, return_inverse=True)
        rest = [*(self.run(int(n)) if n else np.zeros(0, np.int64) for n in lengths), *(self._spelled(chr(b)) for b in range(33))]
        entry = np.concatenate([word_of, len(at) + run_of, len(at) + len(lengths) + data[control].astype(np.int64)])
        # a run comes before what starts where it ends
        where = np.concatenate([2 * chunk.start + 1, 2 * run_at, 2 * control + 1])
        order = np.argsort(where, kind="stable")
        entry, where = entry[order], where[order] // 2
        more = np.array([len(t) for t in rest], np.int64)
        begin = np.concatenate([begin, len(self.tokens) + np.cumsum(more) - more])
        many = np.concatenate([many, more])
        flat = np.concatenate([self.tokens, *rest])
        n = many[entry]
        total = np.cumsum(n)
        ids = flat[np.repeat(begin[entry] - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)]
        doc = np.searchsorted(offsets, where, "right") - 1
        return ids, np.bincount(doc, weights=n, minlength=len(offsets) - 1).astype(np.int64)

    def decode(self, column: pa.Array) -> pa.Array:
        """Texts of id lists; ids outside the vocabulary are an error."""
        if not hasattr(self, "_bytes"):
            spelled = [bytes([int(p[3:5], 16)]) if k == 3 else b"" if k == 2 else b" \xe2\x81\x87 " if k == 1 else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds)]
            self._bytes = np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in spelled])])
        flat, at = self._bytes
        values = column.flatten().to_numpy(zero_copy_only=False)
        if len(values) and (values.min() < 0 or values.max() >= len(self.pieces)):
            raise ValueError("an id is not in the vocabulary")
        many = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(many)])
        valid = pc.is_valid(column).to_pylist()
        texts: list[str | None] = []
        for a, b in spans(ends, DECODED):
            ids = values[ends[a] : ends[b]].astype(np.int64)
            size = at[ids + 1] - at[ids]
            total = np.concatenate([[0], np.cumsum(size)])
            raw = flat[np.repeat(at[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
            cut = total[ends[a : b + 1] - ends[a]]
            for i in range(b - a):
                piece = raw[cut[i] : cut[i + 1]]
                texts.append((piece[1:] if piece[:1] == b" " else piece).decode("utf-8", "replace") if valid[a + i] else None)
        return pa.array(texts, pa.string())


_MODELS: dict[bytes, Model] = {}


def _shared(model: Model) -> Model:
    """The worker's own copy, which remembers words and pairs between tasks."""
    return _MODELS.setdefault(model.mark, model)


def _sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each text or list of ids."""
    size = pc.multiply(pc.list_value_length(column), 4) if pa.types.is_list(column.type) else pc.binary_length(column)
    return pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _with(df: DataFrame, steps: list[tuple[str, str, str, str]], model: Model) -> DataFrame:
    """``df`` with a column ``out`` computed from ``column`` by each step (column, out, type, work).

    An ``out`` that it had is replaced.  All steps run in one pass, in slices of
    a batch, so a worker never holds the results of a whole batch.
    """
    made = {out: kind for _, out, kind, _ in steps}
    first = steps[0][0]
    source = df.select(*[quoted(c) for c in df.columns if c not in made or c == first])
    keep = [c for c in source.columns if c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _shared(model)
        for batch in batches:
            whole = dict(zip(batch.schema.names, batch.columns))
            for a, b in spans(np.concatenate([[0], np.cumsum(_sizes(whole[first]))]), SLICE_BYTES):
                columns = {c: values.slice(a, b - a) for c, values in whole.items()}
                for column, out, _, work in steps:
                    columns[out] = getattr(own, work)(columns[column])
                names = [*keep, *made]
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    fields = [f for f in source.schema.fields if f.name in keep]
    return map_rows(source, run, T.StructType([*fields, *(T.StructField(out, T.DataType.fromDDL(kind)) for out, kind in made.items())]))


def encode(df: DataFrame, model: Model, text: str = "text", ids: str = "ids") -> DataFrame:
    return _with(df, [(text, ids, "array<int>", "encode")], model)


def decode(df: DataFrame, model: Model, ids: str = "ids", text: str = "decoded") -> DataFrame:
    return _with(df, [(ids, text, "string", "decode")], model)


def round_trip(df: DataFrame, model: Model, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The ids of every text and the text that these give back, in one pass."""
    return _with(df, [(text, ids, "array<int>", "encode"), (ids, decoded, "string", "decode")], model)
