"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct words are laid end to end and indexed by a suffix array. Every piece of the vocabulary
is binary-searched in it, all at once, for the range of its occurrences. The occurrences are edges from
start to end; laid out by position and length they are relaxed: for unigram models along the best path, for the merge
models (BPE) in the order of merging, where the best edge that joins two neighbours goes first in each
word. A merge model has no best-path form with the same ids, so this is its relaxation.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Words of more characters than this are merged by a queue each, in n log n steps; the ids are the same.
LONG = 64
_WORDS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of codes sorted by their next depth codes at least, by prefix doubling from as many as fit 63 bits."""
    n = len(codes)
    alphabet, rank = np.unique(codes, return_inverse=True)
    bits = len(alphabet).bit_length()  # of 1 to len(alphabet), and 0 past the end
    step = min(depth, max(1, 63 // max(1, bits)))
    padded = np.concatenate([rank.astype(np.int64) + 1, np.zeros(step, np.int64)])
    both = np.zeros(n, np.int64)
    for d in range(step):
        both <<= bits
        both |= padded[d : d + n]
    while step < depth:
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64) + 1
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:]
        both = rank * (n + 2) + ahead
        step *= 2
    return np.argsort(both)


def occurrences(codes: np.ndarray, order: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[low, high) in the suffix array of every piece (rows of codes, padded), by binary search character by character."""
    n = len(codes)
    low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), n, np.int64)
    padded = np.concatenate([codes, np.full(pieces.shape[1], -1, codes.dtype)])
    for d in range(pieces.shape[1]):
        live = np.nonzero((lengths > d) & (low < high))[0]
        if not len(live):
            break
        want = pieces[live, d]
        for right in (False, True):
            a, b = low[live].copy(), high[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                at = padded[order[np.minimum(mid, n - 1)] + d]
                go = open_ & ((at <= want) if right else (at < want))
                a = np.where(go, mid + 1, a)
                b = np.where(open_ & ~go, mid, b)
            if right:
                high_new = a
            else:
                low_new = a
        low[live], high[live] = low_new, high_new
    return low, high


def _merge_by_queue(first: int, last: int, most: int, scores: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of one word's symbols: scores has the edges' by begin * most + length; a queue holds the edges that join two neighbours."""
    end = list(range(first + 1, last + 1))  # by the symbol's begin; 0 once it has joined the one before
    before = list(range(-1, last - first - 1))
    queue: list[tuple[float, int, int, int]] = []

    def offer(left: int, right: int) -> None:
        stop = end[right]
        got = scores.get((left + first) * most + stop - left - first) if stop - left - first < most else None
        if got is not None:
            queue.append((-got, left, right, stop)) if not ready else heapq.heappush(queue, (-got, left, right, stop))

    ready = False
    size = last - first
    for i in range(size - 1):
        offer(i, i + 1)
    heapq.heapify(queue)
    ready = True
    while queue:
        _, left, right, stop = heapq.heappop(queue)
        if end[left] != right + first or end[right] != stop:
            continue
        end[left], end[right] = stop, 0
        after = stop - first
        if after < size:
            before[after] = left
            offer(left, after)
        if before[left] >= 0:
            offer(before[left], left)
    begin = [i for i in range(size) if end[i]]
    return np.array(begin, np.int64) + first, np.array([end[i] for i in begin], np.int64)


class PieceModel:
    """A vocabulary as arrays: pieces by code points, their scores, the ids of single bytes."""

    def __init__(self, path: str, kind: str = "bpe"):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = kind
        size = self.processor.vocab_size()
        self.pieces = [self.processor.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_byte(i) or self.processor.is_unused(i))]
        self.ids = np.array(plain, np.int64)
        self.lengths = np.array([len(self.pieces[i]) for i in plain], np.int64)
        self.most = int(self.lengths.max())
        self.codes = np.full((len(plain), self.most), -2, np.int32)
        for row, i in enumerate(plain):
            self.codes[row, : self.lengths[row]] = [ord(c) for c in self.pieces[i]]
        self.scores = np.array([self.processor.get_score(i) for i in plain])
        self.ranks = np.unique(self.scores, return_inverse=True)[1].astype(np.int64) << 32
        self.by_byte = {int(self.pieces[i][3:5], 16): i for i in range(size) if self.processor.is_byte(i)}
        self.shown = list(self.pieces)
        for b, i in self.by_byte.items():
            self.shown[i] = bytes([b]).decode("utf-8", "surrogateescape")
        self.joined = any(MARK in self.pieces[i][1:].lstrip(MARK) for i in plain)
        self.words: dict[str, tuple[int, ...]] = {}

    def encode_words(self, words: list[str], chunk: int = 200_000) -> None:
        """Put the ids of words (each with its marks) into self.words."""
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (size == 0 or size + len(words[end]) <= chunk):
                size += len(words[end]) + 1
                end += 1
            self._encode_chunk(words[at:end])
            at = end

    def _encode_chunk(self, words: list[str]) -> None:
        text = "\0".join(words) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        codes[ends] = -1
        order = suffix_array(codes, self.most)
        low, high = occurrences(codes, order, self.codes, self.lengths)
        counts = high - low
        piece = np.repeat(np.arange(len(self.ids), dtype=np.int32), counts)
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = order[np.repeat(low, counts) + nth]
        row = self.most + 1
        edges = np.full(len(codes) * row, -1, np.int32)  # the piece from a place on, by place * row + length
        edges[start * row + self.lengths[piece]] = piece
        starts = np.concatenate([[0], ends[:-1] + 1])
        begin, end = (self._merge if self.kind == "bpe" else self._best_path)(codes, edges, starts, ends)
        found = edges[begin * row + (end - begin)]
        bounds = np.searchsorted(begin, np.concatenate([starts, [len(codes)]]))
        odd = np.unique(np.searchsorted(bounds, np.flatnonzero(found < 0), "right") - 1).tolist()
        ids, cuts = self.ids[found].tolist(), bounds.tolist()
        self.words.update(zip(words, [tuple(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        for w in odd:
            out: list[int] = []
            for k in range(cuts[w], cuts[w + 1]):
                if found[k] >= 0:
                    out.append(ids[k])
                else:
                    out += [self.by_byte[b] for b in text[begin[k] : end[k]].encode("utf-8", "replace")]
            self.words[words[w]] = tuple(out)

    def _merge(self, codes, edges, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of the symbols left when no two neighbours make a piece, the best edge first, of equals the leftmost.

        In each round each word's best edge joins; words of more than LONG characters have a queue of edges each.
        """
        most, size = self.most + 1, len(codes)
        owner = np.cumsum(codes == -1) - (codes == -1)
        long = ends - starts > LONG
        begin = np.nonzero((codes != -1) & ~long[np.minimum(owner, len(long) - 1)])[0]
        end, owner = begin + 1, owner[begin]
        done_b, done_e = [], []
        for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            at = np.flatnonzero(edges[s * most : e * most] >= 0) + s * most
            found = _merge_by_queue(s, e, most, dict(zip(at.tolist(), self.scores[edges[at]].tolist(), strict=True)))
            done_b.append(found[0])
            done_e.append(found[1])
        while len(begin):
            length = end[1:] - begin[:-1]
            pair = np.flatnonzero((owner[1:] == owner[:-1]) & (length < most))
            at = edges[begin[pair] * most + length[pair]]
            hit = at >= 0
            pair, at = pair[hit], at[hit]
            if not len(pair):
                break
            # the best of each word: highest score, then leftmost
            value = self.ranks[at] + (size - begin[pair])
            first = np.flatnonzero(np.concatenate([[True], np.diff(owner[pair]) != 0]))
            top = np.maximum.reduceat(value, first)
            chosen = pair[value == np.repeat(top, np.diff(np.concatenate([first, [len(pair)]])))]
            active = np.zeros(len(starts), bool)
            active[owner[chosen]] = True
            end[chosen] = end[chosen + 1]
            keep = np.ones(len(begin), bool)
            keep[chosen + 1] = False
            going = active[owner]
            idle = keep & ~going
            done_b.append(begin[idle])
            done_e.append(end[idle])
            keep &= going
            begin, end, owner = begin[keep], end[keep], owner[keep]
        begin, end = np.concatenate([*done_b, begin]), np.concatenate([*done_e, end])
        order = np.argsort(begin)
        return begin[order], end[order]

    def _best_path(self, codes, edges, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of the path of the highest score in each word; a character without a piece costs ten below the least."""
        worst = float(self.scores.min()) - 10.0
        best = [-1e300] * (len(codes) + 1)
        back = [0] * (len(codes) + 1)
        for s in starts.tolist():
            best[s] = 0.0
        at = np.flatnonzero(edges >= 0)
        start, piece = at // (self.most + 1), edges[at]
        bounds = np.searchsorted(start, np.arange(len(codes) + 1)).tolist()
        lengths, scores = self.lengths[piece].tolist(), self.scores[piece].tolist()
        for i in np.nonzero(codes != -1)[0].tolist():
            here = best[i]
            for e in range(bounds[i], bounds[i + 1]):
                j = i + lengths[e]
                if here + scores[e] > best[j]:
                    best[j], back[j] = here + scores[e], i
            if here + worst > best[i + 1]:
                best[i + 1], back[i + 1] = here + worst, i
        begin, end = [], []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            while e > s:
                begin.append(back[e])
                end.append(e)
                e = back[e]
        begin, end = np.array(begin, np.int64), np.array(end, np.int64)
        order = np.argsort(begin)
        return begin[order], end[order]

    def split(self, text: str) -> list[str]:
        """A text's words with their marks (a mark in the text is a space to the model).

        No piece reaches over the start of a run of marks or a line's end.
        """
        if self.joined:
            return [(MARK + text).replace(" ", MARK)]
        return _WORDS.findall(MARK + text.replace(" ", MARK))

    def encode(self, texts: list[str], most_words: int = 500_000) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        if len(self.words) > most_words:
            self.words.clear()
        new = set().union(*split) - self.words.keys()
        if new:
            self.encode_words(list(new))
        known = self.words.__getitem__
        return [list(chain.from_iterable(map(known, words))) for words in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces in a row, runs of bytes as UTF-8, marks as spaces, the first mark away."""
        # bytes that are no ASCII are lone surrogates until the whole is UTF-8; no piece starts within a character
        text = "".join(map(self.shown.__getitem__, ids))
        text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text.removeprefix(MARK).replace(MARK, " ")


_MODELS: dict[tuple[str, str], PieceModel] = {}


def piece_model(path: str, kind: str = "bpe") -> PieceModel:
    if (path, kind) not in _MODELS:
        _MODELS[path, kind] = PieceModel(path, kind)
    return _MODELS[path, kind]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", kind: str = "bpe", batch_chars: int = 4_000_000) -> DataFrame:
    """docs, without text, with ids, n_tokens and round_trip (whether the decoded ids are the text).

    A null text is empty and has no ids. Repeated rows get equal ids; an empty table stays empty. Columns
    of the added names are replaced. A task holds the texts of one batch of at most about batch_chars.
    """
    keep = docs.drop("ids", "n_tokens", "round_trip").withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
    schema = keep.drop(text).schema.add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("round_trip", "boolean")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(vocabulary, kind)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            size, first = 0, 0
            texts: list[str] = []
            for n, cell in enumerate(batch.column(at)):
                texts.append(cell.as_py())
                size += len(texts[-1])
                if size < batch_chars and n < batch.num_rows - 1:
                    continue
                ids = model.encode(texts)
                same = [model.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                others = batch.slice(first, len(texts))
                columns = [c for k, c in enumerate(others.columns) if k != at]
                names = [c for k, c in enumerate(batch.schema.names) if k != at]
                out = [*columns, pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(out, [*names, "ids", "n_tokens", "round_trip"])
                size, first, texts = 0, n + 1, []

    return keep.mapInArrow(work, schema)


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text of their ids (replacing a column of that name); null ids give a null text."""
    keep = rows.drop(text)
    schema = T.StructType([*keep.schema.fields, T.StructField(text, T.StringType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(vocabulary)
        for batch in batches:
            cells = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if c is None else model.decode(c) for c in cells], pa.string())], [*batch.schema.names, text])

    return keep.mapInArrow(work, schema)
