"""Best-fit packing of tokenised documents by minimum bin slack.

Each bin starts from the longest piece left; a bitset subset-sum over the lengths that are left finds
the fullest feasible rest, which is removed. Lengths are at most the bin's size, so the state is a
histogram, and one combination is applied as often as its lengths allow. A task packs what it tokenised
and closes the bins that were filled from a rich choice or are full; the few pieces of its other bins stay
open and are packed again with those of other tasks, as a tree of merges with bounded groups, until one
group is left. So the number of bins hardly depends on how the documents are dealt.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsql.llm.common import cut_lineage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
PIECES_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ]
)

#: Texts of these characters only are cut by WORDS, which on them agrees with the vocabulary's own pattern.
PLAIN = re.compile(r"[\x09-\x0d\x20-\x7eÀ-ɏ]*")
WORDS = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class WordEncoder:
    """Token ids of a byte-level BPE as little-endian unsigned 32-bit bytes, with a bounded cache by word.

    The vocabulary cuts a text into words before it merges bytes, so a text's ids are its words' ids in
    a row. Texts outside PLAIN, and those with the text of a special token, are encoded whole. If the same vocabulary is given as ranks too, new words
    are merged by those, which is several times as fast and gives the same ids.
    """

    def __init__(self, path: str, ranks_path: str | None = None, max_words: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.max_words = max_words
        self.words: dict[str, bytes] = {}
        self.ranks = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=WORDS.pattern, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        if self.ranks is None:
            return self._encode(words)
        return [array("I", self.ranks._core_bpe.encode_single_piece(w.encode())).tobytes() for w in words]

    def __call__(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or any(t in text for t in self.special):
            return self._encode([text])[0]
        words = WORDS.findall(text)
        ids = list(map(self.words.get, words))
        if None in ids:
            new = list({w for w, i in zip(words, ids, strict=True) if i is None})
            if len(self.words) + len(new) > self.max_words:
                self.words.clear()
                new = list(set(words))
            self.words.update(zip(new, self._encode_words(new), strict=True))
            ids = list(map(self.words.__getitem__, words))
        return b"".join(ids)


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, ranks_path: str | None = None) -> WordEncoder:
    """The worker's encoder for a vocabulary file, kept from task to task."""
    key = (path, ranks_path)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(*key)
    return _ENCODERS[key]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones of size, the first may be shorter."""
    first = n % size
    starts = ([0] if first else []) + list(range(first, n, size))
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n], strict=True)]


def fullest(counts: dict[int, int], order: list[int], room: int) -> list[tuple[int, int]]:
    """[(length, times)]: the fullest sum of at most room, by bitset subset-sum over the lengths in order."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in order:
        if length > room:
            continue
        have, k = min(counts[length], room // length), 1
        while have > 0:  # binary splitting of the multiplicity
            take = min(k, have)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            have, k = have - take, 2 * k
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return sorted(used.items(), reverse=True)


def pack_lengths(lengths: Iterable[int], size: int) -> list[list[int]]:
    """Bins as lists of positions in lengths, each of at most size in all. Ties go by position."""
    places: dict[int, list[int]] = {}
    for i, length in enumerate(lengths):
        places.setdefault(length, []).append(i)
    for rows in places.values():
        rows.reverse()
    counts = {k: len(v) for k, v in places.items()}
    order = sorted(counts, reverse=True)
    bins = []
    while order:
        seed = order[0]
        counts[seed] -= 1
        rest = fullest(counts, order, size - seed)
        counts[seed] += 1
        need = dict(rest)
        need[seed] = need.get(seed, 0) + 1
        for _ in range(min(counts[k] // v for k, v in need.items())):
            bins.append([places[k].pop() for k in sorted(need, reverse=True) for _ in range(need[k])])
            for k, v in need.items():
                counts[k] -= v
        gone = {k for k in need if not counts[k]}
        if gone:
            order = [k for k in order if k not in gone]
    return bins


class Packer:
    """Collects pieces (the first five PIECES) and packs them; what stays open is packed with the next ones."""

    def __init__(self, size: int, chunk: int, choice: int, base: int):
        self.size, self.chunk, self.choice, self.base = size, chunk, choice, base
        self.rows: list[tuple] = []

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in PIECES_ARROW]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES_ARROW, strict=True)], schema=PIECES_ARROW)

    def packed(self, last: bool = False) -> pa.RecordBatch:
        """The pieces of closed bins; of all bins at last."""
        left, out, stay = len(self.rows), [], []
        for members in pack_lengths((r[3] for r in self.rows), self.size):
            slack = self.size - sum(self.rows[i][3] for i in members)
            if last or left >= self.choice or slack <= self.size // 1024:
                at = 0
                for i in members:
                    out.append((*self.rows[i], self.base, at))
                    at += self.rows[i][3]
                self.base += 1
            else:
                stay += [self.rows[i] for i in members]
            left -= len(members)
        self.rows = stay
        return self._batch(out)

    def add(self, row: tuple) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        if len(self.rows) >= self.chunk:
            yield self.packed()

    def open(self) -> pa.RecordBatch:
        """The pieces of open bins, without a sequence."""
        return self._batch([(*r, None, None) for r in self.rows])


def pack_documents(
    docs: DataFrame, vocabulary: str, ranks: str | None = None, size: int = 2048, separator: int = 0,
    chunk: int = 200_000, choice: int = 2_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents (PIECES), packed into sequences of at most size tokens.

    A document is its token ids, then the separator; a null text is empty, so it has one token. Only
    documents longer than size are cut, texts of any length whole. Repeated rows are packed as often as they
    occur; a null doc_id stays null; an empty table gives no pieces; other columns play no part. Equal lengths
    go by the order in which they are read. A task holds the numbers of at most about chunk pieces. Bins that
    are filled while at least choice pieces are left, or to 1 in 1024, are closed; the others' pieces, fewer
    than choice a task, are packed again in groups of about chunk pieces until there is one group.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary, ranks), separator.to_bytes(4, "little")
        packer = Packer(size, chunk, choice, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    yield from packer.add((doc_id, piece, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])))
        yield packer.packed()
        yield packer.open()

    def again(level: int, last: bool):
        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = Packer(size, chunk, choice, level << 56 | TaskContext.get().partitionId() << 32)
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                    yield from packer.add(row)
            yield packer.packed(last)
            yield packer.open()

        return work

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    made = cut_lineage(docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(work, PIECES))
    out = made.where("sequence_id IS NOT NULL")
    level = 0
    while n := (rest := made.where("sequence_id IS NULL")).count():
        level, groups = level + 1, -(-n // chunk)
        made = cut_lineage(rest.coalesce(groups).mapInArrow(again(level, groups == 1), PIECES))
        out = out.unionAll(made.where("sequence_id IS NOT NULL"))
    return out
