"""Quality rules: exact base counts, then a tokenizer's view of the text.

A public piece vocabulary with byte fallback measures characters a token, the share of byte pieces and
the entropy of the text's tokens; bands by language, else by script, reject what lies outside.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that count as symbols, and ASCII white space.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"

METRICS = (
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"),
    ("n_tokens", "long"), ("chars_per_token", "double"), ("byte_share", "double"), ("token_entropy", "double"), ("kept", "boolean"),
)
ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


@dataclass(frozen=True)
class Band:
    """What is kept: characters a token, bytes among tokens, and entropy over what its length allows."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


#: Bands by language; a language that is not named is judged by its script. The floors of characters a token are the 1 %
#: quantiles of 3,243 documents past the base rules that are labelled good (sf0.1). Entropy over what its length allows
#: falls with length, so a quantile of it would take long documents: its floor stays below what any of them has.
LANGUAGES = {
    "en": Band(2.47, 7.0, 0.10, 0.45),
    "de": Band(2.47, 7.0, 0.10, 0.45),
    "fr": Band(2.17, 7.0, 0.10, 0.45),
    "es": Band(2.15, 7.0, 0.10, 0.45),
}
SCRIPTS = {"LATIN": Band(1.4, 8.0, 0.15, 0.40), "CYRILLIC": Band(1.2, 8.0, 0.15, 0.40), "GREEK": Band(0.8, 8.0, 0.30, 0.40)}
ANY_SCRIPT = Band(0.3, 12.0, 0.95, 0.35)


class PieceCounter:
    """Token ids of a piece vocabulary, by word with a bounded cache.

    No piece holds a word mark after another character or a line end, so the ids of a text are those of
    its words in a row; texts with the mark itself or with runs of spaces are encoded whole.
    """

    def __init__(self, path: str, max_words: int = 400_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.newline = self.model.encode("\n")[1:]
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.max_words = max_words
        self.words: dict[str, tuple[int, ...]] = {}
        self.starts: dict[str, tuple[int, ...]] = {}

    def _known(self, cache: dict, words: Iterable[str], before: str) -> None:
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if new:
            if len(cache) + len(new) > self.max_words:
                cache.clear()
                new = list(dict.fromkeys(words))
            skip = len(self.model.encode(before)) if before else 0
            cache.update((w, tuple(ids[skip:])) for w, ids in zip(new, self.model.encode([before + w for w in new], num_threads=1), strict=True))

    def __call__(self, text: str, words: list[list[str]] | None) -> np.ndarray:
        """words: each line's words, or None if the text isn't plain."""
        if words is None:
            return np.asarray(self.model.encode(text, num_threads=1), np.int64)
        rest = [w for i, line in enumerate(words) for w in line[i > 0 :]]
        starts = [line[0] for line in words[1:]]
        self._known(self.words, rest, "")
        self._known(self.starts, starts, "\n")
        get, out, at = self.words.__getitem__, [], 0
        for i, line in enumerate(words):
            if i:
                out += self.newline
                out += self.starts[line[0]]
            for w in line[i > 0 :]:
                out += get(w)
        return np.asarray(out, np.int64)


_COUNTERS: dict[str, PieceCounter] = {}


def piece_counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def repeated(words: list) -> int:
    """Words in 3-word windows that are found twice or more, the first included."""
    if len(words) < 4:
        return 0
    known: dict = {}
    ids = np.fromiter(map(known.setdefault, words, count()), np.int64, len(words))
    pair = ids[:-1] * len(words) + ids[1:]
    if len(words) >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * len(words) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    held = np.zeros(len(words), bool)
    for k in range(3):
        held[k : k + len(window)] |= twice
    return int(held.sum())


def script_of(text: str) -> str:
    """The first word of the Unicode names of most letters; '' without letters."""
    found: Counter = Counter()
    for ch, n in Counter(text).items():
        if ch.isalpha():
            found[unicodedata.name(ch, "?").split()[0]] += n
    return max(sorted(found), key=found.get) if found else ""


def measure(text: str, lang: str | None, pieces: PieceCounter) -> tuple:
    """One document's METRICS."""
    lines = text.split("\n")
    parts = [line.split(" ") for line in lines]
    plain = not any(c in text for c in "\t\r\x0b\x0c▁\x00")
    if plain:
        words = [w for line in parts for w in line if w]
        whole = all(all(line) for line in parts)
    else:
        words = text.encode("utf-8", "surrogatepass").split()
        whole = False
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    full = [x for x in lines if x.strip(SPACE)]
    dup_lines = len(full) - len(set(full))
    repeat = repeated(words)
    failed = n_words < 50 or 100 * repeat > 50 * n_words
    ids = pieces(text, parts if plain and whole else None)
    n = len(ids)
    per = np.bincount(ids) if n else np.zeros(1, np.int64)
    per = per[per > 0]
    # tokens of line ends are no fallback: they tell of layout
    fallback = (int(pieces.is_byte[ids].sum()) - len(lines) + 1 if n else 0) / max(1, n)
    entropy = float(-(per / n * np.log2(per / n)).sum()) if n else 0.0
    share = entropy / np.log2(n) if n > 1 else 0.0
    chars = len(text) / max(1, n)
    kept = False
    if not failed:
        band = LANGUAGES.get(lang or "") or SCRIPTS.get(script_of(text), ANY_SCRIPT)
        kept = bool(band.least_chars <= chars <= band.most_chars and fallback <= band.most_bytes and share >= band.least_entropy)
    return n_words, word_chars, symbols, dup_lines, repeat, failed, n, chars, max(0.0, fallback), entropy, kept


def quality(docs: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with METRICS added (replacing columns of those names), one row for each row.

    A null text has no words and fails the base rules; a null or unknown language is judged by script.
    Texts of any length are measured whole. Repeated rows get equal figures; an empty table stays empty.
    """
    keep = docs.drop(*(name for name, _ in METRICS))
    schema = T.StructType(list(keep.schema.fields))
    for name, kind in METRICS:
        schema = schema.add(name, kind)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_counter(vocabulary)
        for batch in batches:
            at = batch.schema.get_field_index
            langs = batch.column(at(lang)).to_pylist() if at(lang) >= 0 else [None] * batch.num_rows
            rows = [measure(t.as_py() or "", g, pieces) for t, g in zip(batch.column(at(text)), langs, strict=True)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in METRICS]
            out = [*batch.columns, *(pa.array(c, ARROW[kind]) for c, (_, kind) in zip(columns, METRICS, strict=True))]
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names, *(name for name, _ in METRICS)])

    return keep.withColumn(text, F.col(text).cast("string")).mapInArrow(work, schema)
