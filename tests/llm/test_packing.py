import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillsql.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_bins_hold_every_piece_once(lengths):
    bins = packing.pack_lengths(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 64 for b in bins)
    # minimum bin slack leaves at most one bin half empty
    assert sum(2 * sum(lengths[i] for i in b) <= 64 for b in bins) <= 1


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 60))
@settings(max_examples=80, deadline=None)
def test_fullest_is_the_best_sum(counts, room):
    reach = {0}
    for length, n in counts.items():
        reach = {r + k * length for r in reach for k in range(n + 1) if r + k * length <= room}
    found = packing.fullest(counts, sorted(counts, reverse=True), room)
    assert sum(a * b for a, b in found) == max(reach)
    assert all(b <= counts[a] for a, b in found)


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 4096, 5000])
def test_cut(n):
    pieces = packing.cut(n, 2048)
    assert pieces[0][0] == 0 and sum(k for _, k in pieces) == n
    assert all(k == 2048 for _, k in pieces[1:])


@pytest.mark.parametrize("text", ["", "a  b\n\n c", "it's we'll 'LL", "ß²½ x", "日本 語 12", "\x1c a \x85b", "<|endoftext|> x_y", "a <|endoftext|> b", "a <|endoftext | > b", "x" * 3000, "🙂 🙂"])
def test_word_encoder_is_the_tokenizer(text):
    encode = packing.WordEncoder(PATH, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = Tokenizer.from_file(PATH)
    assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_query_against_brute_force(spark, sf_dir, texts):
    rows = queries.op1_best_fit_packing(spark, sf_dir).collect()
    tokenizer, by_doc, by_sequence = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    total = 0
    for doc_id, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        total += len(ids)
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        at = 0
        for p in pieces:
            assert p.start == at
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids) and (len(pieces) == 1 or len(ids) > 2048)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert len(by_sequence) <= -(-total // 2048) + 2


def test_odd_rows(spark, docs):
    df = docs([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 5000)], ["piece", "offset"])
    rows = packing.pack_documents(df, PATH).collect()
    assert sum(r.doc_id == 2 for r in rows) == 2
    assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1, 1]
    assert sum(r.length for r in rows if r.doc_id == 3) > 4096
    assert sum(r.doc_id is None for r in rows) == 1
    assert packing.pack_documents(docs([]), PATH).count() == 0


@pytest.mark.parametrize("parts", [1, 16, 211])
def test_bins_do_not_depend_on_partitions(spark, sf_dir, parts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(parts)
    rows = packing.pack_documents(docs, PATH, chunk=300, choice=20).collect()
    total, sizes = sum(r.length for r in rows), defaultdict(int)
    for r in rows:
        sizes[r.sequence_id] += r.length
    assert len(sizes) <= -(-total // 2048) + 2 and max(sizes.values()) <= 2048
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_pieces_that_share_no_bin(spark, docs):
    """Texts of a bit more than half a bin never fill one: every piece has its own."""
    df = docs([(i, " word" * 1100) for i in range(50)]).repartition(7)
    rows = packing.pack_documents(df, PATH, chunk=10, choice=4).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) == 50
