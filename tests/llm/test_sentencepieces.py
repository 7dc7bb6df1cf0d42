import public_tokenizers
import pytest
import sentencepiece

from quillsql.llm import queries, sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a  b ", "\n", "a\n\n b\n", "日本語 ①ﬁ é́", "▁x y", "\0a b", "é" * 50, "a\tb\r\nc", "x" * 5000, "🙂 🙂🙂", "The quick brown fox.", "ab" * 2000]


@pytest.mark.parametrize("text", TEXTS)
def test_encoding_is_the_librarys(text):
    model = sentencepieces.piece_model(PATH)
    assert model.encode([text])[0] == model.processor.encode(text)
    assert model.decode(model.encode([text])[0]) == model.processor.decode(model.processor.encode(text))


def test_query_against_the_library(spark, sf_dir, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = queries.op9_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.ids) == model.encode(texts[r.doc_id])
        assert r.n_tokens == len(r.ids) and r.round_trip


def test_suffix_array_and_search():
    import numpy as np

    codes = np.array([ord(c) for c in "banana$bandana$"], np.int32)
    order = sentencepieces.suffix_array(codes, 8)
    text = "banana$bandana$"
    assert [text[i : i + 8] for i in order] == sorted(text[i : i + 8] for i in range(len(text)))
    pieces = np.array([[ord(c) for c in p.ljust(3, "\0")] for p in ("an", "ana", "b", "zz")], np.int32)
    low, high = sentencepieces.occurrences(codes, order, pieces, np.array([2, 3, 1, 2]))
    assert (high - low).tolist() == [4, 3, 2, 0]


def test_best_path_of_a_unigram_model():
    """The best path by scores, against all ways to cut a word."""
    import itertools

    model = sentencepieces.PieceModel(PATH, "unigram")
    scores = dict(zip((model.pieces[i] for i in model.ids), model.scores, strict=True))
    for word in ("▁the", "▁thing", "▁banana"):
        every = [
            [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)), strict=True)]
            for n in range(len(word))
            for cuts in itertools.combinations(range(1, len(word)), n)
        ]
        best = max((parts for parts in every if all(p in scores for p in parts)), key=lambda parts: sum(scores[p] for p in parts))
        model.encode_words([word])
        assert sum(scores[model.pieces[i]] for i in model.words[word]) == pytest.approx(sum(scores[p] for p in best))


def test_odd_rows(spark, docs):
    df = docs([(1, None), (2, ""), (3, "a b"), (3, "a b")], ["ids", "round_trip"])
    rows = sentencepieces.encode(df, PATH).collect()
    assert sorted((r.doc_id, r.n_tokens, r.round_trip) for r in rows) == [(1, 0, True), (2, 0, True), (3, 2, True), (3, 2, True)]
    back = sentencepieces.decode(sentencepieces.encode(df, PATH), PATH).collect()
    assert sorted((r.doc_id, r.text) for r in back) == [(1, ""), (2, ""), (3, "a b"), (3, "a b")]
    assert sentencepieces.encode(docs([]), PATH).count() == 0


def test_marks_and_nuls_go_through_the_index():
    model = sentencepieces.PieceModel(PATH)
    for text in ("▁a ▁▁b a▁b", "a\0b \0 c", "\0", "x\0\0y▁", "a  b\n\n c\0\n▁\nz", " ▁ "):
        assert model.encode([text])[0] == model.processor.encode(text)


@pytest.mark.parametrize("letters", ["ab", "etaoinshrdlu", "日本語中文字学生大"])
@pytest.mark.parametrize("length", [sentencepieces.LONG, sentencepieces.LONG + 1, 300, 100_000])
def test_long_words(letters, length):
    """Words without a space are merged by a queue: no step is quadratic in their length."""
    import random

    coin = random.Random(length)
    text = "".join(coin.choice(letters) for _ in range(length))
    model = sentencepieces.PieceModel(PATH)
    assert model.encode([text])[0] == model.processor.encode(text)


def test_new_words_cost_little_beside_the_library():
    """Edges are looked up by place and length: no sort of them, and no search for each pair of each round."""
    import random
    import time

    coin = random.Random(5)
    words = sorted({"".join(coin.choices("etaoinshrdlu", k=coin.randint(4, 12))) for _ in range(40_000)})
    model = sentencepieces.PieceModel(PATH)

    def least(work):
        took = []
        for _ in range(4):
            model.words.clear()
            before = time.process_time()
            work()
            took.append(time.process_time() - before)
        return min(took)

    text = " ".join(words)
    assert model.encode([text])[0] == model.processor.encode(text)
    assert least(lambda: model.encode([text])) < 3.5 * least(lambda: model.processor.encode(text))


def test_bytes_between_pieces_decode_as_before():
    """Whole and broken runs of bytes, beside pieces and at the ends."""
    model = sentencepieces.PieceModel(PATH)
    a, e, byte = model.processor.piece_to_id("a"), model.processor.piece_to_id("é"), model.by_byte
    for run in ([0xE2, 0x96, 0x81], [0xE3, 0x81], [0x81], [0xF0, 0x9F, 0x99, 0x82], [0x0A], [0xC3, 0x0A, 0xA9]):
        shown = bytes(run).decode("utf-8", "replace").replace("▁", " ")
        ids = [byte[b] for b in run]
        assert model.decode([a, *ids, e, *ids]) == model.decode([a]) + shown + model.decode([e]) + shown
