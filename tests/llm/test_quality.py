import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from quillsql.llm import quality, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    held = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(held), n < 50 or 100 * len(held) > 50 * n


def test_query_against_brute_force(spark, sf_dir, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = queries.op6_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        assert r.n_tokens == len(model.encode(texts[r.doc_id]))
        assert not (r.base_failed and r.kept)


def test_labelled_good_documents_stay(spark, sf_dir):
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    rows = [r for r in queries.op6_quality_rules(spark, sf_dir).collect() if r.doc_id in good and not r.base_failed]
    assert rows and all(r.kept for r in rows)


def test_most_labelled_junk_past_the_base_goes(spark, sf_dir):
    junk = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").collect()}
    rows = [r for r in queries.op6_quality_rules(spark, sf_dir).collect() if r.doc_id in junk and not r.base_failed]
    assert rows and 3 * sum(not r.kept for r in rows) > 2 * len(rows)


TEXTS = [None, "", " \n\t", "a b c a b c", "x\ty\r\nz\x0b\x0cw", "line\nline\n\nline ", "日本語 の テキスト", "a  b   c", "▁mark here", "#$ % & | < >", "\x85\xa0 nbsp\u2003word", "w " * 60, "The cat sat on the mat. " * 3]


def test_odd_rows(spark, docs):
    df = docs(list(enumerate(TEXTS)), ["n_words", "kept"])
    rows = {r.doc_id: r for r in quality.quality(df, PATH).collect()}
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), text
    assert quality.quality(docs([]), PATH).count() == 0


@pytest.mark.parametrize("text", ["plain words here", "two\nlines of\n\ntext", "x" * 300, "é ü 漢字 🙂", "a\nb c\nd"])
def test_piece_counter_is_the_tokenizer(text):
    counter = quality.PieceCounter(PATH)
    parts = [line.split(" ") for line in text.split("\n")]
    words = parts if all(all(line) for line in parts) else None
    assert counter(text, words).tolist() == counter.model.encode(text)


def test_bands_reject_what_a_tokenizer_breaks_up(spark, docs):
    junk = " ".join(chr(0x10000 + 7 * i) + chr(0x12000 + i) for i in range(200))
    prose = "It was a bright cold day in April and the clocks were striking thirteen while people walked along the quiet streets of the old town and spoke of nothing in particular, as they had done every morning for as long as anyone could remember, until the rain began again."
    assert len(prose.split()) >= 46
    prose += " Then everyone went home to wait for better weather."
    rows = {r.doc_id: r.kept for r in quality.quality(docs([(1, junk), (2, prose)]), PATH).collect()}
    assert rows == {1: False, 2: True}
