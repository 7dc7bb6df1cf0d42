import re

import public_tokenizers
import pytest
from tests.llm.test_jaccard_join import brute as near_brute
from tests.llm.test_line_dedup import brute as lines_brute
from tests.llm.test_pii import brute as pii_brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, sf_dir):
    from quillsql.llm import packing, quality
    from quillsql.llm.common import cut_lineage, table

    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    after = []
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = cut_lineage(stage(spark, now, sf_dir))
        assert now.columns == docs.columns
        after.append({r.doc_id: r.text for r in now.collect()})
        assert now.count() == len(after[-1])
    pieces = quality.piece_counter(public_tokenizers.path("piece_bpe_32k.model"))
    good = {d: t for d, (t, lang) in rows.items() if quality.measure(t, lang, pieces)[-1]}
    assert after[0] == good
    lines = {d: t for d, t in lines_brute(sorted(good.items())).items() if re.search(r"[^ \t\n\x0b\f\r]", t)}
    assert after[1] == lines
    classes = near_brute(lines.items())
    assert after[2] == {d: t for d, t in lines.items() if classes[d][0] == d}
    for d, t in after[2].items():
        found = [tuple(map(int, x.split(":")[1:])) for x in pii_brute(t).split(",") if x]
        assert all(t[s:e] not in after[3][d] for s, e in found)
        if not re.search(r"[0-9@]", t):
            assert after[3][d] == t
    out = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    size = {}
    for r in out:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert size == {d: len(encode(t)) // 4 + 1 for d, t in after[3].items()}


def test_repeated_rows_and_nulls(spark, docs, sf_dir):
    long_text = " ".join(f"word{i} of this text" for i in range(30))
    df = docs([(1, long_text), (1, long_text), (2, None), (3, long_text + " more")])
    kept = corpus_pipeline.near_copies(spark, df, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
    clash = docs([(None, long_text), (4, long_text + " more"), (None, "own text of a null id"), (4, "other text of four"), (None, None)], ["_id", "class_key"])
    got = corpus_pipeline.near_copies(spark, clash, sf_dir)
    assert sorted(str(r.text) for r in got.collect()) == sorted([long_text + " more", "own text of a null id", "other text of four", "None"])
    assert got.columns == clash.columns
    assert corpus_pipeline.near_copies(spark, docs([]), sf_dir).count() == 0


def test_stages_on_odd_rows(spark, docs, sf_dir):
    """Null ids and texts, repeated rows, clashing names and empty tables go through every stage."""
    from quillsql.llm.common import cut_lineage

    good = "\n".join(" ".join(f"the house of number {i * 7 + j} stands by the river" for j in range(3)) for i in range(12))
    df = docs([(1, good), (1, good), (None, good + "\nand one more line of words here"), (2, None), (3, ""), (1, "short"), (4, "x" * 50_000)], ["kept", "_row", "key", "pii_spans"])
    for rows in (df, df.limit(0)):
        now = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, rows, sf_dir).count()
            now = cut_lineage(stage(spark, now, sf_dir))
            assert now.columns == rows.columns
        corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).count()
