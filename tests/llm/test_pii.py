import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillsql.llm import pii, queries


def brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        number = re.sub("[^0-9]", "", m[0])
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
        if 16 <= len(number) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{s}:{e}" for k, s, e in out)


def test_query_against_brute_force(spark, sf_dir, texts):
    rows = queries.op8_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(rf"\b{k}:", want)) for k in pii.KINDS[:4]]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


TEXTS = [
    None, "", "a@b.c_x@d.ef", "x@y", "a@b.cd@e.fg", "..a@b..c a@b.c.", "é🙂 mail é.x@ä.de z@q.de", "1.2.3.4.5.6.7.8", "1.2.3 0255.0.00.1 256.1.1.1 1.2.3.4444", "12.34.56.78.9",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "5 4111111111111111", "4111111111111111 1", "00000000000000000000 0", "4111  1111 1111 1111", "+1 (212) 555-1234", "++49 30 123456", "+1+2 345 6789 0", "+12345678901234567",
    "@" * 50, "1 " * 3000, "a." * 3000 + "@b.c", "1." * 3000, "x@" + "y." * 3000 + "z", "+" + "1" * 5000, "12 " * 4000, "a" * 60000, "9" * 30000,
]


def test_odd_texts(spark, docs):
    rows = pii.find_pii(docs(list(enumerate(TEXTS)), ["pii_spans", "_base"])).withColumn("base", pii.span_list(F.filter("pii_spans", lambda s: s["base"]))).collect()
    got = {r.doc_id: r.base for r in rows}
    for i, text in enumerate(TEXTS):
        assert got[i] == brute(text or ""), (text or "")[:60]
    assert pii.find_pii(docs([])).count() == 0


def test_the_method_adds_secrets_and_masks(spark, docs):
    key = "c3fcd1f0a9b84e7d" * 2
    rows = [(i, f"see token = \"{key}{i}\" and mail a{i}@b.com or 10.0.0.{i}") for i in range(40)] + [(100, "no data in this clean text, version 1.2 of page 12345")]
    found = pii.find_pii(docs(rows)).withColumn("safe", pii.masked(F.col("text"), F.col("pii_spans"))).collect()
    for r in found:
        if r.doc_id == 100:
            assert r.safe == r.text
        else:
            assert key not in r.safe and "[EMAIL]" in r.safe and "[IP]" in r.safe and "[SECRET]" in r.safe


def test_em_finds_the_reliable_labeler():
    """Two labelers that follow the truth and one that votes at random."""
    import random

    r, counts = random.Random(3), {}
    for _ in range(4000):
        truth = r.random() < 0.5
        follow = lambda p, t=truth: (1 if t else -1) if r.random() < p else (-1 if t else 1)
        votes = (follow(0.9), follow(0.85), r.choice((-1, 1)), 0, 0)
        counts[0, False, votes] = counts.get((0, False, votes), 0) + 1
    table, _ = pii.reliabilities([(*k, n) for k, n in counts.items()])
    good, noise = table[0, 0, 1, 1] - table[0, 0, 1, 0], table[0, 2, 1, 1] - table[0, 2, 1, 0]
    assert good > 0.6 and abs(noise) < 0.25


def test_main_path_has_no_python(spark, docs):
    plan = pii.find_pii(docs([(1, "a@b.com")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("text, spans, want", [("abcdef", [(0, 1, 3), (1, 2, 5)], "a[EMAIL]f"), ("é🙂x", [(1, 1, 2)], "é[IP]x"), ("x", [], "x")])
def test_masked(spark, text, spans, want):
    rows = spark.createDataFrame([(text, [(k, s, e, True) for k, s, e in spans])], "text string, s array<struct<kind:int,start:bigint,end:bigint,base:boolean>>")
    assert rows.select(pii.masked(F.col("text"), F.col("s")).alias("m")).first().m == want
