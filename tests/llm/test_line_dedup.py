import re
from collections import defaultdict

import pytest

from quillsql.llm import line_dedup, queries


def brute(rows, min_words=5):
    """{doc_id: kept text}, by sets of words with one left out."""
    seen, order = {}, []
    words = lambda line: tuple(x for x in re.split(r"[ \t\x0b\f\r]+", line) if x)
    for doc_id, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            w = words(line)
            if w and w not in seen:
                seen[w] = (doc_id, i)
                order.append(w)
    gaps, gone = defaultdict(list), set()
    for w in order:
        if len(w) >= min_words:
            for i in range(len(w)):
                gaps[w[:i], w[i + 1 :]].append(w)
    for (a, b), members in gaps.items():
        gone.update(members[1:])
        if a + b in seen:
            gone.update(max((w, a + b), key=seen.get) for w in members)
    out = {}
    for doc_id, text in rows:
        kept = [x for i, x in enumerate((text or "").split("\n")) if not words(x) or (seen[words(x)] == (doc_id, i) and words(x) not in gone)]
        out[doc_id] = "\n".join(kept)
    return out


def test_query_against_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: r.text for r in queries.op2_line_dedup(spark, sf_dir).collect()}
    assert got == brute(sorted(texts.items()))


LONG = "one two three four five six seven eight nine ten"


@pytest.mark.parametrize(
    "other, same",
    [
        (LONG, True), (LONG.replace("five", "FIVE"), True), (LONG + " eleven", True), (LONG.replace("four ", ""), True), ("zero " + LONG, True), (LONG.replace(" ", "\t"), True),
        (LONG.replace("five", "5").replace("six", "6"), False), (LONG + " x y", False), ("one two three", False),
    ],
)
def test_one_edit(spark, docs, other, same):
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs([(1, LONG), (2, f"head\n{other}\n")])).collect()}
    assert got[1] == LONG
    assert got[2] == ("head\n" if same else f"head\n{other}\n")


def test_hot_lines_and_templates(spark, docs):
    template = "the same eight words of a template and number {} here"
    rows = [(i, f"common line\n{template.format(i)}\nown {i}") for i in range(300)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got == brute(rows)
    assert got[299] == "own 299"


def test_odd_rows(spark, docs):
    df = docs([(1, None), (2, ""), (3, " \n\n"), (None, "x y"), (5, "x y\nz"), (6, "z\nz"), (6, "z\nz")], ["n_lines", "_row", "_own", "h1"])
    rows = line_dedup.dedup_lines(df).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in rows)
    assert got == [(-1, "x y"), (1, ""), (2, ""), (3, " \n\n"), (5, "z"), (6, ""), (6, "")]
    assert {x for r in rows for x in (r.h1, r._row, r._own)} == {"clash"}
    assert line_dedup.dedup_lines(docs([])).count() == 0


def test_threshold(spark, docs):
    """One edit of five words is a similarity of 0.8; of four words it is less."""
    rows = [(1, "a b c d e\na b c d"), (2, "a b X d e"), (3, "a b X d"), (4, "a b c d Y Z"), (5, "p q r s"), (6, "p q X s")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()}
    # "a b c d" and "a b X d" are lines of five words less one; the last two have four words both
    assert got == brute(rows) == {1: "a b c d e", 2: "", 3: "", 4: "a b c d Y Z", 5: "p q r s", 6: "p q X s"}


def test_clashing_ids(spark, docs):
    """Null ids and repeated ids with different texts neither crash nor share their lines."""
    near = LONG.replace("five", "FIVE")
    rows = [(None, f"{LONG}\nleft one"), (None, f"alone\n{LONG}\nright one"), (7, f"{near}\nseven"), (7, "other text"), (7, "first\nsecond\nthird"), (8, f"{LONG} eleven\nsecond")]
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(docs(rows)).collect())
    assert got in (
        sorted([(0, f"{LONG}\nleft one"), (0, "alone\nright one"), (7, "seven"), (7, "other text"), (7, "first\nsecond\nthird"), (8, "")]),
        sorted([(0, "left one"), (0, f"alone\n{LONG}\nright one"), (7, "seven"), (7, "other text"), (7, "first\nsecond\nthird"), (8, "")]),
    )


def test_extreme_ids(spark, docs):
    low, high = -(1 << 63), (1 << 63) - 1
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs([(high, LONG), (low, LONG), (0, f"{LONG} x\nown")])).collect()}
    assert got == {low: LONG, 0: "own", high: ""}


def test_random_lines(spark, docs):
    import random

    coin = random.Random(5)
    base = [[coin.choice("abcdef") for _ in range(coin.randint(1, 9))] for _ in range(60)]
    rows = []
    for i in range(150):
        lines = []
        for w in coin.sample(base, 4):
            w = list(w)
            at = coin.randrange(len(w))
            lines.append(" ".join([w, w[:at] + w[at + 1 :], [*w[:at], "z", *w[at:]], [*w[:at], coin.choice("xy"), *w[at + 1 :]]][coin.randrange(4)]))
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got == brute(rows)


def test_very_long_lines(spark, docs):
    """A line of 100,000 words and one edit of it; hashes are chained by stretches of 256."""
    words = [f"w{i}" for i in range(100_000)]
    edited = words[:70_000] + ["new"] + words[70_001:]
    shorter = words[:257] + words[258:]
    rows = [(1, " ".join(words)), (2, " ".join(edited) + "\nown"), (3, " ".join(shorter)), (4, " ".join(words[:600])), (5, " ".join(words[1:600]))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got == {1: rows[0][1], 2: "own", 3: "", 4: rows[3][1], 5: ""}
