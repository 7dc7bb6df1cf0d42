import random
from collections import Counter, defaultdict

from quillsql.llm import jaccard_join, queries
from quillsql.llm.components import components


def brute(rows, similarity=0.8):
    sets = {}
    for d, t in rows:
        w = (t or "").split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent, links = {d: d for d in sets}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by_shingle[x].append(d)
    for d, s in sets.items():
        shared = Counter(e for x in s for e in by_shingle[x] if e > d)
        for e, k in shared.items():
            if k >= similarity * (len(s) + len(sets[e]) - k):
                links[d] += 1
                links[e] += 1
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (root(d), links[d]) for d in sets}


def test_query_against_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op4_ngram_jaccard_join(spark, sf_dir).collect()}
    assert got == brute(texts.items())


def test_large_groups_go_through_every_level(spark, docs):
    """Groups beyond a node's and a block's size, of copies and of near copies, and one shared passage."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    base = [r.choice(vocabulary) for _ in range(150)]
    rows = [(i, " ".join(base)) for i in range(30)]
    for i in range(30, 110):
        words = list(base)
        words[r.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(passage + [r.choice(vocabulary) for _ in range(60)])) for i in range(110, 200)]
    found = jaccard_join.near_duplicates(docs(rows), node_limit=20, depth=3, block=25)
    assert {x.doc_id: (x.class_id, x.n_links) for x in found.collect()} == brute(rows)


def test_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "a b"), (5, "a b"), (6, "a b c"), (None, "q r s"), (8, "q r s")]
    got = sorted((x.doc_id or 0, x.class_id, x.n_links) for x in jaccard_join.near_duplicates(docs(rows, ["key", "class_id"])).collect())
    assert got == [(0, 8, 1), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 2), (5, 4, 2), (5, 4, 2), (6, 6, 0), (8, 8, 1)]
    assert jaccard_join.near_duplicates(docs([])).count() == 0


def test_clashing_ids(spark, docs):
    """Links go by rows: an id with two texts and a null id with two texts have each text's links."""
    r = random.Random(2)
    a, b, c = ([f"{x}{r.randrange(10_000)}" for _ in range(60)] for x in "abc")
    near = lambda w: " ".join([*w[:59], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (None, " ".join(c)), (4, near(c)), (None, "lone text of a null id"), (None, "lone text of a null id")]
    got = sorted((x.doc_id or 0, x.class_id or 0, x.n_links) for x in jaccard_join.near_duplicates(docs(rows)).collect())
    assert got == [(0, 0, 1), (0, 0, 1), (0, 4, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 1)]


def test_a_large_group_and_what_lies_at_its_edge(spark, docs):
    """Near copies of one text, and for each of some of them a text just within the threshold of it but further from the rest."""
    r = random.Random(9)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(2):
            words[r.randrange(200)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
        if i % 5 == 0:
            at = r.randrange(20, 160)
            rows.append((1000 + i, " ".join([*words[:at], *(f"y{r.randrange(10**6)}" for _ in range(18)), *words[at + 18 :]])))
    found = jaccard_join.near_duplicates(docs(rows), node_limit=20)
    assert {x.doc_id: (x.class_id, x.n_links) for x in found.collect()} == brute(rows)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (None, 3), (300, 301), (301, 300)]
    got = {r.a: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100, 300: 300, 301: 300}


def test_recall_holds_where_every_node_is_split_to_the_end(spark):
    """Pairs at the threshold in nodes that count as large at every level: few may be told apart."""
    r = random.Random(8)
    rows, pairs = [], 3000
    for i in range(pairs):
        a = [r.getrandbits(30) for _ in range(64)]
        rows += [(f"{i}a".encode(), a), (f"{i}b".encode(), [x if r.random() < 0.8 else r.getrandbits(30) for x in a])]
    classes = spark.createDataFrame(rows, "key binary, sig array<int>")
    edges = jaccard_join.candidate_edges(classes, 0.8, 0.999, 64, node_limit=1, depth=4).collect()
    assert pairs - len({bytes(e.a)[:-1] for e in edges}) <= 0.003 * pairs
