"""Similarity join of documents on word shingles by the chosen path.

Equal shingle sets are one class at once. Root nodes split the classes on distinct minhash tokens; large
nodes are split again on one or two tokens drawn for the node (1 / similarity on average, so a pair at the
threshold is expected in one child; drawn numbers differ by one at most, so that fewer pairs than by a coin for
every token have no child), until a node is small. Small nodes are
compared all with all on their signatures. There are as many roots as a pair at the threshold needs to be
missed with less than 1 - recall even if it is split as often as depth allows. Nodes that stay large are
one candidate group as they are. Candidate groups are then compared all with all on whole shingle sets,
in square blocks, so the links reported are exact.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsql.llm.common import cut_lineage, drop_cut, free_prefix
from quillsql.llm.components import components

#: Odd multipliers of the shingle hash and of the minhash tokens, from a seeded generator.
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD_HASHES: dict[str, int] = {}


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of words; a shorter text is one run, no words no run."""
    split = text.split()
    if not split:
        return np.empty(0, np.uint64)
    known = _WORD_HASHES
    try:
        values = list(map(known.__getitem__, split))
    except KeyError:
        if len(known) > 500_000:
            known.clear()
        for w in split:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        values = list(map(known.__getitem__, split))
    ids = np.array(values, np.uint64)
    size = min(words, len(ids))
    total = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        total = (total ^ ids[k : k + len(total)]) * _MIX
        total ^= total >> np.uint64(29)
    return np.unique(total)


def _tokens(n: int) -> tuple[np.ndarray, np.ndarray]:
    source = random.Random(20_177)
    a = np.array([source.getrandbits(64) | 1 for _ in range(n)], np.uint64)
    return a, np.array([source.getrandbits(64) for _ in range(n)], np.uint64)


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray, width: int = 4096) -> np.ndarray:
    """The least value of every token's hash over the shingles."""
    best = None
    for s in range(0, len(found), width):
        low = (found[None, s : s + width] * a[:, None] + b[:, None]).min(axis=1)
        best = low if best is None else np.minimum(best, low)
    return (best >> np.uint64(33)).astype(np.int32)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, text): ids may be null or repeat, so a row is named by its text too."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def described(docs: DataFrame, id_col: str, text_col: str, tokens: int, words: int) -> DataFrame:
    """(doc_id, text_hash, key, sig) of every document: key tells equal shingle sets, null where there is none."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _tokens(tokens)
        for batch in batches:
            keys, sigs = [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), words)
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sigs.append(signature(found, a, b) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], ["doc_id", "text_hash", "key", "sig"])

    return _named(docs, id_col, text_col).mapInArrow(work, "doc_id long, text_hash long, key binary, sig array<int>")


def _all_lost(k: int, drawn: int, tokens: int, stays: float) -> float:
    """Chance that none of drawn distinct tokens keeps a pair that shares k of them, where a shared one keeps it with chance stays."""
    ways = sum(math.comb(k, h) * math.comb(tokens - k, drawn - h) * (1 - stays) ** h for h in range(min(k, drawn) + 1))
    return ways / math.comb(tokens, drawn)


def _missed(similarity: float, tokens: int, near: int, roots: int, splits: int) -> float:
    """Chance that a pair at the similarity is told apart if every node it meets is split until the last of the splits.

    A pair shares k of the tokens; each split keeps it if a drawn token is one of them. Roots are dealt evenly
    over the tokens. A pair that shares fewer than near tokens is not found in a small node.
    """
    few = int(1 / similarity)
    more = 1 / similarity - few
    rounds, rest = divmod(roots, tokens)
    total = 0.0
    for k in range(tokens + 1):
        stays = 1.0
        for _ in range(splits - 1):
            stays = 1 - (1 - more) * _all_lost(k, few, tokens, stays) - more * _all_lost(k, few + 1, tokens, stays)
        lost = (1 - stays) ** (rounds * k) * _all_lost(k, rest, tokens, stays)
        total += math.comb(tokens, k) * similarity**k * (1 - similarity) ** (tokens - k) * (1.0 if k < near else lost)
    return total


def _roots(similarity: float, recall: float, tokens: int, near: int, splits: int) -> list[tuple[int, int]]:
    """(round, token) pairs of the root nodes: as few as keep recall through all splits, no token twice before all are used."""
    least = _missed(similarity, tokens, near, 64 * tokens, splits)
    if least >= 1 - recall:
        raise ValueError(f"{tokens} tokens miss {least:.4f} of the pairs at {similarity}, however often they are split")
    count = next(n for n in range(1, 64 * tokens + 1) if _missed(similarity, tokens, near, n, splits) <= 1 - recall)
    order = random.Random(4_711).sample(range(tokens), tokens)
    return [(i // tokens, order[i % tokens]) for i in range(count)]


def _children(node: Column, sig: Column, tokens: int, similarity: float) -> Column:
    """The children of a row's node: the values of the tokens drawn for that node, 1 / similarity on average."""
    few = int(1 / similarity)
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(tokens - 1)), lambda j: F.struct(F.xxhash64(node, j).alias("h"), j.alias("j"))))
    one_more = F.pmod(F.xxhash64(node, F.lit(-1)), F.lit(1 << 30)) < int((1 / similarity - few) * (1 << 30))
    return F.transform(F.slice(drawn, F.lit(1), F.lit(few) + one_more.cast("int")), lambda d: F.xxhash64(node, d.j, F.element_at(sig, d.j + 1)))


def _forest(pairs: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The least member of each position's component."""
    root = np.arange(n)
    a, b = pairs
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _near_pairs(sig: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j: the rows of sig that share at least near tokens."""
    n, left, right = len(sig), [], []
    step = max(1, 4_000_000 // (n * sig.shape[1] + 1))
    for s in range(0, n, step):
        i, j = np.nonzero((sig[s : s + step, None, :] == sig[None, :, :]).sum(axis=2) >= near)
        i += s
        left.append(i[i < j])
        right.append(j[i < j])
    return np.concatenate(left), np.concatenate(right)


def _leaf_edges(least: float, tokens: int):
    """Over rows (node, key, sig) in order of node: (a, b), each member of a node with a likely partner to its group's least.

    Most nodes have two members: those are compared all at once.
    """
    near = math.ceil(least * tokens)

    def compared(nodes: np.ndarray, keys: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        starts = np.nonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))[0]
        sizes = np.diff(np.concatenate([starts, [len(nodes)]]))
        two = starts[sizes == 2]
        two = two[(sig[two] == sig[two + 1]).sum(axis=1) >= near]
        a, b = [np.where(keys[two] < keys[two + 1], two + 1, two)], [np.where(keys[two] < keys[two + 1], two, two + 1)]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            order = start + np.argsort(keys[start : start + size], kind="stable")
            i, j = _near_pairs(sig[order], near)
            if len(i):
                root = _forest((i, j), size)
                moved = np.nonzero(root != np.arange(size))[0]
                a.append(order[moved])
                b.append(order[root[moved]])
        return pa.RecordBatch.from_arrays([pa.array(keys[np.concatenate(x)], pa.binary()) for x in (a, b)], ["a", "b"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column(0).to_numpy()
            keys = np.array(batch.column(1).to_pylist(), object)
            sig = batch.column(2).flatten().to_numpy().reshape(len(nodes), tokens)
            held.append((nodes, keys, sig))
            if nodes[0] == nodes[-1] == held[0][0][0]:
                continue  # one node goes on; node_limit bounds what is held
            nodes, keys, sig = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(nodes, nodes[-1]))
            yield compared(nodes[:last], keys[:last], sig[:last])
            held = [(nodes[last:], keys[last:], sig[last:])]
        if held:
            yield compared(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return work


def candidate_edges(classes: DataFrame, similarity: float, recall: float, tokens: int, node_limit: int, depth: int) -> DataFrame:
    """Edges (a, b) whose components hold every pair of classes (key, sig) at the similarity, but for 1 - recall."""
    spread = math.sqrt(similarity * (1 - similarity) / tokens)
    least = similarity - 3.5 * spread
    leaf = _leaf_edges(least, tokens)
    sig = F.col("sig")
    first = F.array(*[F.xxhash64(F.lit(r), F.lit(j), F.element_at(sig, j + 1)) for r, j in _roots(similarity, recall, tokens, math.ceil(least * tokens), depth)])
    rows = classes.select("key", F.explode(first).alias("node"))
    edges = None
    cuts = []
    for level in range(depth):
        # counts come before signatures: most nodes have one member and end here
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        kept_rows = cut_lineage(rows.join(sizes, "node").select("node", "key", "n"))
        cuts.append(kept_rows)
        small = kept_rows.where(F.col("n") <= node_limit).join(classes, "key").select("node", "key", "sig")
        found = small.repartition("node").sortWithinPartitions("node").mapInArrow(leaf, "a binary, b binary")
        edges = found if edges is None else edges.unionAll(found)
        large = kept_rows.where(F.col("n") > node_limit)
        if large.isEmpty():
            break
        if level == depth - 1:
            least = large.groupBy("node").agg(F.min("key").alias("b"))
            edges = edges.unionAll(large.join(least, "node").select(F.col("key").alias("a"), "b").where("a <> b"))
        else:
            rows = large.join(classes, "key").select("key", F.explode(_children(F.col("node"), sig, tokens, similarity)).alias("node")).distinct()
    out = cut_lineage(edges.distinct())
    for c in cuts:
        drop_cut(c)
    return out


def _verified(similarity: float, words: int):
    """Exact links of one block pair: (key, other, links), other being the least of the key's group here."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        sets = [shingles(t, words) for t in pdf["text"]]
        # a text that only shares a hash with the class's own has another key
        own = [xxhash.xxh3_128_digest(s.tobytes()) == bytes(k) for s, k in zip(sets, pdf["key"], strict=True)]
        own = np.array(own, bool) & ~pdf["key"].where(own).duplicated().to_numpy()
        pdf, sets = pdf[own].reset_index(drop=True), [s for s, x in zip(sets, own, strict=True) if x]
        n = len(pdf)
        sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if n else np.empty(0, np.uint64)
        values, at = np.unique(every, return_inverse=True)
        often = np.bincount(at, minlength=len(values)) > 1
        column = np.cumsum(often) - 1
        shared = np.zeros((n, n), np.float32)
        owner = np.repeat(np.arange(n), sizes)
        hold = often[at]
        owner, place = owner[hold], column[at[hold]]
        width = max(1, 16_000_000 // max(1, n))
        for s in range(0, int(often.sum()), width):
            part = (place >= s) & (place < s + width)
            grid = np.zeros((n, min(width, int(often.sum()) - s)), np.float32)
            grid[owner[part], place[part] - s] = 1
            shared += grid @ grid.T
        union = sizes[:, None] + sizes[None, :] - shared
        link = shared >= similarity * union - 1e-6
        np.fill_diagonal(link, False)
        side = pdf["block"].to_numpy()
        if n and (pdf["i"].iloc[0] != pdf["j"].iloc[0]):
            link &= side[:, None] != side[None, :]
        root = _forest(np.nonzero(link), n)
        links = link.astype(np.int64) @ pdf["copies"].to_numpy(np.int64) if n else np.empty(0, np.int64)
        hit = np.nonzero(links)[0]
        keys = pdf["key"].to_numpy()
        return pd.DataFrame({"key": keys[hit], "other": keys[root[hit]], "links": links[hit]})

    return work


def classified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words: int = 5, recall: float = 0.999,
    tokens: int = 64, node_limit: int = 1000, depth: int = 4, block: int = 300,
) -> DataFrame:
    """(doc_id, text_hash, class_key, class_id, n_links) of every document; class_key is null for texts without words.

    A link is a pair of documents whose sets of word shingles have a Jaccard similarity of at least
    similarity; n_links counts a document's links, those to its copies included. class_id is the least
    doc_id that links reach. Texts without words (null ones too) link to nothing. Repeated rows are copies
    of each other; rows may share an id or have none: a null doc_id takes part, but is no class's least id unless
    no other is there. An empty table gives none.
    """
    rows = cut_lineage(described(docs, id_col, text_col, tokens, words))
    known_id = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    grouped = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"),
        F.min(known_id).alias("text_id"), F.min_by("text_hash", known_id).alias("text_hash"),
    )
    classes = cut_lineage(grouped)
    edges = candidate_edges(classes.select("key", "sig"), similarity, recall, tokens, node_limit, depth)
    members = cut_lineage(components(edges).join(classes.select(F.col("key").alias("a"), "text_id", "text_hash", "copies"), "a"))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).select("root", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "root").select(F.col("a").alias("key"), "root", "text_id", "text_hash", "copies", "blocks", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"))
    texts = _named(docs, id_col, text_col).select(known_id.alias("text_id"), "text_hash", "text")
    # always by a shuffle: a broadcast would only fit while the corpus is small; rows that repeat an id and a text give one
    held = placed.join(texts.hint("merge"), ["text_id", "text_hash"]).dropDuplicates(["key", "text"])
    squares = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))
    )
    spread = held.select("key", "root", "copies", "block", "text", F.explode(squares).alias("s")).select("key", "root", "copies", "block", "text", "s.i", "s.j")
    links = cut_lineage(spread.groupBy("root", "i", "j").applyInPandas(_verified(similarity, words), "key binary, other binary, links long"))
    roots = components(links.select(F.col("key").alias("a"), F.col("other").alias("b")))
    totals = links.groupBy("key").agg(F.sum("links").alias("links"))
    known = roots.select(F.col("a").alias("key"), "root").join(classes.select("key", "rep"), "key")
    least = known.groupBy("root").agg(F.min("rep").alias("class_id"))
    linked = known.join(least, "root").join(totals, "key").select("key", F.col("root").alias("class_key"), "class_id", "links")
    by_class = classes.select("key", "rep", "copies").join(linked, "key", "left")
    by_class = by_class.select(
        "key", F.coalesce("class_key", "key").alias("class_key"), F.when(F.col("class_key").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    out = rows.select("doc_id", "text_hash", "key").join(by_class, "key", "left")
    return out.select(
        "doc_id", "text_hash", "class_key", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, n_links) of every document, as classified() has them."""
    return classified(docs, **options).select("doc_id", "class_id", "n_links")


def first_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without near copies: of each class a row with the least id stays (null ids are the greatest), and every text without words.

    Rows of one id go by a hash of their texts; of rows that repeat an id and a text one stays.
    """
    named = classified(docs, id_col, text_col, **options)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    least = named.where("class_key IS NOT NULL").groupBy("class_key").agg(F.min(order).alias("m")).select("m.doc_id", "m.text_hash")
    p = free_prefix(docs)
    stay = least.unionAll(named.where("class_key IS NULL").select("doc_id", "text_hash")).distinct().select(F.col("doc_id").alias(f"{p}id"), F.col("text_hash").alias(f"{p}hash"))
    hashed = docs.withColumn(f"{p}text", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    kept = hashed.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}text") == F.col(f"{p}hash")), "left_semi")
    return kept.dropDuplicates([id_col, text_col]).select(docs.columns)
