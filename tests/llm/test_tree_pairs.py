"""The pipeline's deduplication begins with op8's vantage-point search."""

from __future__ import annotations

import numpy as np

from lociflow.llm import near_copies


def test_fingerprints_near_each_other_are_paired_by_the_tree(spark):
    fps = [0, 1, 3, 1 << 40 | 7 << 50, 0, 0x7FFF_FFFF]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(fps)], "row long, bits long")
    found = {(r.a, r.b) for r in near_copies.tree_pairs(rows).collect()}
    assert (0, 4) in found and all(bin(fps[a] ^ fps[b]).count("1") <= 2 for a, b in found)
    assert {x for p in found for x in p} == {0, 1, 2, 4}


def test_the_last_pass_joins_few_pairs_of_a_group_that_is_near_but_not_similar(spark, monkeypatch):
    words = [f"w{i}" for i in range(150)]
    edited = lambda k: " ".join(f"own{k}x{i}" if i in (20 + k % 7, 60 + k % 11, 110 + k % 13) else w for i, w in enumerate(words))
    texts = [edited(k) for k in range(40)] + [edited(0).replace("w5 ", "v5 ")]
    sets = near_copies.shingle_sets_of([t.encode() for t in texts])
    likeness = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    alike = {(i, j) for i in range(41) for j in range(i + 1, 41) if likeness(sets[i], sets[j]) >= 0.8}
    assert len(alike) < 20
    tried, links = [], near_copies.Verifier.links

    def counted(self, pairs, *most):
        tried.append(pairs.count())
        return links(self, pairs, *most)

    monkeypatch.setattr(near_copies.Verifier, "links", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {r.id: r.root for r in near_copies.near_classes(docs).collect()}
    assert roots[0] == roots[40] and all(roots[i] == roots[j] for i, j in alike)
    assert tried[-1] < 80, tried  # 820 pairs share shingles


def test_parities_refuse_no_pair_of_the_similarity():
    rng = np.random.default_rng(1)
    sets = []
    for n in (1, 4, 9, 60, 64, 70, 500, 520, 1_500):
        one = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sets += [one, one[: n - n // 5], np.append(one, rng.integers(0, 1 << 63, n // 4).astype(np.uint64)), np.append(one[n // 3 :], rng.integers(0, 1 << 63, n // 3).astype(np.uint64))]
    sets = [np.unique(x) for x in sets]
    held = near_copies.Parities(np.array([len(x) for x in sets]), [near_copies.parities(x) for x in sets])
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if 4 * max(len(sets[i]), len(sets[j])) <= 5 * min(len(sets[i]), len(sets[j]))]
    may = held.may_be(*np.array(pairs).T)
    for (i, j), found in zip(pairs, may, strict=True):
        if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])):
            assert found, (i, j)
    assert (~may).sum() > len(pairs) // 4
