import random

from lectern.llm import neardup


def jaccard(a, b):
    a, b = set(neardup.shingles(a).tolist()), set(neardup.shingles(b).tolist())
    return len(a & b) / len(a | b)


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        out.append(base)
        for _ in range(rng.randint(0, 2)):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(copy)
    return [" ".join(x) for x in out]


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "policy_doc_id long, text string, id string, path string")
    pairs, members = neardup.near_copies(df, **how)
    return pairs, members


def test_all_pairs_of_a_brute_force(spark):
    texts = corpus()
    pairs, members = run(spark, [(k, t, "c", "c") for k, t in enumerate(texts)])
    got = {(r.doc_a, r.doc_b) for r in neardup.row_pairs(pairs, members).collect()}
    true = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if jaccard(texts[a], texts[b]) >= 0.7}
    assert got <= true and len(got) >= 0.98 * len(true) > 50


def test_copies_and_groups(spark):
    a = " ".join(f"alpha{k}" for k in range(60))
    b = a.replace("alpha5 ", "beta ")
    rows = [(1, a, "", ""), (2, a, "", ""), (3, b, "", ""), (4, None, "", ""), (5, "", "", ""), (6, "too few words", "", ""), (None, a, "", ""), (1, a, "", "")]
    pairs, members = run(spark, rows)
    got = [(r.doc_a, r.doc_b) for r in neardup.row_pairs(pairs, members).collect()]
    assert sorted(got) == [(1, 2), (1, 3), (2, 3)]
    groups = {r.id: (r.group_id, r.n_links) for r in neardup.groups(pairs, members).collect()}
    assert groups == {1: (1, 1), 2: (1, 1), 3: (1, 1)}


def test_a_long_shuffled_chain_is_one_group(spark):
    ids = list(range(400))
    random.Random(5).shuffle(ids)
    chain = [(min(x), max(x)) for x in zip(ids, ids[1:])]
    members = spark.createDataFrame([(k, k, 1) for k in range(401)], "id long, rep long, n_same long")
    got = {r.id: (r.group_id, r.n_links) for r in neardup.groups(spark.createDataFrame(chain, "a long, b long"), members).collect()}
    ends = {ids[0], ids[-1]}
    assert got == {k: (0, 1 if k in ends else 2) for k in range(400)} | {400: (400, 0)}


def test_hot_clusters_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE", 4)
    texts = []
    for c in range(60):
        base = " ".join(f"base{c}x{k}" for k in range(200))
        texts += [f"{base} {' '.join(f'own{c}x{n}x{k}' for k in range(41))}" for n in range(12)]
    assert 0.7 <= jaccard(texts[0], texts[1]) < 0.71
    pairs, members = run(spark, [(k, t, "", "") for k, t in enumerate(texts)])
    got = neardup.row_pairs(pairs, members).count() / (60 * 12 * 11 // 2)
    assert 0.98 <= got <= 1


def test_trees_by_depth():
    counts = [neardup.trees_for(d, 0.7) for d in range(1, 8)]
    assert counts == sorted(counts) and counts[0] == neardup.TREES < counts[-1]
    assert all(neardup.recall_of(n, d, 0.7, 0.7) >= neardup.RECALL for d, n in enumerate(counts, 1))
    assert neardup.recall_of(10, 7, 0.7, 0.7) < 0.9


def test_large_group_of_copies_is_a_star(spark):
    a = " ".join(f"alpha{k}" for k in range(60))
    pairs, members = run(spark, [(k, a, "", "") for k in range(200)])
    assert {(r.doc_a, r.doc_b) for r in neardup.row_pairs(pairs, members).collect()} == {(0, k) for k in range(1, 200)}


def test_large_node_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE", 10)
    monkeypatch.setattr(neardup, "DEPTH", 1)
    base = [f"alpha{k}" for k in range(80)]
    rows = []
    for k in range(40):
        own = list(base)
        own[k] = f"own{k}"
        rows.append((k, " ".join(own), "", ""))
    pairs, members = run(spark, rows)
    assert neardup.row_pairs(pairs, members).count() == 40 * 39 // 2


def test_empty(spark):
    pairs, members = run(spark, [])
    assert pairs.count() == members.count() == neardup.row_pairs(pairs, members).count() == 0


def test_minwise_of_a_large_set_in_parts():
    import numpy as np

    sets = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    whole = ((sets[:, None] * neardup.MUL + neardup.ADD) >> np.uint64(32)).min(axis=0)
    assert (neardup.minwise(sets) == whole).all()
