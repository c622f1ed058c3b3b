import random

import numpy as np

from stratoloom.llm.clusters import similarity_clusters
from stratoloom.llm.forest import fit_forest
from stratoloom.llm.near_duplicates import CODE_WORD, duplicate_groups, expand_pairs, near_duplicates
from stratoloom.llm.neighbours import mutual_pairs, nearest_neighbours, usable_vectors


def shingles(text, k):
    import re

    w = re.findall(CODE_WORD, text.lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(25):
        base = [rnd.choice(words) for _ in range(60)]
        for _ in range(4):
            t = [x if rnd.random() > 0.06 * (g % 4) else rnd.choice(words) for x in base]
            rows.append((len(rows), " ".join(t), "clash"))
    rows += [(1000, None, ""), (1001, "", ""), (1002, "a b", ""), (None, "x y z q", ""), (0, rows[0][1], "clash")]
    df = spark.createDataFrame(rows, "id long, t string, cell string")
    members, pairs = near_duplicates(df, "id", "t", 3, 0.5, CODE_WORD)
    sets = {i: shingles(t, 3) for i, t, _ in rows if i is not None and t and shingles(t, 3)}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    got = {(r.id_a, r.id_b) for r in expand_pairs(members, pairs, "id").collect()}
    assert got == want and {r.id for r in members.collect()} == set(sets)
    groups = {r.id: r.group_id for r in duplicate_groups(members, pairs, "id").collect()}
    assert all(groups[a] == groups[b] for a, b in want)


def test_a_third_of_copies_and_an_empty_table(spark):
    text = "the same words again and again in this text"
    df = spark.createDataFrame([(i, text if i < 60 else f"other text number {i} with words of its own {i * 7}") for i in range(180)], "id long, t string")
    members, pairs = near_duplicates(df, "id", "t")
    assert members.where("class_id = 0").count() == 60 and pairs.count() == 0
    m, p = near_duplicates(df.where("false"), "id", "t")
    assert m.count() == 0 and p.count() == 0 and duplicate_groups(m, p, "id").count() == 0


def planted(n=600, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[rng.integers(12, size=n)] + 0.06 * rng.normal(size=(n, 64))
    x[:40] = rng.normal(size=(40, 64))  # noise
    # a bridge between two clusters, and a chain of loners
    x[40] = centres[0] + centres[1]
    chain = rng.normal(size=(2, 64))
    for i in range(6):
        x[41 + i] = np.cos(i * 0.7) * chain[0] / np.linalg.norm(chain[0]) + np.sin(i * 0.7) * chain[1] / np.linalg.norm(chain[1])
    x[50:70] = x[50]
    return x


def frame(spark, x):
    rows = [(int(i) * 3, [float(v) for v in r], "d") for i, r in enumerate(x)]
    rows += [(10_001, None, ""), (10_002, [], ""), (10_003, [0.0] * 64, ""), (10_004, [float("nan")] * 64, ""), (10_005, [1.0] * 32, ""), (None, [1.0] * 64, ""), rows[3]]
    return usable_vectors(spark.createDataFrame(rows, "chunk_id long, embedding array<float>, rank string"), "chunk_id", "embedding")


def unit(spark_df):
    rows = sorted(spark_df.collect(), key=lambda r: r.id)
    x = np.array([r.vec for r in rows], dtype=np.float64)
    return np.array([r.id for r in rows]), x / np.linalg.norm(x, axis=1, keepdims=True)


def test_clusters_equal_brute_force(spark):
    v = frame(spark, planted()).cache()
    ids, x = unit(v)
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in np.argwhere(np.triu(x @ x.T >= 0.6, 1)):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {int(ids[i]): int(ids[find(i)]) for i in range(len(ids))}
    got = similarity_clusters(v).collect()
    assert {r.id: r.cluster_key for r in got} == want
    assert all(0 < r.membership <= 1.000001 for r in got)
    assert {r.id: r.cluster_key for r in similarity_clusters(v, block_rows=7).collect()} == want
    assert similarity_clusters(v.where("false")).count() == 0


def test_neighbours(spark):
    v = frame(spark, planted(1500)).cache()
    ids, x = unit(v)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    s = np.round(s, 9)
    want = {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, -s[i]))[:3]] for i in range(len(ids))}
    rows = nearest_neighbours(v, leaf_rows=128, visits=12).cache()
    got = {}
    for r in rows.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    recall = np.mean([len(set(want[i]) & set(got.get(i, []))) / 3 for i in want])
    assert recall >= 0.9, recall
    blocked = {(r.id, r.neighbour) for r in nearest_neighbours(v, leaf_rows=128, visits=12, block_rows=40).collect()}
    assert blocked == {(i, j) for i, js in got.items() for j in js}
    # copies of one vector have each other, in order of id
    assert got[150] == [153, 156, 159] and got[153] == [150, 156, 159]
    assert {(r.id_a, r.id_b) for r in mutual_pairs(rows, 0.999).collect()} >= {(150, 153), (153, 156)}
    assert nearest_neighbours(v.where("false")).count() == 0
    assert nearest_neighbours(v.where("id = 0")).count() == 0
    pair = {(r.id, r.neighbour) for r in nearest_neighbours(v.where("id in (0, 3)")).collect()}
    assert pair == {(0, 3), (3, 0)}


def test_queue_and_table_open_the_same_leaves():
    x = planted(800).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = fit_forest(x, 3, 4)
    prio = f.leaf_priorities(x[:20])
    for r in range(20):
        opened = f.search(x[r], 9)
        assert sorted(np.round(prio[r][opened], 5).tolist()) == sorted(np.round(np.sort(prio[r])[::-1][:9], 5).tolist())


def test_deep_forests_open_the_leaves_of_the_queue():
    from stratoloom.llm.forest import fit_forest

    rng = np.random.default_rng(3)
    x = rng.standard_normal((9000, 12)).astype(np.float32)
    f = fit_forest(x, 3, 10, 1)
    q = x[:300]
    prio = f.leaf_priorities(q)
    got = f.opened(q, 12)
    # the same priorities; leaves whose least margin is that of one node they share may take each other's place
    best = np.sort(prio, axis=1)[:, -12:]
    assert np.allclose(np.sort(np.take_along_axis(prio, got, 1), axis=1), best) and all(len(set(r)) == 12 for r in got.tolist())
    assert (f.homes(q) == prio.reshape(300, 3, f.leaves).argmax(axis=2) + np.arange(3) * f.leaves).all()


def test_recall_at_two_sizes(spark):
    rng = np.random.default_rng(8)
    for n in (3000, 24000):
        centres = rng.standard_normal((n // 100, 16))
        x = np.repeat(centres, 100, axis=0) + 0.45 * rng.standard_normal((n, 16))
        v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, vec array<float>")
        got = {}
        for r in nearest_neighbours(v, leaf_rows=512).where("id % 100 = 0").collect():
            got.setdefault(r.id, set()).add(r.neighbour)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = u[::100] @ u.T
        s[np.arange(len(s)), np.arange(0, n, 100)] = -2
        best = np.argsort(-s, axis=1)[:, :3]
        recall = np.mean([len(got[100 * i] & set(b.tolist())) / 3 for i, b in enumerate(best)])
        assert recall >= 0.95, (n, recall)
