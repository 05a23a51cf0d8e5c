"""Near-duplicates by signatures, centroids by kd-trees, and the audit of sources: parts and edge cases against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import centroids, divergence, minhash, near_join, shingles


def grams(text, words):
    w = text.encode().lower().split()
    return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def components(rows, words, percent):
    """By all pairs; rows: (id, text) with ids that differ."""
    own = {i: grams(t or "", words) for i, t in rows}
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in own:
        for b in own:
            both = len(own[a] & own[b])
            if a < b and both and 100 * both >= percent * (len(own[a]) + len(own[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(own[i]), find(i)) for i in own}


def near(spark, rows, words=2, percent=80, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_groups(df, words, percent, **more).collect()}


def near_rows(seed=1, n=160):
    """Texts of few words, chains of edits, a passage in most of them and a large group of near copies."""
    draw = random.Random(seed)
    word = lambda: f"w{int(draw.paretovariate(0.6)) % 900}"
    passage = [f"p{k}" for k in range(25)]
    texts = [" ".join(word() for _ in range(draw.choice([0, 1, 2, 3, 5, 9, 40]))) for _ in range(n // 4)]
    texts += [" ".join(passage + [word() for _ in range(draw.choice([3, 6, 30]))]) for _ in range(n // 4)]
    base = [word() for _ in range(60)]
    for _ in range(n // 2):
        if draw.random() < 0.1:
            base = base[:]
            base[draw.randrange(60)] = word()
        edited = base[:]
        for _ in range(draw.randrange(4)):
            edited[draw.randrange(60)] = word()
        texts.append(" ".join(edited).upper() if draw.random() < 0.2 else "\t".join(edited))
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("small, block, pivots, hot", [(16, 120, 64, 5000), (2, 8, 4, 20)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, small, block, pivots, hot):
    for name, value in (("SMALL", small), ("BLOCK", block), ("PIVOTS", pivots), ("HOT", hot)):
        monkeypatch.setattr(near_join, name, value)
    rows = near_rows()
    assert near(spark, rows) == components(rows, 2, 80)


def test_the_least_similar_linked_pair_and_the_first_that_is_not(spark):
    a = " ".join(f"x{k}" for k in range(10))  # 9 shingles
    linked = " ".join(f"x{k}" for k in range(9))  # 8 of 9
    apart = " ".join(f"x{k}" for k in range(8))  # 7 of 9
    rows = [(1, a), (2, linked), (3, apart + " y z")]
    assert near(spark, rows) == components(rows, 2, 80)
    assert near(spark, rows)[2] == (8, 1)


def test_signatures_do_not_depend_on_neighbours():
    sets = list(shingles.sets(__import__("pyarrow").array([" ".join(f"a{k}" for k in range(n)) for n in (1, 5, 70_000, 40)]), 2))
    whole = minhash.signatures(sets)
    assert all((minhash.signatures([s])[0] == w).all() for s, w in zip(sets, whole, strict=True))


def test_collisions_follow_the_similarity():
    draw = np.random.default_rng(5)
    hits = []
    for _ in range(200):
        x = draw.integers(0, 2**64, 36, dtype=np.uint64)
        sig = minhash.signatures([np.sort(x[:32]), np.sort(x[4:])])  # 28 of 36
        hits.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(hits) - 28 / 36) < 0.01
    assert np.std(hits) < 1.3 * np.sqrt(28 / 36 * 8 / 36 / minhash.COORDINATES)


def test_threshold_misses_one_in_ten_thousand_millions():
    from math import comb

    t, k = minhash.threshold(80), minhash.COORDINATES
    assert sum(comb(k, i) * 0.8**i * 0.2 ** (k - i) for i in range(t)) <= minhash.MISS < sum(comb(k, i) * 0.8**i * 0.2 ** (k - i) for i in range(t + 1))
    assert minhash.threshold(100) == k


def test_near_edge_cases(spark):
    same = "one two three four five six"
    rows = [(5, same), (3, same), (None, same), (7, None), (8, ""), (9, " \n"), (10, "word"), (11, "WORD"), (12, "two words"), (3, same)]
    got = near(spark, rows)
    assert got[5] == got[3] == (5, 3) and got[10] == got[11] == (1, 10) and got[12] == (1, 12)
    assert got[7] == (0, 7) and got[8] == (0, 8) and got[9] == (0, 9) and got[None] == (5, None)
    assert near(spark, []) == {}


def test_near_copies_go_and_others_keep_their_columns(spark):
    same = " ".join(f"x{k}" for k in range(40))
    rows = [(1, same, "a", 1), (2, same + " y", "b", 2), (None, same, "c", 3), (4, "else", "d", 4), (4, "another", "e", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, n int")
    kept = minhash.drop_near_copies(df, 2, 80)
    assert kept.columns == df.columns
    assert sorted(r["n"] for r in kept.collect()) == [1, 3, 4, 5]


def lloyd(vectors, k, rounds):
    """(assignment, centroids) by plain loops over exact integers; vectors: (id, list of floats)."""
    import math

    q = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    z = [v for _, _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v, v) for i, v in q)][:k]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        own = [(i, *min((far(v, c), n) for n, c in enumerate(z))) for i, v in q]
        if turn < rounds:
            for n in range(len(z)):
                mine = [v for (_, _, m), (_, v) in zip(own, q, strict=True) if m == n]
                if mine:
                    z[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted((i, n, d) for i, d, n in own), z


def clustered(spark, rows, k=40, rounds=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = centroids.cluster(df, k, rounds)
    return sorted(tuple(r) for r in found.assigned.collect()), found.centroids


def test_clusters_are_those_of_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(centroids, "TREE_ROWS", 64)
    monkeypatch.setattr(centroids, "LEAF_ROWS", 4)
    draw = np.random.default_rng(3)
    middle = draw.normal(size=(9, 64))
    rows = [(i, (middle[i % 9] + draw.normal(scale=0.02, size=64)).astype("float32").tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)]  # one vector very often
    assert clustered(spark, rows, 12, 4) == lloyd(rows, 12, 4)


def test_cluster_ties_and_edge_cases(spark):
    unit = lambda *at: [1.0 if k in at else 0.0 for k in range(64)]
    rows = [(i, unit(i % 3)) for i in range(12)] + [(3, unit(0))]
    rows += [(20, None), (21, []), (22, [1.0] * 63), (23, [None] + [1.0] * 63), (24, [float("nan")] * 64), (25, [float("inf")] * 64), (26, [float("-inf")] + [0.0] * 63)]
    got = clustered(spark, rows)
    assert got == lloyd(rows, 40, 5)
    assert len(got[1]) == 13 and len(got[0]) == 13
    assert clustered(spark, []) == ([], [])
    with pytest.raises(Exception, match="beyond 2"):
        clustered(spark, [(1, [2.0**30] * 64)])


def test_trees_prune_and_assign_whole_nodes():
    draw = np.random.default_rng(4)
    middle = draw.integers(-200, 200, (8, 64))
    points = middle[np.arange(2000) % 8] + draw.integers(-3, 4, (2000, 64))
    tree, order = centroids.build(points)
    assert (tree.points == points[order]).all() and sorted(order) == list(range(2000))
    assert (tree.total[0] == points.sum(0)).all()
    whole, seen = 0, np.zeros(2000, int)
    for node, own, far in centroids.filtered(tree, middle):
        rows = slice(tree.start[node], tree.stop[node])
        seen[rows] += 1
        d = centroids.distances(tree.points[rows], middle)
        assert (d.argmin(1) == own).all() and (far is None or (d.min(1) == far).all())
        whole += (far is None) * (tree.stop[node] - tree.start[node])
    assert (seen == 1).all() and whole == 2000


def test_distances_are_exact_beyond_doubles():
    p = np.array([[2**28, 1, -(2**28)]], np.int64)
    assert centroids.distances(p, np.array([[-(2**28), 0, 2**28]], np.int64))[0, 0] == 2 * (2**29) ** 2 + 1


def plain_audit(rows, least, top):
    """rows: (lang, source, text)."""
    import re

    rows = [tuple(x or "" for x in r) for r in rows]
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(a, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(upper))) for a, s, t in rows]
    out = []
    for lang in sorted({a for a, _, _ in words}):
        df = Counter(w for a, _, ws in words if a == lang for w in set(ws))
        kept = [w for w, n in df.items() if n >= least]
        n = {s: Counter() for a, s, _ in words if a == lang}
        for a, s, ws in words:
            if a == lang:
                n[s].update(w for w in ws if df[w] >= least)
        everything = sum(n.values(), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        of, q = {s: p(c) for s, c in n.items()}, p(everything)
        for s in n:
            pair = sorted(((-sum(abs(of[s][w] - of[b][w]) for w in kept), b.encode(), b) for b in n if b != s))
            out += [(lang, s, "pair", b, -v, k) for k, (v, _, b) in enumerate(pair, 1)]
            term = sorted((q[w] - of[s][w], w.encode(), w) for w in kept if n[s][w] and of[s][w] > q[w])[:top]
            out += [(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(term, 1)]
    return sorted(out)


def audited(spark, rows, least, top):
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, term int")
    return sorted(tuple(r) for r in divergence.audit(df, least, top).collect())


def test_audit_is_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 40)
    draw = random.Random(8)
    word = lambda: draw.choice(["Ä", "é", "x", "日本", "tie", "toe"]) + "abcdefghijk"[int(draw.paretovariate(0.7)) % 11] * draw.randrange(1, 4)
    rows = [(draw.choice(["en", "de", None]), draw.choice(["s", "t", "ü", "", None]), " ".join(word() for _ in range(draw.randrange(60))).upper()) for _ in range(150)]
    rows += [("fr", "only", "a b"), ("es", "a", None), ("es", "b", "123 -- ?")] + rows[:10]
    for top in (1, 3, 7, 1000):
        assert audited(spark, rows, 4, top) == plain_audit(rows, 4, top)
    assert audited(spark, [], 4, 5) == []


def test_top_rows_refine_ties_by_bytes(spark):
    rows = [("g", f"{'long' * 5}{k:03d}", 7) for k in range(200)] + [("g", "z", 8), ("g", "a", 6), ("h", "é", 1 << 55), ("h", "z", 1 << 55), ("h", "zz", 1 << 55), ("i", "only", 0)]
    draw = random.Random(2)
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, item string, value long")
    for k in (1, 2, 57, 500):
        want = []
        for g in "ghi":
            want += sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:k]
        assert sorted(tuple(r) for r in divergence.top_rows(df, ["g"], k).collect()) == sorted(want)


def test_terms_of_every_script():
    assert divergence.terms("Ab-c\x00ÄÖ_d9e 日本、x y") == ["ab".encode(), b"c", "ÄÖ".encode(), b"d", b"e", "日本、x y".encode()]
