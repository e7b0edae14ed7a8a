"""Operators 11 to 13 against brute force, and on odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, clustering, vectors, whitening
from tests.llm import odd

# Clusters


def brute_clusters(rows, clusters, rounds, seed=3):
    """``{(vec_id, vector): (cluster, distance)}, centroids`` by plain integers."""
    scale = lambda v: [math.floor(1024 * float(x)) for x in v]
    kept = [(i, tuple(v), scale(v)) for i, v in rows]
    hashed = sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v, x) for i, v, x in kept if i is not None))[:clusters]
    centroids = [x for _, _, x in hashed]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(x)[1] for _, _, x in kept]
        for j in range(len(centroids)):
            members = [x for (_, _, x), k in zip(kept, of) if k == j]
            if members:
                centroids[j] = [sum(c) // len(members) for c in zip(*members)]
    return sorted(((i is None, i or 0, near(x)[1], min(near(x)[0], clustering.LONG)) for i, _, x in kept)), centroids


def table(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"id long, e array<{kind}>").withColumns({"vec_id": F.lit("x"), "v": F.lit(1), "cluster": F.lit(2), "slot": F.lit(3)})


def compare_clusters(spark, rows, clusters, rounds, dimensions):
    found = clustering.cluster(table(spark, rows), "id", "e", clusters, rounds, dimensions).collect()
    wanted, centroids = brute_clusters(rows, clusters, rounds)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in found) == wanted
    inertia = {}
    for _, _, j, d in wanted:
        inertia[j] = inertia.get(j, 0) + d
    for r in found:
        assert r.cluster_inertia == min(inertia[r.cluster], clustering.LONG) and r.inertia == min(sum(inertia.values()), clustering.LONG)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


@pytest.mark.parametrize("clusters, rounds, spread", [(1, 3, 1.0), (2, 4, 1.0), (8, 10, 1.0), (30, 6, 0.004), (8, 10, 0.0)])
def test_clusters_equal_brute_force(spark, clusters, rounds, spread):
    """Small spreads make distances tie often; equal vectors tie always."""
    random = np.random.default_rng(clusters)
    centres = random.normal(size=(5, 6))
    rows = [(i, [float(x) for x in centres[i % 5] * (spread > 0.1) + spread * random.normal(size=6)]) for i in range(250)]
    compare_clusters(spark, rows, clusters, rounds, 6)


def test_clusters_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [3.0, 2.0]), (None, [5.0, 5.0]), (2, [0.0, 0.0]), (3, [-1e300, 1e9]), (4, [1e300, -4.0]), (5, [7.0, 7.0]), (6, [1e12, 1e12])]
    left_out = [(7, None), (8, []), (9, [1.0]), (10, [1.0, None]), (11, [float("nan"), 1.0]), (12, [float("inf"), 1.0]), (13, [1.0, 2.0, 3.0])]
    found = clustering.cluster(table(spark, rows + left_out), "id", "e", 3, 5, 2).collect()
    wanted, _ = brute_clusters(rows, 3, 5)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in found) == wanted
    assert clustering.cluster(table(spark, left_out), "id", "e", 3, 5, 2).collect() == []
    assert len(clustering.cluster(odd.vectors(spark), "id", "e", 4, 3, 3).collect()) == 11
    names = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    for empty in (False, True):
        assert ", ".join(" ".join(t) for t in clustering.cluster(odd.vectors(spark, empty), "id", "e", dimensions=3).dtypes) == names
    # Products beyond a double's range are cut to it.
    assert clustering.cluster(table(spark, [(1, [1.7e308, 0.0]), (2, [-1.7e308, 0.0])]), "id", "e", 1, 2, 2).count() == 2


def test_search_computes_few_distances():
    """On a line of centroids the ball lets few through, and bounds hold while centroids move little."""
    random = np.random.default_rng(5)
    centres = np.stack([np.arange(40) * 1000, np.zeros(40)], 1).astype(np.int64)
    points = centres[random.integers(0, 40, 4000)] + random.integers(-300, 300, (4000, 2))
    bounds, _ = clustering.assign(points, clustering.Bounds.unknown(len(points)), clustering.Centroids.of(centres))
    moved = centres[np.random.default_rng(1).permutation(40)]
    shuffled, all_new = clustering.assign(points, bounds, clustering.Centroids.of(moved, centres))
    assert all_new < 0.8 * 40 * len(points) and (moved[shuffled.first] == centres[bounds.first]).all()
    near, few = clustering.assign(points, bounds, clustering.Centroids.of(centres + 5, centres))
    assert few < 0.1 * len(points) and (near.first == bounds.first).all()


def test_large_integers_survive_limbs():
    values = {0: 5, 1: -(10**40), 2: 2**63, 3: -1, 4: 10**320}
    rows = list(zip(*vectors.limbs(values)))
    assert vectors.from_limbs(rows) == values and all(abs(v) < 2**32 for _, _, v in rows)


# Whitening


def brute_whitening(vectors, k):
    x = np.floor(1024 * np.array(vectors)) + 100_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return ((n * x - sums) ** 2).sum(1), centred @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("n, d, k, kind", [(300, 12, 8, "flat"), (200, 40, 8, "steep"), (50, 5, 8, "flat"), (30, 60, 8, "flat"), (400, 10, 3, "steep")])
def test_whitening_equals_eigenvectors(spark, n, d, k, kind):
    random = np.random.default_rng(d)
    rows = random.normal(size=(n, d)) * (1 + np.arange(d)[::-1] if kind == "flat" else 3.0 ** -np.arange(d) * 50)
    if kind == "steep":
        rows = rows @ np.linalg.qr(random.normal(size=(d, d)))[0]
    found = whitening.whiten(table(spark, [(i, r.tolist()) for i, r in enumerate(rows)]), "id", "e", k).orderBy("vec_id", "component").toPandas()
    k = min(k, d)
    deviation, whitened, explained = brute_whitening(rows, k)
    got = found.whitened.to_numpy().reshape(n, k)
    assert np.abs(got * np.sign((got * whitened).sum(0)) - whitened).max() < 1e-8
    assert (found.deviation.to_numpy()[::k] == deviation.astype(np.int64)).all() and (found.n == n).all()
    assert np.abs(found.explained.to_numpy()[:k] / explained - 1).max() < 1e-9 and found.identity_error.max() < 1e-9


def test_repeated_deviations_are_all_found(spark):
    """Four directions of the same deviation: a single Krylov space shows one of them."""
    rows = [[s * 4.0 * (j == i) for j in range(6)] for i in range(4) for s in (-1, 1)] + [[0.0] * 4 + [s, 0.0] for s in (-1.0, 1.0)]
    found = whitening.whiten(table(spark, list(enumerate(rows))), "id", "e").toPandas()
    shares = found.groupby("component").explained.first().tolist()
    assert np.allclose(shares, [16 / 65] * 4 + [1 / 65]) and found.identity_error.max() < 1e-9


def test_whitening_of_odd_rows(spark):
    assert whitening.whiten(odd.vectors(spark, empty=True), "id", "e").count() == 0
    found = whitening.whiten(odd.vectors(spark), "id", "e").toPandas()
    # Eleven usable vectors have three entries; the two of two are fewer.
    assert len(found) == 33 and (found.n == 11).all() and found.vec_id.isna().sum() == 3 and found.identity_error.max() < 1e-9
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]), "id", "e").count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])]), "id", "e").count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])]), "id", "e").count() == 0
    huge = whitening.whiten(table(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 5.0])]), "id", "e").toPandas()
    assert huge.deviation.max() == whitening.LONG and np.isfinite(huge.whitened).all()


def test_deviations_are_exact_beyond_doubles():
    x = np.array([[3 * 10**9, 7], [1, 100_003], [5, 11]], np.int64)
    centre = whitening.Centre(3, [int(s) for s in x.sum(0)])
    wanted = [min(whitening.LONG, sum((3 * int(a) - int(s)) ** 2 for a, s in zip(row, centre.sums))) for row in x]
    assert centre.deviations(x) == wanted


# Chat


def brute_windows(turns, budget, history, stretch):
    """``(n_repeated, turns)`` of each window of one conversation of ``(turn, role, text)``."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", len((t[2] or "").encode())))
    items, at = [], 0
    for _, role, text in turns:
        role, text = role or "", text or ""
        tokens = -(-len(text.encode()) // 4) + -(-len(role.encode()) // 4) + chat.MARK_TOKENS
        items.append((at, at + tokens, role, text))
        at += tokens
    system = items[:1] if items[0][2] == "system" else []
    others = items[len(system) :]
    room = max(budget - sum(e - b for b, e, *_ in system), budget // 4)
    reach = min(history, room // 2)
    starts, until, own = [], -1, None
    for b, e, *_ in others:
        if e > until or b // stretch != own:
            past = [x[0] for x in others if b - reach <= x[0] < b]
            starts.append(b)
            until = b + room - (b - past[0] if past else 0)
        own = b // stretch
    out = []
    for i, s in enumerate(starts):
        after = starts[i + 1] if i + 1 < len(starts) else 1 << 60
        past = [x for x in others if s - reach <= x[0] < s]
        out.append((len(past) + (len(system) if i else 0), [x[2:] for x in system + past + [x for x in others if s <= x[0] < after]]))
    return out or [(0, [x[2:] for x in system])]


TEXTS = ["", "ok", "\\### Assistant: </turn> ok", "<turn>", "\\", "\\\\<turn", "</role>\\</role>", "<\\turn> <turnip </roles>\n", "é́ 你好 \U0001f600 " * 9, "a word " * 60, "$1 \\1 {x}", "x" * 3000]


def conversations():
    draw = random.Random(4)
    rows = []
    for conv in range(40):
        for turn in range(draw.choice([1, 2, 5, 9, 30])):
            role = "system" if turn == 0 and draw.random() < 0.4 else draw.choice(["user", "assistant", "assistant", "<turn>", "system", None])
            rows.append((conv, turn, role, draw.choice([*TEXTS, None])))
    rows += [(None, 0, "user", "hello"), (None, None, "assistant", "first"), (50, 3, "assistant", "same")] + [(50, 3, "assistant", "same")] * 400
    return rows


@pytest.mark.parametrize("budget, history", [(64, 30), (1024, 256), (200, 0), (16, 100)])
def test_windows_equal_brute_force(spark, budget, history):
    """With small budgets most conversations are longer than a stretch."""
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "c long, n long, r string, t string, text string, window long, before long")
    windows = chat.format_windows(df, "c", "n", "r", "t", budget, history)
    found = {}
    for w in windows.orderBy("window").collect():
        turns = [tuple(x.split("</role>")) for x in w.text.replace("</turn>", "").split("<turn>")[1:]]
        plain = [tuple(unescape(x) for x in t) for t in turns]
        found.setdefault(w.conv_id, []).append((w.n_repeated, plain))
        assert len(plain) == w.n_turns
        new = plain[w.n_repeated :]
        assert [unescape(w.text[s.start : s.end]) for s in w.loss] == [t for r, t in new if r == "assistant"]
        assert w.tokens <= budget or len(new) == 1 or turns[0][0] == "system"
    by_conv = {}
    for c, *turn in rows:
        by_conv.setdefault(c, []).append(turn)
    assert found == {c: brute_windows(t, budget, min(history, budget), chat.STRETCH * budget) for c, t in by_conv.items()}

    facts = {r.conv_id: r for r in chat.digests(windows).collect()}
    for c, turns in by_conv.items():
        turns = [x for n, w in brute_windows(turns, budget, min(history, budget), chat.STRETCH * budget) for x in w[n:]]
        learnt = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (facts[c].n_turns, facts[c].turns_sha256, facts[c].loss_chars, facts[c].loss_sha256) == (len(turns), sha(said), len(learnt), sha(learnt))


def unescape(text):
    out, i = [], 0
    while i < len(text):
        i += text[i] == "\\"
        out.append(text[i])
        i += 1
    return "".join(out)


def test_chat_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "c long, n long, r string, t string")
    assert chat.digests(chat.format_windows(empty, "c", "n", "r", "t")).count() == 0


def test_chat_uses_no_python_workers(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x")], "c long, n long, r string, t string")
    plan = chat.digests(chat.format_windows(rows, "c", "n", "r", "t"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
