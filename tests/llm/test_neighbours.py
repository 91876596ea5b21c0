import numpy as np
import pytest

from conftest import rows
from forgeline.llm.neighbours import AdditiveQuantiser, mutual_neighbours, nearest_neighbours

S = "id string, e array<float>, h int"


def cluster_data(n=400, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, n)] + 0.15 * rng.standard_normal((n, 16))
    return (x * rng.uniform(0.5, 3, (n, 1))).astype(np.float32)


@pytest.mark.parametrize("first", [4096, 4])
def test_recall_against_brute_force(spark, first):
    """With the words of the first codebook as cells, and with pairs of words of the first two."""
    x = cluster_data()
    df = spark.createDataFrame([(f"{i:04}", v.tolist(), 1) for i, v in enumerate(x)], S)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u.astype(float) @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, 1)[:, :5]
    got = {}
    for r in nearest_neighbours(df, "id", "e", dim=16, sample=300, block=64, words=16, first=first).collect():
        got.setdefault(int(r.id_a), set()).add(int(r.id_b))
    assert all(len(v) <= 5 for v in got.values())
    assert np.mean([len(got.get(i, set()) & set(top[i])) / 5 for i in range(len(x))]) >= 0.9
    want = {(f"{min(i, j):04}", f"{max(i, j):04}") for i in range(len(x)) for j in top[i] if i in top[j] and s[i, j] >= 0.95}
    pairs = set(rows(mutual_neighbours(df, "id", "e", dim=16, sample=300, block=64, words=16, first=first)))
    assert len(want & pairs) >= 0.97 * len(want) and len(pairs - want) <= 0.02 * len(want)


def test_unusable_copies_and_empty(spark):
    x = cluster_data(60)
    bad = [("n", None, 1), ("z", [0.0] * 16, 1), ("s", [1.0] * 8, 1), ("q", [float("nan")] * 16, 1), ("m", [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1)]
    copies = [(f"c{i:02}", x[0].tolist(), 1) for i in range(20)]
    df = spark.createDataFrame([(f"v{i:02}", v.tolist(), 1) for i, v in enumerate(x[1:])] + copies + bad, S)
    r = nearest_neighbours(df, "id", "e", dim=16)
    lists = {}
    for t in r.orderBy("id_a", "rank").collect():
        lists.setdefault(t.id_a, []).append(t.id_b)
    assert not set(lists) & {"n", "z", "s", "q", "m"}
    assert lists["c15"] == ["c00", "c01", "c02", "c03", "c04"] and lists["c00"] == ["c01", "c02", "c03", "c04", "c05"]
    pairs = mutual_neighbours(df, "id", "e", dim=16).where("id_a like 'c%' and id_b like 'c%'").count()
    assert pairs == 15  # the six least ids know each other
    assert nearest_neighbours(df.limit(0), "id", "e", dim=16).count() == 0
    assert rows(nearest_neighbours(df, "id", "e", dim=16, queries="id = 'c15'").select("id_a").distinct()) == [("c15",)]


def test_beam_search_is_no_worse():
    x = cluster_data(500)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = AdditiveQuantiser.train(x, 16, levels=4, words=32)

    def error(beam):
        codes, norm = q.encode(x, beam)
        y = sum(b[codes[:, k]] for k, b in enumerate(q.books))
        assert np.allclose((y * y).sum(1), norm, atol=1e-4)
        return ((x - y) ** 2).sum()

    assert error(8) <= error(1)
