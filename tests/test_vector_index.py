import time

import numpy as np
import pandas as pd
import pytest

from tablewright.operators import neighbors, vector_index


def frames(spark, x, q):
    train = spark.createDataFrame([(i, [float(a) for a in v], int(i % 3)) for i, v in enumerate(x)], "id long, vector array<double>, label int")
    test = spark.createDataFrame([(10_000 + i, [float(a) for a in v]) for i, v in enumerate(q)], "id long, vector array<double>")
    return train, test


def brute(x, q, k):
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    return {(10_000 + i, int(j)) for i, row in enumerate(d) for j in row.argsort(kind="stable")[:k]}


@pytest.mark.parametrize("block_rows", [2_048, 30])
def test_clustered_rows_are_found_in_few_cells(spark, monkeypatch, block_rows):
    monkeypatch.setattr(vector_index, "CELL_ROWS", 16)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 20)
    random = np.random.RandomState(1)
    centres = random.normal(size=(40, 8)) * 5
    x = centres[random.randint(40, size=2_000)] + random.normal(size=(2_000, 8))
    q = centres[random.randint(40, size=60)] + random.normal(size=(60, 8))
    found = vector_index.index_neighbours(*frames(spark, x, q), k=5, candidates=480, block_rows=block_rows).collect()
    want = brute(x, q, 5)
    assert len({(r.test_id, r.train_id) for r in found} & want) >= 0.95 * len(want)
    assert len(found) == 300 and {r.place for r in found} == {1, 2, 3, 4, 5}
    for r in found[:40]:
        assert r.distance == pytest.approx(np.sqrt(((x[r.train_id] - q[r.test_id - 10_000]) ** 2).sum()))


def test_small_tables_are_exact(spark):
    random = np.random.RandomState(2)
    x = np.concatenate([random.normal(size=(100, 3)), np.zeros((40, 3))])  # equal rows: ties by id
    train, test = frames(spark, x, random.normal(size=(20, 3)) * [[0.1, 0.1, 0.1]])
    key = lambda df: sorted((r.test_id, r.place, r.train_id) for r in df.collect())
    assert key(vector_index.index_neighbours(train, test)) == key(neighbors.nearest_neighbours(train, test))
    assert neighbors.knn_classify(train, test, exact=False).count() == 20
    one, few = frames(spark, x[:1], x[:2])
    assert vector_index.index_neighbours(one, few).count() == 2
    with pytest.raises(ValueError):
        vector_index.index_neighbours(train.limit(0), test)


def test_rows_without_clusters_are_found(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "CELL_ROWS", 16)
    random = np.random.RandomState(3)
    x, q = random.normal(size=(2_500, 32)), random.normal(size=(40, 32))
    found = vector_index.index_neighbours(*frames(spark, x, q), k=5, candidates=160).collect()
    want = brute(x, q, 5)
    assert len({(r.test_id, r.train_id) for r in found} & want) >= 0.95 * len(want)


@pytest.mark.parametrize("shape", ["far", "equal", "close", "nan"])
def test_products_leave_the_exact_neighbours(shape, monkeypatch):
    monkeypatch.setattr(neighbors, "PRODUCT_ROWS", 64)
    random = np.random.RandomState(6)
    x, q = random.normal(size=(500, 12)), random.normal(size=(70, 12))
    if shape == "far":  # from the origin, where single precision has no digits left
        x, q = 1e7 + x, 1e7 + q
    elif shape == "equal":
        x[100:300], q[:9] = x[0], x[0]
    elif shape == "close":
        x[:400] = x[0] + 1e-9 * random.normal(size=(400, 12))
    else:
        x[7, 3] = np.nan
    ids = random.permutation(500)
    left = pd.DataFrame({"train_id": ids, "vector": list(x), "label": ids % 3})
    out = neighbors._block_neighbours(5)(left, pd.DataFrame({"test_id": np.arange(70), "vector": list(q)}))
    by_id = x[ids.argsort()]
    d = np.sqrt(((q[:, None] - by_id[None]) ** 2).sum(2))
    want = [(i, int(j), d[i, j]) for i in range(70) for j in np.lexsort((np.arange(500), d[i]))[:5]]
    assert list(zip(out.test_id, out.train_id, out.distance)) == want


def test_a_block_is_compared_by_products():
    random = np.random.RandomState(7)
    x, q = random.normal(size=(16_384, 64)), random.normal(size=(1_024, 64))
    left, right = pd.DataFrame({"train_id": range(len(x)), "vector": list(x), "label": 0}), pd.DataFrame({"test_id": range(len(q)), "vector": list(q)})
    neighbors._block_neighbours(5)(left[:100], right[:10])
    start = time.process_time()
    neighbors._block_neighbours(5)(left, right)
    took = time.process_time() - start
    start = time.process_time()
    np.sqrt(((q[:64, None] - x[None, :2_048]) ** 2).sum(2))  # 1/128 of the pairs, one by one
    assert took < 64 * (time.process_time() - start)
