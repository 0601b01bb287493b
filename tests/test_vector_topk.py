"""The nearest vectors of a store against all pairs, where many are equally near and partitions have many batches."""

import numpy as np
import pytest

from fathomline.operators.vectors import topk


@pytest.mark.parametrize("k", [1, 3, 40])
def test_copies_and_many_batches(spark, k):
    rng = np.random.default_rng(5)
    own = rng.normal(size=(300, 6))
    own[100:200] = own[0]  # a third are copies
    own[250:] = -own[:50]
    store = [(f"v{i:03d}", own[i].tolist()) for i in rng.permutation(300)] + [("null", None), ("short", [1.0]), ("zero", [0.0] * 6)]
    asked = [(i, own[i].tolist()) for i in (0, 7, 150, 260)]
    unit = {n: np.array(v) / (np.linalg.norm(v) or 1) for n, v in store if v and len(v) == 6}
    want = []
    for qid, vec in asked:
        q = np.array(vec) / np.linalg.norm(vec)
        order = sorted(unit, key=lambda n: (-round(float(q @ unit[n]), 9), n))[:k]
        want += [(qid, rank, n) for rank, n in enumerate(order)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        frame = spark.createDataFrame(store, "id string, vec array<double>").repartition(2)
        got = topk(frame, spark.createDataFrame(asked, "qid int, vec array<double>"), k).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.qid, r.rank, r.id) for r in got) == want
