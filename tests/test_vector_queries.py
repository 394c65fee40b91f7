"""Vector searches of the whole query set against brute force."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.functions import vector as V
from citeloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name, k", [("vector_topk", 10), ("vector_topk_per_label", 3)])
def test_every_query_against_all_rows(spark, name, k):
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q in (i for i, r in enumerate(rows) if r["vec_id"] % 100 == 0):
        place = {}
        for i in sorted((i for i in range(len(rows)) if i != q), key=lambda i: (-(x[i] @ x[q]), rows[i]["vec_id"])):
            label = rows[i]["label"] if k == 3 else None
            place[label] = place.get(label, 0) + 1
            if place[label] <= k:
                want.add((rows[q]["vec_id"], rows[i]["vec_id"], place[label]))
    got = [(r.query_id, r.vec_id, r["rank"]) for r in QUERIES[name](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want and len({g[0] for g in got}) > 1


def test_rows_of_a_cell_are_met_step_by_step(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (90, 3)).astype(float)
    table = pa.table({"id": np.arange(90), "label": np.arange(90) // 40, "v": pa.array(x.tolist()), "_size": np.sqrt((x * x).sum(1))})
    for by in (None, "label"):
        whole = V._cell(table, table.slice(0, 9), "id", "v", 5, by)
        with monkeypatch.context() as m:
            m.setattr(V, "STEP", 7)
            m.setattr(V, "PAIRS", 11)
            parts = V._cell(table, table.slice(0, 9), "id", "v", 5, by)
        assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[0]) == 9 * 5 * (3 if by else 1)


def test_only_the_best_of_a_cell_leave_it(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (120, 3)).astype(float)  # many equal directions, some zeros
    vectors = [None if i % 31 == 7 else [1.0, None, 2.0] if i % 31 == 8 else [1.0, 2.0] if i % 31 == 9 else [float("nan"), 0.0, 1.0] if i % 31 == 10 else [1e200, 0.0, 1.0] if i % 31 == 11 else [float(c) for c in v] for i, v in enumerate(x)]
    rows = spark.createDataFrame([(i, v, None if i % 5 == 0 else i % 3) for i, v in enumerate(vectors)], "id long, v array<double>, label int")
    asked = rows.where("id % 6 < 2")
    pairs = rows.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), F.col("id") != F.col("query_id")).select("query_id", "id", "label", V.cosine(F.col("v"), F.col("q")).alias("score"))
    for k, by in ((4, None), (3, "label"), (300, None)):
        w = Window.partitionBy("query_id", *([by] if by else [])).orderBy(F.desc("score"), "id")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)  # noqa: B023, E731
        best = V.nearest(rows, asked, "id", "v", k, by)
        told = lambda df: {(r.query_id, r["rank"]) if not by else (r.query_id, r.label, r["rank"]): (r.id, str(r.score)) for r in ranked(df).collect()}  # noqa: B023, E731
        assert told(best) == told(pairs)
        slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert best.count() <= asked.count() * k * slices * (4 if by else 1)
