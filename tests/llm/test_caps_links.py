"""Spherical-cap filters on the given vectors, with near copies made of each of them."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import caps, graph
from lodestone.llm.store import Scratch

TABLE = "/root/testdata/sf0.1/embeddings.parquet"
#: Cosines of the copies with their vector: two links near the threshold, one well above, one no link.
COPIES = (0.85, 0.901, 0.91, 0.97)


@pytest.mark.skipif(not os.path.exists(TABLE), reason="needs the given tables")
def test_links_of_near_copies(spark):
    """Every vector's links against brute force: none is made up, and at least 99 % are found, right above the threshold too."""
    table = spark.read.parquet(TABLE)
    ids, x = (np.array(c) for c in zip(*[(r[0], r[1]) for r in table.select("vec_id", "embedding").orderBy("vec_id").collect()]))
    x = x.astype(np.float64)
    rng = np.random.default_rng(8)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [x]
    for cosine in COPIES:
        noise = rng.normal(size=x.shape)
        noise -= (noise * unit).sum(1, keepdims=True) * unit
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        rows.append((cosine * unit + np.sqrt(1 - cosine**2) * noise) * rng.uniform(0.5, 2, (len(x), 1)))
    vectors = np.concatenate(rows).astype(np.float32)
    names = np.concatenate([ids + k * (ids.max() + 1) for k in range(len(rows))])
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(names, vectors)], "vec_id long, embedding array<float>").repartition(6)
    got = {r["vec_id"]: r for r in caps.digest(df.withColumn("label", F.lit(1)), Scratch(spark, "test")).collect()}
    assert len(got) == len(names)

    u = vectors.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    links = near.sum(1)
    found = np.array([got[int(i)]["n_links"] for i in names])
    assert links.sum() >= 2 * 3 * len(x)  # three copies of each are links, both ways
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    # where all links of a component are found it is the right one
    forest = graph.Forest(len(names))
    for i, j in zip(*np.nonzero(np.triu(near))):
        forest.union(int(i), int(j))
    label = np.array([forest.find(i) for i in range(len(names))])
    whole = np.bincount(label, found != links, len(names))[label] == 0
    least = np.full(len(names), names.max())
    np.minimum.at(least, label, names)
    assert whole.mean() >= 0.97
    assert all(got[int(names[i])]["component_id"] == least[label[i]] for i in np.flatnonzero(whole))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    print(f"{len(names)} vectors, {links.sum() // 2} links, {found.sum() / links.sum():.4f} found")
