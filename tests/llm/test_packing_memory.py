"""Memory of a packing task, whose Python workers share an executor with Spark's own heap."""

from __future__ import annotations

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from lodestone.llm import packing


def test_packing_task_holds_its_ids_once(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(20000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 4000))) for _ in range(1200)]
    batches = [pa.record_batch({"doc_id": np.arange(i, min(i + 100, 1200)), "text": texts[i : i + 100]}) for i in range(0, 1200, 100)]
    encoder = packing.Encoder()
    tracemalloc.start()
    seen = {}
    for batch in packing._local(2048, 0, None, True)(iter(batches)):
        for doc, piece, start, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "piece", "start", "ids"))):
            seen[doc, piece] = (start, told(ids))
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    for doc in range(0, 1200, 97):
        whole = np.append(encoder.encode(pa.array([texts[doc]]))[0], 0)
        got = [seen[k] for k in sorted(k for k in seen if k[0] == doc)]
        assert [g[0] for g in got] == list(range(0, len(whole), 2048))
        assert [g[1] for g in got] == [told(whole[i : i + 2048].astype("<u4").tobytes()) for i in range(0, len(whole), 2048)]
    assert peak < 80, peak


def told(ids: bytes) -> tuple[int, int]:
    return len(ids), hash(ids)
