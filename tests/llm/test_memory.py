"""What a Python worker holds is bounded by stated sizes, however large the batches that reach it."""

import pickle
import tracemalloc

import numpy as np
import pyarrow as pa

from fathom.llm import common, shingles, toxicity


def test_large_batches_are_worked_on_in_parts():
    texts = [f"{k} " * (200 + k % 7 * 300) for k in range(4000)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(texts)], names=["doc_id", "text"])
    assert whole.nbytes > 4 * common.WORK_BYTES
    parts = list(common.frugal(iter([whole, whole.slice(0, 0), whole.slice(0, 1)])))
    assert pa.Table.from_batches(parts[:-1]).combine_chunks().equals(pa.Table.from_batches([whole])) and parts[-1].num_rows == 1
    assert max(p.nbytes for p in parts) < 1.5 * common.WORK_BYTES
    long = pa.RecordBatch.from_arrays([pa.array(["x" * (9 << 20), "y", None])], names=["text"])
    assert [p.to_pylist() for p in common.frugal(iter([long]))] == [[r] for r in long.to_pylist()]


def test_a_model_travels_without_its_zeros():
    weights = np.zeros(1 << toxicity.HASH_BITS, dtype=np.float32)
    texts = pa.array(["one two three", "two", None, ""])
    at = np.unique(np.concatenate([f for *_, f in toxicity._features(texts)]))
    weights[at] = np.linspace(0.1, 1, len(at))
    model = toxicity.Model(weights, -0.5)
    packed = pickle.dumps(model)
    again = pickle.loads(packed)
    assert len(packed) < 10_000
    np.testing.assert_array_equal(again.weights, weights)
    np.testing.assert_array_equal(again.scores(texts), model.scores(texts))


def test_hashing_holds_little_beside_the_texts():
    texts = pa.array(["some words of a text " * 400] * 250)  # 2 MB
    model = toxicity.Model(np.zeros(1 << toxicity.HASH_BITS, dtype=np.float32), 0.0)
    model.weights[::7] = 1
    for work in (lambda: model.scores(texts), lambda: [len(own) for _, own in shingles.row_sets(texts)]):
        shingles._powers.clear()
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 32 << 20
