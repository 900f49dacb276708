"""Folding holds few texts at a time."""

import tracemalloc

import pyarrow as pa

from tidemark.functions import udf as U


def test_folding_holds_a_batch_once_more_and_no_list_of_it():
    texts = pa.array([("é" + "ab" * 5000)] * 2000 + [None, "", "ABC"])
    tracemalloc.start()
    out = U.fold_any.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6
    assert out[0].as_py() == "e" + "ab" * 5000 and out.slice(2000).to_pylist() == [None, "", "abc"]
