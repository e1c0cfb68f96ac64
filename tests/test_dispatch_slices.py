"""How many calls are Python objects at once."""

from __future__ import annotations

import pyarrow as pa

from confabula.operators import dispatch


def test_a_large_batch_is_taken_in_slices():
    batches = [pa.record_batch({"x": list(range(n))}) for n in (0, 1, 5000)]
    got = list(dispatch.slices(iter(batches)))
    assert [x for b in got for x in b.column("x").to_pylist()] == [x for b in batches for x in b.column("x").to_pylist()]
    assert max(b.num_rows for b in got) == dispatch.AT_A_TIME < 5000
