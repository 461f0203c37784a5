import weakref

import pyarrow as pa

from skinnyla.llm.common import batches, per_worker


class Kept:
    pass


def test_what_a_worker_keeps_goes_when_another_function_reads():
    def rows():
        return iter([pa.RecordBatch.from_pydict({"x": [1, 2]})] * 2)

    kept = weakref.ref(per_worker("kept", 1, Kept))
    assert len(list(batches(rows()))) == 2 and kept() is not None  # another task of the same function finds it again
    assert per_worker("kept", 1, Kept) is kept()
    assert not list(batches(iter([]))) and kept() is not None
    assert len(list(batches(rows()))) == 2 and kept() is None
