import pickle

import numpy as np
import pyarrow as pa

from fieldtally.llm import jaccard, sketch
from fieldtally.llm.text import map_arrow

TEXTS = ["one two three four five six", "one two three four five", "", None, "seven eight nine ten eleven"]


def keys_frame(spark, values):
    return spark.createDataFrame([(int(v),) for v in values], "key long").repartition(5)


def test_tables_of_cells_stay_out_of_the_driver(spark):
    """What goes to tasks is a folder's name, and tasks find the bits there."""
    values = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 3000)
    many = np.concatenate([values, values[:1000], *[values[:10]] * 20])

    def cells(batches):
        for batch in batches:
            yield sketch.cell_rows(batch.column(0).to_numpy().view(np.uint64), 28)

    found = sketch.gather(map_arrow(keys_frame(spark, many), cells, sketch.CELLS), 28, 15)
    known = sketch.key_filter(keys_frame(spark, values[:500]), 26)

    def ask(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            flags = [found.again(own.view(np.uint64)), found.very_often(own.view(np.uint64)), known.has(own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, flags)], ["key", "again", "often", "known"])

    got = map_arrow(keys_frame(spark, values), ask, "key long, again boolean, often boolean, known boolean").collect()
    place = {int(v): k for k, v in enumerate(values)}
    assert {place[r.key] for r in got if r.again} == set(range(1000))
    assert {place[r.key] for r in got if r.often} == set(range(10))
    assert set(range(500)) <= {place[r.key] for r in got if r.known} and sum(r.known for r in got) < 510
    order = jaccard.count_sketch(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    assert all(len(pickle.dumps(x)) < 1000 for x in (found, known, order))
    assert order.empty == (1 << order.bits) - 3


def test_tables_of_no_keys(spark):
    none = keys_frame(spark, [1]).where("key > 1")
    assert not sketch.key_filter(none, 24).has(np.arange(5)).any()
    empty = sketch.gather(map_arrow(none, lambda batches: iter(()), sketch.CELLS), 16, 1)
    assert not empty.some_hot and not empty.again(np.arange(5, dtype=np.uint64)).any()
