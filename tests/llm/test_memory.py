import os

import numpy as np
import pyarrow as pa

from nestql.llm import memory, textvec, tokens
from nestql.llm.store import Scratch, small_batches

from .helpers import frame


def test_own_tables_have_no_checksum_files(spark):
    """Each of them starts a process of its own (chmod)."""
    scratch, docs = Scratch(spark, "plain"), frame(spark)
    tables = {"written": scratch.write(docs, "written"), "bucketed": scratch.write_bucketed(docs, "bucketed", "doc_id", 4)}
    want = sorted(map(repr, docs.collect()))
    for name, table in tables.items():
        files = os.listdir(scratch.path(name).removeprefix("file:"))
        assert any(f.endswith(".parquet") for f in files) and not [f for f in files if f.endswith(".crc")]
        assert sorted(map(repr, table.collect())) == want
    scratch.close()


def _task(operator):
    def run(batches):
        textvec.powers(100_000)
        tokens._LOADED["path", "kind"] = None
        yield from batches

    run.__module__ = operator
    return memory.tidy(run)


def test_a_task_of_another_operator_lets_go():
    loaded = tokens._LOADED
    before, batch = dict(loaded), pa.record_batch({"x": [1]})
    list(_task("one")([batch]))
    assert loaded.keys() >= {("path", "kind")} and len(textvec._POWERS[0]) >= 100_000
    memory._begin("one")  # the next task of the operator finds them
    assert ("path", "kind") in loaded and len(textvec._POWERS[0]) >= 100_000
    memory._begin("two")
    assert not loaded and len(textvec._POWERS[0]) == 1
    loaded.update(before)


def test_powers_take_no_more_than_they_need():
    textvec._forget()
    some, inverse = textvec.powers((1 << 20) + 1)
    assert len(textvec._POWERS[0]) < 1.1 * (1 << 20) and len(some) == (1 << 20) + 1
    assert (some * inverse == np.uint64(1)).all()


def test_batches_that_are_read_are_small(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    session = spark.newSession()
    small_batches(session)
    assert session.conf.get(name) == "512"
    session.conf.set(name, "100")
    small_batches(session)
    assert session.conf.get(name) == "100"
