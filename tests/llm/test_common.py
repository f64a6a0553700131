"""Memory of the driver and of the workers."""

import gc
import weakref

import pyarrow as pa

from lorekeep.llm import bpe, common, quality, queries


def test_driver_gives_memory_back(spark):
    """The JVM here has the command, and release() uses it."""
    assert common.trim(spark) is True
    common.release(spark)


class Frame:
    """Takes down what a worker would run."""

    def __getattr__(self, name):
        return lambda *args: self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def test_a_worker_keeps_things_of_one_operator(spark):
    """A worker that has encoded texts lets go of the tokens and of its memo of pieces when it counts n-grams."""
    ranks, pattern = queries.bpe_vocabulary()
    assert bpe.codec(ranks, pattern) is bpe.codec(ranks, pattern)
    codec = weakref.ref(bpe.codec(ranks, pattern))
    frame = Frame()
    quality.counts(frame)
    assert sum(sum(b.column(1).to_pylist()) for b in frame.run([pa.RecordBatch.from_pydict({"text": ["some words"]})])) == 10
    gc.collect()
    assert codec() is None
