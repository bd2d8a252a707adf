"""What Python workers hold after the stage that needed it."""

import gc

import public_tokenizers
import pyarrow as pa

from fleetmill.llm import common, packing, simhash
from fleetmill.llm.queries import WORD_BPE


def test_workers_drop_the_tokenizer_when_another_stage_begins(spark):
    def tokenizers(batches):
        for _ in batches:
            found = sum(type(x).__name__ == "WordBpe" for x in gc.get_objects())
            yield pa.RecordBatch.from_pydict({"n": pa.array([found], pa.int64())})

    docs = spark.range(0, 64, 1, 64).selectExpr("id AS doc_id", "concat('a text of ', id) AS text")
    path = public_tokenizers.path(WORD_BPE)
    assert packing.pieces_of(docs, path, 2048).count() == 64
    # All workers get tasks of the next stage, and then of a plain one that only looks.
    assert simhash.fingerprints(docs).where("fp is not null").count() == 64
    held = docs.mapInArrow(tokenizers, "n bigint").collect()
    assert sum(x.n for x in held) == 0


def test_a_stage_makes_what_it_holds_once():
    made = []

    def make(name):
        made.append(name)
        return [name]

    class Frame:
        def mapInArrow(self, run, schema):  # noqa: N802
            return lambda: list(run(iter([])))

    def work(batches):
        yield common.held(make, "a")
        yield from batches

    first, second = (common.in_tasks(Frame(), work, "n bigint") for _ in range(2))
    assert [*first(), *first()] == [["a"], ["a"]] and made == ["a"]
    second()
    assert made == ["a", "a"]
    common._hold_for("")
    assert not common._held


def test_no_documents_pack_into_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_documents(docs, public_tokenizers.path(WORD_BPE)).count() == 0
