"""What workers hold once a task is over, and disks once a query is."""

import pyarrow as pa

from quire.llm import common, piecefst
from quire.llm.queries import tokenizer_path

from .test_dealt import prose


def test_idle_workers_hold_no_pieces(spark, monkeypatch):
    """The transducer and the ids of its segments go with the task that ends
    or breaks off, and the next one gives the same ids."""
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    model = piecefst.load(tokenizer_path("piece_bpe_32k.model"))
    run = piecefst.encode(df, model)
    batches = [pa.RecordBatch.from_arrays([pa.array([i, i]), pa.array([prose(i, 50), None])], ["doc_id", "text"]) for i in range(3)]
    first = [b.column(2).to_pylist() for b in run(iter(batches))]
    assert not piecefst._LOADED
    broken = run(iter(batches))
    assert next(broken).column(2).to_pylist() == first[0] and piecefst._LOADED
    broken.close()
    assert not piecefst._LOADED
    assert [b.column(2).to_pylist() for b in run(iter(batches))] == first == [[piecefst.Transducer(model).encode(prose(i, 50)), []] for i in range(3)]


def test_shuffle_files_of_the_last_query_go(spark):
    """Also those of the very last one, whose end the listener bus still has."""
    known = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    for _ in range(3):
        before = set(known.keys().mkString(" ").split())
        rows = common.stored(spark.range(1000).repartition(7))
        made = set(known.keys().mkString(" ").split()) - before
        common.released(spark)
        assert made and not made & set(known.keys().mkString(" ").split())
        assert rows.count() == 1000
