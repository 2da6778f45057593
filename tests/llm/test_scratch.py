import gc

from chunkyard.llm.common import Scratch


def test_tables_do_not_collide(spark):
    tmp = Scratch(spark)
    for i in range(30):
        assert tmp.save(spark.range(i, i + 1)).first()[0] == i
        gc.collect()
    a, b = tmp.save(spark.range(2)), tmp.save(spark.range(3))
    tmp.drop(a)
    assert b.count() == 3


def test_scopes_drop_what_was_made_within(spark):
    outer = Scratch(spark)
    with Scratch.scope():
        inner = Scratch(spark)
        kept = outer.save(inner.save(spark.range(4)), 4)
    assert kept.count() == 4 and kept.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    fs, p = inner._fs(inner.root)
    assert not fs.exists(p) and outer._fs(outer.root)[0].exists(outer._fs(outer.root)[1])


def test_batches_are_cut_by_bytes(spark):
    from chunkyard.llm.common import BATCH_BYTES, arrow_map

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "b"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1g")
    long = spark.range(0, 60, 1, 1).selectExpr("repeat('x', 1000000) AS t")
    got = arrow_map(long, sizes, "n long, b long").collect()
    spark.conf.set(key, before)
    assert sum(r.n for r in got) == 60 and max(r.b for r in got) < 1.2 * BATCH_BYTES and len(got) > 6
    assert arrow_map(long.where("false"), sizes, "n long, b long").count() == 0


def test_a_task_of_another_operator_drops_what_was_kept():
    from chunkyard.llm.common import arrow_map, kept

    def count(batches):
        import pyarrow as pa

        from chunkyard.llm.common import kept

        for _ in batches:
            mine = kept.setdefault("mine", {"tasks": 0})
            mine["tasks"] += 1
            yield pa.RecordBatch.from_arrays([pa.array([mine["tasks"]])], names=["n"])

    run = lambda keep: arrow_map(_Frame(), count, "n long", keep)  # noqa: E731  in this process: Spark may give each task another worker
    for keep, n in (("mine", 1), ("mine", 2), ("other", 1), ("", 1), ("mine", 2)):
        assert [b.column(0)[0].as_py() for b in run(keep)] == [n]
    kept.clear()


class _Frame:
    def mapInArrow(self, run, schema):
        import pyarrow as pa

        return list(run([pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])]))
