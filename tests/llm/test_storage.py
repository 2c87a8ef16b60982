import os

from seamline.llm import storage


def test_tables_are_removed_when_asked(spark):
    storage.remove_written(spark)
    table = storage.written(spark.range(5), "kept")
    path = table.inputFiles()[0].removeprefix("file://")
    assert table.count() == 5 and os.path.exists(path)
    assert storage.remove_written(spark) == 1 and not os.path.exists(path) and storage.remove_written(spark) == 0


def test_scratch_tables_go_at_the_end_of_their_block(spark):
    storage.remove_written(spark)
    before = storage.written(spark.range(3), "before")
    with storage.scratch(spark):
        passing, kept = storage.written(spark.range(4), "passing"), storage.written(spark.range(5), "kept", read_later=True)
        path = passing.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(path) and before.count() == 3 and kept.count() == 5 and storage.remove_written(spark) == 2
