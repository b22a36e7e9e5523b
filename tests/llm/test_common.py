import os

from leadflow.llm import simhash
from leadflow.llm.common import emptied, written


def test_tables_of_operators_are_emptied_when_their_results_are_stored(spark, documents, tmp_path):
    docs = documents([(1, "a b c d", "en", "s"), (2, "a b c d", "en", "s"), (3, "other words here", "en", "s")])
    with emptied(spark):
        kept = written(docs, "inside")
        simhash.keep_one(kept, words=3, distance=3).write.parquet(f"{tmp_path}/out")
        files = [f.removeprefix("file://") for f in kept.inputFiles()]
        assert files and all(map(os.path.exists, files))
    assert not any(map(os.path.exists, files)) and spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert written(docs, "outside").count() == 3
