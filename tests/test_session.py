from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from corpusloom import session


def test_tables_are_written_to_the_shared_folder(spark):
    folder = session.shared_dir(spark)
    df = session.materialize(spark.range(10).withColumn("x", F.lit(None).cast("string")), "t")
    assert df.count() == 10 and all(folder.split(":")[-1] in f for f in df.inputFiles())
    assert session.shared_dir(spark) == folder


def test_empty_tables_keep_their_columns(spark):
    df = session.materialize(spark.range(0).withColumn("x", F.array(F.lit(1))), "t")
    assert df.columns == ["id", "x"] and df.count() == 0


def test_a_cluster_needs_a_shared_folder():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(getConf=lambda: {}, master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError, match="shared folder"):
        session.shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_the_session_names_the_folder():
    assert session.shared_dir(SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://x/shared/"})) == "hdfs://x/shared"


def test_release_removes_what_was_written(spark):
    from pathlib import Path

    df = session.materialize(spark.range(3), "t")
    folder = Path(df.inputFiles()[0].split(":")[-1].replace("///", "/")).parent
    assert folder.exists()
    session.release()
    assert not folder.exists()
    session.release()
