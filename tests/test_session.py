from types import SimpleNamespace

import pytest

from chatlens.session import materialise, remove, scratch_path, shared_dir
from chatlens.sizing import broadcast_if_small, is_small, measured_copy


def session(**settings):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)))


def test_shared_folder_is_the_one_the_session_names(spark):
    named = session(**{"spark.checkpoint.dir": "hdfs://shared/check", "spark.master": "yarn"})
    assert shared_dir(named) == "hdfs://shared/check"
    assert scratch_path(named, "x").startswith("hdfs://shared/check/chatlens/x-")
    with pytest.raises(ValueError):
        shared_dir(session(**{"spark.master": "yarn"}))
    own = shared_dir(session(**{"spark.master": "local[2]"}))
    assert own == shared_dir(session(**{"spark.master": "local[8]"}))
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_written_copy_is_the_same(spark):
    df = spark.sql("SELECT id, array(named_struct('a', id)) AS nested, CAST(NULL AS string) AS empty FROM range(3)")
    copy = materialise(df, "copy")
    assert copy.columns == df.columns and sorted(copy.collect()) == sorted(df.collect())


def test_only_the_named_folder_is_removed(spark, tmp_path):
    for name in ("gone", "kept"):
        spark.range(3).write.parquet(f"file://{tmp_path}/{name}")
    remove(spark, f"file://{tmp_path}/gone")
    remove(spark, f"file://{tmp_path}/never-there")
    assert [p.name for p in tmp_path.iterdir()] == ["kept"]


def test_size_is_measured(spark):
    df = spark.range(100).selectExpr("id", "repeat('é', 10) AS text")
    width = 100 * (16 + 16 + 20)
    assert is_small(df, width) and not is_small(df, width - 1)
    assert measured_copy(df, width)[1] and not measured_copy(df, width - 1)[1]
    assert measured_copy(df.where("false"), 0)[1] and is_small(df.where("false"), 0)
    plans = [broadcast_if_small(df, b)._jdf.queryExecution().analyzed().toString() for b in (width, 0)]
    assert "strategy=broadcast" in plans[0] and "strategy=broadcast" not in plans[1]
