import pytest

from tickloom.session import session_settings, shared_folder


def test_settings_last_for_the_block(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with session_settings(spark, {name: "3", "tickloom.unknown": "x"}):
        assert spark.conf.get(name) == "3"
    assert spark.conf.get(name) == before and spark.conf.get("tickloom.unknown", None) is None


def test_an_unset_folder_is_an_error(spark, monkeypatch):
    before = spark.conf.get("spark.checkpoint.dir")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, name, default=None: default)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(spark)
    monkeypatch.undo()
    assert shared_folder(spark) == before
