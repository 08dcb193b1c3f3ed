import os

import pytest

from callsift import session


@pytest.fixture
def unset(spark, monkeypatch):
    """The session as if no shared folder had been named."""
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)


def test_shared_folder_must_be_named(spark, unset, monkeypatch):
    monkeypatch.setattr(session, "CHECKPOINT_SETTING", "spark.callsift.unset")
    with pytest.raises(RuntimeError):
        session.shared_dir(spark)
    with pytest.raises(RuntimeError):
        session.settle(spark.range(1))


def test_local_sessions_may_get_one(spark, unset, monkeypatch):
    monkeypatch.setattr(session, "CHECKPOINT_SETTING", "spark.callsift.trial")
    made = session.shared_dir(session.ensure_shared_dir(spark))
    assert os.path.isdir(made) and session.shared_dir(session.ensure_shared_dir(spark)) == made


def test_settled_tables_are_removed(spark):
    with session.settled(spark.range(3), "short") as kept:
        path = kept.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
        assert kept.count() == 3
    assert not os.path.exists("/" + path.lstrip("/"))
