"""Where intermediate tables are written."""

import os

import pytest

from attestra import session


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, *_):
        return self.value


class Session:
    """What shared_dir() asks of a session."""

    def __init__(self, master, folder=None):
        self.conf = Conf(folder)
        self.sparkContext = self
        self.master, self.applicationId = master, "app-1"

    def getConf(self):
        return Conf(None)


@pytest.fixture(autouse=True)
def forget(monkeypatch):
    monkeypatch.setattr(session, "_FOLDERS", {})
    monkeypatch.setattr(session.atexit, "register", lambda f: f)


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(Session(master))
    assert session.shared_dir(Session("yarn", "hdfs:///x/")).startswith("hdfs:///x/attestra-app-1/")
    assert session.shared_dir(Session("local[4]")).startswith("file:///tmp/attestra-app-1/")


def test_written_tables_go_with_release(spark):
    assert session.written(spark.range(5)).count() == 5
    home = next(iter(session._FOLDERS)).removeprefix("file://")
    assert os.listdir(home)
    session.release()
    assert not os.path.exists(home) and not session._FOLDERS
