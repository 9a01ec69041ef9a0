"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from orrery import session


def fake(master, folder=None, app="app-1"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master, applicationId=app))


def test_shared_dir():
    assert session.shared_dir(fake("spark://x", "hdfs://y/z/")) == "hdfs://y/z"
    one = session.shared_dir(fake("local[2]"))
    assert one == session.shared_dir(fake("local[2]")) != session.shared_dir(fake("local[2]", app="app-2"))
    for master in ("yarn", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError):
            session.shared_dir(fake(master))


def test_durable(spark):
    df = spark.range(3).selectExpr("id", "cast(null as string) as s")
    back = session.durable(df, "t")
    assert back.dtypes == df.dtypes and sorted(r.id for r in back.collect()) == [0, 1, 2]
