"""Session rules: shared checkpoint folder on clusters, bounded broadcasts."""

import types

import pytest

from orderlens.plans.broadcast import bounded
from orderlens.plans.inspect import plan_text
from orderlens.session import ensure_checkpoint_dir


def _fake_session(master, configured=None):
    conf = {"spark.checkpoint.dir": configured} if configured else {}
    calls = []

    def set_dir(path):
        calls.append(path)

    def forbidden(*_):
        raise AssertionError("spark.conf.set on a running session")

    sc = types.SimpleNamespace(master=master, setCheckpointDir=set_dir,
                               getCheckpointDir=lambda: calls[-1] if calls else None)
    runtime = types.SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=forbidden)
    return types.SimpleNamespace(conf=runtime, sparkContext=sc), calls


def test_cluster_without_shared_checkpoint_folder_is_refused():
    session, _ = _fake_session("yarn")
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session)


def test_configured_checkpoint_folder_is_used_as_is():
    session, calls = _fake_session("yarn", "hdfs://nn/shared/ckpt")
    assert ensure_checkpoint_dir(session) == "hdfs://nn/shared/ckpt"
    assert calls == []


def test_local_session_gets_a_scratch_folder_only_when_unset():
    session, calls = _fake_session("local[2]")
    folder = ensure_checkpoint_dir(session)
    assert folder and calls == [folder]
    assert ensure_checkpoint_dir(session) == folder and len(calls) == 1  # registered once


def test_bounded_hints_only_under_the_cap(spark):
    small = spark.range(10)
    assert "BroadcastExchange" in plan_text(spark.range(1000).join(bounded(small, 10), "id"))
    with pytest.raises(ValueError):
        bounded(small, -1)
