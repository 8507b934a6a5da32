from types import SimpleNamespace

import pytest

from flamelake.functions.workdir import fresh_path, shared_dir


def session(master, configured):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: configured),
        sparkContext=SimpleNamespace(master=master, applicationId="app"),
    )


def test_configured_folder_wins():
    assert shared_dir(session("yarn", "s3a://bucket/check/")) == "s3a://bucket/check"
    assert fresh_path(session("yarn", "s3a://b"), "x").startswith("s3a://b/x-")


def test_machine_folder_is_for_local_sessions_only():
    assert shared_dir(session("local[2]", None)) == shared_dir(session("local[2]", None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("yarn", None))
