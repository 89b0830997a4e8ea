"""Shared folders and workers that need the package."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest
from chronoveil.session import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from chronoveil.session import build_session
spark = build_session(master="local[1]", **{{"spark.sql.shuffle.partitions": "1"}})
def run(batches):
    from chronoveil.operators.mechanisms import StreamPublisher
    yield from batches
print("rows", spark.range(3).mapInPandas(run, "id bigint").count())
"""


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master, bad in (("spark://host:7077", True), ("local-cluster[2,1,512]", True), ("yarn", True)):
        conf = {"spark.master": master}
        fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)),
                               sparkContext=SimpleNamespace(getCheckpointDir=lambda: None))
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(fake)
        conf["spark.checkpoint.dir"] = "s3://shared/tmp"
        assert shared_dir(fake) == "s3://shared/tmp"


def test_workers_get_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "rows 3" in out.stdout, out.stderr[-2000:]
