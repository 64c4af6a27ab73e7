"""The rest of the engine without the optional subpackage and its pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_entry_works_without_the_subpackage(tmp_path, pipeline):
    names = [str(p.relative_to(ROOT)) for p in [*ROOT.glob("*.py"), *ROOT.glob("foliospark/**/*.py")]]
    for name in names:
        if not name.startswith(("foliospark/llm/", "tests/")) and (pipeline or name != "corpus_pipeline.py"):
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            shutil.copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q) and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_a_cluster_needs_a_shared_folder():
    from foliospark.sources.storage import workspace

    class Session:
        def __init__(self, master, **conf):
            self.conf, self.sparkContext = conf, type("C", (), {"master": master})

    assert workspace(Session("spark://host", **{"spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"
    for master in ("spark://host", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            workspace(Session(master))
    local = Session("local[2]")
    assert os.path.isdir(workspace(local).removeprefix("file://")) and workspace(local) == workspace(local)


def test_only_small_scans_are_spread(spark):
    from foliospark.sources.storage import spread

    cores = spark.sparkContext.defaultParallelism
    one, many = spark.range(100).coalesce(1), spark.range(0, 100, 1, cores)
    assert spread(one).rdd.getNumPartitions() == cores and spread(one).count() == 100
    assert spread(many) is many
