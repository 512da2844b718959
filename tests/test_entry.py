"""The entry points without the training-data subpackage or a library that it needs; the scratch folder."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from stillpoint import scratch

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["xxhash", "stillpoint.llm", "corpus_pipeline"])
def test_core_loads_without(missing):
    code = f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e; assert 'dwell_representative' in e.queries() and 'dwell_representative' in e.oracle_sql(); assert 'pipeline' not in e.queries()"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    assert scratch.checkpoint_dir(spark)
    of = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d, set=lambda k, v: None), sparkContext=SimpleNamespace(master=master, getConf=dict))
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            scratch.checkpoint_dir(of(master))
    assert scratch.checkpoint_dir(of("local[4]"))
