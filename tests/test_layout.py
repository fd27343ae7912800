"""The training-data subpackage may be deleted: nothing else imports it."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_imports_llm():
    for path in [*ROOT.glob("lamina/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" in path.relative_to(ROOT).parts or path.name == Path(__file__).name:
            continue
        assert not re.search(r"(from|import)\s+[\w.]*\bllm\b|corpus_pipeline", path.read_text()), path


def test_no_forbidden_calls():
    for path in ROOT.glob("lamina/**/*.py"):
        text = path.read_text()
        assert not re.search(r"localCheckpoint\(|crossJoin\(", text), path


def test_the_rest_works_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace as NS

    from lamina.storage import shared_dir

    conf = NS(get=lambda name, default=None: default)
    session = NS(conf=conf, sparkContext=NS(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_intermediate_tables_can_go(spark):
    from pathlib import Path as Local

    from lamina.storage import discard, materialize, written

    frame = materialize(spark.range(3), "three")
    path = written(spark)[-1]
    assert frame.count() == 3 and Local(path.removeprefix("file:")).exists()
    discard(spark, [path])
    assert path not in written(spark) and not Local(path.removeprefix("file:")).exists()
