"""Guards for the project rules: lineage is cut only with reliable checkpoints or
written tables, scratch data lives under spark.checkpoint.dir, and query names
are plain."""

import os
import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent


def _sources():
    for p in list((ROOT / "tarmac").rglob("*.py")) + [ROOT / "bench.py", ROOT / "__spark_entry__.py"]:
        yield p, p.read_text()


def test_no_local_checkpoint_and_no_local_temp_folders():
    for p, src in _sources():
        assert "localCheckpoint" not in src, p
        if p.name != "session.py":  # session.py invents a folder only in local mode when none is configured
            assert "tempfile" not in src and "/tmp" not in src, p


def test_folders():
    assert os.path.isdir(ROOT / "tarmac" / "streaming") and os.path.isdir(ROOT / "tarmac" / "plans")


def test_optional_part_is_imported_by_the_entry_only():
    part = re.compile(r"tarmac[./]llm|corpus_pipeline")
    for p, src in _sources():
        if p.name not in ("__spark_entry__.py", "corpus_pipeline.py") and "llm" not in p.parts:
            assert not part.search(src), p
