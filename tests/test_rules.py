"""Static guards for the execution rules of the library."""

import os
import re

ROOT = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "kairos")


def _sources():
    for d, _, files in os.walk(ROOT):
        for f in files:
            if f.endswith(".py"):
                p = os.path.join(d, f)
                yield p, open(p, encoding="utf-8").read()


def test_no_local_checkpoint_or_cross_join():
    for p, s in _sources():
        assert "localCheckpoint" not in s, p
        assert "crossJoin" not in s, p
        assert not re.search(r"on=F\.lit\(True\)", s), p


def test_no_row_at_a_time_udf():
    for p, s in _sources():
        assert not re.search(r"@F\.udf|F\.udf\(|@udf\b", s), p


def test_no_local_file_checks():
    """Data folders are looked at through the Hadoop API only."""
    for p, s in _sources():
        assert not re.search(r"os\.path\.(exists|isdir|isfile)|os\.(stat|listdir)\(|\bglob\.", s), p


def test_nothing_else_imports_the_optional_subpackage():
    for p, s in _sources():
        if f"{os.sep}llm{os.sep}" not in p:
            assert not re.search(r"(from|import)\s+[.\w]*\bllm\b", s), p


def test_oracles_are_registered_queries():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
