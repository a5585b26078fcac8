"""Source-level guarantees of the library (no Spark needed)."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent
LIB = sorted((ROOT / "kpilane").rglob("*.py")) + [ROOT / "__spark_entry__.py"]


def _sources():
    for path in LIB:
        yield path, path.read_text()


def test_no_driver_side_data_pulls():
    # the scorecard library; the operators in llm/ read statistics of documented bounded size on the driver
    pattern = re.compile(r"\.(collect|toPandas|toLocalIterator|take|first|head)\(")
    hits = [f"{p.name}: {m.group(0)}" for p, src in _sources() if "llm" not in p.parts for m in pattern.finditer(src)]
    assert not hits, hits


def test_no_python_udfs_or_local_checkpoints():
    pattern = re.compile(r"(@udf|F\.udf\(|pandas_udf|localCheckpoint|\.rdd\b|mapPartitions)")
    hits = [f"{p.name}: {m.group(0)}" for p, src in _sources() for m in pattern.finditer(src)]
    assert not hits, hits


def test_no_cross_joins_in_library():
    pattern = re.compile(r"crossJoin|how=\"cross\"|, \"cross\"\)")
    hits = [f"{p.name}: {m.group(0)}" for p, src in _sources() for m in pattern.finditer(src)]
    assert not hits, hits
