"""Files that queries write and read back: their number follows the bytes, not the documents in them."""

import datetime
import json
import uuid

import pytest

from tonelake.plans import queries
from tonelake.sources import io

RUNS = 150


@pytest.fixture
def written(spark, tmp_path, monkeypatch):
    """Runs a query on a folder of tables; gives its rows and the files that it wrote."""

    def run(name, table, rows):
        rows.coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
        monkeypatch.setattr(io, "scratch", lambda _: str(tmp_path / "out" / uuid.uuid4().hex))
        got = queries.QUERIES[name](spark, str(tmp_path)).collect()
        return got, list((tmp_path / "out").rglob("*.json"))

    return run


@pytest.fixture
def events(spark):
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(2 * u + i, at + datetime.timedelta(seconds=u + i), None if u == 7 else u, "view\n\"é\"", u / 8 + i) for u in range(RUNS) for i in range(2)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")


def test_result_files_of_many_runs(written, events):
    got, files = written("result_files", "events", events)
    assert {(r["checkpoint"], r["overall_cer"], r["arrl_cer"], r["kaggle_cer"], r["folds"]) for r in got} == {(None if u == 7 else f"run_{u}", u / 8 + 0.5, u / 8, None, 0) for u in range(RUNS)}
    assert len(got) == RUNS and 0 < len(files) < 20


def test_cases_of_many_runs(written, events):
    got, files = written("result_cases", "events", events)
    assert sorted(tuple(r) for r in got) == sorted((f"case_{2 * u + i}", "view\n\"é\"", u / 8 + i, None) for u in range(RUNS) for i in range(2))
    assert 0 < len(files) < 20


def test_documents_a_file_or_a_line(spark, tmp_path):
    """The same results, one pretty-printed document a file or one a line of one file."""
    docs = [{"checkpoint": f"c{i}", "overall_cer": i / 4, "synthetic": {f"case_{i}": {"bucket": "b\n", "cer": 0.5}}} for i in range(3)]
    for i, x in enumerate(docs):
        (tmp_path / f"f{i}.json").write_text(json.dumps(x, indent=2))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "all.json").write_text("".join(json.dumps(x) + "\n" for x in docs))
    for read in (io.read_results, io.read_cases):
        one, all_ = (sorted(map(str, read(spark, str(p), lines=lines).drop("file").collect())) for p, lines in ((tmp_path / "f*.json", False), (tmp_path / "lines", True)))
        assert one == all_ and len(one) == 3
