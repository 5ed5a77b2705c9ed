import os
from pathlib import Path

import pytest

from corpusloom.plans import all_queries, all_sql
from oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_its_sql(spark, con, name):
    compare(spark, FOLDER, con, all_queries()[name], all_sql()[name])


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_query_runs(spark, name):
    assert all_queries()[name](spark, FOLDER).count() >= 0


def test_every_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries())


def test_core_does_not_import_the_llm_subpackage():
    root = Path(__file__).resolve().parents[1] / "corpusloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert ".llm" not in path.read_text(encoding="utf-8")


def test_history_of_odd_subjects_and_paths(spark, tmp_path):
    subjects = ["P1\n", "a\r\nb", "x\u2028y", "\x85", None, "", "%0A+b", "commit:1:q"]
    paths = ["p/a.cpp", "commit:5:x", "a\nb", "\n", " ", "", None, "a b+%41", "汉/字"]
    rows = [(i, "2024-01-01T00:00:00Z", f"{i}{p}" if i else p, s) for i, s in enumerate(subjects) for p in paths if p is not None]
    times = ["1969-12-31T23:59:59.5Z", "1969-12-31T23:59:58Z", "2023-05-05T00:00:00", "n/a", None]
    rows += [(0, t, p, f"{t}\n") for t in times for p in [*paths, f"{t}.cpp"]]
    versions = [(i + 1, *r[1:]) for i, r in enumerate(rows)]
    spark.createDataFrame(versions, "row_id bigint, timestamp string, path string, problem_id string").coalesce(1).write.parquet(f"{tmp_path}/t/pilot_manifest.parquet")
    files = [(i, p) for i, p in enumerate([*{r[2] for r in rows}, "none"])]
    spark.createDataFrame(files, "record_id bigint, path string").coalesce(1).write.parquet(f"{tmp_path}/t/style_v3.parquet")
    con = connect(tmp_path / "none")
    for name in ("pilot_manifest", "style_v3"):
        con.sql(f"create view {name} as select * from '{tmp_path}/t/{name}.parquet/*.parquet'")
    compare(spark, f"{tmp_path}/t", con, all_queries()["history_lookup"], all_sql()["history_lookup"])
