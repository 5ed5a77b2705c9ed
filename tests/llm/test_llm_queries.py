import os
from pathlib import Path

import pytest

from corpusloom.llm.queries import CATALOG
from oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(CATALOG.sql))
def test_query_equals_its_sql(spark, con, name):
    compare(spark, FOLDER, con, CATALOG.queries[name], CATALOG.sql[name])


def test_ids_are_those_of_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    from corpusloom.llm import bpe

    public = Tokenizer.from_file(bpe.vocabulary_path())
    public.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: list(r.ids) for r in CATALOG.queries["p6_ids"](spark, FOLDER).collect()}
    assert got == {k: public.encode(t or "", add_special_tokens=False).ids for k, t in texts.items()}


def test_containers_hold_the_corpus(spark):
    ids = {r.doc_id: len(r.ids) for r in CATALOG.queries["p6_ids"](spark, FOLDER).collect()}
    rows = CATALOG.queries["p7_containers"](spark, FOLDER).collect()
    held = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.token_start == held.get(r.doc_id, 0) and 0 < r.n_tokens <= 4096
        held[r.doc_id] = r.token_start + r.n_tokens
    assert held == {k: n for k, n in ids.items() if n}
    fill = {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    assert max(fill.values()) <= 4096
    report = CATALOG.queries["p7_fill"](spark, FOLDER).first()
    assert report.containers == len(fill) and report.unused == 4096 * len(fill) - sum(ids.values())


@pytest.mark.parametrize("name", sorted(set(CATALOG.queries) - set(CATALOG.sql)))
def test_query_runs(spark, name):
    assert CATALOG.queries[name](spark, FOLDER).count() >= 0
