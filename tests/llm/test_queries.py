"""Every registered query against its SQL, and the pipeline against its stages' definitions."""

import os

import duckdb
import pytest

import corpus_pipeline
from featshare.llm import queries as Q
from featshare.llm.common import table

TABLES = "documents pages benchmark labels conversations embeddings".split()


@pytest.fixture(scope="module")
def con(request):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].astype(object).where(frame[cols].notna(), None)
    whole = lambda x: int(x) if isinstance(x, float) and x == int(x) else x  # noqa: E731  a nullable long comes as float
    return cols, sorted(repr([whole(x) for x in r]) for r in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, sf_small, name):
    got = Q.QUERIES[name](spark, sf_small).toPandas()
    if name.startswith(("op12_", "op13_")):  # rows are not documents
        assert len(got) > 500 and rows(got) == rows(con.execute(Q.ORACLES[name]).df())
        return
    key = "page_id" if name.startswith("op3") else "doc_id"
    source = "pages" if name.startswith("op3") else "documents"
    ids = {r[0] for r in con.execute(f"select {key} from {source}").fetchall()}
    assert set(got[key]) == ids and (name.startswith("op1_") or len(got) == len(ids))
    if name in Q.ORACLES:
        assert rows(got) == rows(con.execute(Q.ORACLES[name]).df())


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_check):
    """Each stage on what its predecessor kept, decided by the operators' own results."""
    from featshare.llm.decontamination import contaminated_spans
    from featshare.llm.exact_dedup import exact_dedup
    from featshare.llm.simhash import simhash_groups

    docs = table(spark, sf_check, "documents")
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, corpus_pipeline.written(stage(spark, at, sf_check), "test")
        kept[name] = (before, at)
        if name != "best-fit packing":
            assert at.columns == docs.columns and at.exceptAll(before).isEmpty() and at.count() < before.count()

    def ids(frame):
        return sorted(r.doc_id for r in frame.select("doc_id").collect())

    before, after = kept["quality classifier"]
    labels = {r.doc_id: r.quality for r in table(spark, sf_check, "labels").collect()}
    left = set(ids(after))
    assert all(k in left for k, q in labels.items() if q == 1) and not any(k in left for k, q in labels.items() if q == 0)
    before, after = kept["exact dedup"]
    assert ids(after) == ids(exact_dedup(before).where("kept"))
    before, after = kept["simhash near-dedup"]
    assert ids(after) == ids(simhash_groups(before).where("doc_id = component_id"))
    before, after = kept["benchmark decontamination"]
    hit = contaminated_spans(before, table(spark, sf_check, "benchmark")).where("size(spans) = 0")
    assert ids(after) == ids(hit)
    before, after = kept["best-fit packing"]
    assert set(ids(after)) == set(ids(before))
    fill = after.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in fill) <= 4096 and len(fill) <= -(-sum(r[1] for r in fill) // 4096) + 2


def test_entry_without_the_subpackage(tmp_path):
    """The entry module loads when the pipeline and the llm folders are gone."""
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(f"{root}/featshare", tmp_path / "featshare", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"],
                         cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
