"""The registered queries and the pipeline on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as e
import corpus_pipeline
from quern.llm import packing, sql, toxicity
from quern.llm.queries import queries


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries()}
    assert {*queries(), "pipeline"} <= set(e.queries())


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, small, name):
    db = duckdb.connect()
    for f in os.listdir(small):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    df, rel = queries()[name](spark, small), db.sql(sql.oracle_sql()[name])
    columns = sorted(df.columns)
    same = lambda v: float(f"{v:.10g}") if isinstance(v, float) else v
    at = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(same(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_stages_keep_what_they_should(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        last, docs = docs, spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns, name
        if name == "toxicity":
            model = toxicity.train(*toxicity.training_rows(last, spark.read.parquet(f"{small}/labels.parquet")))
            kept = {r.doc_id for r in toxicity.score_toxicity(last, model).where("predicted = 0").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "line dedup":
            assert docs.count() == last.count()
            assert all(len(r.text) <= len(before[r.doc_id]) for r in docs.collect())
        if name.startswith("n-gram"):
            from test_operators import brute_components

            groups = brute_components({r.doc_id: r.text for r in last.collect()})
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in groups.items() if c == i}
    pieces = packing.pack(last, corpus_pipeline.tokenizer())
    assert docs.count() == pieces.count()


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark):
    one, two = (" ".join(f"{w}{n}" for n in range(40)) for w in ("a", "b"))
    rows = [(1, one, "y"), (1, one, "x"), (2, one, "x"), (3, two, "x"), (None, one, "x"), (None, one, "x"), (None, two, "x"), (None, None, "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    want = [(1, one, "x"), (3, two, "x"), (None, one, "x"), (None, two, "x"), (None, None, "x")]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


#: Names of results and of what the operators use inside, in other cases too, and names that need quoting.
CLASHES = (
    "score", "Predicted", "n_lines", "removed_lines", "covered", "row", "gone_id", "gone_row", "extra_id", "whole", "kept", "size", "target", "taken", "copies", "source_size",
    "none", "NAME", "quality", "draw", "key", "range", "words", "before", "earlier", "_block", "_value", "rest", "salt", "total", "sums", "h", "p", "component_id", "label", "a.b", "x`y", "c d",
)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, ties and repeated rows, further columns of clashing names, a map among them."""
    lines = "\n".join(f"line number {k} of those that repeat" for k in range(4))
    one = " ".join(f"word{k}" for k in range(60))
    long = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    texts = [(1, one), (2, one), (2, one), (3, lines + "\nown end"), (4, lines), (5, None), (6, ""), (7, " \n\t"), (None, one), (None, None), (8, long), (9, long + " more"), (10, "x" * 400_000), (11, "you utter scum")]
    columns = ", ".join(f"`{c.replace('`', '``')}` string" for c in CLASHES)
    rows = [(i, t, "en", None if k % 3 == 0 else f"s{k % 2}", None if i is None else len(t or ""), *(f"{c}:{i}" if i != 5 else None for c in CLASHES), {"k": str(i)}) for k, (i, t) in enumerate(texts)]
    folder = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(1, 0), (3, 0), (8, 0), (11, 1), (2, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {columns}, tags map<string,string>"), str(folder)


@pytest.mark.parametrize("k", range(4))
def test_stages_pass_awkward_rows_and_names_on(spark, awkward, k):
    docs, folder = awkward
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
    got, before = out.collect(), docs.collect()
    for r in got:  # further columns belong to their rows still
        values = list(r[5:])
        assert values == [*([None] * len(CLASHES) if r.doc_id == 5 else [f"{c}:{r.doc_id}" for c in CLASHES]), {"k": str(r.doc_id)}], name
    ids = sorted((r.doc_id for r in got), key=str)
    texts = {(r.doc_id, r.text) for r in got}
    if k == 0:
        assert {r.doc_id for r in before} - {11} <= set(ids) and len(got) >= len(before) - 1
    if k == 1:
        assert len(got) == len(before) and (4, "") in texts and {r.n_chars for r in got if r.doc_id == 4} == {0} and (5, None) in texts
        assert texts - {(4, "")} == {(r.doc_id, r.text) for r in before if r.doc_id != 4}
    if k == 2:
        assert ids == sorted([1, 3, 5, 6, 7, None, None, 8, 10, 11, *([4] if (4, docs.where("doc_id = 4").first().text) in texts else [])], key=str)
    if k == 3:
        assert texts <= {(r.doc_id, r.text) for r in before} and {8, 9} & set(ids)


@pytest.mark.parametrize("k", range(5))
def test_stages_of_empty_tables(spark, awkward, k):
    docs, folder = awkward
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), folder).collect() == []


def test_packing_stage_of_awkward_rows(spark, awkward):
    docs, folder = awkward
    rows = corpus_pipeline.packing_stage(spark, docs, folder).collect()
    assert sum(r.piece == 0 for r in rows) == docs.count() and {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_near_duplicate_stage_fetches_no_texts_of_common_passages(spark, monkeypatch):
    """Under a sketch too full to tell, only near copies are fetched, and the later one of them goes."""
    import numpy as np

    from quern.llm import ngramjoin

    monkeypatch.setattr(ngramjoin, "SAMPLED", 1, raising=False)
    monkeypatch.setattr(ngramjoin, "_order", lambda profile: np.zeros(ngramjoin.COUNTERS, np.uint8))
    fetched, sets = [], ngramjoin._sets
    monkeypatch.setattr(ngramjoin, "_sets", lambda docs, members, order: fetched.append(members.count()) or sets(docs, members, order))
    rows = [(i, " ".join([*(f"p{i % 2}w{n}" for n in range(12)), *(f"d{i}w{n}" for n in range(40))]), "a") for i in range(120)]
    rows.append((120, rows[7][1].replace("d7w39", "x"), "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == list(range(120))
    assert fetched == [2]
