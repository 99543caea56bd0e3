"""The queries that SQL can express give DuckDB's rows; the pipeline gives the rows of a brute-force version."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arbora.llm import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(oracle.SQL[name])
    names = sorted(d[0] for d in got.description)
    place = {d[0]: i for i, d in enumerate(got.description)}
    want = [tuple(r[place[c]] for c in names) for r in got.fetchall()]  # sorted below, as rows may hold nulls
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(want, key=repr)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_against_brute_force(spark, tmp_path):
    import brute

    docs, bench = brute.pipeline_tables(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.n_tokens, list(r.ids), r.decoded) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == brute.pipeline(docs.collect(), bench.collect())
    assert 0 < len(got) < docs.count()


def test_rows_that_share_an_id_stay_unless_copied(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(1, text("a")), (1, text("b")), (1, text("b")), (2, text("a")), (2, text("c")), (3, text("c") + " more"), (4, ""), (4, text("d")), (None, text("a"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.jaccard_stage(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, "a0"), (1, "b0"), (2, "c0"), (4, ""), (4, "d0")]  # the row without id is a copy of (1, a)
    assert sorted(((r.doc_id, r.text[:2]) for r in got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_of_one_short_hash_are_told_apart(spark, monkeypatch, seed):
    """With either half of all keys alike, no row goes that is no copy."""
    plain = corpus_pipeline.half_key
    monkeypatch.setattr(corpus_pipeline, "half_key", lambda s, *c: plain(s, *c) if s != seed else F.lit("0" * 16))
    rows = [(i, " ".join(f"{c}{k}" for k in range(30)), "en", "s", 1) for i, c in enumerate("abcab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.jaccard_stage(spark, docs, "").collect()) == [0, 1, 2]


CLASHES = ["_hash", "_doc", "_gone", "_rank", "_n_lines", "_n_removed", "_key", "Key", "one", "row", "node", "component_id", "n_shingles", "words", "lines", "kept"]


def test_stages_on_odd_rows(spark, tmp_path):
    """Clashing names, repeated ids, nulls, empty texts, an empty table: each stage against its rule, said plainly."""
    import brute

    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = lambda c, n=60: " ".join(["the", "of"] + [f"{c}{i}" for i in range(n)])
    leak = text("l") + " one two three four five six seven"
    rows = [
        (1, text("a")), (1, text("b")), (1, text("b")), (2, text("a") + " more"), (2, text("c")), (None, text("a")), (None, text("e")), (None, text("e")),
        (3, ""), (3, ""), (4, None), (None, None), (5, leak), (6, "same line here and there\n" + text("f")), (7, text("g") + "\nsame line here and there"), (8, "x"),
    ]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame([(i, t, len(t or ""), *CLASHES) for i, t in rows], schema)

    def run(stage):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        got = got.collect()
        assert all([r[c] for c in CLASHES] == CLASHES for r in got)
        return sorted(((r.doc_id, r.text) for r in got), key=repr)

    order = lambda x: sorted(x, key=repr)
    assert run(corpus_pipeline.quality_stage) == order((i, t) for i, t in rows if brute.kept(t))
    assert run(corpus_pipeline.benchmark_stage) == order((i, t) for i, t in rows if t != leak)
    kept = [rows[0], rows[1], rows[4], rows[6], rows[8], rows[9], rows[10], rows[11], *rows[12:]]
    assert run(corpus_pipeline.jaccard_stage) == order(kept)
    lined = run(corpus_pipeline.line_stage)
    assert (7, text("g")) in lined and (6, rows[13][1]) in lined and lined.count((3, "")) == 2 and (None, None) in lined
    tokens = corpus_pipeline.token_stage(spark, docs, "").collect()
    assert len(tokens) == len(rows) and all(r.decoded == (r.decoded if r.n_tokens else "") for r in tokens)
    assert sorted((r.doc_id or 0, r.decoded) for r in tokens) == sorted((i or 0, t or "") for i, t in rows)
