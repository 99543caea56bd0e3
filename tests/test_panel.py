"""Hand-made cases of the panel rules."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from arbora.config import Config
from arbora.operators import graph, ledger, select, stats, validate
from arbora.schema import EVIDENCE, PANEL, SOURCE_AOC, SOURCE_PDF, TIERS, VERDICTS
from arbora.sources import blanks_to_null, read_panel_csv, read_stata, split_lists, write_result

CORE = "target_id long, total_assets double, total_liabilities double, equity double, profit_before_tax double, provision_tax double, profit_after_tax double, source_type string, source_found int, pdf_downloaded int, period_end_date string, currency string"


def row(i, ta=100.0, tl=60.0, eq=40.0, pbt=10.0, tax=3.0, pat=7.0, kind=SOURCE_PDF, found=1, pdf=1, end="2020-03-31", currency="USD"):
    return (i, ta, tl, eq, pbt, tax, pat, kind, found, pdf, end, currency)


def derived(spark, rows):
    df = validate.classify(validate.validate(spark.createDataFrame(rows, CORE), Config(identity_tolerance=0.5, pl_tolerance=0.5)))
    return {r.target_id: r for r in df.collect()}


def test_identity_cases(spark):
    r = derived(spark, [row(1), row(2, eq=30.0), row(3, eq=None), row(4, tl=None), row(5, kind=SOURCE_AOC), row(6, found=None)])
    assert (r[1].accounting_identity_gap, r[1].accounting_identity_ok, r[1].ready_for_valuation, r[1].review_reason) == (0, 1, 1, None)
    assert (r[2].accounting_identity_gap, r[2].accounting_identity_ok, r[2].review_reason) == (10, 0, "accounting_identity_failed")
    assert (r[3].variables_parsed, r[3].accounting_identity_gap, r[3].accounting_identity_ok, r[3].ready_for_valuation) == (0, None, 0, 0)
    assert (r[4].total_liabilities, r[4].tl_is_plug, r[4].accounting_identity_ok) == (60, 1, 1)
    assert [r[i].data_quality_tier for i in (1, 2, 5, 6)] == [TIERS[0], TIERS[2], TIERS[1], TIERS[2]]
    assert [r[i].source_priority for i in (1, 5, 2)] == [1, 2, 3]


def test_profit_and_loss_is_three_valued(spark):
    cases = {1: (10.0, 3.0, 7.0, 1), 2: (10.0, -3.0, 7.0, 1), 3: (10.0, 3.0, 9.0, 0)}
    for k, gone in enumerate(itertools.product((True, False), repeat=3), 4):
        if any(gone):
            cases[k] = tuple(None if g else v for g, v in zip(gone, (10.0, 3.0, 7.0))) + (-1,)
    r = derived(spark, [row(i, pbt=a, tax=b, pat=c) for i, (a, b, c, _) in cases.items()])
    assert {i: r[i].pl_identity_ok for i in cases} == {i: v[3] for i, v in cases.items()}


def test_one_preferred_row_and_total_tie_break(spark):
    df = spark.createDataFrame([(1, 2020, 2, "a"), (1, 2020, 1, "b"), (1, 2020, 1, "c"), (2, 2020, 4, "d"), (1, 2021, 3, "e")], "t long, y int, p int, k string")
    got = select.select_preferred(df, ["t", "y"], [F.col("p"), F.col("k")], check=["p", "k"]).filter("preferred_for_target_year = 1")
    assert sorted(r.k for r in got.collect()) == ["b", "d", "e"]
    with pytest.raises(ValueError):
        select.select_preferred(df, ["t", "y"], [F.col("p")], check=["p"])


def test_attribution_keeps_rows_without_rule(spark):
    df = spark.createDataFrame([("multiple_top30_claimants_review",), ("other",), (None,)], "attribution_rule string")
    assert select.without_shared_claims(df).count() == 2


def test_paths_dag_cycle_and_join_form(spark):
    edge = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("X", "Y"), ("Y", "X")], "parent string, child string")
    roots = spark.createDataFrame([("A",), ("X",)], "root string")
    for f in (graph.paths, graph.paths_by_joins):
        got = {(">".join(r.path), r.cycle) for r in f(edge, roots).collect()}
        assert got == {("A", False), ("A>B", False), ("A>C", False), ("A>B>C", False), ("X", False), ("X>Y", False), ("X>Y>X", True)}


def test_paths_against_a_walk(spark):
    r = random.Random(4)
    pairs = {(r.randrange(12), r.randrange(12)) for _ in range(14)}
    edge = spark.createDataFrame(sorted(pairs), "parent long, child long")
    want = []

    def walk(path):
        want.append(tuple(path))
        if len(set(path)) == len(path) and len(path) <= 8:
            for a, b in pairs:
                if a == path[-1]:
                    walk([*path, b])

    walk([0])
    got = graph.paths(edge, spark.createDataFrame([(0,)], "root long"), max_depth=8).collect()
    assert sorted(tuple(x.path) for x in got) == sorted(want)


def test_paths_deeper_than_the_bound_are_an_error(spark):
    edge = spark.createDataFrame([(i, i + 1) for i in range(4)], "parent long, child long")
    roots = spark.createDataFrame([(0,)], "root long")
    for f in (graph.paths, graph.paths_by_joins):
        assert f(edge, roots, max_depth=4).count() == 5
        with pytest.raises(Exception, match="deeper than max_depth 3"):
            f(edge, roots, max_depth=3).select("root").count()


def test_parents_are_resolved_or_reported(spark):
    df = spark.createDataFrame(
        [("P", "a", None, 1), ("P", "b", "a", 2), ("P", "c", "z", 3), ("P", "d", "P", 4), ("P", "e", "f", 5), ("P", "f", "P", 6), ("P", "f", "P", 7)],
        "parent string, entity_name string, immediate_parent string, target_id long",
    )
    got = {r.target_id: r.parent_status for r in graph.resolve_parents(df).collect()}
    assert got == {1: "root", 2: "resolved", 3: "unmatched", 4: "root", 5: "ambiguous", 6: "root", 7: "root"}


def test_concentration_and_currencies(spark):
    df = spark.createDataFrame([("g", "a", 1.0, "USD", "m"), ("g", "b", 1.0, "INR", "m")], "g string, c string, v double, currency string, units string")
    r = stats.concentration(df, ["g"], "c").first()
    assert (r.hhi, round(r.effective_number, 9)) == (0.5, 2.0)
    with pytest.raises(ValueError):
        stats.one_currency_sum(df, ["g"], "v")
    rates = spark.createDataFrame([("USD", "m", 1.0), ("INR", "m", 0.5)], "currency string, units string, rate double")
    assert stats.one_currency_sum(df, ["g"], "v", rates=rates).first().total == 1.5


def test_leave_one_out_forms_agree_and_dominance_shows(spark):
    df = spark.createDataFrame([("big", i, 10.0) for i in range(9)] + [("small", 9, 100.0)], "g string, i long, v double")
    fast = {r.g: r.without for r in stats.leave_one_out(df, "g", F.col("v"), F.lit(1)).collect()}
    slow = {r.dropped: r.v for r in stats.leave_one_out_any(df, "g", lambda g: g.agg(F.avg("v").alias("v"))).collect()}
    assert fast == slow == {"big": 100.0, "small": 10.0}


def test_least_squares_with_clusters(spark):
    df = spark.createDataFrame([(i % 5, float(i), 2.0 * i + 1 + (-1) ** i) for i in range(40)], "c int, x double, y double")
    plain, robust = stats.least_squares(df, "y", ["x"]), stats.least_squares(df, "y", ["x"], "c")
    assert plain["beta"] == pytest.approx(robust["beta"]) and abs(plain["beta"][1] - 2) < 0.05 and min(robust["se"]) > 0


def test_nesting_baseline_is_a_permutation_and_repeatable(spark):
    df = spark.createDataFrame([(i, i % 3, f"l{i % 7}") for i in range(60)], "i long, depth int, label string")
    a = sorted(map(tuple, stats.nesting_baseline(df, "label", "depth", 5).collect()))
    b = sorted(map(tuple, stats.nesting_baseline(df.repartition(3), "label", "depth", 5).collect()))
    assert a == b
    for d in range(3):
        assert sorted(r[2] for r in a if r[1] == d) == sorted(r[3] for r in a if r[1] == d)


def test_taxonomy_is_seeded(spark):
    df = spark.createDataFrame([(i, float(i // 10), float(i % 3)) for i in range(40)], "i long, a double, b double")
    one, two = ([r.cluster for r in stats.taxonomy(df, ["a", "b"], 3).orderBy("i").collect()] for _ in range(2))
    assert one == two and len(set(one)) == 3


def test_ledger(spark, tmp_path):
    fields = dict(result="r", statistic="s", denominator="d", interest="i", robustness="r", mundane="m", data_quality="q", falsification="f")
    with pytest.raises(ValueError):
        ledger.Finding("Z-1", score=1, **fields)
    proof = ledger.Provenance(*"abcdefghij")
    ledger.record(spark, [ledger.Finding("C-F001", score=3, provenance=proof, **fields), ledger.Finding("X-F002", score=5, version=2, **fields)], str(tmp_path / "l"))
    led = spark.read.parquet(str(tmp_path / "l"))
    assert ledger.most_valuable(led, 1).first().finding_id == "X-F002" and ledger.since(led, 1).count() == 1
    df = spark.createDataFrame([(True, True, False, False), (True, False, False, False), (False, True, False, False), (True, True, True, False), (True, True, False, True), (None, True, False, False)], "a boolean, b boolean, c boolean, d boolean")
    got = [r[0] for r in df.select(ledger.verdict(*(F.col(c) for c in "abcd"))).collect()]
    assert got == ["CONFIRMED", "FRAGILE", "NOT REPRODUCIBLE", "DATA ARTIFACT", VERDICTS[5], "PARTIALLY CONFIRMED"]
    assert spark.range(1).select(ledger.loaded_words(F.lit("An Illegal, unusual case"))).first()[0] == ["illegal"]


def test_schema_and_csv(spark, tmp_path):
    assert len(PANEL.names) == 77 and len(EVIDENCE) == 18 and all(e in PANEL.names for e in EVIDENCE.values())
    path = tmp_path / "p.csv"
    path.write_text(",".join(PANEL.names) + "\n" + ",".join({"target_id": "t", "fiscal_year": "2020", "total_assets": "1.5"}.get(c, "") for c in PANEL.names) + "\n")
    r = read_panel_csv(spark, str(path)).first()
    assert (r.target_id, r.fiscal_year, r.total_assets, r.units) == ("t", 2020, 1.5, None)
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        read_panel_csv(spark, str(path))
    df = spark.createDataFrame([("a; b;;", " ")], "top30_claimants string, units string")
    r = split_lists(blanks_to_null(df), "top30_claimants").first()
    assert r.top30_claimants_list == ["a", "b"] and r.units is None
    with pytest.raises(ValueError):
        write_result(df, str(tmp_path / "in/x"), inputs=(str(tmp_path / "in"),))


def test_stata(spark, tmp_path):
    path = str(tmp_path / "p.dta")
    pd.DataFrame({"k": ["a", ""], "v": [1.5, None], "f": pd.array([1, -1], dtype="int8"), "d": pd.to_datetime(["2020-03-31", None])}).to_stata(path, write_index=False, convert_dates={"d": "td"})
    got = read_stata(spark, path).collect()
    assert (got[0].k, got[0].v, got[0].f, str(got[0].d)) == ("a", 1.5, 1, "2020-03-31")
    assert (got[1].k, got[1].v, got[1].f, got[1].d) == (None, None, -1, None)


def test_stream_dedup_and_windows(spark, tmp_path):
    from arbora.streaming import windows

    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:05:00")], "k long, ts string").selectExpr("k", "to_timestamp_ntz(ts) ts").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("k long, ts timestamp_ntz").parquet(str(tmp_path / "s"))
    q = windows.deduplicated(stream, "ts", "10 minutes", ["k"]).writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert spark.table("dedup").count() == 2
    finally:
        q.stop()


def test_section_and_match_gates(spark):
    schema = CORE + ", aoc_match_status string, section_found int, review_reason string"
    rows = [
        (*row(1, kind=SOURCE_AOC), "matched", None, None), (*row(2, kind=SOURCE_AOC), "not_matched", None, None), (*row(3, kind=SOURCE_AOC), None, None, None),
        (*row(4), None, 0, None), (*row(5), None, 1, "x; combined_pdf_section_not_found"), (*row(6), None, None, None), (*row(7, kind=None), None, 0, None), (*row(8, pdf=0), None, 1, None),
    ]
    got = {r.target_id: (r.review_reason, r.data_quality_tier, r.source_priority) for r in validate.classify(validate.validate(spark.createDataFrame(rows, schema))).collect()}
    assert got == {
        1: (None, TIERS[1], 2), 2: ("aoc_not_matched", TIERS[3], 4), 3: ("aoc_not_matched", TIERS[3], 4), 4: ("combined_pdf_section_not_found", TIERS[2], 3),
        5: ("combined_pdf_section_not_found", TIERS[2], 3), 6: (None, TIERS[0], 1), 7: (None, None, 5), 8: (None, TIERS[2], 3),
    }


def test_paths_beyond_a_million(spark):
    edge = spark.range(1, 1_200_001).selectExpr("0L AS parent", "id AS child")
    found = graph.paths(edge, spark.createDataFrame([(0,)], "root long"))
    assert found.count() == 1_200_001


def test_paths_carry_labels(spark):
    edge = spark.createDataFrame([("A", "B", "x"), ("B", "C", "y")], "parent string, child string, land string")
    roots = spark.createDataFrame([("A", "r")], "root string, land string")
    assert {(r.node, tuple(r.labels)) for r in graph.paths(edge, roots, label="land").collect()} == {("A", ("r",)), ("B", ("r", "x")), ("C", ("r", "x", "y"))}


def test_quantiles_equal_numpy(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(stats, "ACCURACY", 50)
    r = np.random.default_rng(3)
    values = {"skew": np.concatenate([np.zeros(4000), r.exponential(size=2000)]), "ties": r.integers(0, 5, 3000).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "wide": r.normal(size=5000)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("two", None), ("none", None), (None, 3.0)], "g string, v double").repartition(5)
    got = {(x.g, x.p): x["quantile"] for x in stats.quantiles(df, "v", [0.0, 0.1, 0.5, 0.73, 1.0], ["g"]).collect()}
    for g, vs in values.items():
        for p in (0.0, 0.1, 0.5, 0.73, 1.0):
            assert got[g, p] == pytest.approx(np.quantile(vs, p))
    assert got[None, 0.5] == 3.0 and ("none", 0.5) not in got
    whole = np.concatenate([*values.values(), [3.0]])
    assert stats.quantiles(df, "v", [0.5]).first()["quantile"] == pytest.approx(np.median(whole))


def test_ntile_of_a_skewed_column(spark):
    from arbora.streaming import windows

    df = spark.createDataFrame([(0.0 if i % 10 else float(i) ** 5, i) for i in range(1000)], "v double, i long").repartition(3)
    got = windows.global_ntile(df, ["v", "i"], 7, "tile").orderBy("v", "i").collect()
    size, extra = divmod(1000, 7)
    want = [t + 1 for t in range(7) for _ in range(size + (t < extra))]
    assert [r.tile for r in got] == want


def test_components_and_ranks(spark):
    edge = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "parent long, child long")
    assert {r.node: r.comp for r in graph.components(edge.toDF("u", "v")).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    assert {r.node: (r.n_out, r.n_in, r.degree) for r in graph.degrees(edge).collect()}[2] == (1, 1, 2)
    ranks = {r.node: r["rank"] for r in graph.page_rank(edge, rounds=3, damping=0.5).collect()}
    assert ranks == {1: 0.1, 5: 0.1, 2: pytest.approx(0.15), 6: pytest.approx(0.15), 3: pytest.approx(0.175)}


def test_names_matches_and_claims(spark):
    left = spark.createDataFrame([("P", "Acme Ltd", 1), ("P", "Zeta", 2), ("Q", "Acme", 3)], "b string, n string, k long")
    right = spark.createDataFrame([("P", "ACME LTD.", 10), ("P", "Beta", 11)], "b string, n string, k long")
    got = {r.k: (r.match_key, r.match_status) for r in validate.best_match(left, right, "b", "n", "k", 0.8).collect()}
    assert got == {1: (10, "matched"), 2: (11, "not_matched"), 3: (None, "not_matched")}
    with pytest.raises(ValueError):
        validate.with_sector_labels(spark.createDataFrame([("a",)], "sector_code string"), spark.createDataFrame([("a", "x"), ("a", "y")], "sector_code string, sector_label string"))


def test_dates_dictionary_and_links(spark, tmp_path):
    from arbora.functions import text_date
    from arbora.sources import commented, read_dictionary, read_mapping

    texts = ["2020-03-31", "31/03/2020", "31st March, 2020", "Mar 31 2020", "31.03.2020", "MARCH 31, 2020", "no date", "", None, "20200331"]
    got = [str(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text_date(F.col("t"))).collect()]
    assert got == ["2020-03-31"] * 6 + ["None"] * 3 + ["2020-03-31"]
    (tmp_path / "d.txt").write_text("Heading\n-------\n\nequity\n  What is left,\n  after all.\n\nunits\n  Of money.\n")
    schema = commented(PANEL, read_dictionary(spark, str(tmp_path / "d.txt")))
    assert schema["equity"].metadata["comment"] == "What is left, after all." and schema["units"].metadata["comment"] == "Of money." and not schema["parent"].metadata
    pd.DataFrame({"uin": ["U1", ""], "n": [1.0, 2.0]}).to_stata(str(tmp_path / "m.dta"), write_index=False)
    assert [r.uin for r in read_mapping(spark, str(tmp_path / "m.dta"), ["uin"]).collect()] == ["U1", None]
    (tmp_path / "in").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "in")
    with pytest.raises(ValueError):
        write_result(spark.range(1), f"file://{tmp_path}/link/x", inputs=(str(tmp_path / "in"),))
