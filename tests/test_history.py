import pytest

from lodestrata.operators import history, report

DAY = history.DAY
SCHEMA = "commit_id string, author string, file_id string, epoch long, added long, deleted long"
NOW = 1000 * DAY


@pytest.fixture(scope="module")
def churn(spark):
    rows = [
        ("c1", "ann", "a", NOW - 10 * DAY, 10, 5), ("c1", "ann", "b", NOW - 10 * DAY, 1, 0), ("c2", "bob", "a", NOW - 20 * DAY, 30, 0), ("c2", "bob", "b", NOW - 20 * DAY, 2, 2),
        ("c3", "ann", "a", NOW - 30 * DAY, 5, 0), ("c4", "cy", "c", NOW - 200 * DAY, 0, 0), ("c4", "cy", "a", NOW - 200 * DAY, 1, 0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_churn_window_takes_its_edge(churn):
    assert rows(history.churn_metrics(churn, 30, NOW), "file_id", "churn", "commits", "authors") == [("a", 50, 3, 2), ("b", 5, 2, 2)]
    assert rows(history.churn_metrics(churn, None, NOW), "file_id", "churn")[2] == ("c", 0)


def test_windows_in_one_pass(churn):
    got = history.churn_windows(churn, [10, 30, None], NOW)
    assert rows(got, "file_id", "churn_10d", "churn_30d", "churn_lifetime") == [("a", 15, 50, 51), ("b", 1, 5, 5), ("c", 0, 0, 0)]


def test_recency_goes_up_to_one(spark):
    c = spark.createDataFrame([("c", "x", "new", NOW - 6 * DAY, 1, 0), ("c", "x", "old", NOW - 200 * DAY, 1, 0)], SCHEMA)
    assert rows(history.recency(c, 30, NOW), "file_id", "age_days", "recency") == [("new", 6.0, 0.2), ("old", 200.0, 1.0)]
    assert rows(history.recency(c, None, NOW), "recency") == [(1.0,), (1.0,)]


def test_ownership_drops_files_without_lines(churn):
    assert rows(history.ownership(history.author_lines(churn)), "file_id", "bus_factor", "top_author_share") == [("a", 1, 0.588), ("b", 1, 0.8)]


def test_bus_factor_counts_up_to_half(spark):
    lines = spark.createDataFrame([("f", x, 10) for x in "abcde"], "file_id string, author string, lines long")
    assert rows(history.ownership(lines), "bus_factor", "top_author_share") == [(3, 0.2)]
    assert rows(history.top_author(lines), "author") == [("a",)]


def test_coupling_leaves_out_large_commits(spark, churn):
    assert rows(history.coupling(churn), "file_a", "file_b", "count") == [("a", "b", 2)]
    assert history.coupling(churn).first()["commits"] == ["c1", "c2"]
    wide = spark.createDataFrame([("w", "x", f"f{k}", NOW, 1, 0) for k in range(60)], SCHEMA)
    both = churn.union(wide)
    assert rows(history.coupling(both, 1), "file_a", "file_b", "count") == [("a", "b", 2), ("a", "c", 1)]
    assert history.skipped_commits(both).first()[0] == 1
    assert rows(history.coupled_to(history.coupling(churn, 1), "a"), "partner", "count") == [("b", 2), ("c", 1)]


def test_path_link_comes_before_coedit(spark):
    tests = spark.createDataFrame([("t1",), ("t2",)], "id string")
    sources = spark.createDataFrame([("s1",), ("s2",)], "id string")
    candidates = spark.createDataFrame([("t1", "s1"), ("t1", "nowhere")], "test_id string, source_id string")
    pairs = spark.createDataFrame([("s2", "t1", 9), ("s1", "t2", 2), ("s2", "t2", 2)], "file_a string, file_b string, count long")
    links = history.link_tests(tests, sources, candidates, pairs)
    assert rows(links, "test_id", "source_id", "method") == [("t1", "s1", "path"), ("t2", "s1", "coedit")]
    assert rows(history.linked_test_count(links), "source_id", "linked_test_count") == [("s1", 2)]


def test_hotspots(spark, churn):
    files = spark.createDataFrame([("a", "source", 4.0), ("b", None, 10.0), ("c", "source", 5.0), ("g", "generated", 9.0)], "id string, role string, cognitive_max double")
    shown = report.keep_files(files)
    assert rows(shown, "id") == [("a",), ("b",), ("c",)]
    got = report.hotspots(shown, history.churn_metrics(churn, 30, NOW), history.recency(churn, 30, NOW))
    assert rows(got, "rank", "id", "score") == [(1, "a", 200), (2, "b", 33)]


def test_budget_gives_one_row_at_least(spark):
    df = spark.createDataFrame([("x" * 50, 1), ("y" * 4, 2)], "id string, rank long")
    assert report.budget(df, "id", "rank", 1).count() == 1
    assert report.budget(df, "id", "rank", 20).count() == 2


def test_health_is_capped(spark):
    df = spark.createDataFrame([(9, 9, 9, 99, 9), (0, 0, 0, 10, 0)], "scary int, new_violations int, carried int, complexity int, hidden int")
    assert rows(report.health(df), "score") == [(25,), (100,)]


def test_drift_tells_resolved_from_displaced(spark):
    t = lambda *r: spark.createDataFrame(list(r), "id string, score long")
    got = report.drift(t(("a", 9), ("n", 5)), t(("a", 7), ("r", 6), ("d", 3)), t(("a", 9), ("n", 5), ("r", 1), ("d", 4)), t(("a", 7)))
    assert rows(got, "id", "status") == [("a", "worsened"), ("d", "displaced"), ("n", "new"), ("r", "resolved")]
