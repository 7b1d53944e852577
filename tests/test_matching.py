"""Keys in texts against plain containment."""

import random

from ledgerloom.plans import matching


def test_equals_containment(spark):
    rng = random.Random(3)
    words = ["the", "of", *(f"w{i}" for i in range(30))]
    texts = [(i, " ".join(rng.choices(words, weights=[40, 20, *[1] * 30], k=rng.randint(0, 25)))) for i in range(120)] + [(900, None), (901, "")]
    keys = [(i, " ".join(rng.choices(words, weights=[10, 5, *[1] * 30], k=rng.randint(1, 3)))) for i in range(200)] + [(900, None), (901, " "), (902, "the"), (903, "unheard of"), (904, "the"), (904, "the")]
    frames = spark.createDataFrame(texts, "text_id long, t string"), spark.createDataFrame(keys, "key_id long, k string")
    for few in (1000, 10):  # keys sent to all tasks, and keys that meet the texts by word
        got = {tuple(r) for r in matching.held(*frames, few).collect()}
        assert got == {(i, j) for i, t in texts if t for j, k in keys if k and k.strip() and f" {k} " in f" {t} "}


def test_no_cut_text_is_sent_to_all_tasks(spark):
    """Files of few bytes hold many words; only counted keys may be broadcast."""
    from ledgerloom.queries import QUERIES
    from tests.oracle import DATA

    texts = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id AS text_id", "text AS t")
    many = matching.held(texts, spark.range(20).selectExpr("id AS key_id", "concat('a ', id) AS k"), 10)
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
    plan = QUERIES["project_matcher"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan


def test_one_project_only(spark):
    projects = [(1, "Tunnel North", "TN-1"), (2, "Bridge", "B7"), (3, None, "X-99/A"), (4, "ab", None), (5, "Tunnel North", "")]
    docs = [(1, "works of Bridge, east"), (2, "the tunnel  NORTH of it"), (3, "no. x-99/a and x 99 a"), (4, "bridge and X-99/A"), (5, "ab b7 TN"), (6, None), (7, "bridges"), (8, "word " * 3000 + "bridge")]
    got = {tuple(r) for r in matching.match_projects(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(projects, "id long, name string, code string")).collect()}
    # the tunnel is two projects; "b7" and "ab" are too short
    assert got == {(1, 2), (3, 3), (8, 2)}
