from pyspark.sql import functions as F

from logloom.llm.exact_dedup import drop_copies, exact_groups


def test_longest_then_smallest_stays(docs):
    rows = {r["doc_id"]: r for r in exact_groups(docs([(5, "a b"), (1, "ab"), (2, "a b"), (3, "\ta\nb"), (4, "c"), (6, None), (7, " ")])).collect()}
    assert [rows[i]["keep_id"] for i in (1, 2, 3, 5)] == [3, 3, 3, 3]
    assert rows[3]["kept"] and not rows[1]["kept"] and rows[1]["group_size"] == 4
    assert rows[4]["keep_id"] == 4 and rows[4]["group_size"] == 1
    assert rows[6]["keep_id"] == 7 and rows[7]["text_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert exact_groups(docs([(9, "a b"), (8, "b a"), (7, "a  b")])).where("kept").count() == 2


def test_colliding_digests_are_told_apart_by_content(docs):
    found = {r["doc_id"]: r for r in exact_groups(docs([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")]), digest=lambda c: F.when(c == "c", "y").otherwise("x")).collect()}
    assert [found[i]["keep_id"] for i in range(1, 6)] == [1, 1, 3, 3, 5]
    assert found[1]["group_size"] == found[3]["group_size"] == 2


def test_a_hot_group_and_edges(docs, clashing):
    rows = [(i, "same text") for i in range(3000)] + [(3000 + i, f"other {i}") for i in range(100)]
    out = exact_groups(docs(rows))
    assert out.where("kept").count() == 101 and out.where("keep_id = 0 and group_size = 3000").count() == 3000
    assert exact_groups(docs([])).count() == 0 and drop_copies(docs([])).count() == 0
    some = clashing([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, "a" * 1_000_000), (3, "a" * 1_000_000 + " ")])
    kept = drop_copies(some)
    assert kept.columns == some.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
    assert exact_groups(some).count() == 6
