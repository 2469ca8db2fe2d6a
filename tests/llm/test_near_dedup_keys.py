"""A key with several texts is one document with the links of all of them."""

from raywalk.llm import near_dedup

A, B, C = (" ".join(f"{letter}{i}" for i in range(20)) for letter in "abc")


def linked(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.link(df).collect())


def test_a_key_links_the_classes_of_its_texts(spark):
    got = linked(spark, [(3, A), (5, A), (5, B), (7, B), (8, C)])
    assert got == [(3, 16, 3, True), (5, 16, 3, False), (5, 16, 3, False), (7, 16, 3, False), (8, 16, 8, True)]


def test_a_key_that_is_first_of_no_class(spark):
    got = linked(spark, [(1, A), (2, B), (9, A), (9, B), (9, None), (4, None), (4, C), (6, "")])
    assert {(k, c) for k, _, c, _ in got} == {(1, 1), (2, 1), (9, 1), (4, 4), (6, 6)}
    assert [k for k, _, _, kept in got if kept] == [1, 4, 4, 6]


def test_links_of_two_keys_run_on(spark):
    got = linked(spark, [(1, A), (2, A), (2, B), (3, B), (3, C), (4, C)])
    assert {c for _, _, c, _ in got} == {1} and len(got) == 6
