from plumbline.operators import filters


def test_any_role_and_prefixes(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "b", "b"), (3, None, "c"), (4, "d", None), (5, "a", "c")], "id long, src string, dst string")
    keys = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "key string")
    found = sorted((r.key, r.id, r.roles) for r in filters.any_role(rows, ["src", "dst"], keys).collect())
    assert found == [("a", 1, ["src"]), ("a", 5, ["src"]), ("b", 1, ["dst"]), ("b", 2, ["src", "dst"])]
    texts = spark.createDataFrame([("a%b",), ("a%",), ("axb",), (None,), ("",)], "k string")
    assert sorted(r.k for r in filters.with_prefix(texts, "k", "a%").collect()) == ["a%", "a%b"] and filters.with_prefix(texts, "k", "").count() == 4
