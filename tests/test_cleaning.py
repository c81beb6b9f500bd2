from orderlens.operators import cleaning


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_trim_strips_blanks_not_tabs(spark):
    df = spark.createDataFrame([("  a b  ", 1), ("\tx\t", 2)], "s string, n int")
    got = [tuple(r) for r in cleaning.trim_columns(df).collect()]
    assert got == [("a b", 1), ("\tx\t", 2)]


def test_collapse_whitespace_string_columns_only(spark):
    df = spark.createDataFrame([(" a \t b  c ", 1)], "s string, n int")
    out = cleaning.collapse_whitespace(df)
    assert out.first()["s"] == " a b c "
    assert dict(out.dtypes)["n"] == "int"
    assert dict(cleaning.collapse_whitespace(df, all_columns=True).dtypes)["n"] == "string"


def test_replace_is_whole_cell_and_case_sensitive(spark):
    df = spark.createDataFrame([("são paulo",), ("São Paulo",), ("a são paulo",), (None,)], "city string")
    got = [r[0] for r in cleaning.replace_values(df, {"são paulo": "sao paulo"}).collect()]
    assert got == ["sao paulo", "São Paulo", "a são paulo", None]


def test_drop_nulls_counts_nan_and_pushes_down(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (2, None), (None, 3.0), (4, float("nan"))], "a int, b double")
    assert [r["a"] for r in cleaning.drop_nulls(df).collect()] == [1]
    assert sorted(r["a"] for r in cleaning.drop_nulls(df, ["b"]).collect() if r["a"]) == [1]
    path = str(tmp_path / "t")
    df.write.parquet(path)
    plan = _plan(cleaning.drop_nulls(spark.read.parquet(path)))
    assert "PushedFilters: [IsNotNull(a), IsNotNull(b)" in plan


def test_fill_numeric_leaves_strings(spark):
    df = spark.createDataFrame([(None, None, None)], "a int, b double, s string")
    r = cleaning.fill_numeric(df, 0).first()
    assert (r.a, r.b, r.s) == (0, 0.0, None)
    r = cleaning.fill_numeric(df, 0, subset=["b"]).first()
    assert (r.a, r.b) == (None, 0.0)


def test_lookup_translate_keeps_untranslated_as_null(spark):
    products = spark.createDataFrame([("p1", "beleza"), ("p2", "unknown_pt"), ("p3", None)], "id string, cat string")
    lookup = spark.createDataFrame([("beleza", "health_beauty")], "cat string, cat_en string")
    got = {r.id: r.cat for r in cleaning.lookup_translate(products, lookup, "cat", "cat_en").collect()}
    assert got == {"p1": "health_beauty", "p2": None, "p3": None}


def test_conditional_override_keeps_null_type(spark):
    df = spark.createDataFrame([("not_defined", 3), ("boleto", 2), (None, 5)], "payment_type string, payment_installments int")
    got = [tuple(r) for r in cleaning.zero_undefined_installments(df).collect()]
    assert got == [("not_defined", 0), ("boleto", 2), (None, 5)]


def test_dedupe_rows_nan_equal(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, float("nan")), (1, 0.0), (1, -0.0)], "a int, b double")
    assert cleaning.dedupe_rows(df).count() == 2


def test_copy_column(spark):
    df = spark.createDataFrame([("SP", None)], "a string, b string")
    assert cleaning.copy_column(df, "b", "a").first().b == "SP"


def test_lookup_column_is_a_left_join(spark):
    from orderlens.operators.relational import lookup_column
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    lookup = spark.createDataFrame([(1, "a"), (2, "b")], "lk int, lv string")
    got = map(tuple, lookup_column(df, "k", lookup, "lk", "lv", "v").collect())
    assert sorted(got, key=str) == sorted([(1, "a"), (2, "b"), (3, None), (None, None)], key=str)


def test_dedupe_keys_keep_a_defined_row(spark):
    rows = [(1, float(i)) for i in range(200)]
    for order in (rows, rows[::-1], rows[100:] + rows[:100]):
        df = spark.createDataFrame(order, "k int, v double").repartition(4)
        assert [tuple(r) for r in cleaning.dedupe_rows(df, ["k"]).collect()] == [(1, 0.0)]


def test_lookup_column_repeated_keys_keep_join_semantics(spark):
    from orderlens.operators.relational import lookup_column
    df = spark.createDataFrame([(1,), (2,)], "k int")
    lookup = spark.createDataFrame([(1, "a"), (1, "b")], "lk int, lv string")
    got = sorted(map(tuple, lookup_column(df, "k", lookup, "lk", "lv", "v").collect()), key=str)
    assert got == [(1, "a"), (1, "b"), (2, None)]


def test_spellings_are_one_by_choice(spark):
    cities = ["são paulo", "SAO PAULO", "Sao Paulo", "rio", "Rio", None, "sao  paulo"]
    df = spark.createDataFrame([(i, c, i) for i, c in enumerate(cities)], "id int, city string, _value int")
    unified = {r.id: r.city for r in cleaning.unify_spellings(df, ["city"]).collect()}
    assert unified == {0: "SAO PAULO", 1: "SAO PAULO", 2: "SAO PAULO", 3: "Rio", 4: "Rio", 5: None, 6: "sao  paulo"}
    assert cleaning.unify_spellings(df, ["city"]).columns == df.columns
    assert {r.id: r.city for r in cleaning.unify_spellings(df, ["city"], "UTF8_LCASE").collect()}[0] == "são paulo"
    assert df.groupBy("city").count().count() == 7                     # all else compares byte by byte


def test_lookup_by_collation(spark):
    lookup = spark.createDataFrame([("Eletrônicos", "electronics"), ("ELETRONICOS", "devices"), ("moveis", "furniture")], "k string, english string")
    df = spark.createDataFrame([(1, "eletronicos"), (2, "Móveis"), (3, None), (4, "other"), (5, "moveis")], "id int, k string")
    loose = {r.id: r.k for r in cleaning.lookup_translate(df, lookup, "k", "english", collation=cleaning.SPELLINGS).collect()}
    assert loose == {1: "devices", 2: "furniture", 3: None, 4: None, 5: "furniture"}
    exact = {r.id: r.k for r in cleaning.lookup_translate(df, lookup, "k", "english").collect()}
    assert exact == {1: None, 2: None, 3: None, 4: None, 5: "furniture"}
