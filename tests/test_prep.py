import math

import pytest
from pyspark.sql import functions as F

from brindle.operators import prep
from brindle.operators.base import NotFitted, Options, Verbosity, model_load, model_save
from brindle.sources.tables import in_memory, read_delimited

N = None


def column(df, name, by="_id"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_onehot_integers(spark):
    df = in_memory(spark, [[3], [6], [3], [4]], ["x"], ["int"])
    m = prep.OneHotEncoder().fit(df, "x")
    assert column(m.predict(), "encoded") == [[True, False, False, False], [False, False, False, True], [True, False, False, False], [False, True, False, False]]
    assert column(m.inverse_transform(m.predict()), "decoded") == [3, 6, 3, 4]


def test_onehot_infrequent_and_missing(spark):
    df = in_memory(spark, [[3], [6], [N], [3], [4]], ["x"], ["int"])
    m = prep.OneHotEncoder(categories=[3, 4, 7], handle_unknown="infrequent", other_categories_name=99).fit(df, "x")
    got = column(m.predict(), "encoded")
    assert got[0] == [True, False, False, False] and got[1] == [False, False, False, True] and got[2] == [None] * 4
    assert column(m.inverse_transform(m.predict()), "decoded") == [3, 99, None, 3, 4]


def test_onehot_of_probabilities(spark):
    df = spark.createDataFrame([(0, {"e": 0.8, "zz": 0.2}), (1, {"e": 0.2, "g": 0.7}), (2, {"b": 0.4, "e": 0.6})], "_id long, p map<string,double>")
    y = in_memory(spark, [["e"], ["g"], ["b"]], ["y"], ["string"])
    m = prep.OneHotEncoder().fit(y, "y")
    assert column(m.transform_pmf(df, "p"), "encoded") == [[0.8, 0.0, 0.0], [0.2, 0.7, 0.0], [0.6, 0.0, 0.4]]


def test_ordinal(spark):
    df = in_memory(spark, [["3"], ["6"], [N], ["3"], ["4"]], ["x"], ["string"])
    m = prep.OrdinalEncoder(categories=["3", "7", "4"], handle_unknown="infrequent").fit(df, "x")
    assert column(m.predict(), "encoded") == [1, 4, None, 1, 3]
    m = prep.OrdinalEncoder(handle_unknown="missing").fit(in_memory(spark, [["1"], ["2"], ["3"]], ["x"], ["string"]), "x")
    assert column(m.predict(in_memory(spark, [["1"], ["4"], ["3"]], ["x"], ["string"])), "encoded") == [1, None, 3]


def test_unknown_is_an_error(spark):
    m = prep.OrdinalEncoder().fit(in_memory(spark, [["a"], ["b"]], ["x"], ["string"]), "x")
    with pytest.raises(Exception, match="unknown category"):
        m.predict(in_memory(spark, [["c"]], ["x"], ["string"])).collect()


def test_scalers(spark):
    df = in_memory(spark, [[1, 10, 100], [2, 20, 200], [3, 30, 300]], ["a", "b", "c"])
    m = prep.Scaler().fit(df, ["a", "b", "c"])
    assert column(m.predict(), "a") == pytest.approx([-1.224744871391589, 0, 1.224744871391589])
    assert column(m.inverse_transform(m.predict()), "c") == pytest.approx([100, 200, 300])
    k = prep.Scaler(method=prep.MinMax(output_range=(-1.0, 1.0)), skip=("b",)).fit(df, ["a", "b", "c"])
    assert column(k.predict(), "a") == [-1, 0, 1] and column(k.predict(), "b") == [10, 20, 30]


def test_constant_and_missing_columns(spark):
    df = in_memory(spark, [[1, 5], [N, 5]], ["a", "b"])
    got = prep.Scaler(method=prep.MinMax()).fit(df, ["a", "b"]).predict().orderBy("_id").collect()
    assert math.isnan(got[0]["b"]) and got[1]["a"] is None
    assert prep.columns_with_missing(df, ["a", "b"]) == ["a"]


def test_pca(spark):
    df = in_memory(spark, [[1, 8], [4.5, 5.5], [9.5, 0.5]], ["a", "b"])
    m = prep.PCAEncoder(encoded_size=1).fit(df, ["a", "b"])
    assert abs(m.info()["prop_explained_var"] - 0.9974) < 1e-3
    assert len(column(m.predict(), "encoded")[0]) == 1


def test_partition_and_folds(spark):
    df = in_memory(spark, [[10 + i, 30 + i] for i in range(10)], ["x", "y"])
    a, b = prep.partition(df, [0.7, 0.3], shuffle=False)
    assert column(b, "y") == [37.0, 38.0, 39.0] and a.count() == 7
    a, b = prep.partition(df, [0.7, 0.3])
    assert sorted(column(a, "x") + column(b, "x")) == [10.0 + i for i in range(10)]
    assert column(prep.partition(df, [0.7, 0.3])[1], "x") == column(b, "x")
    with pytest.raises(ValueError):
        prep.partition(df, [0.7, 0.2])
    for train, valid in prep.KFold(3, 2).split(df):
        assert train.count() + valid.count() == 10 and not set(column(train, "x")) & set(column(valid, "x"))
    assert {r["batch"]: r["count"] for r in prep.batches(df, 3).groupBy("batch").count().collect()} == {0: 3, 1: 3, 2: 3}
    assert prep.batches(df, 30).count() == 10
    assert prep.partition_columns(["a", "b", "c", "d"], [0.5, 0.5], shuffle=False) == [["a", "b"], ["c", "d"]]


def test_numbered_with_ties_and_nulls(spark):
    df = in_memory(spark, [[v] for v in [2, 2, N, 1, 2, 3]], ["v"])
    got = prep.numbered(df, F.col("v"), F.col("_id"))
    assert [r["_id"] for r in got.orderBy("_n").collect()] == [2, 3, 0, 1, 4, 5] and sorted(column(got, "_n")) == list(range(6))
    assert prep.numbered(df.where("false"), F.col("v")).count() == 0
    words = in_memory(spark, [["b"], ["a"], ["c"]], ["w"], ["string"])
    assert [r["w"] for r in prep.numbered(words, F.col("w")).orderBy("_n").collect()] == ["a", "b", "c"]


def test_shapes(spark):
    df = in_memory(spark, [["b"], ["a"], ["b"]], ["x"], ["string"])
    assert [r.value for r in prep.single_unique(df, "x").collect()] == ["b", "a"]
    assert prep.permutations([1, 2, 1], keep_structure=True) == [[1, 2, 1], [2, 1, 2]]
    with pytest.raises(Exception, match="missing"):
        prep.disallow_missing(in_memory(spark, [[N]], ["x"])).collect()


def test_api(spark, tmp_path):
    df = in_memory(spark, [[1.0], [3.0]], ["a"])
    m = prep.Scaler()
    with pytest.warns(UserWarning):
        assert m.predict() is None
    with pytest.raises(NotFitted):
        m.transform(df)
    with pytest.raises(TypeError):
        prep.Scaler(nothing=1)
    m.fit(df, ["a"])
    path = str(tmp_path / "models")
    model_save(spark, path, first=m)
    model_save(spark, path, second=m.copy())
    assert set(model_load(spark, path)) == {"first", "second"}
    assert column(model_load(spark, path, "first").predict(df), "a") == [-1.0, 1.0]
    assert m.reset().fitted is False and Verbosity.from_steps(1) == Verbosity.LOW and Options().seed == 123


def test_delimited(spark, tmp_path):
    p = tmp_path / "x.txt"
    p.write_text("1.0 ?  'a b'\n2.5 3 c\n")
    got = read_delimited(spark, str(p), ["x", "y", "z"], kinds=["double", "double", "string"], repeated_blanks=True).orderBy("_id").collect()
    assert (got[0]["x"], got[0]["y"], got[0]["z"]) == (1.0, None, "'a b'") and got[1]["y"] == 3.0


def test_shapes_and_types(spark):
    df = spark.range(2).select("id", F.lit("a").alias("k"))
    assert not any(f.nullable for f in df.schema) and all(f.nullable for f in prep.allow_missing(df).schema)
    assert prep.allow_missing(df).collect() == df.collect() and prep.column_types(df) == {"id": "bigint", "k": "string"}
    row = prep.row_vector(spark, [1, 2.5])
    assert row.first()["features"] == [1.0, 2.5] and [r["x"] for r in prep.as_column(row, "features").collect()] == [1.0, 2.5]
