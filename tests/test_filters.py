import pytest

from sedge.errors import InvalidParameter
from sedge.operators import filters, projection


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "en", 2023, ["a", "b"], ("x",)), (2, "pl", 2020, ["b"], ("y",)), (3, None, 2024, [], (None,))], "id int, lang string, year int, tags array<string>, d struct<k: string>")


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ('lang = "en"', [1]),
        ("lang = en AND year >= 2023", [1]),
        ("year > 2020 OR lang = pl", [1, 2, 3]),
        ("NOT (year = 2020)", [1, 3]),
        ("tags = b", [1, 2]),
        ("tags != b", [3]),
        ("lang IN [en, 'pl']", [1, 2]),
        ("lang NOT IN [en]", [2]),
        ("lang IS NULL", [3]),
        ("lang IS NOT NULL AND NOT year < 2021", [1]),
        ("d.k EXISTS", [1, 2]),
        ('d.k = "y"', [2]),
        ('lang = "e\\"n"', []),
        ("  ", [1, 2, 3]),
    ],
)
def test_filter(rows, text, ids):
    assert sorted(r.id for r in filters.apply_filter(rows, text).collect()) == ids


@pytest.mark.parametrize("text", ["lang =", "nope = 1", "lang = en garbage", "(lang = en", "year = abc", "lang IN en", "= 3"])
def test_filter_errors(rows, text):
    with pytest.raises(InvalidParameter) as e:
        filters.parse_filter(text, rows)
    assert e.value.field == "filter"


def test_filter_allow_list_and_injection(rows):
    with pytest.raises(InvalidParameter):
        filters.parse_filter("year = 2020", rows, ("lang",))
    assert filters.apply_filter(rows, 'lang = "x\' OR 1=1 --"').count() == 0


def test_filter_is_pushed_down(spark, sf_dir):
    df = filters.apply_filter(spark.read.parquet(f"{sf_dir}/documents.parquet"), 'lang = "en" AND n_chars >= 10').select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "GreaterThanOrEqual(n_chars,10)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_sort(rows):
    got = rows.orderBy(*filters.parse_sort(["lang:desc", " "], rows), "id").collect()
    assert [r.id for r in got] == [2, 1, 3]
    for bad in ("lang", "lang:up", "nope:asc"):
        with pytest.raises(InvalidParameter):
            filters.parse_sort([bad], rows)


def test_parameters():
    assert filters.normalize_weights(0.7, 0.3)[0] == 0.699999988079071
    for pair in ((0, 0), (-1, 1), (float("nan"), 1), (2, 0)):
        with pytest.raises(InvalidParameter):
            filters.normalize_weights(*pair)
    with pytest.raises(InvalidParameter):
        filters.ensure_range("limit", 101, 1, 100)
    with pytest.raises(InvalidParameter):
        filters.ensure_text("q", " a ", 2)
    with pytest.raises(InvalidParameter):
        filters.ensure_list("fields", ["x"] * 65, 64)
    assert filters.index_name(" Main ") == "main"


def test_projection(spark):
    df = spark.createDataFrame([('{"items":[{"name":"first"}],"n":1.5}',)], "record string")
    out = projection.project_json(df, "record", ["items.0.name", "items.1.name", "a..b", " "]).first()["projected"]
    assert out == '{"items.0.name":"first"}'
    assert projection.project_json(df, "record", []).first()["projected"] == df.first()["record"]
    rows = spark.createDataFrame([("i", "doc", "d", "t", float("nan"))], "id string, doc_type string, doc_id string, title string, score double")
    got = projection.rows(rows, ["title"]).first()
    assert list(got.asDict()) == ["title", "id", "doc_type", "doc_id", "score"] and got.score is None
