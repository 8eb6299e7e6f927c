import pytest
from pyspark.sql import functions as F

from tablelens import TableError
from tablelens.operators import catalogue, diff
from tablelens.session import scratch_path
from tablelens.sources import delimited, versions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "name, data, header, want",
    [
        ("semicolon", "id;näme;x\n1;é;2.5\n2;NA;\n".encode(), ["id", "näme", "x"], [(1, "é", 2.5), (2, None, None)]),
        ("bom", b"\xef\xbb\xbfid,name\n1,a\n2,\n", ["id", "name"], [(1, "a"), (2, None)]),
        ("cp1252", b"id,name\n1,caf\xe9 \x80\n2,x\n", ["id", "name"], [(1, "café €"), (2, "x")]),
        ("latin1", b"id,name\n1,caf\xe9 \x81\n", ["id", "name"], [(1, "café \x81")]),
        ("tab", b"a\tb\n1\tTrue\n\tfalse\n", ["a", "b"], [(1, True), (None, False)]),
        ("single", b"a\n1\n2\n", ["a"], [(1,), (2,)]),
        ("quoted", b'a,b\n"x, ""y""",2\n', ["a", "b"], [('x, "y"', 2)]),
    ],
)
def test_csv(spark, tmp_path, name, data, header, want):
    path = tmp_path / f"{name}.csv"
    path.write_bytes(data)
    assert delimited.raw_header(spark, str(path)) == header
    assert rows(delimited.read_csv(spark, str(path))) == sorted(want, key=str)


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "breaks.csv"
    path.write_text('id;note;n\n1;"two\nlines; one ""cell""";3\n2;5" pipe;4\n3;short\n')
    got = rows(delimited.read_csv(spark, str(path)))
    assert got == sorted([(1, 'two\nlines; one "cell"', 3), (2, '5" pipe', 4), (3, "short", None)], key=str)


@pytest.mark.parametrize("surplus", ["1500,v,EXTRA", "1500,v,,EXTRA", '1500,"v\nw",,EXTRA', '1500,"v\nw",EXTRA'])
def test_csv_surplus_cells_are_an_error(spark, tmp_path, surplus):
    path = tmp_path / "surplus.csv"
    path.write_text("id,v\n" + "\n".join(surplus if i == 1500 else f"{i},v{i}" for i in range(3000)) + "\n")
    with pytest.raises(TableError, match="^1 records"):
        versions.import_csv(spark, str(path), scratch_path(spark, "v"), "d")


def test_csv_delimiter_is_judged_on_all_lines(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_text("a,b;c\n" + "x,y;1\n" * 1500 + "1,2,3;4\n")
    assert delimited.read_csv(spark, str(path)).columns == ["a,b", "c"]


def test_failed_import_leaves_no_version(spark, tmp_path):
    path, root = tmp_path / "none.csv", scratch_path(spark, "v")
    path.write_text("a,b\n")
    with pytest.raises(TableError):
        versions.import_csv(spark, str(path), root, "d")
    assert versions.current_version(spark, root, "d") is None


def test_fingerprint_knows_names_and_types(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("1", "x")], "zz string, yy string")
    assert versions.fingerprint(a).first() != versions.fingerprint(b).first()


@pytest.mark.parametrize("header", ["a,,c", "a, a,c", "a,Unnamed: 1,c", "  ,b,c"])
def test_bad_headers(spark, tmp_path, header):
    path = tmp_path / "bad.csv"
    path.write_text(f"{header}\n1,2,3\n")
    with pytest.raises(TableError):
        delimited.read_csv(spark, str(path))


def test_header_without_rows(spark, tmp_path):
    path = tmp_path / "none.csv"
    path.write_text("a,b\n")
    with pytest.raises(TableError):
        delimited.validate_headers(delimited.read_csv(spark, str(path)), ["a", "b"])


def test_versions_and_fingerprint(spark, shelves):
    root = scratch_path(spark, "v")
    with pytest.raises(TableError):
        versions.read_version(spark, root, "d")
    assert versions.write_version(shelves, root, "d", "UPLOADED") == 1
    assert versions.write_version(shelves.where("shelf > 1"), root, "d") == 2
    assert versions.write_version(shelves, root, "other") == 1
    assert versions.read_version(spark, root, "d").count() == 4
    assert versions.read_version(spark, root, "d", 1).count() == 5
    with pytest.raises(TableError):
        versions.read_version(spark, root, "d", 3)
    current = versions.read_catalogue(spark, root).where("is_current")
    assert {(r["dataset_id"], r["version_number"], r["rows_count"]) for r in current.collect()} == {("d", 2, 4), ("other", 1, 5)}

    same = versions.fingerprint(shelves.orderBy(F.desc("shelf")).repartition(3)).first()
    assert same == versions.fingerprint(shelves).first()
    assert versions.fingerprint(shelves.withColumn("height", F.col("height") + 1)).first() != same


def test_fingerprint_sees_cell_borders(spark):
    a = spark.createDataFrame([("ab", "c"), (None, "")], "x string, y string")
    b = spark.createDataFrame([("a", "bc"), ("", None)], "x string, y string")
    assert versions.fingerprint(a).first() != versions.fingerprint(b).first()


def test_diff_of_equal_versions_is_zero(shelves):
    assert tuple(diff.row_changes(shelves, shelves).first()) == (0, 0, 0)
    m = diff.diff_metrics(shelves, shelves).first()
    assert all(m[f"{n}_difference"] == 0 for n in ("rows", "columns", "missing", "duplicates", "quality"))


def test_diff_nulls_and_numbers(spark):
    v1 = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "a int, b string")
    v2 = spark.createDataFrame([(1.0, ""), (2.0, "x")], "a double, b string")
    assert rows(diff.rows_added(v1, v2)) == [(1.0, "")]
    assert rows(diff.rows_removed(v1, v2)) == [(1.0, None)]
    assert diff.rows_added(v1, v2, null_as_empty=True).count() == 0
    assert tuple(diff.row_changes(v1, v2).first()) == (1, 1, 0)


def test_diff_is_symmetric_and_handles_other_widths(spark, shelves):
    other = shelves.withColumn("books", F.col("books") + F.when(F.col("shelf") == 2, 1).otherwise(0))
    assert rows(diff.rows_added(shelves, other)) == rows(diff.rows_removed(other, shelves))
    narrow = shelves.select("shelf", "subject")
    assert tuple(diff.row_changes(shelves, narrow).first())[:2] == (5, 5)
    assert diff.rows_added(shelves, narrow).count() == 5
    text = shelves.withColumn("shelf", F.col("shelf").cast("string"))
    assert diff.rows_added(shelves, text).count() == 5


def test_long_texts_compare_whole(spark):
    a = spark.createDataFrame([("x" * 5000 + "1",), ("x" * 5000 + "1",)], "t string")
    b = spark.createDataFrame([("x" * 5000 + "2",)], "t string")
    assert tuple(diff.row_changes(a, b).first())[:2] == (1, 1)


def test_delete_counts_foreign_unknown_and_repeated(spark):
    datasets = spark.createDataFrame([("1", "me"), ("2", "me"), ("3", "you")], "dataset_id string, user_id string")
    parts = spark.createDataFrame([("1",), ("1",), ("3",)], "dataset_id string")
    ids = spark.createDataFrame([("1",), ("1",), ("3",), ("9",)], "dataset_id string")
    left, counts = catalogue.delete_datasets({"datasets": datasets, "versions": parts}, ids, "me")
    assert counts.first().asDict() == {"deleted": 1, "failed": 3, "total": 4}
    assert rows(left["versions"]) == [("3",)]
    assert {r["dataset_id"] for r in left["datasets"].collect()} == {"2", "3"}


def test_dashboard_without_profiles_or_versions(spark):
    datasets = spark.createDataFrame([("1", "me", "n")], "dataset_id string, user_id string, dataset_name string")
    versions_ = spark.createDataFrame([], "dataset_id string, version_number int, file_size bigint, status string, is_current boolean")
    profiles = spark.createDataFrame([], "dataset_id string, quality_score double")
    k = catalogue.kpis(datasets, versions_, profiles).first()
    assert tuple(k) == (1, 0, 0, 100.0)
    assert catalogue.status_distribution(datasets, versions_).first()["status"] == "UPLOADED"
    assert catalogue.storage_breakdown(datasets, versions_).first()["percentage"] == 0.0
