"""Records with line breaks in quotes, read by many tasks: the rows are those of a reader that goes through the file once."""

import csv
import io
import random

import pytest
from compare import plan

from tablelens import TableError
from tablelens.sources import delimited
from tablelens.sources.records import block_maps, block_states, records, with_states


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of a few hundred bytes."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def written(rows, sep=",", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=sep, quoting=quoting, lineterminator="\n").writerows(rows)
    return out.getvalue()


def random_rows(rng, n):
    bits = ["a", "b c", "\n", '"', ",", ";", '""', "5 in", "x" * 30, "\n\n", ',"', '",', '\n"', " "]
    for k in range(n):
        yield [str(k), "".join(rng.choice(bits) for _ in range(rng.randrange(7))), rng.choice(["", "y", "long " * rng.randrange(80)])]


def rows_of(df):
    return sorted(tuple("" if v is None else v for v in r) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_rows_as_a_sequential_reader_gives_them(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    rows = list(random_rows(rng, 150))
    path = tmp_path / "r.csv"
    path.write_text(written([["k", "t", "u"], *rows]), newline="")
    df = delimited.read_csv(spark, str(path), infer=False)
    expected = [tuple(r) for r in csv.reader(io.StringIO(path.read_text(), newline=""))][1:]
    clean = lambda rs: sorted(tuple("" if v.strip() in delimited.MISSING_TEXTS else v.strip() for v in r) for r in rs)
    assert clean(rows_of(df)) == clean(expected)
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 10


def test_states_of_blocks(spark, tmp_path, small_blocks):
    """A cell over several blocks, quotes that open nothing, and two files."""
    texts = {"a.csv": 'k,t\n1,"' + "line\n" * 200 + '"\n2,5" pipe\n3,"q ""x"" "\n' + "4,plain\n" * 100, "b.csv": "k,t\n" + '5,"b\nc"\n' * 80}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    lines = spark.read.text(str(tmp_path))
    states = block_states(block_maps(with_states(lines, ",")))
    for r in states.collect():
        text = texts[r.file.rsplit("/", 1)[1]]
        begin = text.find("\n", r.block) + 1 if r.block else 0  # the line at its beginning belongs to the block before
        assert r.begins_inside == (text[:begin].count('"') - text[:begin].count('5" pipe')) % 2
    found = sorted((r.file[-5:], r.record) for r in records(lines, ",").where("NOT first").collect())
    assert found == sorted([("a.csv", '1,"' + "line\n" * 200 + '"'), ("a.csv", '2,5" pipe'), ("a.csv", '3,"q ""x"" "')] + [("a.csv", "4,plain")] * 100 + [("b.csv", '5,"b\nc"')] * 80)
    assert sorted(r.record for r in records(lines, ",").where("first").collect()) == ["k,t", "k,t"]


def test_header_with_line_breaks(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text('\n"first\nname";n\n"x\ny";1\nz;2\n')
    df = delimited.read_csv(spark, str(path))
    assert df.columns == ["first\nname", "n"]
    assert sorted(tuple(r) for r in df.collect()) == [("x\ny", 1), ("z", 2)]


def test_surplus_cells_in_one_of_many_blocks(spark, tmp_path, small_blocks):
    path = tmp_path / "s.csv"
    path.write_text("k,t\n" + '1,"a\nb"\n' * 100 + '2,"c\nd",,\n' + '3,"e\nf"\n' * 100)
    with pytest.raises(TableError, match="^1 records"):
        delimited.read_csv(spark, str(path))


def test_an_encoding_other_than_utf8(spark, tmp_path, small_blocks):
    path = tmp_path / "e.csv"
    path.write_bytes("k,t\n".encode() + '1,"é\n€"\n'.encode("cp1252") * 60)
    assert {tuple(r) for r in delimited.read_csv(spark, str(path)).collect()} == {(1, "é\n€")}


def test_a_quoted_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    path = tmp_path / "many.csv"
    path.write_text("k,t\n" + '1,"a\nb"\n' * 500)
    df = delimited.read_csv(spark, str(path), infer=False)
    assert df.count() == 500
    assert "multiLine" not in plan(df)
