"""CSV files of unknown encoding and delimiter."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import TableError
from ..functions.columns import COLUMNS_PER_SCAN, ref
from ..operators.profile import size_estimate
from ..session import materialize
from .records import left_open, records, without_quoted

# Delimiters in the order in which they are tried.
DELIMITERS = (",", ";", "\t")

# Cell texts that count as missing.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Bytes that cp1252 leaves undefined.
UNDEFINED_CP1252 = "[\\u0081\\u008D\\u008F\\u0090\\u009D]"


def detect_encoding(lines: DataFrame) -> str:
    """First of utf-8, cp1252 and latin-1 that can decode the whole file; ``lines`` come from the text source."""
    row = lines.agg(*_undecodable()).first()
    return _encoding(row)


def _undecodable() -> list[Column]:
    as_latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return [
        F.count_if(~F.is_valid_utf8("value")).alias("not_utf8"),
        F.count_if(as_latin.rlike(UNDEFINED_CP1252)).alias("not_cp1252"),
    ]


def _encoding(row) -> str:
    if not row["not_utf8"]:
        return "utf-8"
    return "cp1252" if not row["not_cp1252"] else "latin-1"  # latin-1 decodes any byte


def charset(encoding: str) -> str:
    """Character set under which Spark reads the encoding.

    Spark has no cp1252; it is read as ISO-8859-1, from which it differs only
    in the characters of ``CP1252_ONLY``.
    """
    return {"utf-8": "UTF-8", "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1"}.get(encoding.lower(), encoding)


# Characters 0x80 to 0x9F as ISO-8859-1 and as cp1252 read them.
CP1252_ONLY = [
    (bytes([b]).decode("latin-1"), bytes([b]).decode("cp1252"))
    for b in range(0x80, 0xA0)
    if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
]


def _as_cp1252(c: Column) -> Column:
    return F.translate(c, "".join(a for a, _ in CP1252_ONLY), "".join(b for _, b in CP1252_ONLY))


def _fields(record: str, sep: str) -> list[str]:
    return next(csv.reader(io.StringIO(record, newline=""), delimiter=sep))


def _opens(text: str, sep: str) -> bool:
    """Whether a cell in quotes is open at the end of a text."""
    plain = text.removeprefix("\ufeff").replace('""', "")
    return re.search(f'(^|{sep})"', re.sub(f'(^|{sep})"[^"]*"', r"\1", plain)) is not None


def _opening(lines: DataFrame, seps: Sequence[str]) -> dict[str, str]:
    """Per delimiter the first record that is not blank, as ISO-8859-1 reads it, line breaks in quotes included."""
    raw = lines.select(F.col("value").cast("binary"))
    out: dict[str, str] = {}
    taken = 1
    while len(out) < len(seps):
        found = [bytes(r[0]).decode("latin-1") for r in raw.take(taken)]
        if len(found) < taken or any(x.strip() for x in found):
            begin = next((i for i, x in enumerate(found) if x.strip()), None)
            if begin is None:
                raise TableError("the file has no header")
            for d in seps:
                ends = (n for n in range(begin + 1, len(found) + 1) if not _opens("\n".join(found[begin:n]), d))
                end = next(ends, len(found) if len(found) < taken else None)
                if end is not None:
                    out.setdefault(d, "\n".join(found[begin:end]))
        taken *= 8
    return out


def _cells(record: Column, sep: str) -> Column:
    plain = without_quoted(record, sep)
    return F.length(plain) - F.length(F.replace(plain, F.lit(sep), F.lit(""))) + 1


@dataclass(frozen=True)
class Layout:
    """How a file is to be read."""

    encoding: str
    sep: str
    header: list[str]
    multi_line: bool


def detect_layout(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, multi_line: bool = False
) -> Layout:
    """Encoding, delimiter and line breaks inside quotes, judged on the whole file by one scan of its lines.

    The delimiter is the first that splits the header while no record has more
    cells than the header; comma if none splits it.  If a cell in quotes is
    open at the end of a line, records are counted instead of lines.  Records
    with more cells than the header are an error, as reading would lose them.
    """
    return _layout_and_records(spark, path, sep, encoding, multi_line)[0]


def _layout_and_records(
    spark: SparkSession, path: str, sep: str | None, encoding: str | None, multi_line: bool
) -> tuple[Layout, DataFrame | None]:
    """The layout and, if cells hold line breaks, the records without the header."""
    lines = spark.read.text(path)
    tried = [sep] if sep else list(DELIMITERS)
    opening = _opening(lines, tried)
    width = {d: len(_fields(opening[d].removeprefix("\u00ef\u00bb\u00bf"), d)) for d in tried}
    value = F.col("value")
    counts = list(_undecodable())
    for i, d in enumerate(tried):
        counts.append(F.count_if(_cells(value, d) > width[d]).alias(f"surplus{i}"))
        counts.append(F.count_if(left_open(value, d)).alias(f"open{i}"))
    row = lines.agg(*counts).first()
    encoding = encoding or _encoding(row)
    problem = None
    for i, d in enumerate(tried):
        if width[d] == 1 and not (sep or d == tried[0] and max(width.values()) == 1):
            continue
        header = _fields(opening[d].encode("latin-1").decode(encoding).removeprefix("\ufeff"), d)
        found, surplus = None, row[f"surplus{i}"]
        if multi_line or row[f"open{i}"]:
            decoded = lines if encoding == "utf-8" else lines.withColumn("value", F.decode(value.cast("binary"), charset(encoding)))
            found = records(decoded, d).where("NOT first").select("record")
            surplus = found.where(_cells(F.col("record"), d) > len(header)).count()
        if not surplus:
            return Layout(encoding, d, header, found is not None), found
        problem = problem or f"{surplus} records have more than {len(header)} cells"
    raise TableError(problem)


def _cells_of(found: DataFrame, header: Sequence[str], sep: str) -> DataFrame:
    """The text columns of records."""
    names = [f"c{i}" for i in range(len(header))]
    schema = ", ".join(f"{n} string" for n in names)
    cells = F.from_csv("record", schema, {"sep": sep, "quote": '"', "escape": '"'})
    return found.select(cells.alias("cells")).select(*[F.col(f"cells.{n}").alias(h) for n, h in zip(names, header, strict=True)])


def _read(spark: SparkSession, path: str, schema: str, sep: str, encoding: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=sep, encoding=charset(encoding), quote='"', escape='"', enforceSchema=True)


def raw_header(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> list[str]:
    """The header cells as they stand in the file; Spark would rename blank and repeated ones."""
    return detect_layout(spark, path, sep, encoding).header


def check_header(header: Sequence[str]) -> None:
    """Reject blank, unnamed or repeated headers."""
    names = [h.strip() for h in header]
    if any(n == "" or "Unnamed:" in n for n in names):
        raise TableError("a column has no header")
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise TableError(f"headers occur more than once: {', '.join(repeated)}")


def validate_headers(df: DataFrame, header: Sequence[str]) -> None:
    """Reject an empty table and bad headers; ``header`` is the raw one."""
    check_header(header)
    if df.isEmpty():
        raise TableError("the table has no rows")


def _present(c: Column) -> Column:
    return F.when(~c.isin(*MISSING_TEXTS), c)


def infer_types(df: DataFrame) -> DataFrame:
    """Turn text columns into bigint, double or boolean where every present cell fits.

    A scan tests all types of ``COLUMNS_PER_SCAN`` columns.
    """
    names = df.columns
    tests = {
        "bigint": lambda c: F.trim(c).rlike("^[+-]?[0-9]+$") & F.trim(c).try_cast("bigint").isNotNull(),
        "double": lambda c: F.trim(c).try_cast("double").isNotNull() & ~F.trim(c).rlike("[dDfF]$"),
        "boolean": lambda c: F.lower(F.trim(c)).isin("true", "false"),
    }
    out = []
    for start in range(0, len(names), COLUMNS_PER_SCAN):
        batch, checks = names[start : start + COLUMNS_PER_SCAN], []
        for i, n in enumerate(batch):
            c = _present(ref(n))
            checks.append(F.count(c).alias(f"n{i}"))
            checks += [F.count_if(c.isNotNull() & ~test(c)).alias(f"{t}{i}") for t, test in tests.items()]
        row = df.agg(*checks).first()
        for i, n in enumerate(batch):
            c = _present(ref(n))
            fits = [t for t in tests if row[f"n{i}"] and row[f"{t}{i}"] == 0]
            out.append((F.trim(c).cast(fits[0]) if fits else c).alias(n))
    return df.select(*out)


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str | None = None,
    multi_line: bool = False,
    infer: bool = True,
) -> DataFrame:
    """Read CSV, finding encoding and delimiter unless they are given.

    Cells are read as text with the raw header as column names, missing texts
    become null, and types are inferred from all rows.  Line breaks inside
    quotes are found (or announced by ``multi_line``); files with them are read
    by many tasks too.  The text is judged once and parsed once: cells are
    stored, and types inferred from what is stored.  Records with fewer cells
    than the header end in nulls, those with more are an error.
    """
    layout, found = _layout_and_records(spark, path, sep, encoding, multi_line)
    check_header(layout.header)
    if found is None:
        schema = ", ".join(f"`{h.replace('`', '``')}` string" for h in layout.header)
        df = _read(spark, path, schema, layout.sep, layout.encoding)
    else:
        df = _cells_of(found, layout.header, layout.sep)
    if layout.encoding == "cp1252":
        df = df.select(*[_as_cp1252(ref(n)).alias(n) for n in df.columns])
    if infer:
        return infer_types(materialize(df, "csv-cells"))
    return df.select(*[_present(ref(n)).alias(n) for n in df.columns])


def table_metadata(df: DataFrame) -> DataFrame:
    """Rows, columns, bytes and the type of each column."""
    types = F.map_from_arrays(
        F.array(*[F.lit(n) for n, _ in df.dtypes]), F.array(*[F.lit(t) for _, t in df.dtypes])
    )
    return size_estimate(df).select(
        F.col("rows").alias("rows_count"),
        F.lit(len(df.columns)).cast("bigint").alias("columns_count"),
        F.col("data_bytes").alias("memory_bytes"),
        types.alias("column_types"),
    )
