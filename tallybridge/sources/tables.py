"""Reading and writing the two tables: workbooks, parquet and csv in; result sheets out."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab as V
from ..operators.results import summary_note
from ..plans.linkage import A_NAME, B_NAME, Linkage, LinkageError
from . import titled, xlsx
from .headers import find_header, norm_header

A_SHEET, B_SHEET = "客户交易明细_A系统", "银行流水明细_B系统"


@dataclass
class TableInfo:
    """What is known of a table that was read."""

    label: str
    path: str
    sheet: str | None
    header_row: int
    header_hits: int
    missing: list[str] = field(default_factory=list)
    extra: list[str] = field(default_factory=list)


def _type(values: list) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {float} and kinds:
        return T.LongType() if all(v is None or v.is_integer() for v in values) else T.DoubleType()
    if kinds == {bool}:
        return T.BooleanType()
    if kinds == {dt.datetime}:
        return T.DateType() if all(v is None or v.time() == dt.time() for v in values) else T.TimestampType()
    return T.StringType()


def _fit(v, kind: T.DataType):
    if v is None:
        return None
    if isinstance(kind, T.LongType):
        return int(v)
    if isinstance(kind, T.DateType):
        return v.date()
    if isinstance(kind, T.StringType):
        return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    return v


def check_file(path: str) -> Path:
    p = Path(path)
    if not p.exists():
        raise LinkageError(f"no such file: {path}")
    if not p.is_file():
        raise LinkageError(f"not a file: {path}")
    return p


def load_workbook(spark: SparkSession, path: str, sheet: str, expected: list[str], name: str, label: str) -> tuple[DataFrame, TableInfo]:
    """A sheet as a DataFrame: header row found, columns without a header and rows without a value left out, the name column text as it is.

    A workbook is one zip file of at most about a million rows a sheet, so it is read on the driver; large tables come as parquet or csv.
    """
    p = check_file(path)
    if sheet not in xlsx.list_sheets(p):
        raise LinkageError(f"no sheet {sheet!r} in {path}; there are {', '.join(xlsx.list_sheets(p))}")
    rows = xlsx.read_rows(p, sheet)
    at, hits = find_header(rows, expected)
    header = [norm_header(v) for v in rows[at]] if rows else []
    if name not in header:
        raise LinkageError(f"no column {name!r} in sheet {sheet!r}")
    keep = [k for k, h in enumerate(header) if h and header.index(h) == k]
    body = [[r[k] if k < len(r) else None for k in keep] for r in rows[at + 1 :]]
    body = [r for r in body if any(v is not None for v in r)]
    names = [header[k] for k in keep]
    kinds = [T.StringType() if n == name else _type([r[k] for r in body]) for k, n in enumerate(names)]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, kinds)])
    df = spark.createDataFrame([tuple(_fit(v, t) for v, t in zip(r, kinds)) for r in body], schema)
    return df, TableInfo(label, str(p), sheet, at, hits, [e for e in expected if e not in names], [n for n in names if n not in expected])


def _head(path: str, expected: list[str]) -> titled.Head | None:
    """The header of a text file; None where Python sees no such file, as Spark may, or will tell what is wrong."""
    try:
        return titled.first_head(path, expected=json.dumps(expected))
    except (OSError, ValueError):
        return None


def load_table(spark: SparkSession, path: str, expected: list[str], name: str, label: str, sheet: str | None = None) -> tuple[DataFrame, TableInfo]:
    """A table by its kind: .xlsx, .csv, else parquet. A .csv whose first line is the header has its types inferred; one with title lines above it is read as text."""
    if path.endswith(".xlsx"):
        return load_workbook(spark, path, sheet or "", expected, name, label)
    head = _head(path, expected) if path.endswith(".csv") else None
    try:
        if head and head.line:
            df = titled.read_titled(spark, path, expected)
        else:
            df = spark.read.csv(path, header=True, inferSchema=True) if path.endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
    except AnalysisException as e:
        raise LinkageError(f"{path} cannot be read: {e.getCondition() or e}") from e
    df = df.select(*(F.col(f"`{c}`").alias(norm_header(c)) for c in df.columns if norm_header(c)))
    if name not in df.columns:
        raise LinkageError(f"no column {name!r} in {path}")
    df = df.withColumn(name, F.col(name).cast("string")).na.drop("all")
    return df, TableInfo(label, path, None, head.line if head else 0, len(set(df.columns) & set(expected)), [e for e in expected if e not in df.columns], [c for c in df.columns if c not in expected])


def load_ledger(spark: SparkSession, path: str, sheet: str = A_SHEET) -> tuple[DataFrame, TableInfo]:
    return load_table(spark, path, V.A_COLUMNS, A_NAME, "A", sheet)


def load_statement(spark: SparkSession, path: str, sheet: str = B_SHEET) -> tuple[DataFrame, TableInfo]:
    return load_table(spark, path, V.B_COLUMNS, B_NAME, "B", sheet)


def default_filename(team: str, when: dt.date | None = None) -> str:
    return f"模糊匹配结果_{team}_{(when or dt.date.today()):%Y%m%d}.xlsx"


def write_parquet(run: Linkage, folder: str, mode: str = "errorifexists") -> None:
    """One parquet table per sheet; the sink for large results."""
    for name, df in (("matches", run.matches), ("a_only", run.a_only), ("b_only", run.b_only), ("summary", run.summary)):
        df.withColumnsRenamed({c: c.replace("(%)", "") for c in df.columns}).write.mode(mode).parquet(f"{folder}/{name}")


def _row_style(sheet: str, row: dict) -> str | None:
    tier = row.get("匹配状态")
    if tier is None:
        return None
    return "exact" if tier in V.TIERS[:2] else "mid" if tier == V.TIERS[2] else "low"


def export_workbook(run: Linkage, out_dir: str, team: str = "team", filename: str | None = None, tries: int = 10) -> tuple[str, dict[str, int]]:
    """A workbook of four sheets; a name that cannot be written gets (2) to (10). For results that fit a workbook."""
    Path(out_dir).mkdir(parents=True, exist_ok=True)
    order = {"匹配统计汇总": "place"}
    sheets = {}
    for name, df in run.sheets().items():
        key = order.get(name, df.columns[0])
        rows = [tuple(r) for r in df.orderBy(key).toLocalIterator()]
        header = df.columns
        if name == "匹配统计汇总":
            header, rows = ["指标", "数量", "占比"], [*(r[1:] for r in rows), (None, None, None), (summary_note(run.thresholds), None, None)]
        sheets[name] = (header, rows)
    base = Path(out_dir, filename or default_filename(team))
    for k in range(1, tries + 1):
        path = base if k == 1 else base.with_stem(f"{base.stem}({k})")
        try:
            counts = xlsx.write_workbook(path, sheets, _row_style)
            counts["匹配统计汇总"] -= 2  # an empty row and the note
            return str(path), counts
        except PermissionError:
            continue
    raise PermissionError(f"none of {tries} names can be written: {base}")
