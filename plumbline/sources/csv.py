"""CSV files whose separator, encoding and types aren't known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions.kinds import col
from ..operators.dataset import sample_exact

HEAD_BYTES = 65_536


def detect_delimiter(data: bytes) -> str:
    """The candidate that the first line has most often; a comma on ties and without any."""
    line = data[:HEAD_BYTES].split(b"\n", 1)[0]
    counts = [(line.count(d.encode()), -i, d) for i, d in enumerate(fixed.CSV_DELIMITERS)]
    most = max(counts)
    return most[2] if most[0] else ","


def detect_encoding(data: bytes) -> str:
    """The first of the known encodings that can decode the bytes."""
    for encoding in fixed.CSV_ENCODINGS:
        try:
            data.decode(encoding)
        except UnicodeDecodeError:
            continue
        return encoding
    raise AssertionError("latin-1 decodes anything")


def header_names(line: str, sep: str) -> list[str]:
    """Unique, non-empty column names; Spark's own would clash where only case differs."""
    import csv

    cells = next(csv.reader([line.lstrip("﻿").rstrip("\r\n")], delimiter=sep), [])
    names, seen = [], {}
    for i, cell in enumerate(cells):
        name = cell or f"unnamed_{i}"
        key = name.lower()
        seen[key] = seen.get(key, -1) + 1
        names.append(f"{name}.{seen[key]}" if seen[key] else name)
    return names


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, max_rows: int | None = None, seed: int = 0, infer: bool = True) -> tuple[DataFrame, dict]:
    """(table, {sep, encoding, names}). All rows are read unless max_rows asks for an exact-size hash sample.

    Only the file's head is looked at on the driver. One distributed scan of all
    lines finds the encoding that decodes every byte, and whether a quoted value
    holds a line end. If none does, files are split among tasks; if one does, Spark
    reads a file in one task, as no one else can tell where its records begin.
    """
    data = _head(spark, path)
    sep = sep or detect_delimiter(data)
    known, multiline = _scan(spark, path)
    encoding = encoding or known
    first = data.split(b"\n", 1)[0].decode(encoding, "replace")
    names = header_names(first, sep)
    charset = {"utf-8-sig": "UTF-8", "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1"}.get(encoding, encoding)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    raw = spark.read.csv(path, schema=schema, sep=sep, header=True, enforceSchema=True, encoding=charset, quote='"', escape='"', multiLine=multiline, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False)
    if encoding == "cp1252":  # Spark reads no cp1252, which differs from ISO-8859-1 in 27 places
        there = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
        there = {k: v for k, v in there.items() if v}
        raw = raw.select(*[F.translate(col(c), "".join(there), "".join(there.values())).alias(c) for c in raw.columns])
    cells = raw.select(*[F.when(~col(c).isin(*fixed.CSV_NA), col(c)).alias(c) for c in raw.columns])
    if max_rows is not None:
        cells = sample_exact(cells.withColumn("_pl_row", F.monotonically_increasing_id()), max_rows, "_pl_row", seed).drop("_pl_row")
    table = infer_types(cells) if infer else cells
    return table.toDF(*names), {"sep": sep, "encoding": encoding, "names": names}


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file, read through the cluster's file system."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [where] if store.getFileStatus(where).isFile() else sorted((f.getPath() for f in store.listStatus(where) if f.isFile() and not f.getPath().getName().startswith(("_", "."))), key=str)
    if not files:
        raise FileNotFoundError(path)
    stream = store.open(files[0])
    try:
        return bytes(stream.readNBytes(HEAD_BYTES))
    finally:
        stream.close()


def _scan(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(the first known encoding that decodes every line, whether a record has several lines)."""
    line = F.col("value")
    # ISO-8859-1 gives each byte its own character; cp1252 has no character for five of them.
    undefined = F.decode(line.cast("binary"), "ISO-8859-1").rlike("[\\x81\\x8d\\x8f\\x90\\x9d]")
    # The line on which a quoted value is open at the end has an odd number of quotes.
    odd = F.regexp_count(line, F.lit('"')) % 2 == 1
    text = spark.read.text(path)
    row = text.agg(F.count_if(~F.is_valid_utf8(line)).alias("not_utf8"), F.count_if(undefined).alias("not_cp1252"), F.count_if(odd).alias("odd")).first()
    fits = {"utf-8-sig": not row["not_utf8"], "cp1252": not row["not_cp1252"], "latin-1": True}
    return next(e for e in fixed.CSV_ENCODINGS if fits[e]), row["odd"] > 0


def infer_types(cells: DataFrame) -> DataFrame:
    """Text columns as long, double or boolean where all present values are that; dates stay text.

    One pass over all rows decides every column. A boolean column with missing
    values stays text, an all-missing one is double.
    """
    long_, num = r"^\s*[+-]?\d{1,18}\s*$", rf"^\s*(?:{fixed.NUMBER}|[+-]?(?i:inf|infinity))\s*$"
    tests = []
    for c in cells.columns:
        some = col(c).isNotNull()
        tests.append(F.struct(F.count_if(some).alias("n"), F.count_if(~some).alias("gone"), F.count_if(some & ~col(c).rlike(long_)).alias("not_long"), F.count_if(some & ~col(c).rlike(num)).alias("not_num"), F.count_if(some & ~col(c).isin("True", "False", "true", "false", "TRUE", "FALSE")).alias("not_bool")).alias(c))
    facts = cells.agg(*tests).first()
    out = []
    for c in cells.columns:
        f = facts[c]
        if not f["n"] or f["not_num"] == 0:
            whole = f["n"] and f["not_long"] == 0 and not f["gone"]
            number = F.regexp_replace(F.lower(F.trim(col(c))), "^([+-]?)inf(inity)?$", "$1Infinity")
            out.append((F.trim(col(c)).try_cast("bigint") if whole else number.try_cast("double")).alias(c))
        elif f["not_bool"] == 0 and not f["gone"]:
            out.append((F.lower(col(c)) == "true").alias(c))
        else:
            out.append(col(c))
    return cells.select(*out)


def csv_call(info: dict, path: str = "data.csv") -> str:
    """How the file was read, as a line of code for a script's header."""
    return f"spark.read.csv({path!r}, header=True, sep={info['sep']!r}, encoding={info['encoding']!r})"


def estimated_rows(data: bytes) -> int:
    """Lines of a CSV text without its header."""
    lines = data.count(b"\n") + (1 if data and not data.endswith(b"\n") else 0)
    return max(lines - 1, 0)


__all__ = ["csv_call", "detect_delimiter", "detect_encoding", "estimated_rows", "header_names", "infer_types", "read_csv"]
