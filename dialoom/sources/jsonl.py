"""JSON and JSON-lines tables: reading with line numbers and errors, expanding paths, writing, exporting."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from dialoom.functions.text import strip


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def layout(spark: SparkSession, path: str) -> str:
    """How a file holds its records: ``array``, one ``object`` over several lines, or ``lines``; compressed files by their suffix.

    The first line that is not blank decides, however many blank ones stand before it; an empty file has ``lines``.
    """
    jvm = spark.sparkContext._jvm
    p, fs = _fs(spark, path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(p)
    stream = fs.open(p)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        while (line := reader.readLine()) is not None:
            line = line.strip("\ufeff \t\r\n\x0b\x0c")
            if line.startswith("["):
                return "array"
            if line:
                try:
                    json.loads(line)
                except ValueError:
                    return "object" if line.startswith("{") else "lines"
                return "lines"
    finally:
        reader.close()
    return "lines"


def expand(spark: SparkSession, path: str) -> list[str]:
    """All .json and .jsonl files under a folder, sorted and unique; a file is itself."""
    p, fs = _fs(spark, path)
    if fs.isFile(p):
        return [path]
    found, files = set(), fs.listFiles(p, True)
    while files.hasNext():
        f = files.next().getPath().toString()
        if f.endswith((".json", ".jsonl")):
            found.add(f)
    return sorted(found)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value``: physical lines numbered from 1 per file; blank lines are left out but counted.

    Lines keep their number although files are read in parts: the parts of a file
    are counted first, then every part starts after those before it.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"))
    from pyspark.sql import Window

    sizes = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", "block", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("_id"))
    return raw.withColumn("_in", inside).join(starts, ["file", "block"]).select("file", (F.col("_before") + F.col("_in")).alias("line_no"), "value").where(strip(F.col("value")) != "")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fails on a line that is no JSON of the schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Leaves out lines that cannot be read."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``file, line_no, record, error``: the record of every line, or what is wrong with it; the line stays."""
    kind = t._parse_datatype_string(schema)
    kind = t.StructType([*kind.fields, t.StructField("_corrupt", t.StringType())])
    r = numbered_lines(spark, path).withColumn("record", F.from_json("value", kind, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    bad = F.col("record").isNull() | F.col("record._corrupt").isNotNull()
    return r.select("file", "line_no", F.when(~bad, F.col("record").dropFields("_corrupt")).alias("record"), F.when(bad, F.concat(F.lit("not a record: "), F.substring("value", 1, 80))).alias("error"))


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Array files, single objects and lines alike: the layout decides; what does not follow it fails when it is read."""
    return spark.read.schema(schema).option("multiLine", layout(spark, path) != "lines").option("mode", "FAILFAST").json(path)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite", one_file: bool = False) -> None:
    """JSON lines, not ASCII-escaped; one file only for export."""
    (df.coalesce(1) if one_file else df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_buckets(df: DataFrame, path: str, bucket: str) -> None:
    """One pass writes every row into its bucket's folder; the folder above is all of them."""
    df.write.mode("overwrite").partitionBy(bucket).json(path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small nested summary as one JSON file."""
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(report, ensure_ascii=False, indent=2, default=str).encode()))
    finally:
        out.close()


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header; quoted fields may hold line ends; gzip by suffix."""
    return spark.read.schema(schema).csv(path, sep=sep, header=True, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV with a header; quotes within fields are doubled."""
    df.write.mode("overwrite").csv(path, sep=sep, header=True, escape='"')


def append_lines(df: DataFrame, path: str) -> None:
    """Rows added to a JSON-lines table."""
    write_lines(df, path, mode="append")


def whole_numbers(df: DataFrame, column: str) -> DataFrame:
    """``df``, with an error on any target in ``column`` that has a decimal point."""
    bad = F.col(column).cast("string").contains(".")
    return df.withColumn(column, F.when(bad, F.raise_error(F.concat(F.lit("not a whole number: "), F.col(column).cast("string")))).otherwise(F.col(column)))


def output_name(path: str, kind: str) -> str:
    """``x.jsonl`` and ``x.json`` become ``x.<kind>.jsonl``; others get ``.<kind>.jsonl`` added."""
    stem = path.rsplit(".", 1)[0] if path.endswith((".jsonl", ".json")) else path
    return f"{stem}.{kind}.jsonl"


def runs_with(spark: SparkSession, root: str, part: str = "artifacts") -> list[str]:
    """The folders under ``root`` that have a folder ``part``, by name."""
    p, fs = _fs(spark, root)
    jvm = spark.sparkContext._jvm
    found = [x.getPath() for x in fs.listStatus(p) if x.isDirectory()] if fs.exists(p) else []
    return sorted(x.toString() for x in found if fs.exists(jvm.org.apache.hadoop.fs.Path(x, part)))


def copy_files(spark: SparkSession, source: str, target: str, names: list[str]) -> list[str]:
    """Copies the named files that are there, keeping their places below the folder; returns their names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = []
    for name in names:
        a, fs = _fs(spark, f"{source}/{name}")
        b, to = _fs(spark, f"{target}/{name}")
        if fs.exists(a):
            to.mkdirs(b.getParent())
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, to, b, False, True, conf)
            done.append(name)
    return done


def existing(spark: SparkSession, presets: dict[str, list[str]]) -> dict[str, list[str]]:
    """The presets whose paths all exist."""
    there = lambda path: (lambda x: x[1].exists(x[0]))(_fs(spark, path))
    return {k: v for k, v in presets.items() if all(map(there, v))}


def append_manifest(df: DataFrame, path: str) -> None:
    """Rows added to a tab-separated manifest."""
    df.write.mode("append").csv(path, sep="\t", header=False)


def split_rows(df: DataFrame, share: float, seed: int, key: str) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows by a hash of the key: the same rows whatever the partitioning."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    return df.where(u >= share), df.where(u < share)


def head_and_tail(lines: DataFrame, n: int = 200) -> DataFrame:
    """The first and the last n numbered lines of every file."""
    from pyspark.sql import Window

    w = Window.partitionBy("file")
    r = lines.withColumn("_a", F.row_number().over(w.orderBy("line_no"))).withColumn("_b", F.row_number().over(w.orderBy(F.desc("line_no"))))
    return r.where((F.col("_a") <= n) | (F.col("_b") <= n)).drop("_a", "_b")


def shortened(lines: DataFrame, n: int = 200) -> DataFrame:
    """Files of more than 2 n numbered lines cut to their first and last n, with one line between that says how many are left out."""
    sizes = lines.groupBy("file").agg(F.max("line_no").alias("_n"))
    gap = sizes.where(F.col("_n") > 2 * n).select("file", F.lit(n + 1).cast("long").alias("line_no"), F.concat(F.lit("... "), (F.col("_n") - 2 * n).cast("string"), F.lit(" lines left out ...")).alias("value"))
    kept = lines.join(sizes, "file").where((F.col("line_no") <= n) | (F.col("line_no") > F.col("_n") - n)).select("file", F.col("line_no").cast("long").alias("line_no"), "value")
    return kept.unionByName(gap)


def html_table(df: DataFrame, title: str = "", most: int = 1000) -> str:
    """A small result as an HTML table; an error beyond ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    cell = lambda tag, v: f"<{tag}>{'' if v is None else html.escape(str(v))}</{tag}>"
    body = ["".join(cell("td", v) for v in r) for r in rows]
    return (cell("h2", title) if title else "") + "<table>" + "".join(f"<tr>{x}</tr>" for x in ["".join(cell("th", c) for c in df.columns), *body]) + "</table>"


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; an error beyond ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def scan_logs(spark: SparkSession, path: str, signatures: dict[str, str]) -> DataFrame:
    """``file`` and one boolean column per signature (a regular expression over the whole log)."""
    logs = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return logs.select("file", *[F.col("value").rlike(p).alias(k) for k, p in signatures.items()])
