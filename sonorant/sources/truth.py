"""Ground-truth tables from CSV, and result exports to CSV."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonorant.operators.dataset import accepted_rows


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows id, text; rejected rows id, file, line, reason) of a CSV, or a folder of them, with a header that has `id` and
    `text` or `transcript`, in any case and with spaces around. Ids are reduced to file stems; lines count a file's records from 2,
    and of rows that share an id the first one in the order of files and lines is accepted."""
    raw = spark.read.option("header", True).option("multiLine", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    names = {c.replace("\ufeff", "").strip().lower(): c for c in raw.columns}
    text = names.get("text", names.get("transcript"))
    if "id" not in names or text is None:
        raise ValueError("the table needs the columns id and text (or transcript)")
    stem = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{names['id']}`"), F.lit("")), r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", ""))
    # A file that may have breaks in its fields is read by one task, in order; its rows are numbered from the first of them.
    rows = raw.select(stem.alias("id"), F.trim(F.col(f"`{text}`")).alias("text"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    line = F.col("at") - F.min("at").over(Window.partitionBy("file")) + 2
    rows = rows.select("id", "text", F.struct(F.col("file"), line.alias("line")).alias("ordinal"))
    marked = accepted_rows(rows)
    return marked.where("reason IS NULL").select("id", "text"), marked.where("reason IS NOT NULL").select("id", "ordinal.file", "ordinal.line", "reason")


#: A record of a CSV, breaks within quotes included, and a field with the comma before it and its quotes. Possessive: linear, without recursion.
RECORD = r'((?:[^"\r\n]++|"[^"]*+(?:""[^"]*+)*+")++)'
FIELD = r',((?:[^,"]++|"[^"]*+(?:""[^"]*+)*+")*+)'


def read_truth_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As `read_truth`, for a folder whose files differ in encoding, in the order of their columns or in their health. A file is UTF-8,
    with or without a mark, where its bytes are valid; any other is read as latin-1 and noted (reason `latin-1`, no line). A file
    without a record (`empty`) or without the columns (`no_columns`) is noted too and gives no row; the rest of the folder is
    read; Spark's scans pass over files of no bytes. Lines count records from 2, blank ones left out. A file is held whole, which binary scans allow to 2 GB."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "content")
    plain = F.col("content").cast("string")
    valid = F.is_valid_utf8(plain)
    text = F.regexp_replace(F.when(valid, plain).otherwise(F.decode("content", "ISO-8859-1")), "^\ufeff", "")
    unquoted = lambda f: F.trim(F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    fields = lambda record: F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(FIELD)), unquoted)
    files = raw.select("file", valid.alias("valid"), F.regexp_extract_all(text, F.lit(RECORD)).alias("records"))
    names = F.transform(fields(F.get("records", F.lit(0))), F.lower)
    at = lambda n: F.array_position("names", n).cast("int")
    files = files.withColumn("names", F.coalesce(names, F.array().cast("array<string>")))
    files = files.withColumns({"id_at": at("id"), "text_at": F.coalesce(F.nullif(at("text"), F.lit(0)), at("transcript"))})
    whole = (F.col("id_at") > 0) & (F.col("text_at") > 0)
    told = F.filter(F.array(F.when(~F.col("valid"), "latin-1"), F.when(F.size("records") == 0, "empty").when(~whole, "no_columns")), lambda r: r.isNotNull())
    notes = files.select(F.lit(None).cast("string").alias("id"), "file", F.lit(None).cast("long").alias("line"), F.explode(told).alias("reason"))
    rows = files.where(whole).select("file", "id_at", "text_at", F.posexplode("records").alias("k", "record")).where("k > 0")
    part = lambda c: F.coalesce(F.get(fields(F.col("record")), F.col(c) - 1), F.lit(""))
    stem = F.trim(F.regexp_replace(F.regexp_replace(part("id_at"), r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", ""))
    marked = accepted_rows(rows.select(stem.alias("id"), part("text_at").alias("text"), F.struct("file", (F.col("k") + 1).cast("long").alias("line")).alias("ordinal")))
    bad = marked.where("reason IS NOT NULL").select("id", "ordinal.file", "ordinal.line", "reason")
    return marked.where("reason IS NULL").select("id", "text"), bad.unionByName(notes)


#: The columns of the tables of assessments, any of which a file may be.
ASSESSMENTS = (("human_level", "system_level"), ("level", "reference", "hypothesis"), ("expected", "heard"))


def read_assessments(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of assessments as the columns of its layout, all of them strings with null as empty; other columns are dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c.replace("\ufeff", "").strip().lower(): c for c in raw.columns}
    layout = next((a for a in ASSESSMENTS if set(a) <= names.keys()), None)
    if layout is None:
        raise ValueError("the table has the columns of no layout of assessments")
    return raw.select(*(F.coalesce(F.col(f"`{names[c]}`"), F.lit("")).alias(c) for c in layout))


def export_csv(tables: list[DataFrame], path: str) -> None:
    """Tables one under the other as CSV; columns are the union, in order of first appearance."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).write.mode("overwrite").option("header", True).csv(path)
