"""Text formats as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import sequence as S

#: Bits of the flag column of alignment text, by public specification.
FLAGS = {"is_paired": 1, "is_proper": 2, "unmapped": 4, "mate_unmapped": 8, "is_reverse": 16, "first": 64, "second": 128, "secondary": 256, "is_dup": 1024, "supplementary": 2048}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """n and line over all files in order of their names: line counts of file blocks give each block its first number."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("id").alias("first"))
    # one row a block of a file, summed in one task
    before = F.sum("lines").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    at = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(at, ["file", "block"]).select((F.col("id") + F.col("shift")).alias("n"), "line")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """record, name, seq, qual: four lines a record, numbered over all files."""
    lines = numbered_lines(spark, path)
    rows = lines.groupBy(F.floor(F.col("n") / 4).alias("record")).agg(*[F.max(F.when(F.col("n") % 4 == i, F.col("line"))).alias(c) for i, c in ((0, "name"), (1, "seq"), (3, "qual"))])
    return rows.withColumn("name", F.regexp_replace("name", "^@", ""))


def paired_fastq(spark: SparkSession, path1: str, path2: str, turn_mate: bool = False) -> DataFrame:
    """Both mates by record number; the second optionally reverse-complemented."""
    a, b = fastq(spark, path1), fastq(spark, path2)
    if turn_mate:
        b = b.withColumns({"seq": S.reverse_complement("seq"), "qual": F.reverse("qual")})
    return a.select("record", "name", F.col("seq").alias("seq1"), F.col("qual").alias("qual1")).join(b.select("record", F.col("seq").alias("seq2"), F.col("qual").alias("qual2")), "record")


def fasta(spark: SparkSession, path: str, *keep: str) -> DataFrame:
    """name (up to the first blank), description and seq; ``keep``: columns that the folders carry."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    seq = F.regexp_replace(F.col("value").substr(F.length(head) + 1, F.length("value")), r"\s", "")
    return rows.select(*keep, F.trim(F.substring_index(head, " ", 1)).alias("name"), F.trim(head).alias("description"), seq.alias("seq"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments: name, mate, chrom, pos (0-based), end_pos, mapq, flags, mate_pos, soft_clip, seq, qual."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(*[f[i].alias(n) for i, n in enumerate(("name", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "tlen", "seq", "qual"))])

    def total(kinds):
        return F.aggregate(F.regexp_extract_all("cigar", F.lit(rf"(\d+)[{kinds}]"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))

    bit = {n: F.col("flag").cast("int").bitwiseAND(b) != 0 for n, b in FLAGS.items()}
    pos = F.col("pos").cast("long") - 1
    return rows.select(
        "name", F.when(bit["second"], 2).otherwise(1).alias("mate"), "chrom", pos.alias("pos"), (pos + total("MDN=X")).alias("end_pos"), F.col("mapq").cast("int").alias("mapq"),
        bit["is_paired"].alias("is_paired"), bit["is_proper"].alias("is_proper"), (~bit["unmapped"]).alias("is_mapped"), (~bit["mate_unmapped"]).alias("mate_mapped"),
        (~(bit["secondary"] | bit["supplementary"])).alias("is_primary"), bit["is_dup"].alias("is_dup"), bit["is_reverse"].alias("is_reverse"), (F.col("mate_pos").cast("long") - 1).alias("mate_pos"), total("S").alias("soft_clip"), "seq", "qual")


def bed(spark: SparkSession, path: str) -> DataFrame:
    """Regions: chrom, start, end, name, score, strand and the further fields as an array."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").rlike("^(#|track|browser)"))
    return rows.select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), F.get(f, F.lit(3)).alias("name"), F.try_to_number(F.get(f, F.lit(4)), F.lit("999999.99")).cast("double").alias("score"), F.get(f, F.lit(5)).alias("strand"), F.slice(f, F.lit(7), F.greatest(F.size(f) - 6, F.lit(0))).alias("extra"))


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}, found {df.columns}")
    return df


def table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A tab-separated table with a header that has the required columns; all values are text."""
    return require_columns(spark.read.csv(path, sep="\t", header=True), *columns)


def sample_meta(spark: SparkSession, path: str, samples: DataFrame) -> DataFrame:
    """Metadata of the given samples."""
    return table(spark, path, "sample").join(samples.select("sample"), "sample", "left_semi")


def places(spark: SparkSession, path: str, samples: DataFrame) -> DataFrame:
    """Country and site of the given samples."""
    return table(spark, path, "sample", "country", "site").join(samples.select("sample"), "sample", "left_semi")


def tandems(spark: SparkSession, path: str) -> DataFrame:
    rows = table(spark, path, "repeat", "size", "adjustedPartialSize")
    return rows.select(F.col("repeat").alias("unit"), F.col("size").cast("long").alias("size"), F.col("adjustedPartialSize").cast("long").alias("adjusted_size"))


def result_files(spark: SparkSession, glob: str, pattern: str, read) -> DataFrame:
    """All result tables below a glob whose path fits the pattern, each row with its file and directory."""
    rows = read(glob).withColumn("file", F.col("_metadata.file_path"))
    return rows.where(F.col("file").rlike(pattern)).withColumn("directory", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
