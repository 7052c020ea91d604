"""Reports and files; each function returns the table that is written, and ``save_*`` writes one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators.kmers import A, Graph, degrees
from ..operators.staging import staged


def token() -> str:
    """A fresh name for a folder."""
    return uuid.uuid4().hex


def fasta_lines(contigs: DataFrame, meta: list[str], *keep: str) -> DataFrame:
    """FASTA records whose names carry metadata: >name[a=1;b=2;]."""
    fields = F.concat_ws("", *[F.concat(F.lit(f"{m}="), F.coalesce(F.col(m).cast("string"), F.lit("NA")), F.lit(";")) for m in meta])
    return contigs.select(*keep, F.concat(F.lit(">"), "name", F.lit("["), fields, F.lit("]\n"), "seq").alias("value"))


def save_text(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def save_table(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True)


def contig_info(contigs: DataFrame) -> DataFrame:
    """name, readCount and fraction of the assembly's total."""
    total = contigs.groupBy(A).agg(F.sum("cnt").alias("_t"))
    return contigs.join(total, A).select(A, "name", F.col("cnt").alias("readCount"), (F.col("cnt") / F.col("_t")).alias("fraction"))


def node_table(g: Graph) -> DataFrame:
    reads = g.node_reads.groupBy(A, "node_id").agg(F.count("*").alias("readCount"))
    return degrees(g).join(reads, [A, "node_id"], "left").select(
        A, "node_id", (F.length("seq") - g.k + 1).alias("nodekSize"), F.lit(g.k).alias("kLen"), F.col("cnt").alias("count"), F.coalesce("readCount", F.lit(0)).alias("readCount"), F.col("heads").alias("headEdgesCount"), F.col("tails").alias("tailEdgesCount"))


def edge_table(g: Graph, names: bool = False) -> DataFrame:
    agg = [F.countDistinct("read").alias("readCount")] + ([F.array_join(F.array_sort(F.collect_set("read")), ",").alias("reads")] if names else [])
    reads = g.edge_reads.groupBy(A, "src", "dst").agg(*agg)
    return g.edges.distinct().withColumnRenamed("cnt", "connectorCount").join(reads, [A, "src", "dst"], "left")


def count_tables(nodes: DataFrame) -> DataFrame:
    return nodes.select(A, "seq", "cnt").orderBy(A, F.desc("cnt"), "seq")


def read_groups(spark, path: str) -> DataFrame:
    """Nodes of the groups with the name of their file."""
    return spark.read.parquet(f"{path}/nodes").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def save_by_group(nodes: DataFrame, path: str, files: int = 64) -> None:
    """Nodes sorted by connected group in at most ``files`` files, and an index: which file holds a group, and how many rows.

    A group lies in one file, however many groups there are; a reader of one group opens that file only.
    """
    nodes.repartition(files, A, "group").sortWithinPartitions(A, "group").write.parquet(f"{path}/nodes")
    read_groups(nodes.sparkSession, path).groupBy(A, "group", "file").agg(F.count("*").alias("rows")).coalesce(1).write.parquet(f"{path}/index")


def _ragged(report: DataFrame) -> DataFrame:
    """The extra fields as extraField0.. columns, padded with null."""
    most = report.agg(F.max(F.size("extra"))).first()[0] or 0
    return report.select(*[c for c in report.columns if c != "extra"], *[F.get("extra", F.lit(i)).alias(f"extraField{i}") for i in range(max(most, 0))])


def coverage_info(report: DataFrame) -> DataFrame:
    """Per-base coverage of the regions."""
    return _ragged(report.select("chrom", "start", "end", "name", (F.col("end") - F.col("start")).alias("length"), "strand", "coverage", "extra"))


def basic_info(report: DataFrame, haplotypes: DataFrame | None = None) -> DataFrame:
    """The whole region report, with ``haplotypes`` (uid, seq, cnt) also their number and reads."""
    out = report
    if haplotypes is not None:
        n = haplotypes.groupBy("uid").agg(F.countDistinct("seq").alias("uniqHaps"), F.sum("cnt").alias("readTotalUsed"))
        out = out.join(n, "uid", "left").na.fill(0, ["uniqHaps", "readTotalUsed"]).withColumn("success", F.col("uniqHaps") > 0)
    return _ragged(out)


#: Nodes and links of a piece of JSON.
PIECE = 10_000


def graph_json(g: Graph) -> DataFrame:
    """Nodes and links as JSON, in pieces of about ``PIECE`` of them, so no row holds a whole assembly: assembly_id, part, graph."""
    node, link = F.struct("node_id", "seq", "cnt"), F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("cnt").alias("value"))
    rows = g.nodes.select(A, F.xxhash64("node_id").alias("_key"), node.alias("node")).unionByName(g.edges.select(A, F.xxhash64("src", "dst").alias("_key"), link.alias("link")), allowMissingColumns=True)
    parts = staged(rows.groupBy(A).agg(F.ceil(F.count("*") / PIECE).alias("_parts")))
    dealt = rows.join(parts, A).withColumn("part", F.pmod("_key", "_parts"))
    pieces = dealt.groupBy(A, "part").agg(F.sort_array(F.collect_list("node")).alias("nodes"), F.sort_array(F.collect_list("link")).alias("links"))
    return pieces.select(A, "part", F.to_json(F.struct("nodes", "links")).alias("graph"))
