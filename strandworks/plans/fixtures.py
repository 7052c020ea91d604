"""Tables of the library's data model, derived from the driver's tables; SQL has the same derivations for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import sequence as S

#: Fixed letter map of the derivation.
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
READ, STEP, WIDTH = 150, 75, 10_000_000
#: Quality letters come round after 41 places; document d begins 16 d places on, as 3 * 16 = 7 (mod 41).
LETTERS_Q = "".join(chr(i * 3 % 41 + 33) for i in range(41 + READ))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bases(text, with_n: bool = False):
    keep = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]" if with_n else "[^a-z]", "")
    return F.translate(keep, LETTERS + "0123456789", BASES + "N" * 10)


def reads(spark, d, with_n: bool = False) -> DataFrame:
    """Windows of every document, the last one up to its end (a short text is one read): read_id, doc_id, w, sample, name, seq, qual."""
    # dealt out before anything is derived: a file of few row groups would be cut, and its reads tested, by as few tasks
    x = table(spark, d, "documents").select("doc_id", "lang", "source", "text").repartition("doc_id", F.xxhash64("text"))
    x = x.select("doc_id", F.col("lang").alias("sample"), F.col("source").alias("name"), bases(F.col("text"), with_n).alias("s"))
    # pieces of one step, cut in one pass: a substring far inside a long text would count through all before it
    x = x.select("doc_id", "sample", "name", F.length("s").alias("n"), F.regexp_extract_all("s", F.lit(f"(.{{1,{STEP}}})"), F.lit(1)).alias("h"), F.right("s", F.lit(READ)).alias("last"))
    full = F.floor((F.col("n") - READ) / STEP).cast("int") + 1
    windows = F.transform(F.sequence(F.lit(0), full - 1), lambda w: F.concat(F.get("h", w), F.get("h", w + 1)))
    end = F.when((F.col("n") - READ) % STEP > 0, F.array("last")).otherwise(F.array().cast("array<string>"))
    seqs = F.when(F.col("n") == 0, F.array().cast("array<string>")).when(F.col("n") < READ, F.array("last")).otherwise(F.concat(windows, end))
    x = x.select("doc_id", "sample", "name", F.posexplode(seqs).alias("w", "seq"))
    letter = lambda i: F.char((F.col("doc_id") * 7 + i * 3) % 41 + 33)
    one_by_one = F.array_join(F.transform(F.sequence(F.lit(1), F.length("seq")), letter), "")
    qual = F.when(F.col("doc_id") >= 0, F.lit(LETTERS_Q).substr(((F.col("doc_id") % 41 * 16 + 1) % 41 + 1).cast("int"), F.length("seq"))).otherwise(one_by_one)
    return x.select((F.col("doc_id") * WIDTH + F.col("w")).alias("read_id"), "doc_id", "w", "sample", "name", "seq", qual.alias("qual"))


def mates(spark, d, of: DataFrame | None = None) -> DataFrame:
    """Pairs as rows: windows 2i and 2i+1 of a document, the second reverse-complemented.  ``of``: the reads, where they are kept already."""
    x = reads(spark, d) if of is None else of
    first = x.where("w % 2 = 0").withColumns({"mate": F.lit(1), "pair_id": F.col("read_id")})
    second = x.where("w % 2 = 1").withColumns({"mate": F.lit(2), "pair_id": F.col("read_id") - 1, "seq": S.reverse_complement("seq"), "qual": F.reverse("qual")})
    whole = second.select("pair_id")
    return first.join(whole, "pair_id", "left_semi").unionByName(second.select(first.columns))


def chats(spark, d) -> DataFrame:
    """Every turn of a conversation as one read: read_id, sample, seq."""
    # dealt out before anything is derived, as reads are
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").repartition(n, "conv_id", "turn", F.xxhash64("text"))
    return x.select((F.coalesce("conv_id", F.lit(-1)) * 1000 + F.coalesce("turn", F.lit(0))).cast("long").alias("read_id"), F.coalesce("role", F.lit("none")).alias("sample"), bases(F.col("text")).alias("seq"))


def references(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), bases(F.col("text")).alias("seq"))


def alignments(spark, d) -> DataFrame:
    x = table(spark, d, "lineitem")
    line = F.col("l_linenumber")
    pos = F.col("l_partkey") * 10 + line
    return x.select(
        F.col("l_orderkey").cast("string").alias("name"), (line % 2 + 1).cast("int").alias("mate"), F.col("l_returnflag").alias("chrom"), pos.cast("long").alias("pos"), (pos + F.col("l_quantity").cast("long")).alias("end_pos"),
        F.round(F.col("l_discount") * 600).cast("int").alias("mapq"), (line <= 4).alias("is_paired"), (line <= 3).alias("is_proper"), (line < 7).alias("is_mapped"), (line != 4).alias("mate_mapped"),
        (line != 6).alias("is_primary"), ((line == 5) & (F.col("l_linestatus") == "F")).alias("is_dup"), (line % 2 == 0).alias("is_reverse"), (line % 5).cast("int").alias("soft_clip"))


def regions(spark, d) -> DataFrame:
    x = table(spark, d, "part")
    chrom = F.when(F.col("p_partkey") % 3 == 0, "A").when(F.col("p_partkey") % 3 == 1, "N").otherwise("R")
    start = F.col("p_partkey") * 10
    return x.select(F.col("p_partkey").alias("uid"), chrom.alias("chrom"), start.cast("long").alias("start"), (start + F.col("p_size")).cast("long").alias("end"), F.col("p_brand").alias("name"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"))


def haplotypes(spark, d) -> DataFrame:
    """target, sample, replicate, seq, cnt, preferred."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), bases(F.concat("c_mktsegment", F.lit("abcdefgh"), "c_mktsegment")).alias("s"))
    o = table(spark, d, "orders")
    variant = F.when(F.col("o_orderkey") % 3 == 0, F.col("s")).otherwise(F.concat(F.left("s", F.lit(5)), F.lit("T"), F.col("s").substr(F.lit(7), F.length("s"))))
    return o.join(c, "o_custkey").select(F.col("o_orderpriority").alias("target"), F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("replicate"), variant.alias("seq"), F.floor("o_totalprice").cast("long").alias("cnt"), (F.col("o_orderstatus") == "F").alias("preferred"))


def places(spark, d) -> DataFrame:
    """haplotype, country, site, seq, cnt of every customer."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("haplotype"), F.col("r_name").alias("country"), F.when(F.col("c_custkey") % 50 != 0, F.col("n_name")).alias("site"), bases(F.col("c_mktsegment")).alias("seq"), F.lit(1).cast("long").alias("cnt"))


_TEXT = f"translate(regexp_replace(lower(coalesce({{0}}, '')), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}')"
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"

READS_SQL = f"""reads AS (SELECT doc_id * {WIDTH} + w AS read_id, doc_id, w, sample, name, seq,
  array_to_string(list_transform(range(1, len(seq) + 1), lambda i: chr(CAST((doc_id * 7 + i * 3) % 41 + 33 AS INT))), '') AS qual
  FROM (SELECT doc_id, w, sample, name, CASE WHEN w * {STEP} + {READ} <= len(s) THEN substr(s, w * {STEP} + 1, {READ}) ELSE right(s, {READ}) END AS seq
  FROM (SELECT *, unnest(range(0, CASE WHEN len(s) = 0 THEN 0 WHEN len(s) <= {READ} THEN 1 ELSE (len(s) - {READ} + {STEP} - 1) // {STEP} + 1 END)) AS w FROM (SELECT doc_id, lang AS sample, source AS name, {_TEXT.format('text')} AS s FROM documents))))"""
READS_N_SQL = READS_SQL.replace("[^a-z]", "[^a-z0-9]").replace(f"'{LETTERS}', '{BASES}'", f"'{LETTERS}0123456789', '{BASES}NNNNNNNNNN'")
MATES_SQL = READS_SQL + f""", mates AS (SELECT read_id, read_id AS pair_id, 1 AS mate, sample, seq, qual FROM reads r WHERE w % 2 = 0 AND EXISTS (SELECT 1 FROM reads q WHERE q.read_id = r.read_id + 1)
  UNION ALL SELECT read_id, read_id - 1, 2, sample, {_RC.format('seq')}, reverse(qual) FROM reads WHERE w % 2 = 1),
pairs AS (SELECT a.pair_id, a.sample, a.seq AS seq1, b.seq AS seq2, a.qual AS qual1, b.qual AS qual2 FROM mates a JOIN mates b ON a.pair_id = b.pair_id AND a.mate = 1 AND b.mate = 2)"""
REFERENCES_SQL = f"refs AS (SELECT item_id AS id, {_TEXT.format('text')} AS seq FROM benchmark)"
CHATS_SQL = f"chats AS (SELECT CAST(coalesce(conv_id, -1) * 1000 + coalesce(turn, 0) AS BIGINT) AS read_id, coalesce(role, 'none') AS sample, {_TEXT.format('text')} AS seq FROM conversations)"
ALIGNMENTS_SQL = """aln AS (SELECT CAST(l_orderkey AS VARCHAR) AS name, CAST(l_linenumber % 2 + 1 AS INT) AS mate, l_returnflag AS chrom, CAST(l_partkey * 10 + l_linenumber AS BIGINT) AS pos,
  CAST(l_partkey * 10 + l_linenumber + CAST(l_quantity AS BIGINT) AS BIGINT) AS end_pos, CAST(round(l_discount * 600) AS INT) AS mapq, l_linenumber <= 4 AS is_paired, l_linenumber <= 3 AS is_proper,
  l_linenumber < 7 AS is_mapped, l_linenumber <> 4 AS mate_mapped, l_linenumber <> 6 AS is_primary, l_linenumber = 5 AND l_linestatus = 'F' AS is_dup, l_linenumber % 2 = 0 AS is_reverse, l_linenumber % 5 AS soft_clip FROM lineitem)"""
REGIONS_SQL = """regions AS (SELECT p_partkey AS uid, CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS chrom, CAST(p_partkey * 10 AS BIGINT) AS start_, CAST(p_partkey * 10 + p_size AS BIGINT) AS end_,
  p_brand AS name, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)"""
HAPLOTYPES_SQL = f"""haps AS (SELECT o_orderpriority AS target, o_custkey AS sample, o_orderkey AS replicate, CASE WHEN o_orderkey % 3 = 0 THEN s ELSE left(s, 5) || 'T' || substr(s, 7) END AS seq,
  CAST(floor(o_totalprice) AS BIGINT) AS cnt, o_orderstatus = 'F' AS preferred FROM orders JOIN (SELECT c_custkey, {_TEXT.format("c_mktsegment || 'abcdefgh' || c_mktsegment")} AS s FROM customer) ON o_custkey = c_custkey)"""
PLACES_SQL = f"""places AS (SELECT c_custkey AS sample, c_mktsegment AS haplotype, r_name AS country, CASE WHEN c_custkey % 50 <> 0 THEN n_name END AS site, {_TEXT.format('c_mktsegment')} AS seq, 1::BIGINT AS cnt
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def kmers_sql(k: int, cutoff: int) -> str:
    """reads -> kmers, counts, nodes, links and edges of the graph of each sample."""
    return READS_SQL + f""", kmers AS (SELECT sample AS assembly_id, read_id, pos, substr(seq, pos + 1, {k}) AS kmer, CASE WHEN pos + 1 + {k} <= len(seq) THEN substr(seq, pos + 2, {k}) END AS nxt FROM (SELECT *, unnest(range(0, len(seq) - {k} + 1)) AS pos FROM reads WHERE len(seq) > {k})),
counts AS (SELECT assembly_id, kmer, count(*) AS cnt FROM kmers GROUP BY ALL), nodes AS (SELECT * FROM counts WHERE cnt > {cutoff}),
rep AS (SELECT read_id FROM (SELECT read_id, count(*) AS n, count(DISTINCT kmer) AS m FROM kmers GROUP BY 1) WHERE n > m),
occ AS (SELECT *, 0 AS occ FROM kmers ANTI JOIN rep USING (read_id) UNION ALL SELECT *, greatest(row_number() OVER (PARTITION BY read_id, kmer ORDER BY pos) - 1, CASE WHEN nxt IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY read_id, nxt ORDER BY pos) - 1 END) FROM kmers SEMI JOIN rep USING (read_id)),
links AS (SELECT o.assembly_id, o.kmer AS src, o.nxt AS dst, CASE WHEN occ = 0 THEN CAST(read_id AS VARCHAR) ELSE read_id || '#again' || occ END AS read
  FROM occ o SEMI JOIN nodes a ON o.assembly_id = a.assembly_id AND o.kmer = a.kmer SEMI JOIN nodes b ON o.assembly_id = b.assembly_id AND o.nxt = b.kmer),
edges AS (SELECT o.assembly_id, o.kmer AS src, o.nxt AS dst, count(*) AS cnt FROM kmers o SEMI JOIN nodes a ON o.assembly_id = a.assembly_id AND o.kmer = a.kmer SEMI JOIN nodes b ON o.assembly_id = b.assembly_id AND o.nxt = b.kmer GROUP BY ALL)"""
