"""Registered queries of the library's operators over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import contigs as C
from ..operators import geography as H
from ..operators import kmers as K
from ..operators import population as P
from ..operators import reads as R
from ..operators import regions as I
from ..operators.staging import staged
from . import fixtures as X
from .assemble import Settings, filtered
from .registry import QUERIES, SQL, query  # noqa: F401

KLEN, CUT = 31, 2


#: Entropy in bits of the base counts of a sequence, N counted as A.
_ENTROPY = "list_sum(list_transform(['A','C','G','T'], lambda b: CASE WHEN len({0}) - len(replace({0}, b, '')) > 0 THEN -((len({0}) - len(replace({0}, b, ''))) / len({0})) * log2((len({0}) - len(replace({0}, b, ''))) / len({0})) ELSE 0 END))"
_KEPT = X.READS_SQL + f", good AS (SELECT * FROM reads WHERE {_ENTROPY.format('seq')} >= 0.75), kept AS (SELECT * FROM good WHERE read_id IN (SELECT min(read_id) FROM good GROUP BY sample, seq))"


@query(f"WITH {_KEPT}, k AS (SELECT sample, substr(seq, p, {KLEN}) AS kmer FROM (SELECT *, unnest(range(1, len(seq) - {KLEN} + 2)) AS p FROM kept WHERE len(seq) > {KLEN})) SELECT sample, kmer, count(*) AS cnt FROM k GROUP BY ALL HAVING count(*) > {CUT}")
def k07_surviving_kmers(spark, d):
    kept = filtered(X.reads(spark, d), Settings(k=KLEN))
    return K.count_kmers(kept, KLEN, "sample").where(F.col("cnt") > CUT)


# --- reads ------------------------------------------------------------------------

_Q = "list_transform(range(1, len(qual) + 1), lambda i: ascii(substr(qual, i, 1)) - 33)"


@query(f"WITH {X.READS_SQL}, q AS (SELECT read_id, list_filter(range(0, len(qual)), lambda i: {_Q}[i + 1] >= 20) AS g FROM reads) SELECT read_id, coalesce(list_min(g), 0) AS start, coalesce(list_max(g) + 1, 0) AS end_, coalesce(list_max(g) + 1 - list_min(g), 0) AS n FROM q".replace(_Q + "[i + 1]", "(ascii(substr(qual, i + 1, 1)) - 33)"))
def b01_quality_trim(spark, d):
    t = R.quality_trim(X.reads(spark, d).withColumn("b", S.quality_bounds("qual", 20)), 20)
    return t.select("read_id", F.col("b.start").alias("start"), F.col("b.end").alias("end_"), F.length("seq").alias("n"))


@query(f"WITH {X.READS_SQL}, w AS (SELECT read_id, i * 5 AS p FROM (SELECT read_id, seq, unnest(range(0, CASE WHEN len(seq) >= 20 THEN (len(seq) - 20) // 5 + 1 ELSE 0 END)) AS i FROM reads) WHERE {_ENTROPY.format('substr(seq, i * 5 + 1, 20)')} >= 1.7) SELECT r.read_id, coalesce(max(p) + 20 - min(p), 0) AS n FROM reads r LEFT JOIN w ON r.read_id = w.read_id GROUP BY r.read_id")
def b02_entropy_trim(spark, d):
    return R.entropy_trim(X.reads(spark, d), 20, 5, 1.7).select("read_id", F.length("seq").alias("n"))


@query(f"WITH {X.READS_SQL} SELECT sample, count(*) AS n, count(*) FILTER (WHERE list_count(list_filter(range(1, len(qual) + 1), lambda i: ascii(substr(qual, i, 1)) - 33 >= 20)) / len(qual) >= 0.5) AS enough_quality, count(*) FILTER (WHERE {_ENTROPY.format('seq')} >= 1.5) AS enough_entropy FROM reads GROUP BY sample")
def b03_b04_filter_counts(spark, d):
    r = X.reads(spark, d)
    return R.filter_tests(r, {"enough_quality": S.quality_fraction("qual", 20) >= 0.5, "enough_entropy": S.base_entropy("seq") >= 1.5})


@query(f"WITH {X.READS_SQL} SELECT min(read_id) AS read_id, sample FROM reads GROUP BY sample, seq")
def b05_first_of_duplicates(spark, d):
    return R.first_of_duplicates(X.reads(spark, d), R.unpaired_key(), "read_id").select("read_id", "sample")


_FATES = X.MATES_SQL + f""", t AS (SELECT *, {_ENTROPY.format('seq1')} >= 1.9 AS ok1, {_ENTROPY.format('seq2')} >= 1.9 AS ok2, CASE WHEN seq1 <= seq2 THEN seq1 || '-' || seq2 ELSE seq2 || '-' || seq1 END AS key FROM pairs),
f AS (SELECT sample, key, min(pair_id) AS m FROM t WHERE ok1 AND ok2 GROUP BY ALL),
fate AS (SELECT t.pair_id, t.sample, CASE WHEN ok1 AND ok2 AND t.pair_id = f.m THEN 'pair' WHEN ok1 AND ok2 THEN 'dup' WHEN ok1 THEN 'single1' WHEN ok2 THEN 'single2' ELSE 'off' END AS fate FROM t LEFT JOIN f ON t.sample = f.sample AND t.key = f.key)"""


@query(f"WITH {_FATES} SELECT * FROM fate")
def b06_pair_fates(spark, d):
    return R.route_pairs(R.pairs(X.mates(spark, d)), S.base_entropy("seq1") >= 1.9, S.base_entropy("seq2") >= 1.9).select("pair_id", "sample", "fate")


@query(f"WITH {_FATES} SELECT count(*) AS total, count(*) FILTER (WHERE fate = 'pair') AS pairs, count(*) FILTER (WHERE fate = 'dup') AS dups, count(*) FILTER (WHERE fate LIKE 'single%') AS singles, count(*) FILTER (WHERE fate = 'off') AS off FROM fate")
def b07_fate_counts(spark, d):
    f = F.col("fate")
    return R.filter_counts(b06_pair_fates(spark, d), {"pairs": f == "pair", "dups": f == "dup", "singles": f.startswith("single"), "off": f == "off"})


_NEAR = "k.p < 40 OR k.p + 12 > k.n - 40"
_REPORT = X.MATES_SQL + f""", q AS (SELECT *, CASE WHEN list_count(list_filter(range(1, len(qual) + 1), lambda i: ascii(substr(qual, i, 1)) - 33 >= 18)) / len(qual) < 0.55 THEN 'quality' WHEN {_ENTROPY.format('seq')} < 1.9 THEN 'entropy' END AS fault FROM (SELECT read_id, pair_id, mate, sample, seq, qual FROM mates UNION ALL SELECT read_id, read_id, 0, sample, seq, qual FROM reads ANTI JOIN mates USING (read_id))),
pr AS (SELECT a.sample, a.pair_id, a.read_id AS r1, b.read_id AS r2, a.seq AS s1, b.seq AS s2, a.fault AS f1, b.fault AS f2, CASE WHEN a.seq <= b.seq THEN a.seq || '-' || b.seq ELSE b.seq || '-' || a.seq END AS key FROM q a JOIN q b ON a.pair_id = b.pair_id AND a.mate = 1 AND b.mate = 2),
al AS (SELECT sample, read_id, seq FROM q WHERE mate = 0 AND fault IS NULL UNION ALL SELECT sample, r1, s1 FROM pr WHERE f1 IS NULL AND f2 IS NOT NULL UNION ALL SELECT sample, r2, s2 FROM pr WHERE f2 IS NULL AND f1 IS NOT NULL),
kp AS (SELECT * FROM pr WHERE f1 IS NULL AND f2 IS NULL QUALIFY row_number() OVER (PARTITION BY sample, key ORDER BY pair_id) = 1), on1 AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY sample, seq ORDER BY read_id) = 1),
ks AS (SELECT sample, r1 AS pair, 'r1' AS side, s1 AS seq, r1 AS read_id FROM kp UNION ALL SELECT sample, r1, 'r2', s2, r2 FROM kp UNION ALL SELECT sample, read_id, 'singles', seq, read_id FROM on1),
k0 AS (SELECT len(seq) AS n, p, substr(seq, p + 1, 12) AS kmer FROM (SELECT *, unnest(range(0, greatest(len(seq) - 11, 0))) AS p FROM reads)), c AS (SELECT kmer FROM k0 GROUP BY kmer HAVING count(*) >= 5 AND stddev_pop(p) < 15),
ht AS (SELECT sample, pair, count(*) AS sides, min(side) AS side FROM ks SEMI JOIN (SELECT read_id FROM (SELECT read_id, len(seq) AS n, p, substr(seq, p + 1, 12) AS kmer FROM (SELECT *, unnest(range(0, greatest(len(seq) - 11, 0))) AS p FROM ks)) k JOIN c USING (kmer) WHERE {_NEAR}) USING (read_id) GROUP BY ALL),
du AS (SELECT sample, sum(n - 1)::BIGINT AS d FROM (SELECT sample, key, count(*) AS n FROM pr WHERE f1 IS NULL AND f2 IS NULL GROUP BY ALL) GROUP BY 1), ds AS (SELECT sample, sum(n - 1)::BIGINT AS d FROM (SELECT sample, seq, count(*) AS n FROM al GROUP BY ALL) GROUP BY 1),
hc AS (SELECT sample, count(*) FILTER (WHERE sides > 1) AS pc, count(*) FILTER (WHERE sides = 1 AND side = 'r1') AS c1, count(*) FILTER (WHERE sides = 1 AND side = 'r2') AS c2, count(*) FILTER (WHERE sides = 1 AND side = 'singles') AS cs FROM ht GROUP BY 1)"""


@query(f"WITH {_REPORT} SELECT sample, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE mate = {m} AND fault = '{f}') AS {n}_{f}" for f in ("quality", "entropy") for m, n in ((1, "r1"), (2, "r2"), (0, "singles"))) + ", coalesce(any_value(du.d), 0) AS pairs_duplicates, coalesce(any_value(ds.d), 0) AS singles_duplicates, coalesce(any_value(pc), 0) AS pairs_constant, coalesce(any_value(c1), 0) AS r1_constant, coalesce(any_value(c2), 0) AS r2_constant, coalesce(any_value(cs), 0) AS singles_constant FROM q LEFT JOIN du USING (sample) LEFT JOIN ds USING (sample) LEFT JOIN hc USING (sample) GROUP BY sample")
def b07_filter_report(spark, d):
    """All thirteen counters, over pairs of windows and the windows without a mate."""
    r = staged(X.reads(spark, d))  # read some ten times: for both mates, singles and constant k-mers
    m = X.mates(spark, d, r)
    alone = r.join(m.select("read_id"), "read_id", "left_anti")
    return R.filter_report(R.pairs(m), alone, 18, 0.55, 1.9, (R.constant_kmers(r, 12, 5, 15.0), 12, 40))


@query(f"WITH {X.MATES_SQL} SELECT pair_id, mate, seq FROM mates")
def b08_mates(spark, d):
    return X.mates(spark, d).select("pair_id", "mate", "seq")


@query(f"WITH {X.READS_N_SQL} SELECT sample, count(*) AS n, count(*) FILTER (WHERE len(seq) > {KLEN} AND seq NOT LIKE '%N%') AS countable FROM reads GROUP BY sample")
def b09_countable(spark, d):
    r = X.reads(spark, d, with_n=True)
    ok = R.countable(r, KLEN).groupBy("sample").agg(F.count("*").alias("countable"))
    return r.groupBy("sample").agg(F.count("*").alias("n")).join(ok, "sample", "left").na.fill(0)


@query(f"WITH {X.READS_SQL} SELECT read_id FROM reads WHERE len(seq) > 6 AND NOT regexp_matches(seq, 'A{{6}}|C{{6}}|G{{6}}|T{{6}}')")
def b10_countable_without_homopolymer(spark, d):
    return R.countable_without_homopolymer(X.reads(spark, d), 6).select("read_id")


@query(f"WITH {X.READS_N_SQL}, p AS (SELECT read_id, unnest(string_split_regex(seq, 'N+')) AS s, unnest(range(0, len(string_split_regex(seq, 'N+')))) AS i FROM reads WHERE seq LIKE '%N%'), m AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY len(s) DESC, i) AS r FROM p) SELECT read_id, s AS seq FROM m WHERE r = 1 AND len(s) > {KLEN + 1}")
def b11_rescue_n(spark, d):
    return R.rescue_n(X.reads(spark, d, with_n=True), KLEN).select("read_id", "seq")


_CONST = X.READS_SQL + ", k AS (SELECT read_id, len(seq) AS n, p, substr(seq, p + 1, 12) AS kmer FROM (SELECT *, unnest(range(0, greatest(len(seq) - 11, 0))) AS p FROM reads)), c AS (SELECT kmer, stddev_pop(p) AS sd FROM k GROUP BY kmer HAVING count(*) >= 5 AND stddev_pop(p) < 15)"


@query(f"WITH {_CONST} SELECT read_id FROM reads WHERE read_id NOT IN (SELECT read_id FROM k JOIN c USING (kmer) WHERE p < 40 OR p + 12 > n - 40)")
def b12_drop_constant_kmers(spark, d):
    r = X.reads(spark, d)
    return R.drop_constant(r, R.constant_kmers(r, 12, 5, 15.0), 12, 40).select("read_id")


@query(f"WITH {X.READS_SQL}, x AS (SELECT read_id, name, row_number() OVER (PARTITION BY name ORDER BY read_id) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM reads) SELECT read_id, name, CASE WHEN i // 2 * 2 + 1 < n THEN i // 2 END AS pair_no, CASE WHEN i // 2 * 2 + 1 < n THEN i % 2 + 1 END AS mate FROM x")
def b13_repair_singles(spark, d):
    return R.repair_singles(X.reads(spark, d)).select("read_id", "name", "pair_no", "mate")


_STITCH = X.MATES_SQL + f""", s AS (SELECT pair_id, seq1, {{b}} AS m, list_max(list_filter(range(31, least(len(seq1), len(seq2)) + 1), lambda o: right(seq1, o) = left({{b}}, o))) AS o FROM pairs),
st AS (SELECT pair_id, CASE WHEN o IS NULL THEN 'none' WHEN o = len(seq1) AND o = len(m) THEN 'perfect' ELSE 'r1_ends_in_r2' END AS status, CASE WHEN o IS NOT NULL THEN seq1 || substr(m, o + 1) END AS stitched FROM s)"""


def _stitched(spark, d, turned):
    p = R.pairs(X.mates(spark, d))
    return R.stitch(p.withColumn("seq2", S.reverse_complement("seq2")) if turned else p, 31)


@query("WITH " + _STITCH.format(b="reverse(translate(seq2, 'ACGT', 'TGCA'))") + " SELECT * FROM st")
def b14_stitch(spark, d):
    return _stitched(spark, d, True).select("pair_id", "status", "stitched")


@query(f"""WITH {_STITCH.format(b='seq2')}, s2 AS (SELECT seq1, seq2, list_max(list_filter(range(31, least(len(seq1), len(seq2)) + 1), lambda o: right(seq1, o) = left(reverse(translate(seq2, 'ACGT', 'TGCA')), o))) AS o FROM pairs JOIN st USING (pair_id) WHERE status = 'none'),
a AS (SELECT CASE WHEN o IS NULL THEN 'none' WHEN o = len(seq1) AND o = len(seq2) THEN 'perfect' ELSE 'r1_ends_in_r2' END AS status FROM s2)
SELECT status, count(*) FILTER (WHERE t = 1) AS before, count(*) FILTER (WHERE t = 2) AS after, count(*) AS combined FROM (SELECT status, 1 AS t FROM st UNION ALL SELECT status, 2 FROM a) GROUP BY status""")
def b14_stitch_counts(spark, d):
    first = _stitched(spark, d, False)
    again = R.stitch(first.where("overlap IS NULL").withColumn("seq2", S.reverse_complement("seq2")).drop("overlap", "status", "stitched"), 31)
    return R.stitch_counts(first, again)


@query(f"WITH x AS (SELECT lang AS sample, len({X._TEXT.format('text')}) AS n FROM documents) SELECT sample, avg(n) AS mean_len, median(n) AS median_len, max(n) AS max_len FROM x GROUP BY sample")
def b15_length_stats(spark, d):
    return R.length_stats(X.table(spark, d, "documents").select(F.col("lang").alias("sample"), X.bases(F.col("text")).alias("seq")))


@query(f"""WITH {X.READS_SQL}, c AS (SELECT read_id, p, substr(seq, p + 1, 1) AS b FROM (SELECT *, unnest(range(0, len(seq))) AS p FROM reads)),
g AS (SELECT *, p - row_number() OVER (PARTITION BY read_id, b ORDER BY p) AS g FROM c) SELECT read_id, min(p) AS start, max(p) + 1 AS end_ FROM g GROUP BY read_id, b, g HAVING count(*) >= 4""")
def b16_homopolymers(spark, d):
    return X.reads(spark, d).select("read_id", F.explode(S.homopolymers("seq", 4)).alias("x")).select("read_id", F.col("x.start").alias("start"), F.col("x.end").alias("end_"))


def _tandems(spark, d):
    refs = X.references(spark, d).withColumnRenamed("id", "read_id")
    return refs, R.tandem_candidates(refs, 5)


@query()
def b17_tandem_candidates(spark, d):
    return _tandems(spark, d)[1]


@query()
def b18_b22_tandems(spark, d):
    refs, found = _tandems(spark, d)
    units = R.choose_tandems(found, 5, 1).select(F.explode("alternates").alias("unit")).distinct()
    joined = R.join_tandems(R.locate_tandems(refs, units, 2, 8), refs)
    return R.expansion_intervals(refs, joined, 9)


@query(f"""WITH {X.ALIGNMENTS_SQL}, s AS (SELECT name, pos, end_pos, max(end_pos) OVER (PARTITION BY name ORDER BY pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM aln),
g AS (SELECT *, sum(CASE WHEN e IS NULL OR pos > e + 9 THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY pos, end_pos) AS g FROM s) SELECT name, min(pos) AS start, max(end_pos) AS end_ FROM g GROUP BY name, g""")
def b21_merge_intervals(spark, d):
    x = X.alignments(spark, d).groupBy("name").agg(S.merge_intervals(F.collect_list(F.struct(F.col("pos").alias("start"), F.col("end_pos").alias("end"))), 10).alias("m"))
    return x.select("name", F.explode("m").alias("x")).select("name", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end_"))


@query()
def b23_subsample(spark, d):
    r = X.mates(spark, d).withColumn("region", F.col("sample"))
    return R.subsample(r, r.select("region").distinct().withColumn("share", F.lit(0.25))).select("read_id", "pair_id", "mate")


@query(r"SELECT page_id, regexp_replace(regexp_extract(regexp_extract(url, '([^/]+)$', 1), '^([^.]+)', 1), '_R[12].*$', '') AS sample FROM pages")
def b24_sample_name(spark, d):
    return X.table(spark, d, "pages").select("page_id", R.sample_name(F.col("url")).alias("sample"))


# --- k-mers and graph -------------------------------------------------------------


@query(f"WITH {X.kmers_sql(KLEN, CUT)} SELECT assembly_id, kmer, cnt FROM counts WHERE cnt > 1")
def k01_kmer_counts(spark, d):
    return K.count_kmers(X.reads(spark, d).withColumn("assembly_id", F.col("sample")), KLEN, "assembly_id").where("cnt > 1")


def _graph(spark, d, k=KLEN, cut=CUT):
    r = X.reads(spark, d).withColumn("assembly_id", F.col("sample"))
    tokens = K.with_tokens(r, k).select("assembly_id", "read_id", "tokens")
    return K.thread_reads(tokens, staged(K.nodes_from_counts(K.count_kmers(r, k, "assembly_id"), cut)), k)


def _named(g, edges):
    n = g.nodes.select("assembly_id", "node_id", "seq")
    return edges.join(n.toDF("assembly_id", "src", "src_seq"), ["assembly_id", "src"]).join(n.toDF("assembly_id", "dst", "dst_seq"), ["assembly_id", "dst"])


@query(f"""WITH {X.kmers_sql(KLEN, CUT)}, a AS (SELECT assembly_id, avg(cnt) AS mean_all, median(cnt) AS median_all, avg(cnt) FILTER (WHERE cnt > 2) AS mean_above2, median(cnt) FILTER (WHERE cnt > 2) AS median_above2 FROM counts GROUP BY 1)
SELECT a.*, greatest(mean_above2, median_above2) AS pivot_count, avg(c.cnt) AS mean_high, median(c.cnt) AS median_high FROM a LEFT JOIN counts c ON a.assembly_id = c.assembly_id AND greatest(mean_above2, median_above2) >= 30 AND c.cnt > greatest(mean_above2, median_above2) * 0.5 GROUP BY ALL""")
def k03_count_stats(spark, d):
    return K.count_stats(K.count_kmers(X.reads(spark, d).withColumn("assembly_id", F.col("sample")), KLEN, "assembly_id"), "assembly_id")


_PERCENTS = "p AS (SELECT unnest([0.01, 0.02, 0.03, 0.05])::DOUBLE AS percent)"


def _percents(spark):
    return spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.05,)], "percent double")


@query(f"WITH {X.kmers_sql(KLEN, CUT)}, {_PERCENTS}, n AS (SELECT assembly_id, count(*) AS node_count FROM nodes GROUP BY 1) SELECT assembly_id, node_count, percent, ceil(percent * node_count)::BIGINT AS kcut FROM n, p WHERE node_count > 100")
def k04_cutoffs_from_nodes(spark, d):
    counts = K.count_kmers(X.reads(spark, d).withColumn("assembly_id", F.col("sample")), KLEN, "assembly_id")
    return K.cutoffs_from_nodes(K.nodes_from_counts(counts, CUT).groupBy("assembly_id").agg(F.count("*").alias("node_count")), _percents(spark))


@query(f"WITH {X.READS_SQL}, {_PERCENTS}, b AS (SELECT sample, sum(len(seq))::BIGINT AS bases FROM reads GROUP BY 1) SELECT sample, bases, percent, ceil(percent * bases / 9000)::BIGINT AS kcut FROM b, p")
def k05_cutoffs_from_bases(spark, d):
    return K.cutoffs_from_bases(X.reads(spark, d), 9000, _percents(spark))


def _hash_sql(*parts):
    return "sum(('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 8))::BIGINT)::BIGINT"


def _hash(*parts):
    return F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long"))


@query(f"WITH {X.kmers_sql(KLEN, CUT)} SELECT assembly_id, count(*) AS edges, sum(cnt)::BIGINT AS cnt, {_hash_sql('src', 'dst', 'CAST(cnt AS VARCHAR)')} AS edge_hash FROM edges GROUP BY 1")
def k08_threaded_edges(spark, d):
    """Numbers and hashes of all edges; so many rows are not compared one by one."""
    g = _graph(spark, d)
    return _named(g, g.edges).groupBy("assembly_id").agg(F.count("*").alias("edges"), F.sum("cnt").alias("cnt"), _hash("src_seq", "dst_seq", F.col("cnt").cast("string")).alias("edge_hash"))


@query(f"WITH {X.kmers_sql(KLEN, CUT)} SELECT assembly_id, count(*) AS edge_reads, {_hash_sql('src', 'dst', 'read')} AS read_hash FROM (SELECT DISTINCT * FROM links) GROUP BY 1")
def k09_edge_reads(spark, d):
    g = _graph(spark, d)
    return _named(g, g.edge_reads).groupBy("assembly_id").agg(F.count("*").alias("edge_reads"), _hash("src_seq", "dst_seq", "read").alias("read_hash"))


@query(f"""WITH {X.kmers_sql(KLEN, CUT)}, m AS (SELECT * FROM nodes WHERE cnt > 4), e AS (SELECT x.* FROM edges x SEMI JOIN m p ON x.assembly_id = p.assembly_id AND x.src = p.kmer SEMI JOIN m q ON x.assembly_id = q.assembly_id AND x.dst = q.kmer WHERE x.cnt > 3),
x AS (SELECT m.assembly_id, coalesce(h, 0) AS heads, coalesce(t, 0) AS tails FROM m LEFT JOIN (SELECT assembly_id, dst AS kmer, count(*) AS h FROM e GROUP BY ALL) i USING (assembly_id, kmer) LEFT JOIN (SELECT assembly_id, src AS kmer, count(*) AS t FROM e GROUP BY ALL) o USING (assembly_id, kmer))
SELECT assembly_id, count(*) AS nodes, count(*) FILTER (WHERE heads = 0) AS headless, count(*) FILTER (WHERE tails = 0) AS tailless, count(*) FILTER (WHERE heads = 0 AND tails = 0) AS isolated FROM x GROUP BY 1""")
def k15_k21_pruned_states(spark, d):
    return K.state_counts(K.prune_edges(K.prune_nodes(_graph(spark, d), 4), 3))


# --- contigs ----------------------------------------------------------------------

_SIM = X.REFERENCES_SQL + """, k AS (SELECT id, len(seq) AS n, substr(seq, p, 10) AS kmer, count(*) AS c FROM (SELECT *, unnest(range(1, len(seq) - 8)) AS p FROM refs) GROUP BY ALL)"""


@query(f"WITH {_SIM} SELECT a.id AS a_id, b.id AS b_id, sum(least(a.c, b.c)) / (least(a.n, b.n) - 9) AS similarity FROM k a JOIN k b USING (kmer) GROUP BY a.id, b.id, a.n, b.n")
def c04_kmer_similarity(spark, d):
    refs = X.references(spark, d)
    return C.kmer_similarity(refs, refs, 10)


@query(f"""WITH {X.READS_SQL}, {X.REFERENCES_SQL}, own AS (SELECT sample, read_id, substr(seq, p, 15) AS kmer FROM (SELECT *, unnest(range(1, len(seq) - 13)) AS p FROM reads)), often AS (SELECT sample, kmer FROM own GROUP BY ALL HAVING count(*) > 1),
ref AS (SELECT DISTINCT substr(seq, p, 15) AS kmer FROM (SELECT *, unnest(range(1, len(seq) - 13)) AS p FROM refs)), s AS (SELECT sample, read_id, count(ref.kmer) / count(*) AS share FROM own SEMI JOIN often USING (sample, kmer) LEFT JOIN ref USING (kmer) GROUP BY ALL)
SELECT r.sample, r.total, coalesce(u, 0) AS used, coalesce(u, 0) / r.total AS used_share FROM (SELECT sample, count(*) AS total FROM reads GROUP BY 1) r LEFT JOIN (SELECT sample, count(*) FILTER (WHERE share > 0.75) AS u FROM s GROUP BY 1) x USING (sample)""")
def c07_used_by_kmers(spark, d):
    r = X.reads(spark, d)
    contigs = r.select("sample").distinct().join(F.broadcast(X.references(spark, d)))
    return C.used_by_kmers(r, contigs, 15)


def _runs(spark, d):
    x = X.table(spark, d, "orders")
    return x.select(F.col("o_custkey").alias("region"), (F.floor("o_totalprice") % 100 / 100).alias("used_share"), (F.col("o_orderkey") % 5).alias("open_ends"), (F.col("o_orderkey") % 3).alias("short_inner"), (F.col("o_orderkey") % 7).alias("contigs"), (F.col("o_orderkey") % 4 + 2).alias("kcut"), (F.col("o_orderkey") % 3).alias("tip"), F.col("o_orderkey").alias("klen"))


_RUNS = "runs AS (SELECT o_custkey AS region, floor(o_totalprice)::BIGINT % 100 / 100 AS used_share, o_orderkey % 5 AS open_ends, o_orderkey % 3 AS short_inner, o_orderkey % 7 AS contigs, o_orderkey % 4 + 2 AS kcut, o_orderkey % 3 AS tip, o_orderkey AS klen FROM orders)"


@query(f"""WITH {_RUNS}, l AS (SELECT *, least(floor((used_share - 1e-12) / 0.1), 9) AS lev FROM runs), t AS (SELECT *, max(lev) OVER (PARTITION BY region) AS top FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY open_ends, short_inner, (CASE WHEN open_ends < 2 THEN contigs END) NULLS FIRST, kcut, tip, klen) AS r FROM t WHERE lev = top) SELECT region, klen, kcut, tip FROM r WHERE r = 1""")
def c11_best_runs(spark, d):
    return C.best_runs(_runs(spark, d), "region").select("region", "klen", "kcut", "tip")


def _hits(spark, d):
    return X.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("sample"), F.col("l_orderkey").alias("read_id"), (F.col("l_partkey") % 20).alias("contig")).distinct()


@query("""WITH h AS (SELECT DISTINCT l_returnflag AS sample, l_orderkey AS read_id, l_partkey % 20 AS contig FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY sample, read_id) AS ways FROM h),
u AS (SELECT sample, contig, count(*) AS u FROM n WHERE ways = 1 GROUP BY ALL), m AS (SELECT n.*, coalesce(u, 0) AS u FROM n LEFT JOIN u USING (sample, contig) WHERE ways > 1),
w AS (SELECT *, sum(u) OVER (PARTITION BY sample, read_id) AS us FROM m), s AS (SELECT sample, contig, sum(CASE WHEN us > 0 THEN u / us ELSE 1 / ways END) AS s FROM w GROUP BY ALL),
a AS (SELECT sample, contig, round(coalesce(u, 0) + round(coalesce(s, 0), 6))::BIGINT AS cnt FROM (SELECT DISTINCT sample, contig FROM h) LEFT JOIN u USING (sample, contig) LEFT JOIN s USING (sample, contig))
SELECT *, cnt / sum(cnt) OVER (PARTITION BY sample) AS fraction FROM a""")
def c21_share_multi(spark, d):
    return C.share_multi(_hits(spark, d))


@query(f"""WITH {X.ALIGNMENTS_SQL}, p AS (SELECT name AS contig, unnest(range(pos, end_pos)) AS pos FROM aln), g AS (SELECT contig, pos, count(*)::DOUBLE AS depth FROM p GROUP BY ALL), s AS (SELECT *, min(pos) OVER w AS lo, max(pos) OVER w AS hi, count(*) OVER w AS n FROM g WINDOW w AS (PARTITION BY contig))
SELECT contig, avg(depth) FILTER (WHERE n <= 60 OR (pos >= lo + 25 AND pos <= hi - 25)) AS coverage, max(n) AS positions FROM s GROUP BY contig""")
def c22_contig_coverage(spark, d):
    return C.contig_coverage(X.alignments(spark, d).select(F.col("name").alias("contig"), F.col("pos").alias("start"), F.col("end_pos").alias("end"), F.lit(1.0).alias("weight")))


@query(f"""WITH {X.HAPLOTYPES_SQL}, h AS (SELECT DISTINCT target AS region, seq AS id, seq FROM haps), p AS (SELECT region, id, len(seq) AS n, i AS pos, substr(seq, i + 1, 1) AS base FROM (SELECT *, unnest(range(0, len(seq))) AS i FROM h))
SELECT region, id, pos, base, kinds FROM p JOIN (SELECT region, n, pos, count(DISTINCT base) AS kinds FROM p GROUP BY ALL HAVING count(DISTINCT base) > 1) USING (region, n, pos)""")
def c28_variant_positions(spark, d):
    h = X.haplotypes(spark, d).select(F.col("target").alias("region"), F.col("seq").alias("id"), "seq").distinct()
    return C.variant_positions(h)


@query(f"WITH {X.HAPLOTYPES_SQL}, h AS (SELECT target AS region, seq, sum(cnt)::BIGINT AS cnt FROM haps GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY cnt DESC, seq) - 1 AS i, count(*) OVER (PARTITION BY region) AS n FROM h) SELECT region, seq, cnt, region || '.' || lpad(CAST(i AS VARCHAR), greatest(len(CAST(n - 1 AS VARCHAR)), 2)::INT, '0') AS hap FROM r")
def c25_named_haplotypes(spark, d):
    return C.name_haplotypes(X.haplotypes(spark, d).groupBy(F.col("target").alias("region"), "seq").agg(F.sum("cnt").alias("cnt")))


# --- regions ----------------------------------------------------------------------

_HIT = f"""{X.ALIGNMENTS_SQL}, {X.REGIONS_SQL}, good AS (SELECT * FROM aln WHERE is_primary AND is_mapped AND NOT is_dup), hit AS (SELECT a.*, uid, start_, end_, greatest(pos, start_) AS lo, least(end_pos, end_) AS hi FROM good a JOIN regions r ON a.chrom = r.chrom AND pos < end_ AND start_ < end_pos)"""


def _good(spark, d):
    return I.filter_alignments(X.alignments(spark, d))


@query(f"""WITH {_HIT}, b AS (SELECT uid, sum(hi - lo) AS raw, sum(CASE WHEN mapq < 5 THEN hi - lo ELSE 0 END) AS multi FROM hit GROUP BY 1),
t AS (SELECT a.uid, sum(greatest(least(a.hi, b.hi) - greatest(a.lo, b.lo), 0)) AS twice FROM hit a JOIN hit b ON a.uid = b.uid AND a.name = b.name AND a.mate = 1 AND b.mate = 2 GROUP BY 1)
SELECT r.uid, (coalesce(raw, 0) - coalesce(twice, 0))::BIGINT AS bases, coalesce(multi, 0)::BIGINT AS multi_bases, (coalesce(raw, 0) - coalesce(twice, 0)) / greatest(end_ - start_, 1) AS coverage FROM regions r LEFT JOIN b USING (uid) LEFT JOIN t USING (uid)""")
def i02_covered_bases(spark, d):
    return I.covered_bases(_good(spark, d), X.regions(spark, d)).select("uid", "bases", "multi_bases", "coverage")


@query(f"""WITH {_HIT}, p AS (SELECT uid, count(*) FILTER (WHERE is_paired) AS paired, count(*) FILTER (WHERE is_paired AND is_proper) AS proper, count(*) FILTER (WHERE is_paired AND NOT mate_mapped) AS mu FROM hit GROUP BY 1)
SELECT r.uid, coalesce(paired, 0) AS paired, coalesce(proper, 0) AS proper, coalesce(mu, 0) AS mate_unmapped, CASE WHEN paired > 0 THEN proper / paired ELSE 0 END AS proper_fraction, CASE WHEN paired > 0 THEN mu / paired ELSE 0 END AS mate_unmapped_fraction FROM regions r LEFT JOIN p USING (uid)""")
def i03_pair_fractions(spark, d):
    return I.pair_fractions(_good(spark, d), X.regions(spark, d)).select("uid", "paired", "proper", "mate_unmapped", "proper_fraction", "mate_unmapped_fraction")


@query(f"""WITH {_HIT}, p AS (SELECT uid, name, bool_or(pos <= start_ AND end_pos >= end_) AS one, count(DISTINCT mate) = 2 AND count(DISTINCT is_reverse) = 2 AND max(pos) <= min(end_pos) AND min(pos) <= max(start_) AND max(end_pos) >= max(end_) AS joint FROM hit GROUP BY ALL)
SELECT r.uid, coalesce(n, 0) AS reads, coalesce(s, 0) AS spanning FROM regions r LEFT JOIN (SELECT uid, count(*) AS n, count(*) FILTER (WHERE one OR joint) AS s FROM p GROUP BY 1) x USING (uid)""")
def i04_spanning_reads(spark, d):
    return I.spanning_reads(_good(spark, d), X.regions(spark, d)).select("uid", "reads", "spanning")


@query(f"WITH {X.REGIONS_SQL} SELECT uid, greatest(start_ - 36, 0) AS start_, end_ + 36 AS end_ FROM regions")
def i06_expanded_regions(spark, d):
    return I.expand_regions(X.regions(spark, d), 36).select("uid", F.col("start").alias("start_"), F.col("end").alias("end_"))


@query(f"WITH {_HIT}, b AS (SELECT r.uid, r.name, end_ - start_ AS n, (SELECT count(*) FROM hit h WHERE h.uid = r.uid) AS c FROM regions r) SELECT uid, (sum(c) OVER (PARTITION BY name))::BIGINT AS c_total, (sum(n) OVER (PARTITION BY name))::BIGINT AS length_total FROM b")
def i07_roll_up(spark, d):
    r = X.regions(spark, d)
    n = I.overlaps(_good(spark, d), r).groupBy("uid").agg(F.count("*").alias("c"))
    return I.roll_up(r.join(n, "uid", "left").na.fill(0, ["c"]), "c").select("uid", "c_total", "length_total")


@query(f"""WITH {_HIT}, g AS (SELECT * FROM aln WHERE name IN (SELECT name FROM hit)) SELECT name, mate, pos, CASE WHEN is_paired AND NOT mate_mapped THEN 'mate_unmapped' WHEN count(DISTINCT mate) OVER (PARTITION BY name) >= 2 THEN 'pair' ELSE 'single' END AS read_class FROM g""".replace("count(DISTINCT mate) OVER (PARTITION BY name) >= 2", "min(mate) OVER (PARTITION BY name) < max(mate) OVER (PARTITION BY name)").replace("(SELECT name FROM hit)", "(SELECT a.name FROM aln a JOIN regions r ON a.chrom = r.chrom AND pos < end_ AND start_ < end_pos)"))
def i08_recruited(spark, d):
    return I.recruit(X.alignments(spark, d), X.regions(spark, d)).select("name", "mate", "pos", "read_class")


@query(f"WITH {X.ALIGNMENTS_SQL}, {X.REGIONS_SQL} SELECT name, mate, pos FROM aln a WHERE (NOT is_mapped OR end_pos - pos <= 10) AND (name, mate) NOT IN (SELECT (b.name, b.mate) FROM aln b JOIN regions r ON b.chrom = r.chrom AND pos < end_ AND start_ < end_pos WHERE is_mapped AND end_pos - pos <= 10)".replace("(name, mate) NOT IN (SELECT (b.name, b.mate)", "NOT EXISTS (SELECT 1").replace("WHERE is_mapped AND end_pos - pos <= 10)", "WHERE b.name = a.name AND b.mate = a.mate AND b.is_mapped AND b.end_pos - b.pos <= 10)").replace("pos < end_ AND start_ < end_pos", "b.pos < end_ AND start_ < b.end_pos"))
def i09_outside(spark, d):
    return I.outside(X.alignments(spark, d), X.regions(spark, d), 10).select("name", "mate", "pos")


@query(f"""WITH {X.READS_SQL}, {X.REFERENCES_SQL}, c AS (SELECT DISTINCT substr(seq, p, 19) AS kmer FROM (SELECT *, unnest(range(1, len(seq) - 17)) AS p FROM refs WHERE len(seq) >= 80)),
b AS (SELECT read_id, '+' AS strand, seq FROM reads UNION ALL SELECT read_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM reads), h AS (SELECT DISTINCT read_id, strand, substr(seq, p, 19) AS kmer FROM (SELECT *, unnest(range(1, len(seq) - 17)) AS p FROM b)),
n AS (SELECT read_id, strand, count(*) AS shared FROM h SEMI JOIN c USING (kmer) GROUP BY ALL HAVING count(*) >= 5), r AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY shared DESC, strand) AS r FROM n) SELECT read_id, strand, shared FROM r WHERE r = 1""")
def i10_recruited_by_kmers(spark, d):
    return I.recruit_by_kmers(X.reads(spark, d), X.references(spark, d), 19, 5).select("read_id", "strand", "shared")


@query(f"WITH {X.HAPLOTYPES_SQL}, u AS (SELECT sample AS region, count(DISTINCT seq) AS uniq_haps FROM haps GROUP BY 1) SELECT uniq_haps, count(*) AS regions FROM u GROUP BY 1")
def i13_coi_histogram(spark, d):
    return I.coi_histogram(X.haplotypes(spark, d).select(F.col("sample").alias("region"), F.col("seq").alias("hap")))


# --- population -------------------------------------------------------------------


def _sets(spark, d):
    return X.haplotypes(spark, d).groupBy("target", "sample", "seq").agg(F.sum("cnt").alias("cnt"))


def _fractions(spark, d):
    return H.fraction_within(_sets(spark, d), ["target", "sample"], "frac").select("target", "sample", "seq", "cnt", "frac")


_SETS = X.HAPLOTYPES_SQL + ", sets AS (SELECT target, sample, seq, sum(cnt)::BIGINT AS cnt FROM haps GROUP BY ALL), fr AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY target, sample) AS frac FROM sets)"


@query(f"WITH {_SETS}, t AS (SELECT target, sample, count(*) * 100 AS reads FROM haps GROUP BY ALL) SELECT target, sample, seq, round(frac * reads)::BIGINT AS cnt, frac FROM fr JOIN t USING (target, sample) WHERE len(seq) >= 12 ORDER BY ALL")
def p03_p05_normalised(spark, d):
    h = P.gather(_sets(spark, d))
    totals = X.haplotypes(spark, d).groupBy("target", "sample").agg((F.count("*") * 100).alias("reads"))
    return P.normalise(h, totals).select("target", "sample", "seq", "cnt", "frac")


@query(f"WITH {_SETS}, n AS (SELECT target, count(*) AS n FROM sets GROUP BY 1) SELECT target, n, coalesce(sum(n) OVER (ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM n")
def p08_target_locations(spark, d):
    return P.target_locations(_sets(spark, d)).select("target", "n", "first")


@query(f"""WITH {X.HAPLOTYPES_SQL}, t AS (SELECT target, sample, replicate, max(preferred::INT) AS p, sum(cnt) AS c FROM haps GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY target, sample ORDER BY p DESC, c DESC, replicate) AS r FROM t) SELECT target, sample, replicate, seq, cnt FROM haps SEMI JOIN (SELECT * FROM r WHERE r = 1) USING (target, sample, replicate)""")
def p10_chosen_replicates(spark, d):
    return P.choose_replicates(X.haplotypes(spark, d), "sample", "replicate", "preferred").select("target", "sample", "replicate", "seq", "cnt")


_LEVELS = X.HAPLOTYPES_SQL + """, h AS (SELECT *, sample || '-' || replicate % 3 AS experiment FROM haps), t1 AS (SELECT target, experiment AS grp, replicate, max(preferred::INT) AS p, sum(cnt) AS c FROM h GROUP BY ALL), r1 AS (SELECT * FROM t1 QUALIFY row_number() OVER (PARTITION BY target, grp ORDER BY p DESC, c DESC, replicate) = 1),
h2 AS (SELECT h.* FROM h SEMI JOIN r1 ON h.target = r1.target AND h.experiment = r1.grp AND h.replicate = r1.replicate), t2 AS (SELECT target, CAST(sample AS VARCHAR) AS grp, replicate, max(preferred::INT) AS p, sum(cnt) AS c FROM h2 GROUP BY ALL), r2 AS (SELECT * FROM t2 QUALIFY row_number() OVER (PARTITION BY target, grp ORDER BY p DESC, c DESC, replicate) = 1)"""


def _levels(spark, d):
    h = X.haplotypes(spark, d).withColumn("experiment", F.concat_ws("-", "sample", (F.col("replicate") % 3).cast("string")))
    return P.choose_two_levels(h, "experiment", "sample", "replicate", "preferred")


@query(f"WITH {_LEVELS} SELECT h2.target, sample, h2.replicate, seq, cnt FROM h2 SEMI JOIN r2 ON h2.target = r2.target AND CAST(h2.sample AS VARCHAR) = r2.grp AND h2.replicate = r2.replicate")
def p10_chosen_at_two_levels(spark, d):
    return _levels(spark, d)[0].select("target", "sample", "replicate", "seq", "cnt")


@query(f"WITH {_LEVELS}, u AS (SELECT 'experiment' AS level, * FROM t1 UNION ALL SELECT 'biological', * FROM t2) SELECT level, target, grp AS \"group\", count(*) AS replicates FROM (SELECT *, max(p) OVER (PARTITION BY level, target, grp) AS top FROM u) WHERE p = top GROUP BY ALL HAVING count(*) > 1")
def p10_undecided_groups(spark, d):
    return _levels(spark, d)[1]


@query(f"WITH {_SETS} SELECT c.c_custkey AS target, count(s.seq) AS sequences FROM customer c LEFT JOIN sets s ON s.sample = c.c_custkey GROUP BY 1")
def p12_sequences_per_target(spark, d):
    h = _sets(spark, d).select(F.col("sample").alias("target"), "seq")
    return P.sequences_per_target(h, X.table(spark, d, "customer").select(F.col("c_custkey").alias("target")))


@query(f"WITH {_SETS} SELECT c_custkey AS sample, target FROM customer, (SELECT DISTINCT target FROM sets) t WHERE NOT EXISTS (SELECT 1 FROM sets s WHERE s.sample = c_custkey AND s.target = t.target)")
def p13_lacking(spark, d):
    h = _sets(spark, d)
    return P.lacking(h, X.table(spark, d, "customer").select(F.col("c_custkey").alias("sample")), h).select("sample", "target")


@query(f"WITH {_SETS} SELECT target, sample, seq, cnt FROM (SELECT *, sum(cnt) OVER (PARTITION BY target, sample) AS t FROM sets) WHERE t >= 100000 AND cnt >= 50000")
def p15_least_reads(spark, d):
    return P.least_reads(_sets(spark, d), 100000, 50000).select("target", "sample", "seq", "cnt")


@query(f"WITH {_SETS} SELECT target, sample, seq, cnt FROM fr WHERE frac >= CASE WHEN sample % 10 = 0 THEN 0.6 ELSE 0.3 END")
def p16_least_fraction(spark, d):
    h = _fractions(spark, d)
    custom = X.table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("sample"), F.lit(0.6).alias("cutoff"))
    return P.least_fraction(h, 0.3, custom).select("target", "sample", "seq", "cnt")


@query(f"WITH {X.HAPLOTYPES_SQL} SELECT target, sample, replicate, seq FROM haps SEMI JOIN (SELECT target, sample, seq FROM haps GROUP BY ALL HAVING count(DISTINCT replicate) >= 2) USING (target, sample, seq)")
def p17_least_runs(spark, d):
    return P.least_runs(X.haplotypes(spark, d), 2).select("target", "sample", "replicate", "seq")


@query(f"WITH {_SETS} SELECT target, sample, seq, cnt FROM fr a WHERE NOT EXISTS (SELECT 1 FROM fr b WHERE a.target = b.target AND a.sample = b.sample AND a.seq <> b.seq AND levenshtein(a.seq, b.seq) <= 1 AND b.frac >= 1.5 * a.frac)")
def p18_without_one_offs(spark, d):
    return P.drop_one_offs(_fractions(spark, d), 1.5).select("target", "sample", "seq", "cnt")


@query(f"WITH {_SETS}, u AS (SELECT target, seq, sum(cnt)::BIGINT AS cnt FROM sets GROUP BY ALL), nr AS (SELECT a.target, a.seq, b.seq AS o, b.cnt AS c2 FROM u a JOIN u b ON a.target = b.target AND a.seq <> b.seq AND levenshtein(a.seq, b.seq) <= 1 AND (b.cnt > a.cnt OR (b.cnt = a.cnt AND b.seq < a.seq))), be AS (SELECT target, seq, max({{'c': c2, 'o': o}}).o AS t FROM nr GROUP BY ALL), mv AS (SELECT * FROM be x WHERE NOT EXISTS (SELECT 1 FROM be y WHERE y.target = x.target AND y.seq = x.t)) SELECT target, coalesce(t, u.seq) AS seq, sum(cnt)::BIGINT AS cnt FROM u LEFT JOIN mv USING (target, seq) GROUP BY ALL")
def p14_clustered_once(spark, d):
    """One round of merging near-identical haplotypes of a target."""
    return P.cluster(_sets(spark, d), ["target"], 1, rounds=1)


@query(f"WITH {X.REFERENCES_SQL}, v AS (SELECT id % 5 AS target, seq FROM refs UNION SELECT id % 5, left(seq, 30) || translate(substr(seq, 31, 1), 'ACGT', 'CGTA') || substr(seq, 32) FROM refs UNION SELECT id % 5, left(seq, 20) || substr(seq, 22, 20) || translate(substr(seq, 42, 1), 'ACGT', 'CGTA') || substr(seq, 43) FROM refs UNION SELECT id % 5, 'A' || left(seq, len(seq) - 2) FROM refs) SELECT a.target, a.seq, b.seq AS other FROM v a JOIN v b ON a.target = b.target AND a.seq <> b.seq AND levenshtein(a.seq, b.seq) <= 2")
def p14_close_pairs(spark, d):
    """Passages and their variants within two edits, found by parts."""
    r = X.references(spark, d).select((F.col("id") % 5).alias("target"), "seq")
    turn = lambda p: F.translate(F.substr("seq", F.lit(p), F.lit(1)), "ACGT", "CGTA")
    cut = lambda a, n=None: F.substr("seq", F.lit(a), F.lit(n)) if n else F.substr("seq", F.lit(a))
    forms = (F.col("seq"), F.concat(F.left("seq", F.lit(30)), turn(31), cut(32)), F.concat(F.left("seq", F.lit(20)), cut(22, 20), turn(42), cut(43)), F.concat(F.lit("A"), F.left("seq", F.length("seq") - 2)))
    return P.close_pairs(r.select("target", F.explode(F.array(*forms)).alias("seq")), ["target"], 2)


@query()
def p14_p20_population_clusters(spark, d):
    return P.population_clusters(_sets(spark, d))


@query(f"WITH {_SETS}, p AS (SELECT target, seq, count(DISTINCT sample) AS s, max(frac) AS top, avg(frac) AS m FROM fr GROUP BY ALL) SELECT target, sample, seq, cnt FROM fr ANTI JOIN (SELECT * FROM p WHERE (s = 1 AND top < 0.21) OR (s > 1 AND m < 0.75)) USING (target, seq)")
def p21_low_level_filters(spark, d):
    return P.low_level_filters(_fractions(spark, d), common_low=0.75).select("target", "sample", "seq", "cnt")


@query(f"WITH {_SETS} SELECT target, seq, count(DISTINCT sample) AS samples, array_to_string(list_sort(list(DISTINCT CAST(sample AS VARCHAR))), ',') AS sample_list FROM sets GROUP BY ALL")
def p24_samples_per_haplotype(spark, d):
    return P.samples_per_haplotype(_sets(spark, d).withColumn("sample", F.col("sample").cast("string")))


@query(f"WITH {_SETS}, c AS (SELECT target, sample, count(DISTINCT seq) AS coi FROM sets GROUP BY ALL) SELECT target, count(*) AS n_samples, sum(coi)::BIGINT AS total, min(coi) AS min_coi, max(coi) AS max_coi, avg(coi) AS mean_coi, median(coi) AS median_coi FROM c GROUP BY 1")
def p26_coi_by_target(spark, d):
    return P.coi_by_target(_sets(spark, d).groupBy("target", "sample").agg(F.countDistinct("seq").alias("coi")))


# --- geography --------------------------------------------------------------------


@query(f"WITH {X.PLACES_SQL}, n AS (SELECT seq, count(*) AS cnt FROM places GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, seq) - 1 AS rank FROM n) SELECT seq, 'hap.' || lpad(CAST(rank AS VARCHAR), 2, '0') AS name, cnt, cnt / sum(cnt) OVER () AS fraction, rank FROM r")
def h01_collapsed(spark, d):
    return H.collapse_haplotypes(X.places(spark, d).select("seq"), X.references(spark, d).select("seq", F.lit("ref").alias("name")))


_COUNTS = X.PLACES_SQL + ", counts AS (SELECT haplotype, country, coalesce(site, 'na') AS site, sum(cnt)::BIGINT AS cnt FROM places GROUP BY ALL)"


def _places(spark, d):
    return H.count_locations(X.places(spark, d))


@query(f"WITH {_COUNTS} SELECT country, site, sum(cnt)::BIGINT AS cnt FROM counts GROUP BY ALL")
def h05_country_totals(spark, d):
    return H.country_totals(_places(spark, d))


@query(f"WITH {_COUNTS} SELECT haplotype, country, site, cnt, cnt / sum(cnt) OVER (PARTITION BY country, site) AS frac FROM counts")
def h06_counts_in_countries(spark, d):
    return H.counts_in_countries(_places(spark, d)).select("haplotype", "country", "site", "cnt", "frac")


@query(f"WITH {_COUNTS} SELECT haplotype, country, site, cnt, cnt / sum(cnt) OVER (PARTITION BY haplotype) AS frac FROM counts")
def h07_counts_of_haplotypes(spark, d):
    return H.counts_of_haplotypes(_places(spark, d)).select("haplotype", "country", "site", "cnt", "frac")


@query(f"WITH {_COUNTS}, t AS (SELECT country, site, sum(cnt)::BIGINT AS cnt FROM counts GROUP BY ALL) SELECT country, site, cnt, 1000 + (cnt - min(cnt) OVER ()) / (max(cnt) OVER () - min(cnt) OVER ()) * 19000 AS radius FROM t")
def h10_scaled_sites(spark, d):
    return H.scale(H.country_totals(_places(spark, d)), F.col("cnt"), 1000.0, 20000.0, "radius")


@query(f"WITH {_COUNTS}, p AS (SELECT haplotype, country, sum(cnt)::BIGINT AS cnt FROM counts GROUP BY ALL) SELECT *, cnt / sum(cnt) OVER (PARTITION BY haplotype) AS frac FROM p")
def h11_country_pieces(spark, d):
    return H.country_pieces(_places(spark, d), _places(spark, d))


@query(f"WITH {_COUNTS} SELECT country, array_to_string(list_sort(list(DISTINCT site)), ',') AS sites FROM counts GROUP BY 1")
def h12_names_by_country(spark, d):
    return H.names_by_country(_places(spark, d))


from . import table_queries, trim_queries, graph_queries, path_queries, sweep_queries  # noqa: E402, F401, I001  they register theirs, the cheaper ones first
