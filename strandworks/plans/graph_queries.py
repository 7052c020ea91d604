"""Queries of graph rewriting, graph reports and contigs over the graph of all conversation texts, collapsed.

Results are compared as digests: numbers and sums of hashes of nodes, edges and reads of each assembly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import contigs as C
from ..operators import graph as G
from ..operators import kmers as K
from ..operators.staging import shared, shared_dir, staged
from ..sources import writers as W
from . import fixtures as X
from .registry import query

A, KLEN, CUT = K.A, 11, 1


def version(spark, d):
    """What the conversations were when a graph of them was made: folder, files' time and size."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/conversations.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return d, fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength()


class Parts(K.Graph):
    """A graph whose tables are made when they are first asked for; ``makers``: name -> function."""

    def __init__(self, k, **makers):
        object.__setattr__(self, "k", k)
        object.__setattr__(self, "makers", makers)

    def __getattr__(self, name):
        if name.startswith("_") or name not in self.makers:
            raise AttributeError(name)
        object.__setattr__(self, name, self.makers[name]())
        return getattr(self, name)

    def with_(self, **changes):
        return K.Graph(**{name: changes[name] if name in changes else getattr(self, name) for name in ("nodes", "edges", "node_reads", "edge_reads", "k")})


def tables(spark, d, name, make):
    """The tables of ``make()``, the same for all queries of an application over the same folder."""
    return shared(spark, (name, *version(spark, d)), make)


def tokens(spark, d):
    """The k-mers of every role's texts."""
    reads = tables(spark, d, "chats", lambda: [X.chats(spark, d)])[0]
    return K.with_tokens(reads.withColumn(A, F.col("sample")), KLEN).select(A, "read_id", "tokens")


def raw_nodes(spark, d):
    return tables(spark, d, "raw nodes", lambda: [K.nodes_from_counts(K.count_tokens(tokens(spark, d), A), CUT)])[0]


def raw(spark, d):
    """The read-threaded graph of every role's texts."""
    def rest():
        g = K.thread_reads(tokens(spark, d), raw_nodes(spark, d), KLEN, hold=staged)
        return g.edges, g.node_reads, g.edge_reads

    def part(i):
        return lambda: tables(spark, d, "raw", rest)[i]

    return Parts(KLEN, nodes=lambda: raw_nodes(spark, d), edges=part(0), node_reads=part(1), edge_reads=part(2))


def base(spark, d, once=False):
    """The same, collapsed.  Chains need no reads: these are threaded through what is left of the edges.

    ``once``: reads on nodes are read once, by node, so they are not written before that.
    """
    def shape():
        nodes = raw_nodes(spark, d)
        return G.collapsed_shape(nodes, staged(K.token_edges(tokens(spark, d), nodes)), KLEN)

    def shaped(i):
        return lambda: tables(spark, d, "base", shape)[i]

    def links():
        return tables(spark, d, "base links", lambda: [G.collapsed_links(tokens(spark, d), shaped(2)())])[0]

    return Parts(
        KLEN, nodes=shaped(0), edges=shaped(1), edge_reads=lambda: links().where("NOT inner").drop("inner"),
        node_reads=lambda: G.reads_on_nodes(links()) if once else tables(spark, d, "base reads", lambda: [G.reads_on_nodes(links())])[0])


def text_hash(*parts):
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def digest(g):
    """One row an assembly."""
    s = g.nodes.select(A, "node_id", "seq")
    n = g.nodes.groupBy(A).agg(F.count("*").alias("nodes"), F.sum("cnt").cast("long").alias("node_cnt"), F.sum(text_hash("seq", F.col("cnt").cast("string"))).alias("node_hash"))
    e = g.edges.join(s.toDF(A, "src", "a"), ["src", A]).join(s.toDF(A, "dst", "b"), ["dst", A])
    e = e.groupBy(A).agg(F.count("*").alias("edges"), F.sum(text_hash("a", "b", F.col("cnt").cast("string"))).alias("edge_hash"))
    r = g.node_reads.join(s, ["node_id", A]).groupBy(A).agg(F.count("*").alias("node_reads"), F.sum(text_hash("seq", "read")).alias("read_hash"))
    er = g.edge_reads.groupBy(A).agg(F.count("*").alias("edge_reads"))
    return n.join(e, A, "left").join(r, A, "left").join(er, A, "left").na.fill(0)


def _h(*parts):
    return "('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 8))::BIGINT"


def graph_sql(n="n", e="e", nr="nr", er="er"):
    """Digest of tables of nodes (a, id, seq, cnt), edges (a, src, dst, cnt), node reads (a, id, read) and edge reads."""
    return f"""SELECT x.a AS assembly_id, nodes, node_cnt, node_hash, coalesce(edges, 0) AS edges, coalesce(edge_hash, 0) AS edge_hash, coalesce(node_reads, 0) AS node_reads, coalesce(read_hash, 0) AS read_hash, coalesce(edge_reads, 0) AS edge_reads
FROM (SELECT a, count(*) AS nodes, sum(cnt)::BIGINT AS node_cnt, sum({_h('seq', 'CAST(cnt AS VARCHAR)')})::BIGINT AS node_hash FROM {n} GROUP BY a) x
LEFT JOIN (SELECT e.a, count(*) AS edges, sum({_h('p.seq', 'q.seq', 'CAST(e.cnt AS VARCHAR)')})::BIGINT AS edge_hash FROM {e} e JOIN {n} p ON e.a || e.src = p.a || p.id JOIN {n} q ON e.a || e.dst = q.a || q.id GROUP BY e.a) y USING (a)
LEFT JOIN (SELECT r.a, count(*) AS node_reads, sum({_h('p.seq', 'r.read')})::BIGINT AS read_hash FROM {nr} r JOIN {n} p ON r.a || r.id = p.a || p.id GROUP BY r.a) z USING (a)
LEFT JOIN (SELECT a, count(*) AS edge_reads FROM {er} GROUP BY a) w USING (a)"""


def after_sql(n, e, before=""):
    """Digest where nodes and edges are those of ``n`` and ``e`` and the reads follow them."""
    return f"""{before}nn AS ({n}), ee AS (SELECT x.* FROM ({e}) x WHERE (a, src) IN (SELECT (a, id) FROM nn) AND (a, dst) IN (SELECT (a, id) FROM nn)), nrr AS (SELECT * FROM nr WHERE (a, id) IN (SELECT (a, id) FROM nn)),
err AS (SELECT er.* FROM er SEMI JOIN ee ON er.a || er.src = ee.a || ee.src AND er.dst = ee.dst) {graph_sql('nn', 'ee', 'nrr', 'err')}"""


RAW = X.CHATS_SQL + f""", km AS (SELECT sample AS a, read_id, pos, substr(seq, pos + 1, {KLEN}) AS kmer, CASE WHEN pos + 1 + {KLEN} <= len(seq) THEN substr(seq, pos + 2, {KLEN}) END AS nxt FROM (SELECT *, unnest(range(0, len(seq) - {KLEN} + 1)) AS pos FROM chats WHERE len(seq) > {KLEN})),
rn AS (SELECT a, kmer AS id, kmer AS seq, count(*) AS cnt FROM km GROUP BY ALL HAVING count(*) > {CUT}),
oc AS (SELECT *, greatest(row_number() OVER (PARTITION BY read_id, kmer ORDER BY pos) - 1, CASE WHEN nxt IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY read_id, nxt ORDER BY pos) - 1 END) AS occ FROM km),
li AS (SELECT o.a, o.kmer AS src, o.nxt AS dst, CASE WHEN occ = 0 THEN CAST(read_id AS VARCHAR) ELSE read_id || '{K.AGAIN}' || occ END AS read FROM oc o JOIN rn x ON o.a || o.kmer = x.a || x.id JOIN rn y ON o.a || o.nxt = y.a || y.id),
re AS (SELECT a, src, dst, count(*) AS cnt FROM li GROUP BY ALL), rer AS (SELECT DISTINCT * FROM li), rnr AS (SELECT a, src AS id, read FROM li UNION SELECT a, dst, read FROM li)"""
BASE = "RECURSIVE " + RAW + """, ch AS (SELECT o.a, o.src, o.dst FROM (SELECT a, src, min(dst) AS dst FROM re GROUP BY a, src HAVING count(*) = 1) o SEMI JOIN (SELECT a, dst FROM re GROUP BY a, dst HAVING count(*) = 1) i ON o.a || o.dst = i.a || i.dst WHERE o.src <> o.dst),
open AS (SELECT a, id AS start, id AS cur, 0 AS rank FROM rn ANTI JOIN ch ON rn.a || rn.id = ch.a || ch.dst UNION ALL SELECT w.a, w.start, ch.dst, w.rank + 1 FROM open w JOIN ch ON w.a || w.cur = ch.a || ch.src),
ring AS (SELECT ch.* FROM ch ANTI JOIN open w ON w.a || w.cur = ch.a || ch.src),
round AS (SELECT a, src AS start, src AS cur, 0 AS rank FROM ring UNION ALL SELECT w.a, w.start, r.dst, w.rank + 1 FROM round w JOIN ring r ON w.a || w.cur = r.a || r.src WHERE r.dst > w.start),
walk AS (SELECT * FROM open UNION ALL SELECT x.* FROM round x SEMI JOIN (SELECT w.a, w.start FROM round w JOIN ring r ON w.a || w.cur = r.a || r.src AND w.start = r.dst) y ON x.a || x.start = y.a || y.start),
n AS (SELECT w.a, start AS id, string_agg(CASE WHEN rank = 0 THEN cur ELSE right(cur, 1) END, '' ORDER BY rank) AS seq, sum(cnt)::BIGINT AS cnt FROM walk w JOIN rn ON w.a || w.cur = rn.a || rn.id GROUP BY w.a, start),
e AS (SELECT e.a, p.start AS src, q.start AS dst, sum(e.cnt)::BIGINT AS cnt FROM re e JOIN walk p ON e.a || e.src = p.a || p.cur JOIN walk q ON e.a || e.dst = q.a || q.cur WHERE NOT (p.start = q.start AND q.rank = p.rank + 1) GROUP BY ALL),
er AS (SELECT DISTINCT r.a, p.start AS src, q.start AS dst, r.read FROM rer r JOIN walk p ON r.a || r.src = p.a || p.cur JOIN walk q ON r.a || r.dst = q.a || q.cur WHERE NOT (p.start = q.start AND q.rank = p.rank + 1)),
nr AS (SELECT DISTINCT r.a, p.start AS id, r.read FROM rnr r JOIN walk p ON r.a || r.id = p.a || p.cur),
deg AS (SELECT n.*, coalesce(heads, 0) AS heads, coalesce(tails, 0) AS tails, coalesce(reads, 0) AS reads FROM n LEFT JOIN (SELECT a, dst AS id, count(*) AS heads FROM e GROUP BY ALL) i USING (a, id) LEFT JOIN (SELECT a, src AS id, count(*) AS tails FROM e GROUP BY ALL) o USING (a, id) LEFT JOIN (SELECT a, id, count(*) AS reads FROM nr GROUP BY ALL) r USING (a, id))"""


# --- graph rewriting --------------------------------------------------------------


@query(f"WITH {RAW} {graph_sql('rn', 're', 'rnr', 'rer')}")
def k08_k11_threaded_graph(spark, d):
    return digest(raw(spark, d))


@query(f"WITH {BASE} {graph_sql()}")
def g01_collapse(spark, d):
    return digest(base(spark, d, once=True))


@query(f"WITH {BASE}, {after_sql('SELECT * FROM n WHERE cnt > 20', 'SELECT * FROM e')}")
def k15_prune_nodes(spark, d):
    return digest(K.prune_nodes(base(spark, d, once=True), 20))


@query(f"WITH {BASE}, {after_sql('SELECT * FROM n', 'SELECT * FROM e WHERE cnt > 3')}")
def k16_prune_edges(spark, d):
    return digest(K.prune_edges(base(spark, d, once=True), 3))


@query(f"WITH {BASE} SELECT a AS assembly_id, count(*) AS nodes, count(*) FILTER (WHERE heads = 0) AS headless, count(*) FILTER (WHERE tails = 0) AS tailless, count(*) FILTER (WHERE heads = 0 AND tails = 0) AS isolated FROM deg GROUP BY a")
def k21_state_counts(spark, d):
    return K.state_counts(base(spark, d))


@query(f"WITH {BASE} SELECT a AS assembly_id, tails, count(*) AS n FROM deg GROUP BY ALL")
def k17_tail_histogram(spark, d):
    return K.tail_histogram(base(spark, d))


@query(f"WITH {BASE} SELECT a AS assembly_id, count(*) FILTER (WHERE tails > 0) AS tail, count(*) FILTER (WHERE tails = 1) AS one_tail, count(*) FILTER (WHERE heads > 0) AS head, count(*) FILTER (WHERE heads = 1) AS one_head FROM deg GROUP BY a")
def k18_neighbours(spark, d):
    n = K.neighbours(base(spark, d))
    one = lambda x: F.count_if(F.col(f"first_{x}") == F.col(f"last_{x}"))
    return n.groupBy(A).agg(F.count("first_tail").alias("tail"), one("tail").alias("one_tail"), F.count("first_head").alias("head"), one("head").alias("one_head"))


@query(f"WITH {BASE} SELECT a AS assembly_id, name, cnt FROM (SELECT a, seq AS name, cnt FROM n UNION ALL SELECT a, seq || '1', cnt FROM n WHERE cnt % 3 = 0)")
def k19_unique_names(spark, d):
    n = base(spark, d).nodes
    twin = n.where("cnt % 3 = 0").withColumn("node_id", F.xxhash64("node_id", F.lit("twin")))
    return K.unique_names(n.unionByName(twin)).select(A, "name", "cnt")


@query(f"WITH {BASE} SELECT e.a AS assembly_id, count(*) AS broken FROM e LEFT JOIN n p ON e.a || e.src = p.a || p.id LEFT JOIN n q ON e.a || e.dst = q.a || q.id WHERE p.cnt % 5 = 0 OR q.cnt % 5 = 0 GROUP BY e.a")
def k20_broken_edges(spark, d):
    """A graph from which some nodes were taken, and not their edges."""
    g = base(spark, d)
    return K.broken_edges(g.with_(nodes=g.nodes.where("cnt % 5 <> 0"))).groupBy(A).agg(F.count("*").alias("broken"))


@query(f"WITH {BASE}, more AS (SELECT a, src, dst, cnt FROM e UNION ALL SELECT a, src, dst, 2 FROM e WHERE cnt > 2 UNION ALL SELECT a, dst, src, 1 FROM e WHERE cnt > 4), e2 AS (SELECT a, src, dst, sum(cnt)::BIGINT AS cnt FROM more GROUP BY ALL) {graph_sql(e='e2')}")
def k13_add_edges(spark, d):
    g = base(spark, d)
    more = g.edges.where("cnt > 2").withColumn("cnt", F.lit(2).cast("long")).unionByName(g.edges.where("cnt > 4").select(A, F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).cast("long").alias("cnt")))
    return digest(g.with_(edges=K.add_edges(g.edges, more)))


@query(f"WITH {BASE}, w AS (SELECT a, seq, cnt FROM n WHERE cnt % 2 = 0 UNION ALL SELECT a, 'ACGT' || seq, 1 FROM n) SELECT a AS assembly_id, count(*) FILTER (WHERE known) AS known, count(*) AS total FROM (SELECT w.a, EXISTS (SELECT 1 FROM n WHERE n.a || n.seq = w.a || w.seq) AS known FROM w UNION ALL SELECT n.a, FALSE FROM n WHERE cnt % 2 = 1) GROUP BY a")
def k14_add_nodes(spark, d):
    n = base(spark, d).nodes
    more = n.where("cnt % 2 = 0").select(A, "seq", "cnt").unionByName(n.select(A, F.concat(F.lit("ACGT"), "seq").alias("seq"), F.lit(1).cast("long").alias("cnt")))
    known = K.has_nodes(more, n).groupBy(A).agg(F.count("*").alias("known"))
    return K.add_nodes(n, more).groupBy(A).agg(F.count("*").alias("total")).join(known, A)


@query(f"WITH {BASE} SELECT a AS assembly_id, seq, cnt FROM n")
def k22_by_size(spark, d):
    return K.by_size(base(spark, d).nodes).select(A, "seq", "cnt")


_TWICE = ", ".join(f"{t}2 AS (SELECT a || '|' || s AS a, {c} FROM {t}, (SELECT unnest(['x', 'y']) AS s))" for t, c in (("n", "id, seq, cnt"), ("e", "src, dst, cnt"), ("nr", "id, read"), ("er", "src, dst, read")))


@query(f"WITH {BASE}, {_TWICE} {graph_sql('n2', 'e2', 'nr2', 'er2')}")
def k23_graphs_for_settings(spark, d):
    return digest(K.for_settings(base(spark, d), spark.createDataFrame([("x",), ("y",)], "setting string")))


_FEW = "i AS (SELECT er.a, dst AS id, read FROM er JOIN deg ON er.a || er.dst = deg.a || deg.id WHERE heads = 1 AND tails = 1), o AS (SELECT er.a, src AS id, read FROM er JOIN deg ON er.a || er.src = deg.a || deg.id WHERE heads = 1 AND tails = 1), ni AS (SELECT a, id, count(*) AS c FROM i GROUP BY ALL), no AS (SELECT a, id, count(*) AS c FROM o GROUP BY ALL), sh AS (SELECT i.a, i.id, count(*) AS c FROM i JOIN o USING (a, id, read) GROUP BY ALL)"
_FEW += ", bad AS (SELECT ni.a, ni.id FROM ni JOIN no USING (a, id) LEFT JOIN sh USING (a, id) WHERE coalesce(sh.c, 0) <> least(ni.c, no.c) AND coalesce(sh.c, 0) <= 2)"


@query(f"WITH {BASE}, {_FEW}, n2 AS (SELECT a, id, seq, cnt FROM n UNION ALL SELECT n.a, n.id || '+', seq, cnt FROM n SEMI JOIN bad USING (a, id)), e2 AS (SELECT e.a, CASE WHEN bad.id IS NULL THEN src ELSE src || '+' END AS src, dst, cnt FROM e LEFT JOIN bad ON e.a || e.src = bad.a || bad.id), nr2 AS (SELECT * FROM nr UNION ALL SELECT o.a, o.id || '+', read FROM o SEMI JOIN bad USING (a, id)) {graph_sql('n2', 'e2', 'nr2', 'er')}")
def g03_split_low_coverage(spark, d):
    return digest(G.split_low_coverage(base(spark, d), 2))


_TIPS = "tips AS (SELECT a, id FROM deg WHERE (heads = 0) <> (tails = 0) AND len(seq) - 11 < 10 AND reads < 4)"


@query(f"WITH {BASE}, {_TIPS}, {after_sql('SELECT n.* FROM n ANTI JOIN tips USING (a, id)', 'SELECT * FROM e')}")
def g05_remove_tips(spark, d):
    return digest(G.remove_tips(base(spark, d), 10, 4, until_stable=False))


_PAIR = "al AS (SELECT e.a, p.id AS i1, q.id AS i2, p.seq AS s1, q.seq AS s2 FROM e JOIN deg p ON e.a || e.src = p.a || p.id JOIN deg q ON e.a || e.dst = q.a || q.id WHERE p.heads = 0 AND p.tails = 1 AND q.heads = 1 AND q.tails = 0 AND (len(p.seq) - 11 < 30 OR len(q.seq) - 11 < 30)), tw AS (SELECT a, seq FROM n GROUP BY ALL HAVING count(*) > 1), tp AS (SELECT a, i1 AS id, s1 AS seq FROM al UNION ALL SELECT a, i2, s2 FROM al), gone AS (SELECT a, id FROM tp WHERE len(seq) - 11 < 30 OR (a, seq) IN (SELECT (a, seq) FROM tw))"


@query(f"WITH {BASE}, {_PAIR}, {after_sql('SELECT n.* FROM n ANTI JOIN gone USING (a, id)', 'SELECT * FROM e')}")
def g06_remove_pair_tips(spark, d):
    return digest(G.remove_pair_tips(base(spark, d), 30))


@query(f"WITH {BASE}, {after_sql('SELECT a, id, seq, cnt FROM deg WHERE NOT (heads = 0 AND tails = 0 AND len(seq) <= 25)', 'SELECT * FROM e')}")
def g07_remove_islands(spark, d):
    return digest(G.remove_islands(base(spark, d, once=True), 25))


@query(f"WITH {BASE}, lo AS (SELECT a, src FROM e WHERE src = dst), {after_sql('SELECT * FROM n', 'SELECT e.* FROM e ANTI JOIN lo ON e.a || e.src = lo.a || lo.src ANTI JOIN lo l2 ON e.a || e.dst = l2.a || l2.src')}")
def g08_break_self_loops(spark, d):
    return digest(G.break_self_loops(base(spark, d, once=True)))


@query(f"WITH {BASE}, {after_sql('SELECT * FROM n', 'SELECT * FROM e WHERE src <> dst')}")
def g08_cut_self_loops(spark, d):
    return digest(G.break_self_loops(base(spark, d, once=True), keep_others=True))


_THROUGH = "thr AS (SELECT i.a, i.dst AS id, i.read, i.src AS h, o.dst AS t FROM er i JOIN er o ON i.a || i.dst = o.a || o.src AND i.read = o.read JOIN deg ON deg.a || deg.id = i.a || i.dst WHERE i.src <> i.dst AND o.dst <> o.src AND heads > 0 AND tails > 0 AND (heads > 1 OR tails > 1)), one AS (SELECT a, id, read, min(h) AS h, min(t) AS t FROM thr GROUP BY ALL HAVING count(*) = 1), br AS (SELECT a, id, h, t, count(*) AS w FROM one GROUP BY ALL HAVING count(*) > 1)"


@query(f"WITH {BASE}, {_THROUGH} SELECT br.a AS assembly_id, x.seq, y.seq AS head_seq, z.seq AS tail_seq, w AS bridging FROM br JOIN n x ON br.a || br.id = x.a || x.id JOIN n y ON br.a || br.h = y.a || y.id JOIN n z ON br.a || br.t = z.a || z.id")
def g09_bridges(spark, d):
    g = base(spark, d)
    s = g.nodes.select(A, "node_id", "seq")
    b = G.bridges(g, 1).join(s, [A, "node_id"]).join(s.toDF(A, "h", "head_seq"), [A, "h"]).join(s.toDF(A, "t", "tail_seq"), [A, "t"])
    return b.select(A, "seq", "head_seq", "tail_seq", F.col("n").alias("bridging"))


_BY_NODES = "i AS (SELECT e.a, e.dst AS id, e.src AS h, x.read FROM e JOIN nr x ON x.a || x.id = e.a || e.dst SEMI JOIN nr y ON y.a || y.id = e.a || e.src AND y.read = x.read), o AS (SELECT e.a, e.src AS id, e.dst AS t, x.read FROM e JOIN nr x ON x.a || x.id = e.a || e.src SEMI JOIN nr y ON y.a || y.id = e.a || e.dst AND y.read = x.read), thr AS (SELECT i.a, i.id, i.read, h, t FROM i JOIN o USING (a, id, read) JOIN deg USING (a, id) WHERE h <> id AND t <> id AND heads > 0 AND tails > 0 AND (heads > 1 OR tails > 1)), one AS (SELECT a, id, read, min(h) AS h, min(t) AS t FROM thr GROUP BY ALL HAVING count(*) = 1), br AS (SELECT a, id, h, t, count(*) AS w FROM one GROUP BY ALL HAVING count(*) > 1)"


@query(f"WITH {BASE}, {_BY_NODES} SELECT a AS assembly_id, count(*) AS ways, sum(w)::BIGINT AS bridging FROM br GROUP BY a")
def g10_bridges_by_nodes(spark, d):
    return G.bridges(base(spark, d), 1, by_nodes=True).groupBy(A).agg(F.count("*").alias("ways"), F.sum("n").alias("bridging"))


@query(f"WITH {BASE}, x AS (SELECT DISTINCT nr.a, read FROM nr JOIN n USING (a, id) WHERE cnt > 20), y AS (SELECT DISTINCT nr.a, read FROM nr JOIN n USING (a, id) WHERE cnt <= 20) SELECT a AS assembly_id, count(*) AS shared FROM x JOIN y USING (a, read) GROUP BY a")
def g11_shared_reads(spark, d):
    g = base(spark, d)
    r = g.node_reads.join(g.nodes.select(A, "node_id", "cnt"), [A, "node_id"])
    return G.shared_reads(r.where("cnt > 20"), r.where("cnt <= 20")).groupBy(A).agg(F.count("*").alias("shared"))


def _merge_sql(most, ok):
    b = f"lk AS (SELECT d.a, d.id, d.seq, d.cnt, h.src AS h, t.dst AS t FROM deg d JOIN e h ON h.a || h.dst = d.a || d.id JOIN e t ON t.a || t.src = d.a || d.id WHERE heads = 1 AND tails = 1), gr AS (SELECT *, count(*) OVER (PARTITION BY a, h, t) AS size FROM lk), top AS (SELECT a, h, t, max(cnt) AS cnt FROM gr WHERE size BETWEEN 2 AND {most} GROUP BY ALL)"
    b += f", mv AS (SELECT g.a, g.id, b.id AS best FROM gr g JOIN top USING (a, h, t) JOIN gr b ON b.a || b.h = g.a || g.h AND b.t = g.t AND b.cnt = top.cnt WHERE g.cnt < top.cnt AND {ok})"
    b += ", n2 AS (SELECT n.a, n.id, n.seq, (n.cnt + coalesce(m, 0))::BIGINT AS cnt FROM n ANTI JOIN mv ON n.a || n.id = mv.a || mv.id LEFT JOIN (SELECT mv.a, best AS id, sum(cnt) AS m FROM mv JOIN n ON n.a || n.id = mv.a || mv.id GROUP BY ALL) x ON x.a || x.id = n.a || n.id)"
    b += ", e2 AS (SELECT e.a, coalesce(p.best, src) AS src, coalesce(q.best, dst) AS dst, sum(cnt)::BIGINT AS cnt FROM e LEFT JOIN mv p ON p.a || p.id = e.a || e.src LEFT JOIN mv q ON q.a || q.id = e.a || e.dst GROUP BY ALL)"
    b += ", er2 AS (SELECT DISTINCT e.a, coalesce(p.best, src) AS src, coalesce(q.best, dst) AS dst, read FROM er e LEFT JOIN mv p ON p.a || p.id = e.a || e.src LEFT JOIN mv q ON q.a || q.id = e.a || e.dst), nr2 AS (SELECT DISTINCT nr.a, coalesce(best, nr.id) AS id, read FROM nr LEFT JOIN mv ON mv.a || mv.id = nr.a || nr.id) "
    return f"WITH {BASE}, {b}" + graph_sql("n2", "e2", "nr2", "er2")


@query(_merge_sql(2, "b.cnt >= 1.5 * g.cnt AND abs(len(g.seq) - len(b.seq)) <= 20 AND levenshtein(g.seq, b.seq) <= 4"))
def g12_collapse_bubbles(spark, d):
    return digest(G.collapse_bubbles(base(spark, d), 4, 1.5))


_RUNS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g')"


def _split_sql(chosen):
    b = f"c AS (SELECT a, id FROM deg WHERE {chosen}), k AS (SELECT n.* FROM n ANTI JOIN c USING (a, id)), ke AS (SELECT e.* FROM e SEMI JOIN k x ON e.a || e.src = x.a || x.id SEMI JOIN k y ON e.a || e.dst = y.a || y.id)"
    b += ", co AS (SELECT e.a, e.src AS id, e.dst AS other, e.cnt, e.src || '>' || e.dst AS fresh, TRUE AS tail FROM e SEMI JOIN c ON e.a || e.src = c.a || c.id UNION ALL SELECT e.a, e.dst, e.src, e.cnt, e.dst || '<' || e.src, FALSE FROM e SEMI JOIN c ON e.a || e.dst = c.a || c.id)"
    b += ", n2 AS (SELECT * FROM k UNION ALL SELECT co.a, fresh, seq, co.cnt FROM co JOIN n ON n.a || n.id = co.a || co.id), e2 AS (SELECT * FROM ke UNION ALL SELECT co.a, CASE WHEN tail THEN fresh ELSE other END, CASE WHEN tail THEN other ELSE fresh END, cnt FROM co SEMI JOIN k ON k.a || k.id = co.a || co.other)"
    b += ", s AS (SELECT er.a, src AS id, dst AS other, read, src || '>' || dst AS fresh, count(*) OVER (PARTITION BY er.a, src, read) AS w FROM er SEMI JOIN c ON er.a || er.src = c.a || c.id UNION ALL SELECT er.a, dst, src, read, dst || '<' || src, count(*) OVER (PARTITION BY er.a, dst, read) FROM er SEMI JOIN c ON er.a || er.dst = c.a || c.id)"
    b += ", nr2 AS (SELECT nr.* FROM nr SEMI JOIN k USING (a, id) UNION ALL SELECT a, fresh, read FROM s WHERE w = 1), er2 AS (SELECT er.* FROM er SEMI JOIN ke ON er.a || er.src = ke.a || ke.src AND er.dst = ke.dst UNION ALL SELECT s.a, fresh, other, read FROM s SEMI JOIN k ON k.a || k.id = s.a || s.other WHERE w = 1) "
    return f"WITH {BASE}, {b}" + graph_sql("n2", "e2", "nr2", "er2")


@query(_split_sql("(heads = 0 AND tails > 1) OR (tails = 0 AND heads > 1)"))
def g15_split_ends(spark, d):
    return digest(G.split_ends(base(spark, d)))


@query(_split_sql("tails > 1"))
def g16_split_multitailed(spark, d):
    return digest(G.split_multitailed(base(spark, d)))


_PAIRS2 = "two AS (SELECT a, id, substr(seq, p, 2) AS x, count(*) AS c FROM (SELECT *, unnest(range(1, len(seq))) AS p FROM n) GROUP BY ALL), ent AS (SELECT a, id, -sum(c / t * log2(c / t)) AS bits FROM (SELECT *, sum(c) OVER (PARTITION BY a, id) AS t FROM two) GROUP BY ALL)"


@query(f"WITH {BASE}, {_PAIRS2}, {after_sql('SELECT deg.a, deg.id, seq, cnt FROM deg JOIN ent USING (a, id) WHERE NOT ((heads = 0 OR tails = 0) AND bits < 2.9)', 'SELECT * FROM e')}")
def g17_remove_low_entropy_ends(spark, d):
    return digest(G.remove_low_entropy_ends(base(spark, d), 2.9))


@query(f"WITH {BASE}, r AS (SELECT e.a, e.src, e.dst, e.cnt, count(er.read) AS c FROM e LEFT JOIN er ON e.a || e.src = er.a || er.src AND e.dst = er.dst GROUP BY ALL), s AS (SELECT * FROM (SELECT *, max(c) OVER (PARTITION BY a, src) AS m FROM r) WHERE c = m), t AS (SELECT * FROM (SELECT a, src, dst, cnt, c, max(c) OVER (PARTITION BY a, dst) AS m2 FROM s) WHERE c = m2), {after_sql('SELECT * FROM n', 'SELECT a, src, dst, cnt FROM t')}")
def g19_strongest_edges(spark, d):
    return digest(G.strongest_edges(base(spark, d)))


_GROUPS = "und AS (SELECT a, src AS x, dst AS y FROM e UNION SELECT a, dst, src FROM e), rch AS (SELECT a, id AS root, id FROM n UNION SELECT rch.a, rch.root, und.y FROM rch JOIN und ON und.a || und.x = rch.a || rch.id), comp AS (SELECT a, id, min(root) AS g FROM rch GROUP BY ALL)"


@query(f"WITH {BASE}, {_GROUPS}, z AS (SELECT a, g, count(*) AS nodes, sum(len(seq))::BIGINT AS bases FROM comp JOIN n USING (a, id) GROUP BY ALL) SELECT a AS assembly_id, nodes, bases, count(*) AS groups FROM z GROUP BY ALL")
def g20_components(spark, d):
    c = G.components(base(spark, d)).groupBy(A, "group").agg(F.count("*").alias("nodes"), F.sum(F.length("seq").cast("long")).alias("bases"))
    return c.groupBy(A, "nodes", "bases").agg(F.count("*").alias("groups"))


@query(f"WITH {BASE}, hs AS (SELECT e.a, e.dst AS id, min(p.seq) AS hs FROM e JOIN n p ON p.a || p.id = e.a || e.src GROUP BY ALL HAVING count(*) = 1), ts AS (SELECT e.a, e.src AS id, min(p.seq) AS ts FROM e JOIN n p ON p.a || p.id = e.a || e.dst GROUP BY ALL HAVING count(*) = 1) SELECT a AS assembly_id, coalesce(substr(hs, 1, len(hs) - 10), '') || seq || coalesce(substr(ts, 11), '') AS seq, cnt FROM n LEFT JOIN hs USING (a, id) LEFT JOIN ts USING (a, id)")
def g21_sequences_with_neighbours(spark, d):
    return G.node_sequences(base(spark, d), add_neighbours=True).select(A, "seq", "cnt")


@query(f"WITH {BASE} SELECT a AS assembly_id, seq, cnt FROM deg x WHERE NOT (heads = 0 AND tails = 0 AND EXISTS (SELECT 1 FROM n y WHERE y.a = x.a AND len(y.seq) > len(x.seq) AND contains(y.seq, x.seq)))")
def g23_drop_contained(spark, d):
    return G.drop_contained(K.degrees(base(spark, d)), KLEN).select(A, "seq", "cnt")


@query(f"WITH {BASE}, p AS (SELECT a, src, dst, split_part(read, '{K.AGAIN}', 1) AS r FROM er), hh AS (SELECT a, dst AS id, r FROM p GROUP BY ALL HAVING count(DISTINCT src) > 1), tt AS (SELECT a, src AS id, r FROM p GROUP BY ALL HAVING count(DISTINCT dst) > 1) SELECT DISTINCT a AS assembly_id, seq FROM hh JOIN tt USING (a, id, r) JOIN n USING (a, id)")
def g26_redundant_nodes(spark, d):
    g = base(spark, d)
    return G.redundant_nodes(g).join(g.nodes, [A, "node_id"]).select(A, "seq")


@query(f"WITH {BASE} SELECT nr.a AS assembly_id, seq, count(DISTINCT CAST(read AS BIGINT) % 17) AS samples FROM nr JOIN n USING (a, id) WHERE NOT contains(read, '{K.AGAIN}') GROUP BY ALL")
def g27_samples_per_node(spark, d):
    g = base(spark, d)
    of = X.chats(spark, d).select(F.col("read_id").cast("string").alias("read"), (F.col("read_id") % 17).alias("sample"))
    return G.samples_per_node(g, of).join(g.nodes, [A, "node_id"]).select(A, "seq", "samples")


@query(f"WITH {RAW} SELECT o.a AS assembly_id, count(*) AS steps, sum(pos)::BIGINT AS head_pos, sum(pos + 1)::BIGINT AS tail_pos FROM oc o SEMI JOIN rn x ON o.a || o.kmer = x.a || x.id SEMI JOIN rn y ON o.a || o.nxt = y.a || y.id GROUP BY o.a")
def g24_edge_positions(spark, d):
    p = G.edge_positions(K.steps_of(tokens(spark, d)), raw_nodes(spark, d))
    return p.groupBy(A).agg(F.count("*").alias("steps"), F.sum("head_pos").alias("head_pos"), F.sum("tail_pos").alias("tail_pos"))


# --- reports ----------------------------------------------------------------------


@query(f"WITH {BASE} SELECT a AS assembly_id, seq, len(seq) - 10 AS nodekSize, 11 AS kLen, cnt AS count, reads AS readCount, heads AS headEdgesCount, tails AS tailEdgesCount FROM deg")
def snk3_node_table(spark, d):
    g = base(spark, d)
    return W.node_table(g).join(g.nodes.select(A, "node_id", "seq"), [A, "node_id"]).drop("node_id")


def _edge_rows(g, t):
    s = g.nodes.select(A, "node_id", "seq")
    return t.join(s.toDF(A, "src", "head"), [A, "src"]).join(s.toDF(A, "dst", "tail"), [A, "dst"]).drop("src", "dst")


_EDGES = "SELECT e.a AS assembly_id, p.seq AS head, q.seq AS tail, e.cnt AS connectorCount, count(er.read) AS readCount{0} FROM e JOIN n p ON e.a || e.src = p.a || p.id JOIN n q ON e.a || e.dst = q.a || q.id JOIN er ON er.a || er.src = e.a || e.src AND er.dst = e.dst GROUP BY e.a, p.seq, q.seq, e.cnt, e.src, e.dst"


@query(f"WITH {BASE} {_EDGES.format('')}")
def snk4_edge_table(spark, d):
    g = base(spark, d)
    return _edge_rows(g, W.edge_table(g))


@query(f"WITH {BASE} {_EDGES.format(', array_to_string(list_sort(list(DISTINCT er.read)), chr(44)) AS reads')}")
def snk5_edge_table_with_reads(spark, d):
    g = base(spark, d)
    return _edge_rows(g, W.edge_table(g, names=True))


@query(f"WITH {BASE} SELECT a AS assembly_id, seq, cnt FROM n")
def snk6_count_table(spark, d):
    return W.count_tables(base(spark, d).nodes)


@query(f"WITH {BASE}, {_GROUPS} SELECT a AS assembly_id, count(DISTINCT g) AS groups, count(*) AS nodes FROM comp GROUP BY a")
def snk7_nodes_by_group(spark, d):
    """Groups by the index and nodes by the files, each group found in the file that the index names."""
    path = f"{shared_dir(spark)}/groups-{W.token()}"
    W.save_by_group(G.components(base(spark, d)), path)
    index = spark.read.parquet(f"{path}/index")
    nodes = W.read_groups(spark, path).groupBy(A, "group", "file").agg(F.count("*").alias("rows"))
    return index.join(nodes, [A, "group", "file", "rows"]).groupBy(A).agg(F.count("*").alias("groups"), F.sum("rows").alias("nodes"))


@query(f"WITH {BASE} SELECT a AS assembly_id, nodes, bases, coalesce(links, 0) AS links, coalesce(value, 0) AS value FROM (SELECT a, count(*) AS nodes, sum(len(seq))::BIGINT AS bases FROM n GROUP BY a) LEFT JOIN (SELECT a, count(*) AS links, sum(cnt)::BIGINT AS value FROM e GROUP BY a) USING (a)")
def snk9_graph_json(spark, d):
    """Written as JSON and parsed again."""
    shape = "struct<nodes:array<struct<node_id:bigint,seq:string,cnt:bigint>>,links:array<struct<source:bigint,target:bigint,value:bigint>>>"
    x = W.graph_json(base(spark, d)).select(A, F.from_json("graph", shape).alias("g"))
    total = lambda c, f: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + f(v))
    links = F.coalesce("g.links", F.array().cast("array<struct<source:bigint,target:bigint,value:bigint>>"))
    of = {"nodes": F.size("g.nodes"), "bases": total(F.col("g.nodes"), lambda v: F.length(v.seq).cast("long")), "links": F.size(links), "value": total(links, lambda v: v.value)}
    return x.select(A, *(v.alias(c) for c, v in of.items())).groupBy(A).agg(*(F.sum(c).alias(c) for c in of))


@query(f"WITH {BASE} SELECT a AS assembly_id, '>' || seq || '[cnt=' || cnt || ';headless=' || (heads = 0) || ';tailless=' || (tails = 0) || ';]' AS head, seq FROM deg")
def snk1_contig_fasta(spark, d):
    """Written as FASTA, one folder an assembly, and read back."""
    from ..sources import readers

    path = f"{shared_dir(spark)}/fasta-{W.token()}"
    c = K.degrees(base(spark, d)).withColumn("name", F.col("seq"))
    W.fasta_lines(c, ["cnt", "headless", "tailless"], A).write.partitionBy(A).text(path)
    x = readers.fasta(spark, path, A)
    return x.select(A, F.concat(F.lit(">"), "description").alias("head"), "seq")


@query(f"WITH {BASE} SELECT a AS assembly_id, seq AS name, cnt AS readCount, cnt / sum(cnt) OVER (PARTITION BY a) AS fraction FROM n")
def snk2_contig_info(spark, d):
    return W.contig_info(base(spark, d).nodes.withColumn("name", F.col("seq")))


# --- contigs ----------------------------------------------------------------------


def _contigs(spark, d):
    return K.degrees(base(spark, d)).withColumn("id", F.col("node_id"))


@query(f"WITH {BASE} SELECT a AS assembly_id, seq, cnt FROM deg WHERE len(seq) > CASE WHEN heads = 0 OR tails = 0 THEN 30 ELSE 14 END")
def c01_long_enough(spark, d):
    return C.long_enough(_contigs(spark, d), KLEN, 14, 30).select(A, "seq", "cnt")


@query(f"WITH {BASE}, t AS (SELECT *, CASE WHEN heads = 0 THEN 16 ELSE 0 END AS f, CASE WHEN tails = 0 THEN 16 ELSE 0 END AS b FROM deg) SELECT a AS assembly_id, substr(seq, f + 1, greatest(len(seq) - f - b, 0)) AS seq, cnt FROM t")
def c02_trim_open_ends(spark, d):
    return C.trim_open_ends(_contigs(spark, d), KLEN).select(A, "seq", "cnt")


@query(f"WITH {BASE} SELECT a AS assembly_id, seq, 'contig.' || lpad(CAST(row_number() OVER (PARTITION BY a ORDER BY len(seq) DESC, cnt DESC, seq) - 1 AS VARCHAR), len(CAST(count(*) OVER (PARTITION BY a) AS VARCHAR))::INT, '0') AS name FROM n")
def c03_renamed_contigs(spark, d):
    return C.rename_by_length(_contigs(spark, d)).select(A, "seq", "name")


@query(f"WITH {BASE}, {_GROUPS}, k AS (SELECT comp.a, g, bool_or(cnt > 30) AS keep FROM comp JOIN n USING (a, id) GROUP BY ALL) SELECT comp.a AS assembly_id, keep, count(*) AS nodes FROM comp JOIN k USING (a, g) GROUP BY ALL")
def c05_keep_whole_groups(spark, d):
    c = G.components(base(spark, d)).withColumn("keep", F.col("cnt") > 30)
    return C.keep_whole_groups(c).groupBy(A, "keep").agg(F.count("*").alias("nodes"))


@query(f"WITH {BASE} SELECT read_id, sample FROM chats WHERE CAST(read_id AS VARCHAR) IN (SELECT read FROM nr JOIN n USING (a, id) WHERE cnt > 30)")
def c06_reads_touching(spark, d):
    g = base(spark, d)
    r = g.node_reads.join(g.nodes.where("cnt > 30"), ["node_id", A]).where(~F.contains("read", F.lit(K.AGAIN))).select(F.col("read").cast("long").alias("read_id"))
    return C.reads_touching(X.chats(spark, d), r).select("read_id", "sample")


@query(f"WITH {BASE} SELECT sample AS assembly_id, total, coalesce(used, 0) AS used, coalesce(used, 0) / total AS used_share FROM (SELECT sample, count(*) AS total FROM chats GROUP BY 1) LEFT JOIN (SELECT a AS sample, count(DISTINCT split_part(read, '{K.AGAIN}', 1)) AS used FROM nr GROUP BY 1) USING (sample)")
def c08_used_by_nodes(spark, d):
    return C.used_by_nodes(base(spark, d).node_reads, X.chats(spark, d).groupBy(F.col("sample").alias(A)).agg(F.count("*").alias("total")))


@query(f"WITH {BASE} SELECT a AS assembly_id, count(*) AS contigs, count(*) FILTER (WHERE heads = 0) + count(*) FILTER (WHERE tails = 0) AS open_ends, count(*) FILTER (WHERE (heads = 0 OR tails = 0) AND len(seq) < 30) AS short_open, count(*) FILTER (WHERE heads > 0 AND tails > 0 AND len(seq) < 22) AS short_inner FROM deg GROUP BY a")
def c09_run_scores(spark, d):
    return C.score_runs(_contigs(spark, d), 22, 30)


@query(f"WITH {BASE}, t AS (SELECT n.*, x.cnt AS ca, z.cnt AS cz FROM n LEFT JOIN rn x ON n.a = x.a AND left(n.seq, 11) = x.id LEFT JOIN rn z ON n.a = z.a AND right(n.seq, 11) = z.id), u AS (SELECT *, CASE WHEN coalesce(ca, 0) <= 4 THEN 11 ELSE 0 END AS f, CASE WHEN coalesce(cz, 0) <= 4 THEN 11 ELSE 0 END AS b FROM t) SELECT a AS sample, substr(seq, f + 1, greatest(len(seq) - f - b, 0)) AS seq FROM u")
def c14_trim_by_coverage(spark, d):
    r = raw(spark, d).nodes.select(F.col(A).alias("sample"), F.col("seq").alias("kmer"), "cnt")
    return C.trim_by_coverage(_contigs(spark, d).withColumnRenamed(A, "sample"), r, KLEN, 2).select("sample", "seq")


@query(f"WITH {BASE}, k AS (SELECT n.a, n.id, p, coalesce(rn.cnt, 0) AS c, len(n.seq) - 10 AS m FROM (SELECT *, unnest(range(0, len(seq) - 10)) AS p FROM n) n LEFT JOIN rn ON rn.a = n.a AND rn.id = substr(n.seq, p + 1, 11)), w AS (SELECT *, sum(c) OVER v AS su, sum(c * c) OVER v AS sq, count(*) OVER v AS q FROM k WINDOW v AS (PARTITION BY a, id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)), f AS (SELECT * FROM w WHERE q = 5 OR (p = 0 AND m - 1 < 4)), b AS (SELECT *, min({{'v': q * sq - su * su, 's': su, 'n': q}}) OVER (PARTITION BY a, id ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS best FROM f) SELECT a AS sample, n.seq, min(best.s / best.n) AS coverage FROM b JOIN n USING (a, id) GROUP BY ALL")
def c13_coverage_estimate(spark, d):
    x = _contigs(spark, d).withColumnRenamed(A, "sample")
    r = raw(spark, d).nodes.select(F.col(A).alias("sample"), F.col("seq").alias("kmer"), "cnt")
    return C.estimate_coverage(x, r, KLEN, 5).join(x.select("sample", "id", "seq"), ["sample", "id"]).select("sample", "seq", "coverage")


@query(f"WITH {BASE}, u AS (SELECT a, seq, max(cnt) AS cnt FROM n WHERE len(seq) >= 12 GROUP BY ALL) SELECT a AS assembly_id, seq, cnt FROM u")
def c17_unique_contigs(spark, d):
    return C.unique_contigs(_contigs(spark, d), 12).select(A, "seq", "cnt")


_K3 = "list_distinct(list_transform(range(1, len({0}) - 1), lambda i: substr({0}, i, 3)))"


@query(f"WITH {BASE}, r AS (SELECT a, seq, cnt, {_RUNS.format('seq')} AS runs FROM n WHERE len(seq) >= 12) SELECT a AS assembly_id, seq, cnt FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE x.a || x.runs = y.a || y.runs AND x.seq <> y.seq AND (y.cnt > x.cnt OR (y.cnt = x.cnt AND y.seq < x.seq)) AND len(list_intersect({_K3.format('x.seq')}, {_K3.format('y.seq')})) / (least(len(x.seq), len(y.seq)) - 2) >= 0.5)")
def c18_collapse_homopolymer_equal(spark, d):
    c = base(spark, d).nodes.where(F.length("seq") >= 12).select(A, F.concat_ws("|", A, "seq").alias("id"), "seq", "cnt", F.col("cnt").alias("coverage"))
    return C.collapse_homopolymer_equal(c, 3, 0.5).select(A, "seq", "cnt")


@query(f"WITH {BASE} SELECT a AS assembly_id, seq, cnt FROM n WHERE cnt >= 15")
def c23_enough_coverage(spark, d):
    return C.enough_coverage(_contigs(spark, d).withColumn("coverage", F.col("cnt")), 15).select(A, "seq", "cnt")


@query(f"WITH {BASE} SELECT a || (len(seq) % 5) AS region, seq, bool_and(cnt > 4) OVER (PARTITION BY a || (len(seq) % 5)) AS final FROM n")
def c24_final_or_partial(spark, d):
    c = _contigs(spark, d).withColumns({"region": F.concat(A, (F.length("seq") % 5).cast("string")), "trim_status": F.col("cnt") > 4})
    return C.final_or_partial(c).select("region", "seq", "final")


@query(f"WITH {BASE} SELECT a AS sample, seq, cnt / sum(cnt) OVER (PARTITION BY a) AS fraction FROM n WHERE cnt > 4 AND len(seq) >= 14")
def c27_final_selection(spark, d):
    c = _contigs(spark, d).withColumnRenamed(A, "sample").withColumn("trim_status", F.col("cnt") > 4)
    return C.final_selection(c, 14).select("sample", "seq", "fraction")
