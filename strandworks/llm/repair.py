"""Repair of conversation structure: cheapest edits that make the roles follow ``(s?(ua)+)?``.

Method: each turn becomes one letter, its role's initial with its fault; a
conversation becomes a word over these letters, its signature.  The signatures
are sorted by their reversal, so that the suffix-shared automaton of all of them
(one node for each different suffix) is walked node by node from the end: the
stack of the walk holds the path of the last signature, and only the nodes that
the next one does not share are made.  A node keeps, for each of four grammar
states, the cost to go and the first edit of the best audit suffix.  At one node
and state every edit letter leads to one next node and state, so ties are
decided by the letter, and an audit is read off along the path.

Scale: turns are sorted over all conversations by ranges, so a conversation with
any share of the rows is cut into parts; parts carry a letter a turn, and the
edits come back to the turns by conversation and part.  Signatures are dealt by
ranges of (reversal, id), so a signature shared by many conversations is split.
Counts of equal rows are summed before any shuffle.  A SHA-256 is sequential: one
task streams the text of a conversation of several parts, in pieces.

Results in edge cases
  * null role and null text are one space; null turns come first; turns of one
    number are ordered by role and text.  A null id is a conversation.
  * only a role's first character counts; a role that starts with none of s, u,
    a can be changed or deleted only.
  * a conversation without rows needs no edits: zeros, empty audit, hash of "".
  * other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stage

CHANGE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3

#: Letters of turns: 4 * role + fault; roles s, u, a, other; faults none, cut off, seen before, blank.
FIRST = ord("A")
#: Grammar states: nothing yet, after s, after u, after a.  Role that an insert or change gives, and its state.
NEXT_ROLE, NEXT_STATE, FINAL = "uuau", (2, 2, 3, 2), (0, 3)
#: State after keeping a role, by role and state; -1 where the grammar forbids it.
KEEP = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
FAR = 1 << 60
SPACES = " \t\n\x0b\x0c\r"
#: Text of one conversation that is handed on at once where it spans several parts.
CHUNK = 1 << 20


def damaged(turns: DataFrame) -> DataFrame:
    """Turns of the query: by crc32("conv_id:turn") % 20 dropped, emptied, cut off, repeated or given to the user.

    conv_id, turn, role, text and copies, the number of adjacent equal rows (0: dropped).
    """
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select(turns["conv_id"], turns["turn"], turns["role"], turns["text"], (F.crc32(key.cast("binary")) % 20).alias("fate"))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def sorted_turns(turns: DataFrame) -> DataFrame:
    """Different rows in order, with part (of all rows) and place (in the part), role and fault class, staged."""
    gone = F.col("copies") == 0
    rows = turns.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(gone, "").otherwise(F.coalesce("text", F.lit(" "))).alias("text"), "copies")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    keys = ["conv_id", "turn", "role", "text"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    # the number of a row is the partition of the range and the row's rank in it, both the same on every attempt
    numbered = dealt.withColumn("at", F.monotonically_increasing_id())
    ink = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    return stage(numbered.select(
        "conv_id", "turn", "role", "text", "copies", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("who"),
        F.when(ink == "", 3).when(F.right(ink, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1).alias("fault"),
        F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "text", "role").alias("h2")), "turns")[0]


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, letters of the whole conversation, and its parts: number, letters a row, first, last and number of turns."""
    seen = rows.where("copies > 0").groupBy("conv_id", "h1", "h2").agg(F.min(F.struct("part", "place")).alias("m"))
    light = rows.select("conv_id", "turn", "copies", "part", "place", "who", "fault")
    firsts = seen.select("m.part", "m.place", F.lit(True).alias("is_first"))
    fault = F.when((F.col("fault") != 3) & F.col("is_first").isNull(), 2).otherwise(F.col("fault"))

    # a row's letters: its first copy, then the others, which have been seen
    first, again = (F.expr(f"char({FIRST} + 4 * who + {f})") for f in ("fault", "if(blank, 3, 2)"))
    word = F.when(F.col("copies") == 0, "").otherwise(F.concat(first, F.repeat(again, (F.col("copies") - 1).cast("int"))))
    judged = light.join(firsts, ["part", "place"], "left").withColumns({"fault": fault, "blank": F.col("fault") == 3})
    lettered = judged.select("conv_id", "part", F.struct("place", word.alias("word"), "turn").alias("r"))
    pieces = lettered.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("r")).alias("r")).select(
        "conv_id", F.struct(
            "part", F.col("r.word").alias("words"), F.array_min("r.turn").alias("low"), F.array_max("r.turn").alias("high"),
            F.size(F.array_distinct(F.filter("r.turn", lambda t: t.isNotNull()))).alias("turns")).alias("piece"))
    return pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces")).withColumn(
        "letters", F.array_join(F.transform("pieces", lambda p: F.array_join(p.words, "")), ""))


class Automaton:
    """Path of nodes from the end of a signature: costs and first edits by state, the shared part kept between signatures."""

    def __init__(self):
        self.word, self.cost, self.edit = "", array("q"), bytearray()
        self._push([0 if s in FINAL else FAR for s in range(4)], [ord("-")] * 4)

    def _push(self, cost, edit):
        """Relax inserts, at most two in a row: a third would come back to the same state."""
        for _ in range(2):
            for s in range(4):
                there = cost[NEXT_STATE[s]] + INSERT
                if there < cost[s] or (there == cost[s] and ord("I") < edit[s]):
                    cost[s], edit[s] = there, ord("I")
        self.cost.extend(cost)
        self.edit.extend(edit)

    def read(self, backwards: str) -> None:
        """Make ``backwards`` the path; what it shares with the last one stays."""
        low, high = 0, min(len(backwards), len(self.word))
        while low < high:  # length of the common beginning
            mid = (low + high + 1) // 2
            low, high = (mid, high) if backwards[:mid] == self.word[:mid] else (low, mid - 1)
        del self.cost[4 * (low + 1) :], self.edit[4 * (low + 1) :]
        for x in backwards[low:]:
            who, fault = divmod(ord(x) - FIRST, 4)
            after = self.cost[-4:]
            cost, edit = [c + DELETE for c in after], [ord("D")] * 4
            if fault < 2:
                extra = CUT_OFF * fault
                for s in range(4):
                    for e, to, price in ((ord("K"), KEEP[who][s], extra), (ord("R"), NEXT_STATE[s], extra + CHANGE)):
                        if to >= 0 and after[to] + price < cost[s]:  # in order of the letters, so that ties keep the first
                            cost[s], edit[s] = after[to] + price, e
            self._push(cost, edit)
        self.word = backwards

    def audit(self):
        """Cost, audit, and for each turn what it becomes: inserts before it (u, a), then K, U, A or nothing; the last element follows all turns."""
        d, s, out, said = len(self.word), 0, [], ""
        made = []
        while True:
            e = chr(self.edit[4 * d + s])
            if e == "-":
                break
            out.append(e)
            if e == "I":
                said, s = said + NEXT_ROLE[s], NEXT_STATE[s]
                continue
            if e == "K":
                said, s = said + "K", KEEP[(ord(self.word[d - 1]) - FIRST) // 4][s]
            elif e == "R":
                said, s = said + NEXT_ROLE[s].upper(), NEXT_STATE[s]
            made.append(said)
            said, d = "", d - 1
        return self.cost[4 * len(self.word)], "".join(out), [*made, said]


#: Letter pairs of adjacent turns that are legal, by role.
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Blank and repeated turns can only go: one letter for both and for all roles.
SAME = {FIRST + 4 * w + f: FIRST + 14 for w in range(4) for f in (2, 3)}

PLANNED = (
    "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "edits array<struct<part:long,parts:long,made:array<string>>>"
)


def _plan(schema):
    def run(batches):
        nodes = Automaton()
        for batch in batches:
            out = {k: [] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "edits")}
            for letters, pieces, backwards in zip(batch.column("letters").to_pylist(), batch.column("pieces").to_pylist(), batch.column("backwards").to_pylist()):
                nodes.read(backwards)
                cost, audit, made = nodes.audit()
                codes = [ord(x) - FIRST for x in letters]
                whos, faults = [c // 4 for c in codes], [c % 4 for c in codes]
                dated = [p for p in pieces if p["low"] is not None]
                turns = sum(p["turns"] for p in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
                edits, i = [], 0
                for p in pieces:
                    tokens = []
                    for word in p["words"]:
                        tokens.append("".join(made[i : i + len(word)]))
                        i += len(word)
                    edits.append({"part": p["part"], "parts": len(pieces), "made": tokens})
                edits[-1]["made"][-1] += made[-1]
                for k, v in (
                    ("gaps", dated[-1]["high"] - dated[0]["low"] + 1 - turns if dated else 0), ("blank", faults.count(3)), ("duplicate", faults.count(2)),
                    ("truncated", faults.count(1)), ("illegal", sum(x not in LEGAL for x in zip(whos, whos[1:]))), ("cost", cost), ("audit", audit), ("edits", edits),
                ):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(v, schema.field(k).type) for k, v in out.items())], names=["conv_id", *out])

    return run


def plans(words: DataFrame) -> DataFrame:
    """Audit and counts of each conversation, and the edits by part and row."""
    kind = words.schema["conv_id"].dataType
    piece = pa.list_(pa.struct([("part", pa.int64()), ("parts", pa.int64()), ("made", pa.list_(pa.string()))]))
    schema = pa.schema([(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("edits", piece)])
    letters = "".join(map(chr, SAME)), "".join(map(chr, SAME.values()))
    backwards = words.withColumn("backwards", F.reverse(F.translate("letters", *letters)))
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = backwards.repartitionByRange(parts, "backwards", "conv_id").sortWithinPartitions("backwards", "conv_id")
    return dealt.mapInArrow(_plan(schema), PLANNED.format(kind.simpleString()))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def lines(made: str, role: str, text: str) -> list[tuple[str, str]]:
    """Repaired turns that stand for one row."""
    given = {"u": "user", "a": "assistant", "U": "user", "A": "assistant", "K": role}
    return [(given[x], "" if x in "ua" else text) for x in made]


def _render(kind, each):
    """Stream parts, each led by its edits; ``each(info)`` makes what receives the lines of a part and gives its rows."""

    def run(batches):
        now = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["place"] < 0:
                    if now is not None:
                        rows += now.end()
                    now, edits = each(r), r["made"]
                    i = 0
                else:
                    for role, text in lines(edits[i], r["role"], r["text"]):
                        rows += now.add(role, text)
                    i += 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kind)
        if now is not None:
            yield pa.RecordBatch.from_pylist(now.end(), kind)

    return run


class _Turns:
    """Rows of repaired turns."""

    def __init__(self, info):
        self.key, self.n = {"conv_id": info["conv_id"], "part": info["part"]}, 0

    def add(self, role, text):
        self.n += 1
        return [self.key | {"turn": self.n - 1, "role": role, "text": text}]

    def end(self):
        return []


class _Digest:
    """The hash of a conversation of one part; of others its text in pieces, each turn led by a line feed."""

    def __init__(self, info):
        self.row = {k: info[k] for k in ("conv_id", "part", "audit", *COUNTS)}
        self.whole, self.hash, self.any, self.held, self.seq = info["parts"] == 1, hashlib.sha256(), False, bytearray(), 0

    def add(self, role, text):
        line = f"{role}:{text}".encode()
        if self.whole:
            self.hash.update(b"\n" * self.any + line)
            self.any = True
            return []
        self.held += b"\n" + line
        return self._flush() if len(self.held) >= CHUNK else []

    def _flush(self):
        row = self.row | {"seq": self.seq, "chunk": bytes(self.held)}
        self.held, self.seq = bytearray(), self.seq + 1
        return [row]

    def end(self):
        return [self.row | {"seq": 0, "repaired_sha256": self.hash.hexdigest()}] if self.whole else self._flush()


def _led(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Parts in order, each as one row of edits followed by its turns; the key holds the part, so no conversation is gathered."""
    heads = planned.withColumn("e", F.explode("edits")).select("conv_id", "e.part", F.lit(-1).cast("long").alias("place"), "e.parts", "e.made", "audit", *COUNTS)
    both = heads.unionByName(rows.select("conv_id", "part", "place", "role", "text"), allowMissingColumns=True)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "conv_id", "part").sortWithinPartitions("conv_id", "part", "place")


def _arrow(kind, **columns):
    """The same columns as Arrow schema and as Spark's; conv_id keeps its type."""
    from pyspark.sql.pandas.types import to_arrow_type

    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return pa.schema([("conv_id", to_arrow_type(kind)), *columns.items()]), ", ".join([f"conv_id {kind.simpleString()}", *(f"{k} {names[v]}" for k, v in columns.items())])


def repaired(turns: DataFrame) -> DataFrame:
    """Turns after the cheapest edits: conv_id, part and turn (the order, both from the smallest), role, text."""
    rows = sorted_turns(turns)
    schema, ddl = _arrow(rows.schema["conv_id"].dataType, part=pa.int64(), turn=pa.int64(), role=pa.string(), text=pa.string())
    return _led(rows, plans(signatures(rows))).mapInArrow(_render(schema, _Turns), ddl)


def _join_chunks(schema):
    """Hash of the conversations of several parts from their pieces, in order; the first line feed is left out."""

    def run(batches):
        now, key, row, empty = None, None, None, True
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != key:
                    if now is not None:
                        done.append(row | {"repaired_sha256": now.hexdigest()})
                    now, key, row, empty = hashlib.sha256(), r["conv_id"], {k: r[k] for k in ("conv_id", "audit", *COUNTS)}, True
                if r["chunk"]:
                    now.update(r["chunk"][empty:])
                    empty = False
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([row | {"repaired_sha256": now.hexdigest()}], schema)

    return run


def repair(turns: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired turns, one row a conversation.

    ``turns`` has conv_id, turn, role, text and copies (of adjacent equal rows; 0 keeps the conversation only).
    """
    rows = sorted_turns(turns)
    kind, counts = rows.schema["conv_id"].dataType, dict.fromkeys(COUNTS, pa.int64())
    full, ddl = _arrow(kind, part=pa.int64(), seq=pa.int64(), **counts, audit=pa.string(), repaired_sha256=pa.string(), chunk=pa.binary())
    parts, _ = stage(_led(rows, plans(signatures(rows))).mapInArrow(_render(full, _Digest), ddl), "repairs")
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    short, ddl = _arrow(kind, **counts, audit=pa.string(), repaired_sha256=pa.string())
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    several = parts.where("chunk IS NOT NULL").drop("repaired_sha256").repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return parts.where("chunk IS NULL").select(names).unionByName(several.mapInArrow(_join_chunks(short), ddl).select(names))


SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    row_number() OVER () AS nr, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
bits AS (SELECT key, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT))),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))) AS c
  FROM (SELECT DISTINCT key FROM k)),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT *, xor(c, 4294967295) % 20 AS fate FROM k JOIN bits USING (key))),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS r,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ink FROM d),
f AS (SELECT *, CASE WHEN ink = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    coalesce(lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au'), FALSE) AS bad FROM o),
s AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (bad) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
b AS (SELECT conv_id, CAST(n AS BIGINT) AS i, {'c': 0, 'a': '', 'l': []::VARCHAR[]} AS s0, {'c': 6, 'a': 'II', 'l': ['user:', 'assistant:']} AS s1,
    {'c': 3, 'a': 'I', 'l': ['assistant:']} AS s2, {'c': 0, 'a': '', 'l': []::VARCHAR[]} AS s3 FROM s
  UNION ALL
  SELECT conv_id, i, least(b0, {'c': g2.c + 3, 'a': 'I' || g2.a, 'l': list_prepend('user:', g2.l)}), least(b1, {'c': g2.c + 3, 'a': 'I' || g2.a, 'l': list_prepend('user:', g2.l)}), g2,
    least(b3, {'c': b2.c + 3, 'a': 'I' || b2.a, 'l': list_prepend('user:', b2.l)})
  FROM (SELECT *, least(b2, {'c': b3.c + 3, 'a': 'I' || b3.a, 'l': list_prepend('assistant:', b3.l)}) AS g2
  FROM (SELECT conv_id, i - 1 AS i,
    least({'c': s0.c + 4, 'a': 'D' || s0.a, 'l': s0.l}, {'c': s2.c + e + 3, 'a': 'R' || s2.a, 'l': list_prepend('user:' || text, s2.l)},
      CASE r WHEN 's' THEN {'c': s1.c + e, 'a': 'K' || s1.a, 'l': list_prepend(role || ':' || text, s1.l)} WHEN 'u' THEN {'c': s2.c + e, 'a': 'K' || s2.a, 'l': list_prepend(role || ':' || text, s2.l)} END) AS b0,
    least({'c': s1.c + 4, 'a': 'D' || s1.a, 'l': s1.l}, {'c': s2.c + e + 3, 'a': 'R' || s2.a, 'l': list_prepend('user:' || text, s2.l)},
      CASE r WHEN 'u' THEN {'c': s2.c + e, 'a': 'K' || s2.a, 'l': list_prepend(role || ':' || text, s2.l)} END) AS b1,
    least({'c': s2.c + 4, 'a': 'D' || s2.a, 'l': s2.l}, {'c': s3.c + e + 3, 'a': 'R' || s3.a, 'l': list_prepend('assistant:' || text, s3.l)},
      CASE r WHEN 'a' THEN {'c': s3.c + e, 'a': 'K' || s3.a, 'l': list_prepend(role || ':' || text, s3.l)} END) AS b2,
    least({'c': s3.c + 4, 'a': 'D' || s3.a, 'l': s3.l}, {'c': s2.c + e + 3, 'a': 'R' || s2.a, 'l': list_prepend('user:' || text, s2.l)},
      CASE r WHEN 'u' THEN {'c': s2.c + e, 'a': 'K' || s2.a, 'l': list_prepend(role || ':' || text, s2.l)} END) AS b3
  FROM (SELECT b.*, role, text, r, CASE fault WHEN '' THEN 0 WHEN 't' THEN 3 ELSE 1000000 END AS e FROM b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i))))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT * FROM b WHERE i = 0) x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
"""
