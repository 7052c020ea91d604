"""Quality rules: base counts, and divergence from the language's own histograms.

Method: the corpus gives each language two references, the shares of its
characters by class and the shares of its ``COMMON`` most frequent short words.
A document is compared with those of its language by Jensen-Shannon distance
(base 2, 0 to 1).  A distance counts only from a minimum length on, as short
texts lie far from any reference by chance.  Built-in column functions only.

Results in edge cases
  * null text counts as empty; it has no words and fails the base rules.
  * a null language is a language of its own, as is every other value; a language
    without a short word has an empty list, and only its character classes count.
  * every row is judged by itself and stays, repeated rows too; null ids pass
    through; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Character classes: lower case, upper case, digits, white space, marks that end words, rest.
CLASSES = (r"\p{Ll}+", r"\p{Lu}+", r"\p{Nd}+", r"[\x20\x09-\x0D]+", r"[.,;:?'()-]+")
COMMON, SHORT = 16, 5
#: Least words for a distance to count, and the largest distances of a kept document.
MIN_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 50, 0.25, 0.45
#: Most languages for which the references are sent to every task.
LANGUAGES = 10_000


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of equal length."""

    def against(x, y):
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    parts = F.zip_with(p, q, lambda x, y: (against(x, y) + against(y, x)) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b), F.lit(0.0)))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.when(total > 0, F.transform(counts, lambda c: c / total)).otherwise(F.transform(counts, lambda c: F.lit(0.0)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(grams: Column) -> Column:
    """Words in windows of five whose hash is found twice or more."""

    def covered(s):
        last = F.size(s) - 1
        same = F.filter(
            F.sequence(F.lit(0), last),
            lambda k: ((k > 0) & (F.get(s, k - 1).g == F.get(s, k).g)) | ((k < last) & (F.get(s, k + 1).g == F.get(s, k).g)),
        )
        at = F.sort_array(F.transform(same, lambda k: F.get(s, k).i))
        start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
        return F.aggregate(at, start, lambda a, i: F.struct((a.n + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")), lambda a: a.n)

    marked = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), _let(marked, covered)).otherwise(0)


def counted(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Base counts of every document, its words and its character classes."""
    x = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    x = x.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    gone = [F.length("text") - F.length(F.regexp_replace("text", c, "")) for c in CLASSES]
    lines = F.filter(F.split("text", "\n", -1), lambda s: s.rlike(WORD))
    x = x.withColumns({
        "hashes": F.transform("words", lambda w: F.xxhash64(w)),
        "found": F.array(*[g.cast("long") for g in gone]),
        "n_chars": F.length("text").cast("long"),
        "n_symbols": (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long"),
        "lines": lines,
    })
    n = F.size("hashes")
    grams = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(5)]))
    x = x.withColumns({
        "grams": F.when(n >= 5, grams).otherwise(F.array().cast("array<bigint>")),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "classes": F.concat("found", F.array(F.col("n_chars") - F.aggregate("found", F.lit(0).cast("long"), lambda a, b: a + b))),
        "word_chars": F.col("n_chars") - F.get("found", F.lit(3)),
        "n_words": n.cast("long"),
    })
    return x.select("doc_id", "lang", "words", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat_words(F.col("grams")).cast("long").alias("n_repeat_words"), "classes")


def references(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """ref_lang, ref_classes (shares by class) and ref_words with ref_shares (of all words), from all documents."""
    text = F.coalesce(docs[text_col], F.lit(""))
    x = docs.select(docs[lang_col].alias("lang"), text.alias("text"))
    gone = [(F.length("text") - F.length(F.regexp_replace("text", c, ""))).cast("long") for c in CLASSES]
    sums = x.groupBy("lang").agg(*[F.sum(g).alias(f"c{i}") for i, g in enumerate(gone)], F.sum(F.length("text").cast("long")).alias("chars"))
    each = [F.col(f"c{i}") for i in range(len(CLASSES))]
    classes = sums.select("lang", shares(F.array(*each, F.col("chars") - sum(each[1:], each[0]))).alias("ref_classes"))
    words = x.select("lang", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    total = words.groupBy("lang").agg(F.sum(F.size("words").cast("long")).alias("n_all"))
    short = words.select("lang", F.explode(F.filter("words", lambda w: F.length(w) <= SHORT)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = short.withColumn("r", rank).where(F.col("r") <= COMMON).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "word", "n"))).alias("top"))
    joined = classes.join(total.withColumnRenamed("lang", "l2"), classes.lang.eqNullSafe(F.col("l2"))).drop("l2")
    joined = joined.join(top.withColumnRenamed("lang", "l3"), joined.lang.eqNullSafe(F.col("l3")), "left").drop("l3")
    empty = F.array().cast("array<struct<r:int,word:string,n:bigint>>")
    joined = joined.withColumn("top", F.coalesce("top", empty))
    return joined.select(
        F.col("lang").alias("ref_lang"), "ref_classes", F.transform("top", lambda t: t.word).alias("ref_words"),
        F.transform("top", lambda t: t.n / F.col("n_all")).alias("ref_shares"),
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: the counts, class_distance, word_distance, base_failed and kept."""
    refs, _ = stage(references(docs, text_col, lang_col), "languages")
    refs = F.broadcast(refs) if refs.count() <= LANGUAGES else refs
    x = counted(docs, id_col, text_col, lang_col)
    x = x.join(refs, x.lang.eqNullSafe(F.col("ref_lang")), "left")
    x = x.withColumn("common", F.filter("words", lambda w: F.array_contains("ref_words", w)))
    per_word = F.transform("ref_words", lambda r: F.size(F.filter("common", lambda w: w == r)) / F.col("n_words"))

    def with_rest(a):
        return F.concat(a, F.array(F.greatest(1.0 - F.aggregate(a, F.lit(0.0), lambda s, v: s + v), F.lit(0.0))))

    long_enough = F.col("n_words") >= MIN_WORDS
    x = x.withColumns({
        "class_distance": F.when(long_enough, distance(shares(F.col("classes")), F.col("ref_classes"))),
        "word_distance": F.when(long_enough & (F.size("ref_words") > 0), distance(with_rest(per_word), with_rest(F.col("ref_shares")))),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    })
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    gone = [f"len(text) - len(regexp_replace(text, '{c.replace(chr(39), chr(39) * 2)}', '', 'g'))" for c in CLASSES]
    h = "list_transform(list_zip({p}, {q}), lambda z: (CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END) / 2)"

    def js(p, q):
        return f"sqrt(greatest(list_sum({h.format(p=p, q=q)}), 0))"

    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
c0 AS (SELECT *, [{', '.join(gone)}] AS found, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '{WORD}')) AS lines FROM d),
c AS (SELECT *, list_concat(found, [len(text) - list_sum(found)::BIGINT]) AS classes FROM c0),
g AS (SELECT doc_id, s, array_to_string(ws[s:s + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS s FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + 5)) AS p
  FROM g JOIN (SELECT doc_id, k FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, k)) GROUP BY doc_id),
rc AS (SELECT lang, {', '.join(f'sum(classes[{i + 1}]) AS c{i}' for i in range(len(CLASSES) + 1))}, sum(len(text)) AS chars, sum(len(ws)) AS n_all FROM c GROUP BY lang),
sw AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(ws) AS w FROM d) WHERE len(w) <= {SHORT} GROUP BY ALL),
tw AS (SELECT lang, list(w ORDER BY n DESC, w) AS words, list(n ORDER BY n DESC, w) AS ns FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS r FROM sw) WHERE r <= {COMMON} GROUP BY lang),
f AS (SELECT rc.lang, [{', '.join(f'c{i}::DOUBLE / chars' for i in range(len(CLASSES) + 1))}] AS rcl, words, list_transform(ns, lambda n: n::DOUBLE / n_all) AS rsh
  FROM rc LEFT JOIN tw ON rc.lang IS NOT DISTINCT FROM tw.lang),
x AS (SELECT c.doc_id, len(ws) AS n_words, len(text) - found[4] AS word_chars, len(text) - len(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  list_transform(classes, lambda v: v::DOUBLE / len(text)) AS p, rcl,
  list_transform(words, lambda a: len(list_filter(ws, lambda b: b = a))::DOUBLE / len(ws)) AS pw, rsh
  FROM c LEFT JOIN r ON c.doc_id = r.doc_id LEFT JOIN f ON c.lang IS NOT DISTINCT FROM f.lang),
y AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  CASE WHEN n_words >= {MIN_WORDS} THEN {js('p', 'rcl')} ELSE 0 END AS cd,
  CASE WHEN n_words >= {MIN_WORDS} AND len(pw) > 0 THEN {js('list_concat(pw, [greatest(1 - list_sum(pw), 0)])', 'list_concat(rsh, [greatest(1 - list_sum(rsh), 0)])')} ELSE 0 END AS wd FROM x)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (cd > {MAX_CLASS_DISTANCE} OR wd > {MAX_WORD_DISTANCE}) AS kept FROM y
"""


SQL = _sql()
