"""The pipeline stage by stage on a small corpus, each judged on its own input."""

import hashlib
import math
import random
from collections import Counter

import corpus_pipeline
from strandworks.llm import mixing
from tests.llm.test_near_copies import brute, shingles
from tests.llm.test_substrings import brute_bytes


def test_stages(spark, tmp_path):
    r = random.Random(2)
    vocab = ["the", "river", "runs", "to", "sea", "and"] + [f"w{i}" for i in range(200)]
    passage = " ".join(r.choices(vocab, k=70))
    rows = []
    for i in range(90):
        words = r.choices(vocab, k=r.choice([30, 90]))
        text = " ".join(words) + (" " + passage if i % 6 == 0 else "")
        rows.append((i, text if i % 5 else " ".join(w.upper() + "!!" for w in words), "en", f"src{i % 3}", len(text)))
    rows += [(100 + i, rows[i + 1][1], "en", "src0", 1) for i in range(3)]
    # near copies: a word or two changed at the end of long texts, linked by shingles and not by four bits
    base = [" ".join(r.choices(vocab, k=120)) for _ in range(4)]
    rows += [(120 + 2 * i + j, b + f" end{j} stop{j}", "en", "src1", 1) for i, b in enumerate(base) for j in (0, 1)]
    rows += [(110, "", "en", None, 0), (111, None, None, "src1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(90)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    state = {}
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        state[name] = (docs.collect(), out.collect())
        docs = out
    before, after = state["quality_classifier"]
    kept = {x.doc_id for x in after}
    assert all(i in kept for i in range(90) if i % 5) and not any(i in kept for i in range(0, 90, 5))
    before, after = state["simhash_near_dedup"]
    root = brute([shingles(x.text) for x in before])
    least = {}
    for x, c in zip(before, root):
        least[c] = min(least.get(c, x.doc_id), x.doc_id)
    assert sorted(x.doc_id for x in after) == sorted(least.values())
    assert {120, 122, 124, 126} <= {x.doc_id for x in after} and not {121, 123, 125, 127} & {x.doc_id for x in after}
    before, after = state["suffix_array_dedup"]
    want = {d: n - gone for d, n, gone, _, _ in brute_bytes([(x.doc_id, x.text) for x in before], 200)}
    assert {x.doc_id: len((x.text or "").encode()) for x in after} == want
    before, after = state["source_mixing"]
    # Poisson counts by inversion at hashed numbers, from the sizes of the sources
    size = lambda x: max(len(x.text or ""), 1)
    source = Counter()
    for x in before:
        source[x.source] += size(x)
    want = Counter()
    for x in before:
        mean = sum(source.values()) / len(source) / source[x.source]
        n = max(math.ceil(mean / mixing.CHUNK), 1)
        for j in range(1, n + 1):
            u = int(hashlib.md5(f"{mixing.SEED}:{x.doc_id}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            p = cdf = math.exp(-mean / n)
            k = 0
            while cdf <= u:
                k += 1
                p *= mean / n / k
                cdf += p
            want[x.doc_id] += k
    assert Counter(x.doc_id for x in after) == +want and all(x in before for x in after)
    before, after = state["packing"]
    assert sum(x.length for x in after) == sum({(x.doc_id, x.doc_tokens): x.doc_tokens for x in after if True}[(b, t)] for b, t in [(x.doc_id, x.doc_tokens) for x in after if x.start == 0])
    assert sorted({x.doc_id for x in after}) == sorted({x.doc_id for x in before})
