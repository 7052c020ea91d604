"""Packing: concatenate the token streams of all documents and cut them into fixed windows.

Method: the first pass tokenizes and stages each document's ids with its place
in its partition; prefix sums over the partition totals then give global
offsets; the second pass cuts every document at the multiples of the window.
Only the last window is short.

Results in edge cases
  * null and empty texts are one id, the end mark; every row is packed, repeated
    rows and null ids too; other columns are ignored, whatever their names.
  * an empty table gives no rows; a long text is cut into as many pieces as needed.
  * the order of documents in the stream is that of the staged table.
"""

from __future__ import annotations

import base64
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage, text_buffer
from .repeats import keyed

WINDOW, END = 1024, 0
#: Units of text (a word with the white space before it) whose ids a Python worker remembers.
REMEMBERED = 400_000

_UNITS = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
#: White space beyond ASCII's, which joins runs across units, and the mark of the vocabulary's own special token.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]|<\\|endoftext\\|>")


class Tokenizer:
    """Ids of the vocabulary file, the same as the ``tokenizers`` library gives.

    A pretoken never spans from a word into the white space after it, so a text
    is the sum of its units.  Units are looked up, and new ones are encoded with the
    same vocabulary as ranks; texts with odd white space or special tokens go to
    the library whole.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer as Whole

        self.whole = Whole.from_file(vocabulary)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.known: dict[bytes, bytes] = {}

    def _learn(self, unit: bytes) -> bytes:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        ids = self.known[unit] = np.array(self.encode(unit.decode()), np.uint16).tobytes()
        return ids

    def ids(self, body: bytes, odd: bool) -> bytes:
        """Unsigned 16-bit ids, little-endian."""
        if odd:
            return np.array(self.whole.encode(body.decode(), add_special_tokens=False).ids, np.uint16).tobytes()
        get, learn = self.known.get, self._learn
        return b"".join([get(u) or learn(u) for u in _UNITS.findall(body)])


_LOADED: dict[tuple, Tokenizer] = {}


def tokenizer(files: tuple[str, str, str]) -> Tokenizer:
    """One per Python worker, kept for its later tasks."""
    if files not in _LOADED:
        _LOADED[files] = Tokenizer(*files)
    return _LOADED[files]


def default_files() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _tokenize(files, end: int):
    tail = np.array([end], np.uint16).tobytes()

    def run(batches):
        part, place, tok = TaskContext.get().partitionId(), 0, tokenizer(files)
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            raw, ids = data.tobytes(), []
            for i in range(len(offs) - 1):
                body = raw[offs[i] : offs[i + 1]]
                ids.append(tok.ids(body, bool(_ODD.search(body.decode()))) + tail)
            ends = list(accumulate((len(x) // 2 for x in ids), initial=place))
            place = ends[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(ends[:-1], pa.int64()), pa.array(ends[1:], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "part", "begin", "until", "ids"],
            )

    return run


def _cut(window: int):
    def run(batches):
        for batch in batches:
            doc, begin = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for d, g, body in zip(doc, begin, batch.column(2).to_pylist()):
                ids = np.frombuffer(body, np.uint16).astype("<u4")
                cuts = [0, *range(window - g % window, len(ids), window), len(ids)]
                for a, b in zip(cuts, cuts[1:]):
                    rows.append((d, a, b - a, len(ids), (g + a) // window, (g + a) % window, ids[a:b].tobytes()))
            cols = list(zip(*rows)) or [()] * 7
            types = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, str, str] | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (32-bit, little-endian)."""
    docs = keyed(docs, id_col, text_col)
    tokens, _ = stage(docs.mapInArrow(_tokenize(files or default_files(), end), "doc_id long, part int, begin long, until long, ids binary"), "tokens")
    # one row a partition of the first pass, so few that one task sums and every task may hold them
    totals = tokens.groupBy("part").agg(F.max("until").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("begin")).alias("begin"), "ids")
    return placed.mapInArrow(_cut(window), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
