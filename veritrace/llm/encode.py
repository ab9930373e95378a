"""Byte-level BPE of a whole corpus with a public vocabulary: merges by recursive SQL inside each partition.

A partition's texts are cut into words by the vocabulary's pattern. The words not met before that aren't a token by
themselves go to DuckDB as token-position rows: a recursive query joins neighbouring tokens to the merge table, finds each
word's pair of least rank and contracts it, until no pair is left. All places of that pair are contracted in one round,
from the left; a pair that holds a new token ranks after the one that made it, so this is the fixpoint of contracting
the leftmost one at a time, in far fewer rounds for long runs. An ordered aggregation gives the ids of each word, which
are kept for the rest of the partition.
"""

from __future__ import annotations

import base64
import gc
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts text into words, as the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII texts, which the standard library's matcher takes in less time.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+", re.ASCII)
#: Where the vocabulary files lie.
TOKENIZERS = "/opt/tokenizers"
#: Words a partition keeps the ids of; when full, the memory is emptied and words are encoded again.
KEPT_WORDS = 300_000
#: Bytes of words that one recursive query takes at most; a longer word goes alone.
QUERY_BYTES = 400_000

#: spots: one row a token, with the place of the next one of its word; a contracted place stays with token -1. Only pairs
#: of one token with itself can overlap; of a run of such pairs every second is taken, from the left.
_RECURSIVE = """
WITH RECURSIVE spots(word, pos, tok, nxt) USING KEY (pos) AS (
    SELECT word, pos, tok, nxt FROM first_tokens
  UNION ALL
    (WITH pairs AS (
        SELECT s.word, s.pos, n.pos AS gone, n.nxt AS after, m.rank, m.merged, s.tok = n.tok AS twin
        FROM spots s JOIN spots n ON s.nxt = n.pos JOIN merges m ON m.pair = s.tok::BIGINT * 65536 + n.tok
        WHERE s.tok >= 0
    ), best AS (
        SELECT word, min(rank) AS rank FROM pairs GROUP BY word
    ), hits AS (
        SELECT pairs.* FROM pairs JOIN best ON pairs.word = best.word AND pairs.rank = best.rank
    ), islands AS (
        SELECT pos, gone, after, merged, sum(fresh) OVER (ORDER BY pos) AS island
        FROM (SELECT *, CASE WHEN lag(gone) OVER (ORDER BY pos) = pos THEN 0 ELSE 1 END AS fresh FROM hits WHERE twin)
    ), taken AS (
        SELECT pos, gone, after, merged FROM hits WHERE NOT twin
        UNION ALL
        SELECT pos, gone, after, merged FROM (SELECT *, row_number() OVER (PARTITION BY island ORDER BY pos) AS nth FROM islands) WHERE nth % 2 = 1
    )
    SELECT s.word, s.pos, CASE WHEN g.gone IS NOT NULL THEN -1 WHEN t.pos IS NOT NULL THEN t.merged ELSE s.tok END, CASE WHEN t.pos IS NOT NULL THEN t.after ELSE s.nxt END
    FROM spots s JOIN best ON s.word = best.word LEFT JOIN taken t ON s.pos = t.pos LEFT JOIN taken g ON s.pos = g.gone
    WHERE s.tok >= 0)
)
SELECT word, list(tok ORDER BY pos) AS ids FROM spots WHERE tok >= 0 GROUP BY word
"""


@lru_cache(maxsize=2)
def vocabulary(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> tuple[dict[bytes, int], list[tuple[int, int, int, int]]]:
    """(id of each token's bytes, merges as (left id, right id, rank, merged id)) of a byte-level vocabulary."""
    # the file writes each byte as one printable character: those that are printable as they are, the others from U+0100 on
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}
    with open(f"{folder}/{name}.json", encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranked = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    ids = {t: i for t, i in ids.items() if t in ranked}
    raw = model["vocab"]
    merges = []
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges.append((raw[a], raw[b], rank, raw[a + b]))
    return ids, merges


class Encoder:
    """Ids of texts; holds one DuckDB connection and the ids of the words met so far."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> None:
        import duckdb

        self.ids, merges = vocabulary(folder, name)
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.find = regex.compile(PATTERN).findall
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "350MB", "preserve_insertion_order": "false"})
        cols = [pa.array(x, pa.int32()) for x in zip(*merges)]
        merge_table = pa.table(cols, names=["a", "b", "rank", "merged"])
        self.con.register("merge_arrow", merge_table)
        self.con.execute("CREATE TABLE merges AS SELECT a::BIGINT * 65536 + b AS pair, rank, merged FROM merge_arrow")
        self._forget()

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids)."""
        sizes = np.array([len(w) for w in words])
        nxt = np.arange(1, sizes.sum() + 1, dtype=np.int32)
        nxt[np.cumsum(sizes) - 1] = -1
        first = pa.table(
            {
                "word": pa.array(np.repeat(np.arange(len(words), dtype=np.int32), sizes)),
                "pos": pa.array(np.arange(sizes.sum(), dtype=np.int32)),
                "tok": pa.array(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]),
                "nxt": pa.array(nxt),
            }
        )
        self.con.register("first_tokens", first)
        out = self.con.sql(_RECURSIVE).to_arrow_table().combine_chunks()
        self.con.unregister("first_tokens")
        order = np.argsort(out.column("word").to_numpy())
        ids = out.column("ids").combine_chunks().take(pa.array(order))
        return np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()

    def _keep(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.start.frombytes((self.start[-1] + np.cumsum(sizes, dtype=np.int64)).tobytes())
        self.flat.frombytes(ids.astype(np.int32).tobytes())

    def learn(self, words: set[str]) -> None:
        """Find the ids of words not known yet."""
        names = list(words)
        raws = [w.encode("utf-8", "replace") for w in names]
        ones = np.fromiter((self.ids.get(r, -1) for r in raws), np.int32, len(raws))
        whole = np.flatnonzero(ones >= 0)
        self._keep([names[i] for i in whole], np.ones(len(whole), np.int64), ones[whole])
        rest = np.flatnonzero(ones < 0)
        part = np.cumsum([len(raws[i]) for i in rest]) // QUERY_BYTES
        for k in np.unique(part):
            some = rest[part == k]
            self._keep([names[i] for i in some], *self._contract([raws[i] for i in some]))

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.place) > KEPT_WORDS:
            self._forget()
        new = set(chain.from_iterable(cut)).difference(self.place)
        if new:
            self.learn(new)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        words = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        start = np.frombuffer(self.start, np.int64)
        n = (start[1:] - start[:-1])[words]
        ends = np.cumsum(n)
        flat = np.frombuffer(self.flat, np.int32)[np.repeat(start[:-1][words] - (ends - n), n) + np.arange(int(n.sum()))] if len(words) else np.zeros(0, np.int32)
        offsets = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.start = array("i"), array("q", [0])

    def cut(self, text: str) -> list[str]:
        """The words of a text."""
        return (_PLAIN.findall if text.isascii() else self.find)(text)


@lru_cache(maxsize=1)
def encoder(folder: str, name: str) -> Encoder:
    """One for each worker process, kept between the partitions that it takes."""
    return Encoder(folder, name)


def _encoded(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of short-lived strings, none of them in a cycle
        try:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), encoder(folder, name).encode(batch.column(1).to_pylist())], names=["doc_id", "ids"])
        finally:
            gc.enable()

    return run


def encode_corpus(docs: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each text, one row a row of docs, without special tokens.

    An empty and a null text give an empty list. Strings of special tokens are ordinary text. Lone surrogates can't
    occur in a Spark string. Repeated rows come out repeatedly; other columns are ignored; no shuffle takes place.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encoded(folder, name), "doc_id long, ids array<int>")


def decode(ids: list[int], folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> str:
    """The text of ids; the inverse of encoding."""
    tokens = {i: t for t, i in vocabulary(folder, name)[0].items()}
    return b"".join(tokens[i] for i in ids).decode("utf-8")
