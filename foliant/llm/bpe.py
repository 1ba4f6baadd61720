"""Byte-level BPE encoding and decoding from a local rank file.

A null text counts as empty: no ids, empty bytes. Any text gives the ids that
the whole text would give: cuts are made only where every match of the
pattern ends anyway.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from foliant.llm.common import batched, id_text, pairs

#: White space as the pattern's \s has it.
_WS = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space before a space: such a text can't be cut at each of its spaces.
_WS_SPACE = re.compile(f"[{_WS}] ")
_LONG_WS = re.compile(f"[{_WS}]{{256,}}")
_SAFE = re.compile(f"(?<=[^{_WS}])(?=[{_WS}])")
#: Characters handed to the regular expression engine at once where a safe cut exists.
CHUNK = 1 << 16
#: Words whose ids a worker remembers.
CACHE_WORDS = 200_000

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("ids_text", pa.string()), ("decoded", pa.binary()), ("decoded_ok", pa.bool_())])
_DDL = {"doc_id": "doc_id long", "n_tokens": "n_tokens long", "token_ids": "token_ids array<int>", "ids_text": "ids_text string", "decoded": "decoded binary", "decoded_ok": "decoded_ok boolean"}


class Codec:
    """Encodes and decodes with one rank file and pattern; remembers the ids of common words."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.words: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        if _WS_SPACE.search(text):
            return [i for chunk in safe_chunks(text) for i in self._chunk(chunk)]
        # Each space follows a non-space, so each starts a new match.
        first, *rest = text.split(" ")
        get, encode = self.words.get, self.encoding.encode_ordinary
        found = [get(w) for w in rest]
        if None in found:
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
            for k, ids in enumerate(found):
                if ids is None:
                    w = rest[k]
                    ids = found[k] = self.words.get(w) or tuple(self._plain(" " + w))
                    if len(w) < 40:
                        self.words[w] = ids
        return [*self._plain(first), *chain.from_iterable(found)] if first else list(chain.from_iterable(found))

    def _plain(self, text: str) -> list[int]:
        if len(text) < CHUNK:
            return self.encoding.encode_ordinary(text)
        return [i for chunk in safe_chunks(text) for i in self._chunk(chunk)]

    def _chunk(self, chunk: tuple[str, bool]) -> list[int]:
        text, whole = chunk
        return self.encoding._encode_single_piece(text) if whole else self.encoding.encode_ordinary(text)

    def decode(self, ids: Iterable[int]) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])


def safe_chunks(text: str) -> Iterator[tuple[str, bool]]:
    """(chunk, whole): parts of text between safe cuts; a whole one is a single match of the pattern.

    A match never goes from a non-space to a space, so a cut between them is
    safe. Of a long run of white space all but the last character is one match
    (all, at the end of the text), which is taken out here as the regular
    expression engine would need a stack frame for each character.
    """
    at = 0
    for run in _LONG_WS.finditer(text):
        yield from _cut(text, at, run.start())
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : end], True
        at = end
    yield from _cut(text, at, len(text))


def _cut(text: str, start: int, end: int) -> Iterator[tuple[str, bool]]:
    while end - start > CHUNK:
        found = _SAFE.search(text, start + CHUNK, end)
        if not found:
            break
        yield text[start : found.start()], False
        start = found.start()
    if start < end:
        yield text[start:end], False


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> Codec:
    """A worker's codec, made once."""
    return Codec(rank_file, pattern)


def encode_documents(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("token_ids",)) -> DataFrame:
    """doc_id, n_tokens and the columns named in `outputs` for every row.

    token_ids: the ids; ids_text: the ids in decimal, joined by commas;
    decoded: the bytes that the ids stand for; decoded_ok: whether they are the
    text's. `rank_file` is a path on every
    worker. Null text: as an empty one. Null ids and repeated rows are kept.
    """
    names = ["doc_id", "n_tokens", *outputs]
    schema = pa.schema([SCHEMA.field(n) for n in names])

    def run(batches):
        c = codec(rank_file, pattern)

        def rows():
            for doc_id, raw in pairs(batches):
                ids = c.encode((raw or b"").decode("utf-8", "replace"))
                row = [doc_id, len(ids)]
                for name in outputs:
                    if name == "token_ids":
                        row.append(ids)
                    elif name == "ids_text":
                        decimal = c.decimal
                        row.append(",".join([decimal[i] for i in ids]))
                    elif name == "decoded":
                        row.append(c.decode(ids))
                    else:
                        row.append(c.decode(ids) == (raw or b""))
                yield tuple(row)

        yield from batched(rows(), schema, lambda row: 10 * row[1])

    return id_text(df, id_col, text_col).mapInArrow(run, ", ".join(_DDL[n] for n in names))


def decode_documents(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id and decoded (raw bytes, which need not be whole UTF-8) for every row; null ids decode to nothing."""
    schema = pa.schema([SCHEMA.field("doc_id"), SCHEMA.field("decoded")])

    def run(batches):
        c = codec(rank_file, pattern)
        rows = ((doc_id, c.decode(ids or ())) for batch in batches for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield from batched(rows, schema, lambda row: len(row[1]))

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].alias("token_ids")).mapInArrow(run, "doc_id long, decoded binary")
