"""Removal of repeated passages by longest-previous-factor arrays over the suffixes that can match.

A byte goes if a string of LENGTH bytes that covers it also starts in a
document with a smaller id. All positions' suffixes of a large corpus can't be
sorted together, so those that can't match are told apart first, exactly:

0. A text that a smaller document also has as a whole (by SHA-256) goes as a whole: the
   factor of each of its suffixes is the suffix. Its windows all start in that document too,
   so it isn't looked at further.
1. A window of LENGTH bytes is marked by the least hash of its GRAM-byte
   grams. Equal windows have equal marks. Successive windows of one mark, at most REGION,
   are a region, and regions' places are dealt out by mark, without their bytes.
2. The bytes of regions whose mark two or more documents have are called for,
   and dealt out by mark. Of equal strings in a batch only the first document's go on.
3. The suffixes of a mark's strings are sorted and neighbours' longest common
   prefixes measured. The previous and next smaller document in suffix order
   give each suffix its longest previous factor; factors of LENGTH bytes
   and more are removed. Equal strings are neighbours in suffix order, so they are sorted
   once, and the factors of all but the first document's are the whole strings.

Marks that very many regions have are known before anything is gathered by
mark: a task that meets more than FLUSH_HOT regions of one hands on one of them in place of
all. Such regions are called for window by window and dealt out by window.

Texts are UTF-8 bytes, null is empty. Rows without a doc_id are neither
compared nor changed. Rows with the same id aren't compared with each other,
and each is judged by its own text. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import batched, id_text, pairs

#: Longer grams make more regions, of which fewer share a mark by chance: without copies, over 0.51 GB of documents 43, 48, 55 and 76 million
#: regions by 16, 20, 24 and 32 bytes, of which 25, 20, 19 and 18 % share theirs (20, 18, 17 and 16 % over 0.10 GB).
LENGTH, GRAM = 50, 20
#: Bytes of text hashed together, and regions that a task holds before it sends them off.
BUFFER, HELD = 1 << 19, 1 << 20
#: Windows of a region at most.
REGION = 256
#: Regions of one mark, in all and in a task's hands, beyond which its windows are dealt out.
HOT, FLUSH_HOT = 1024, 64
#: Added to a region's count: it stands for very many of its mark.
MANY = 1 << 16
CALLED, CALLED_HOT = 1, 2
#: Bytes of suffixes compared at once.
CHUNK = 64

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.array([xxhash.xxh64_intdigest(bytes([b]), 9) for b in range(256)], np.uint64)
_RANGE = np.dtype([("start", "<u4"), ("count", "<u2"), ("bucket", "<u4"), ("kind", "u1")])
_LATE = np.dtype([("start", "<u4"), ("size", "<u4"), ("check", "<u4")])
_HEAD = np.dtype([("doc", "<i8"), ("start", "<u4"), ("n", "<u4")])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_SPAN = BUFFER + (1 << 16)
_POWER = _powers(_BASE, _SPAN)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _joined(x: np.ndarray, size: int, join) -> np.ndarray:
    """For each position join() over `size` values from there, by doubling; join(left, right, width of left)."""
    n, out, width, power, span = len(x), None, 0, x, 1
    while span <= size:
        if size & span:
            m = n - width - span + 1
            out = power[:m] if out is None else join(out[:m], power[width : width + m], width)
            width += span
        if 2 * span <= size:
            m = n - 2 * span + 1
            power = join(power[:m], power[span : span + m], span)
        span *= 2
    return out


def marks(text: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The mark of the window at each position that has one."""
    grams = _mix(_joined(_TABLE[text], gram, lambda a, b, w: a + b * _POWER[w]))
    return _joined(grams, length - gram + 1, lambda a, b, w: np.minimum(a, b))


def regions(pieces: list[tuple[int, int, bytes]], length: int = LENGTH, gram: int = GRAM, most: int = REGION) -> dict[str, np.ndarray]:
    """mark, doc, start, count of the regions of pieces (doc_id, offset, bytes), of BUFFER bytes in all at most (or one piece)."""
    text = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    if len(text) < length:
        return {}
    sizes = np.array([len(p) for _, _, p in pieces])
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(pieces)), sizes)[: len(text) - length + 1]
    mark = marks(text, length, gram)
    inside = np.arange(len(mark)) + length <= ends[of]
    same = np.r_[False, (mark[1:] == mark[:-1]) & (of[1:] == of[:-1]) & inside[:-1]]
    first = np.flatnonzero(inside & ~same)
    if not len(first):
        return {}
    count = np.add.reduceat(inside.astype(np.int64), first)
    if (count > most).any():  # cut into parts
        parts = -(-count // most)
        step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * most
        first, count = np.repeat(first, parts) + step, np.minimum(np.repeat(count, parts) - step, most)
    piece = of[first]
    start = first - (ends - sizes)[piece] + np.array([o for _, o, _ in pieces])[piece]
    return {"mark": mark[first], "doc": np.array([d for d, _, _ in pieces], np.int64)[piece], "start": start, "count": count}


def _pieces(rows: Iterator[tuple[int | None, bytes | None]], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts in lists for regions(); a long text in parts that overlap by all but one byte of a window."""
    held, size = [], 0
    for doc_id, text in rows:
        if doc_id is None or text is None or len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, BUFFER):
            part = text[at : at + BUFFER + length - 1]
            if size + len(part) > BUFFER and held:
                yield held
                held, size = [], 0
            held.append((doc_id, at, part))
            size += len(part)
    if held:
        yield held


_PACK = (("mark", "<u4"), ("doc", "<i8"), ("start", "<u4"), ("count", "<u4"))


def _pack(found: dict[str, np.ndarray]) -> bytes:
    """Columns one after another, the ids as steps, which compress well; of a mark the lower half, as the upper one deals it out."""
    rest = b"".join([np.diff(found["doc"], prepend=0).astype("<i8").tobytes(), found["start"].astype("<u4").tobytes(), found["count"].astype("<u4").tobytes()])
    # Byte planes: equal high bytes stand together.
    planes = b"".join(np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(-1, w).T).tobytes() for part, w in ((rest[: 8 * len(found["doc"])], 8), (rest[8 * len(found["doc"]) :], 4)))
    return len(found["doc"]).to_bytes(4, "little") + (found["mark"] & found["mark"].dtype.type(0xFFFFFFFF)).astype("<u4").tobytes() + zlib.compress(planes, 1)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    mark = np.frombuffer(blob, "<u4", n, 4)
    planes = np.frombuffer(zlib.decompress(blob[4 + 4 * n :]), np.uint8)
    doc = np.cumsum(np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view("<i8").ravel())
    rest = np.ascontiguousarray(planes[8 * n :].reshape(4, 2 * n).T).view("<u4").ravel()
    return {"mark": mark, "doc": doc, "start": rest[:n], "count": rest[n:]}


def _concat(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys starts."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _planes(records: np.ndarray) -> bytes:
    """Records byte by byte of their width: equal high bytes stand together."""
    return np.ascontiguousarray(records.view(np.uint8).reshape(-1, records.itemsize).T).tobytes()


def _records(planes: bytes, dtype: np.dtype) -> np.ndarray:
    n = len(planes) // dtype.itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).ravel()


def _bundles(doc: np.ndarray, records: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket of documents, its documents and their records)."""
    if not len(doc):
        return
    bucket = doc % n_buckets
    order = np.lexsort((doc, bucket))
    doc, records, bucket = doc[order], records[order], bucket[order]
    at = np.flatnonzero(_runs(bucket))
    for a, b in zip(at, np.r_[at[1:], len(doc)], strict=True):
        yield int(bucket[a]), zstandard.compress(_planes(np.diff(doc[a:b], prepend=0)) + _planes(records[a:b]), 1)


def _slim(records: np.ndarray) -> bytes:
    """Records of a document by rising start, in few bytes."""
    steps = records.copy()
    steps["start"][1:] = np.diff(records["start"])
    return zstandard.compress(_planes(steps), 1)


def _wide(blob: bytes, dtype: np.dtype) -> np.ndarray:
    records = _records(zstandard.decompress(blob), dtype).copy()
    records["start"] = np.cumsum(records["start"])
    return records


def _gather(dtype: np.dtype, form=_planes):
    """Each document's records in one row, from bundles."""

    def rows(batches):
        entries = ((b, x) for batch in batches for b, x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, same in groupby(entries, lambda e: e[0]):
            docs, records = [], []
            for _, blob in same:
                raw = zstandard.decompress(blob)
                n = len(raw) // (8 + dtype.itemsize)
                docs.append(np.cumsum(_records(raw[: 8 * n], np.dtype("<i8"))))
                records.append(_records(raw[8 * n :], dtype))
            doc, record = np.concatenate(docs), np.concatenate(records)
            order = np.lexsort((record["start"], doc))
            doc, record = doc[order], record[order]
            at = np.flatnonzero(_runs(doc))
            for a, b in zip(at, np.r_[at[1:], len(doc)], strict=True):
                yield int(doc[a]), form(record[a:b])

    return lambda batches: batched(rows(batches), _BY_DOC, lambda row: len(row[1]))


def _ranges(found: dict[str, np.ndarray], kind: np.ndarray, bucket: int) -> np.ndarray:
    out = np.zeros(len(kind), _RANGE)
    out["start"], out["count"], out["bucket"], out["kind"] = found["start"], found["count"], bucket, kind
    return out


def _take(found: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[which] for k, v in found.items()}


def _by_mark(found: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Regions sorted by mark; the number of each one's mark; and by mark how many regions it has (MANY and more if that is known) and whether two documents have it."""
    found = _take(found, np.argsort(found["mark"], kind="stable"))
    at = np.flatnonzero(_runs(found["mark"]))
    of = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(found["mark"])]))
    shared = np.minimum.reduceat(found["doc"], at) < np.maximum.reduceat(found["doc"], at)
    return found, of, np.bincount(of, np.where(found["count"] >= MANY, MANY, 1)), shared


_DEALT = pa.schema([("bucket", pa.int64()), ("docs", pa.int64()), ("blob", pa.binary())])
_BUNDLED = pa.schema([("docs", pa.int64()), ("blob", pa.binary())])
_BY_DOC = pa.schema([("doc_id", pa.int64()), ("blob", pa.binary())])
_COPIES = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("known", pa.bool_())])


def _scan(n_buckets: int, n_docs: int, length: int, flush_hot: int):
    """Regions in packs by mark, and (with a bucket of documents) ranges of marks that very many regions have."""

    def send(held):
        found, of, n, shared = _by_mark(_concat(held))
        many = ((n > flush_hot) & shared)[of]
        if many.any():
            hot = _take(found, many)
            for docs, blob in _bundles(hot["doc"], _ranges(hot, np.full(many.sum(), CALLED_HOT), 0), n_docs):
                yield docs, docs, blob
            stand = many & np.r_[True, of[1:] != of[:-1]]
            found["count"] = np.where(stand, found["count"] + MANY, found["count"])
            found = _take(found, ~many | stand)
        bucket = (found["mark"] >> np.uint64(32)) % np.uint64(n_buckets)
        order = np.lexsort((found["start"], found["doc"], bucket))
        rest, bucket = _take(found, order), bucket[order]
        at = np.flatnonzero(_runs(bucket)) if len(bucket) else []
        for a, b in zip(at, [*at[1:], len(bucket)], strict=True):
            yield int(bucket[a]), None, _pack(_take(rest, slice(a, b)))

    def rows(batches):
        held, n = [], 0
        for pieces in _pieces(((d, t.as_py()) for batch in batches for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)), length):
            if found := regions(pieces, length):
                held.append(found)
                n += len(found["mark"])
            if n > HELD:
                yield from send(held)
                held, n = [], 0
        if held:
            yield from send(held)

    return lambda batches: batched(rows(batches), _DEALT, lambda row: len(row[2]))


def judge(found: dict[str, np.ndarray], hot: int = HOT) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The regions whose mark two or more documents have, with their kind."""
    found, of, n, shared = _by_mark(found)
    shared |= n >= MANY
    found["count"] = np.where(found["count"] >= MANY, found["count"] - MANY, found["count"])
    which = shared[of]
    return _take(found, which), np.where(n > hot, CALLED_HOT, CALLED)[of][which]


def _settle(hot: int, n_docs: int):
    def rows(batches):
        entries = ((b, d, x) for batch in batches for b, d, x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held, n = [], 0
        for bucket, same in groupby(entries, lambda e: e[0]):
            packs = []
            for _, docs, blob in same:
                if docs is None:
                    packs.append(_unpack(blob))
                else:
                    yield docs, blob
            if packs:
                found, kind = judge(_concat(packs), hot)
                held.append((found["doc"], _ranges(found, kind, bucket)))
                n += len(kind)
            if n > HELD:
                yield from _bundles(*(np.concatenate(x) for x in zip(*held, strict=True)), n_docs)
                held, n = [], 0
        if held:
            yield from _bundles(*(np.concatenate(x) for x in zip(*held, strict=True)), n_docs)

    return lambda batches: batched(rows(batches), _BUNDLED, lambda row: len(row[1]))


def first_of_equals(entries: Iterable[tuple[int, int, bytes]]) -> tuple[dict[bytes, list[tuple[int, int]]], list[tuple[int, int, bytes]]]:
    """Of entries (doc_id, start, string): for each string the least document and its starts; and the entries of later documents."""
    first: dict[bytes, list[tuple[int, int]]] = {}
    later = []
    for doc, start, string in entries:
        have = first.get(string)
        if have is None or have[0][0] > doc:
            if have is not None:
                later += ((d, s, string) for d, s in have)
            first[string] = [(doc, start)]
        elif have[0][0] == doc:
            have.append((doc, start))
        else:
            later.append((doc, start, string))
    return first, later


def _told(found: list[tuple[int, int, int, int]], n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """Bundles of what is to be removed: doc_id, start, size and check of strings that a smaller document has."""
    yield from _bundles(np.array([x[0] for x in found], np.int64), np.array([x[1:] for x in found], _LATE), n_buckets)


def _digest(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _twins(length: int):
    """doc_id and digest of texts; those that a smaller document of the task has are known to be copies, and of others the task has one for each digest."""

    def rows(batches):
        first: dict[bytes, int] = {}
        for doc_id, text in pairs(batches):
            if text is None or len(text) < length:
                continue
            digest = _digest(text)
            have = first.setdefault(digest, doc_id)
            if have != doc_id:
                first[digest] = min(have, doc_id)
                yield max(have, doc_id), digest, True
            if len(first) > HELD:
                yield from ((d, x, False) for x, d in first.items())
                first = {}
        yield from ((d, x, False) for x, d in first.items())

    return lambda batches: batched(rows(batches), _COPIES, lambda row: 40)


def copies(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """twin_of and twins: a doc_id and the digests of its texts that documents with smaller ids have as a whole."""
    found = docs.mapInArrow(_twins(length), "doc_id long, digest binary, known boolean")
    least = F.min("doc_id").over(Window.partitionBy("digest", F.when(F.col("known"), F.col("doc_id"))))
    late = found.select("doc_id", "digest", "known", least.alias("least")).where("known OR doc_id > least")
    return late.groupBy(F.col("doc_id").alias("twin_of")).agg(F.collect_set("digest").alias("twins"))


def _is_copy(text: bytes, twins: pa.Scalar) -> bool:
    return twins.is_valid and _digest(text) in twins.as_py()


def _originals(batches):
    """The texts that no smaller document has as a whole."""
    for batch in batches:
        rows = ((d, zstandard.decompress(t.as_py()), twins) for d, t, twins in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True))
        yield from batched(((d, t) for d, t, twins in rows if not _is_copy(t, twins)), _BY_DOC, lambda row: len(row[1]))


def _squeeze(batches):
    """Texts, each compressed by itself, for the way by id."""
    pack = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False).compress
    for batch in batches:
        rows = ((d, pack(t.as_py() or b"")) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        yield from batched(rows, _BY_DOC, lambda row: len(row[1]))


def _call(n_buckets: int, n_docs: int, length: int):
    """The called regions' bytes by mark, or window by window for marks with very many; of equal strings in a batch the first document's."""

    def rows(batches):
        for batch in batches:
            called: dict[int, list[tuple[int, int, bytes]]] = {}
            for doc_id, text, blobs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if not blobs.is_valid:
                    continue
                text = zstandard.decompress(text.as_py())
                for start, count, bucket, kind in _wide(blobs.as_py(), _RANGE).tolist():
                    if start + count - 1 + length > len(text):  # another text of the same id
                        continue
                    if kind == CALLED:
                        called.setdefault(bucket, []).append((doc_id, start, text[start : start + count - 1 + length]))
                    else:
                        for s in range(start, start + count):
                            window = text[s : s + length]
                            called.setdefault(xxhash.xxh64_intdigest(window) % n_buckets, []).append((doc_id, s, window))
            told = []
            for bucket, entries in called.items():
                first, later = first_of_equals(entries)
                told += ((d, s, len(x), zlib.crc32(x)) for d, s, x in later)
                head = np.array([(d, s, len(x)) for x, at in first.items() for d, s in at], _HEAD)
                strings = b"".join(x for x, at in first.items() for _ in at)
                yield bucket, None, zstandard.compress(len(head).to_bytes(4, "little") + _planes(head) + strings, 3)
            for docs, blob in _told(told, n_docs):
                yield docs, docs, blob

    return lambda batches: batched(rows(batches), _DEALT, lambda row: len(row[2]))


def _chunks(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CHUNK bytes from each start on, zero from end on; text has CHUNK bytes to spare."""
    rows = np.lib.stride_tricks.sliding_window_view(text, CHUNK)[np.minimum(start, end)]
    short = np.flatnonzero(end - start < CHUNK)
    rows[short] *= np.arange(CHUNK) < (end - start)[short, None]
    return rows


def suffix_order(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes text[start:end], each to its own end, and what each shares with the one before it in that order."""
    text = np.r_[text, np.zeros(CHUNK, np.uint8)]
    width = f"S{CHUNK}"
    n = len(start)
    order = np.argsort(_chunks(text, start, end).view(width).ravel(), kind="stable")
    lcp = np.zeros(n, np.int64)
    group, which, depth = np.zeros(n, np.int64), np.arange(n), 0
    while len(which):
        # `which` are places in the order that stand in runs of equal prefixes so far; find what they share from here on.
        at = order[which]
        rows = _chunks(text, start[at] + depth, end[at])
        differ = rows[1:] != rows[:-1]
        apart = differ.any(1)
        here = np.minimum(np.where(apart, differ.argmax(1), CHUNK), np.maximum(np.minimum(end[at[1:]] - start[at[1:]], end[at[:-1]] - start[at[:-1]]) - depth, 0))
        together = np.r_[False, group[1:] == group[:-1]]
        lcp[which[1:]] += np.where(together[1:], here, 0)
        # Equal over the whole chunk, so far: sorted by what follows.
        equal = np.r_[False, together[1:] & ~apart & (here == CHUNK)]
        run = np.cumsum(~equal)
        more = equal.copy()
        more[:-1] |= equal[1:]
        which, group, depth = which[more], run[more], depth + CHUNK
        if len(which):
            keys = _chunks(text, start[order[which]] + depth, end[order[which]]).view(width).ravel()
            order[which] = order[which][np.lexsort((keys, group))]
    return order, lcp


def previous_factors(doc: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For suffixes in suffix order, the longest prefix that each shares with one of a smaller document.

    lcp[r] is what suffixes r - 1 and r share. The nearest smaller document
    before and after in suffix order bound what can be shared; a pass with a
    stack each way finds them, with the least lcp on the way.
    """
    if not len(doc):
        return np.zeros(0, np.int64)
    docs, shared = doc.tolist(), lcp.tolist()
    before = _previous_smaller(docs, shared)
    after = _previous_smaller(docs[::-1], [0, *shared[:0:-1]])[::-1]
    return np.maximum(np.array(before, np.int64), np.array(after, np.int64))


def _previous_smaller(docs: list[int], shared: list[int]) -> list[int]:
    """What each shares with the nearest one before it of a smaller document (0 if there is none)."""
    best, stack = [], []  # (document, what it shares with the one below it)
    for doc, here in zip(docs, shared, strict=True):
        while stack and stack[-1][0] >= doc:
            here = min(here, stack.pop()[1])
        best.append(here if stack else 0)
        stack.append((doc, here))
    return best


def factors(doc: np.ndarray, lcp: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """previous_factors() where they are `length` at least, else 0: runs that share less needn't be looked at together."""
    full = lcp >= length
    run = np.cumsum(~full) - 1
    size = np.bincount(run)[run] if len(run) else run
    out = np.zeros(len(doc), np.int64)
    second = np.flatnonzero(full & (size == 2))  # two suffixes: the larger document's has the factor
    out[np.where(doc[second] > doc[second - 1], second, second - 1)] = np.where(doc[second] != doc[second - 1], lcp[second], 0)
    many = np.flatnonzero(size > 2)
    found = previous_factors(doc[many], np.where(full, lcp, 0)[many])
    out[many] = found
    return np.where(out >= length, out, 0)


def _could_match(text: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at `start` have the hash of another one; equal windows have equal hashes."""
    hashes = _mix(_joined(_TABLE[text], length, lambda a, b, w: a + b * _POWER[w]))[start]
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    out = np.zeros(len(start), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def later_copies(entries: Iterable[tuple[int, int, bytes]], length: int = LENGTH) -> list[tuple[int, int, bytes]]:
    """The runs (doc_id, start, bytes) of entries, of `length` bytes at least each, that factors shared with smaller documents cover."""
    first, later = first_of_equals(entries)
    if not first:
        return later
    strings = list(first)
    # A byte between strings keeps their runs apart.
    text = np.frombuffer(b"\0".join(strings), np.uint8)
    sizes = np.array([len(x) for x in strings])
    begin = np.cumsum(sizes + 1) - sizes - 1
    n = sizes - length + 1
    of = np.repeat(np.arange(len(strings)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[of]
    which = np.flatnonzero(_could_match(text, start, length))
    of, start = of[which], start[which]
    order, lcp = suffix_order(text, start, (begin + sizes)[of])
    doc = np.array([first[x][0][0] for x in strings], np.int64)[of]
    found = factors(doc[order], lcp, length)
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, start[order], found > 0)
    np.add.at(step, start[order] + found, -(found > 0).astype(np.int64))
    gone = np.cumsum(step[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    runs = np.searchsorted(begin, edges[::2], "right") - 1
    for k, a, b in zip(runs.tolist(), (edges[::2] - begin[runs]).tolist(), (edges[1::2] - begin[runs]).tolist(), strict=True):
        later += ((d, s + a, strings[k][a:b]) for d, s in first[strings[k]])
    return later


def _copies(length: int, n_docs: int):
    def unpack(packed):
        blob = zstandard.decompress(packed)
        n = int.from_bytes(blob[:4], "little")
        at = 4 + _HEAD.itemsize * n
        for d, s, size in _records(blob[4:at], _HEAD).tolist():
            yield d, s, blob[at : at + size]
            at += size

    def rows(batches):
        rows_ = ((b, d, x) for batch in batches for b, d, x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held = []
        for _, same in groupby(rows_, lambda e: e[0]):
            packs = []
            for _, docs, blob in same:
                if docs is None:
                    packs.append(blob)
                else:
                    yield docs, blob
            held += ((d, s, len(x), zlib.crc32(x)) for d, s, x in later_copies((e for blob in packs for e in unpack(blob)), length))
            if len(held) > HELD // 4:
                yield from _told(held, n_docs)
                held = []
        yield from _told(held, n_docs)

    return lambda batches: batched(rows(batches), _BUNDLED, lambda row: len(row[1]))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])


def _cut_out(length: int):
    def rows(batches):
        for batch in batches:
            for doc_id, text, twins, late in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                text = zstandard.decompress(text.as_py())
                if _is_copy(text, twins):
                    yield doc_id, len(text), len(text), 1, [0, len(text)], b""
                    continue
                if not late.is_valid:
                    yield doc_id, len(text), 0, 0, [], text
                    continue
                step = np.zeros(len(text) + 1, np.int64)
                for s, size, check in _wide(late.as_py(), _LATE).tolist():
                    if s + size <= len(text) and zlib.crc32(text[s : s + size]) == check:  # not another text of the same id
                        step[s] += 1
                        step[s + size] -= 1
                gone = np.cumsum(step[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                yield doc_id, len(text), int(gone.sum()), len(edges) // 2, edges.tolist(), np.frombuffer(text, np.uint8)[~gone].tobytes()

    return lambda batches: batched(rows(batches), _OUT, lambda row: len(row[5]) + 8 * len(row[4]))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, flush_hot: int = FLUSH_HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (starts and ends of the removed runs) and kept (the other bytes) of every row."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = 4 * parts
    rows = id_text(df, id_col, text_col)
    docs = rows.where("doc_id IS NOT NULL")
    by_doc, dealt, bundled = "doc_id long, blob binary", "bucket long, docs long, blob binary", "docs long, blob binary"

    def gathered(bundles: DataFrame, dtype: np.dtype, name: str) -> DataFrame:
        rows = bundles.repartition(parts, "docs").sortWithinPartitions("docs").mapInArrow(_gather(dtype, _slim), by_doc)
        return rows.select(F.col("doc_id").alias(f"{name}_of"), F.col("blob").alias(name))

    def scan(batches):
        return _scan(n_buckets, parts, length, flush_hot)(_originals(batches))

    # The texts are dealt out by id once, for the scan, the call and the cut.
    placed = docs.mapInArrow(_squeeze, by_doc).repartition(parts, "doc_id")
    twins = copies(docs, length)
    marked = placed.join(twins, placed["doc_id"] == twins["twin_of"], "left").select("doc_id", placed["blob"], "twins")
    scanned = marked.mapInArrow(scan, dealt).repartition(parts, "bucket").sortWithinPartitions("bucket")
    ranges = gathered(scanned.mapInArrow(_settle(hot, parts), bundled), _RANGE, "ranges")
    with_ranges = placed.join(ranges, placed["doc_id"] == ranges["ranges_of"], "left").select("doc_id", placed["blob"], "ranges")
    called = with_ranges.mapInArrow(_call(n_buckets, parts, length), dealt).repartition(parts, "bucket").sortWithinPartitions("bucket")
    late = gathered(called.mapInArrow(_copies(length, parts), bundled), _LATE, "late")
    judged = marked.join(late, marked["doc_id"] == late["late_of"], "left").select("doc_id", "blob", "twins", "late")
    unnamed = rows.where("doc_id IS NULL").mapInArrow(_squeeze, by_doc).select("doc_id", "blob", F.lit(None).cast("array<binary>").alias("twins"), F.lit(None).cast("binary").alias("late"))
    return judged.union(unnamed).mapInArrow(_cut_out(length), "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")
