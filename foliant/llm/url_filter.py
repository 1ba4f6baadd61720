"""URL filters by a cascade of Bloom filters.

Level 1 encodes the listed keys, level 2 those keys of the corpus that level 1
takes for listed, level 3 the listed keys that level 2 takes for such, and so
on until no false positive is left among all keys that the corpus has. Looked
up by a key of that universe, the cascade's answer is exact, without a join.
Only the levels' bits are sent to the driver and broadcast; their size is
checked, and beyond it lookups fall back on a join.

A null url, or one without ://, has an empty host and path, no rule, and
isn't listed. Repeated and null ids are passed on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import batched, cut

#: Bits a key and hashes of the first level, which has few false positives, and of all others, which halve them.
FIRST, LATER = (8.0, 4), (1.45, 1)
#: Bits of a level up to which it is collected and broadcast (32 MB).
MAX_BITS = 1 << 28
MAX_LEVELS = 64


@dataclass
class Cascade:
    """Levels of (bits, hashes); a level's seed is its position."""

    levels: list[tuple[np.ndarray, int]] = field(default_factory=list)

    def __contains__(self, key: str) -> bool:
        raw = key.encode()
        for k, (bits, hashes) in enumerate(self.levels):
            if not all(bits[p >> 6] >> np.uint64(p & 63) & np.uint64(1) for p in positions(raw, k, hashes, 64 * len(bits))):
                return k % 2 == 1
        return len(self.levels) % 2 == 1

    def bytes(self) -> int:
        return sum(bits.nbytes for bits, _ in self.levels)


def positions(key: bytes, level: int, hashes: int, n_bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 2 * level), xxhash.xxh64_intdigest(key, 2 * level + 1) | 1
    return [(a + k * b) % n_bits for k in range(hashes)]


def _bits_of(keys: DataFrame, level: int, hashes: int, n_bits: int) -> np.ndarray:
    """The bits that the keys set: each task gives the words it has set, which are or-ed together."""
    schema = pa.schema([("word", pa.int64()), ("bits", pa.int64())])

    def run(batches):
        own: dict[int, int] = {}
        for batch in batches:
            for key in batch.column(0).to_pylist():
                for p in positions(key.encode(), level, hashes, n_bits):
                    own[p >> 6] = own.get(p >> 6, 0) | 1 << (p & 63)
            if len(own) > 1 << 16:
                yield _words(own, schema)
                own = {}
        if own:
            yield _words(own, schema)

    words = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(n_bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _words(own: dict[int, int], schema: pa.Schema) -> pa.RecordBatch:
    bits = np.fromiter(own.values(), np.uint64, len(own)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.fromiter(own, np.int64, len(own))), pa.array(bits)], schema=schema)


def _passing(keys: DataFrame, level: int, bits: np.ndarray, hashes: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([("key", pa.string())])

    def run(batches):
        own = shared.value
        for batch in batches:
            hit = [key for key in batch.column(0).to_pylist() if all(int(own[p >> 6]) >> (p & 63) & 1 for p in positions(key.encode(), level, hashes, 64 * len(own)))]
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array(hit, pa.string())], schema=schema)

    return keys.mapInArrow(run, "key string")


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade | None:
    """The cascade of the keys in `listed` over those in `universe` (column key); None if a level would take over `max_bits`.

    Null keys and repeats count for nothing. Listed keys outside the universe are encoded too.
    """
    spark = listed.sparkSession
    inside = cut(spark, listed.select("key").where("key IS NOT NULL").distinct())
    outside = cut(spark, universe.select("key").where("key IS NOT NULL").distinct().join(inside, "key", "left_anti"))
    cascade = Cascade()
    n = inside.count()
    for level in range(MAX_LEVELS):
        if not n:
            return cascade
        per_key, hashes = FIRST if level == 0 else LATER
        n_bits = 64 * (int(per_key * n) // 64 + 1)
        if n_bits > max_bits:
            return None
        bits = _bits_of(inside, level, hashes, n_bits)
        cascade.levels.append((bits, hashes))
        wrong = cut(spark, _passing(outside, level, bits, hashes))
        inside, outside, n = wrong, inside, wrong.count()
    raise RuntimeError("the cascade does not end")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ://, or nothing."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")


def _lengths(rules: dict[str, str]) -> list[int]:
    """The rules' path lengths, longest first."""
    return sorted({len(r) - r.index("/") for r in rules}, reverse=True)


def rule_keys(host: str, path: str, lengths: list[int]) -> list[str]:
    """Each domain that holds the host with each beginning of the path that a rule could have, longest first."""
    labels = host.split(".")
    keys = {".".join(labels[i:]) + path[:n] for i in range(len(labels)) for n in lengths if n <= len(path)}
    return sorted(keys, key=lambda k: (-len(k), k))


def judge(pages: DataFrame, rules: dict[str, str], listed_hosts: DataFrame, id_col: str = "page_id", url_col: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule, listed, verdict of every row.

    rules: from host/path-prefix to allow or block; the longest that fits a url
    decides. Of the others, those whose host is in `listed_hosts` (column key) are
    blocked. Two cascades, of rules and of hosts, are built over all the keys that the pages have.
    """
    spark = pages.sparkSession
    split = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    lengths = _lengths(rules)
    deepest = max(lengths, default=0)
    places = split.select("host", F.substring("path", 1, deepest).alias("path")).distinct()
    key_schema = pa.schema([("key", pa.string())])

    def expand(batches):
        for batch in batches:
            keys = {k for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k in rule_keys(host, path, lengths)}
            yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.string())], schema=key_schema)

    rule_cascade = build_cascade(spark.createDataFrame([(r,) for r in rules], "key string"), places.mapInArrow(expand, "key string"))
    hosts = split.select(F.col("host").alias("key")).where("key <> ''").distinct()
    host_cascade = build_cascade(listed_hosts, hosts, max_bits)
    if host_cascade is None:
        names = listed_hosts.select(F.col("key").alias("name")).where("name IS NOT NULL").distinct()
        split = split.join(names, split["host"] == names["name"], "left").select("page_id", "host", "path", F.col("name").isNotNull().alias("listed"))
    else:
        split = split.withColumn("listed", F.lit(False))
    shared = spark.sparkContext.broadcast((rule_cascade, host_cascade))
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("listed", pa.bool_()), ("verdict", pa.string())])

    def run(batches):
        by_rule, by_host = shared.value
        seen: dict[str, bool] = {}

        def rows():
            for batch in batches:
                if len(seen) > 1 << 17:
                    seen.clear()
                for page_id, host, path, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    rule = next((k for k in rule_keys(host, path, lengths) if k in by_rule), None)
                    if by_host is not None:
                        if host not in seen:
                            seen[host] = bool(host) and host in by_host
                        listed = seen[host]
                    yield page_id, host, path, rule, listed, rules[rule] if rule else "block" if listed else "allow"

        yield from batched(rows(), schema, lambda row: len(row[1]) + len(row[2]))

    return split.mapInArrow(run, "page_id long, host string, path string, rule string, listed boolean, verdict string")
