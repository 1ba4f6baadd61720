"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints that differ in at most 3 of 64 bits agree wholly in one of four
16-bit blocks. Each block's mask with a shared pattern is an upper node of the
index and a task's unit of work. Below it fingerprints are sorted by Gray rank,
so each run with the same leading bits is a node; a node factors out the bits
that all its members share, and a pair of nodes whose shared bits already
differ in more than 3 places is dropped with all that is below. Pairs of
nodes that are linked already are dropped too, so a dense group of near
copies isn't compared pair by pair. Only links that join something new leave a
task; components are then found by repeated minimum labels.

Null and empty texts have no word and the fingerprint zero, and link like any
other. Rows with a null id have a fingerprint and no component. Repeated rows
stay repeated, but for keep_one().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, id_text, look_up, pairs, unused

MAX_DIFFERENCES = 3
BLOCKS, BLOCK_BITS = 4, 16
#: Depths (leading bits) of the index's levels; the first is the upper node.
LEVELS = (16, 20, 24, 28, 32, 40, 48, 64)
#: Pairs of nodes that are looked at together.
FRONTIER = 1 << 18
#: Members of an upper node that one task takes; larger ones are split by more masked bits.
NODE_ROWS = 1 << 16

_SPACES = b" \t\n\v\f\r"


def fingerprint(text: bytes, size: int = 3) -> int:
    """The SimHash of a text's word shingles: a bit is set where over half the shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    h64 = xxhash.xxh64_intdigest
    hashes = np.array([h64(s, 42) for s in shingles], np.uint64)
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _own(text: Column) -> Column:
    """What tells texts apart: a null text is as an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")).cast("binary"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """doc_id, own (a hash of the text) and code (the fingerprint as a signed long) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("code", pa.int64())])

    def run(batches):
        for batch in batches:
            codes = [fingerprint(text or b"", size) for _, text in pairs([batch])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(codes, np.uint64).view(np.int64))], schema=schema)

    rows = id_text(df, id_col, text_col)
    return rows.withColumn("own", _own(F.col("text"))).mapInArrow(run, "doc_id long, own long, code long")


def _rotated(codes: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Codes with their block moved to the front."""
    shift = (block * BLOCK_BITS).astype(np.uint64)
    left = codes << shift
    return np.where(shift == 0, codes, left | (codes >> ((np.uint64(64) - shift) & np.uint64(63))))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The position of a code in Gray order; leading bits of rank and code determine each other."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class Links:
    """Disjoint sets over row numbers; the least row is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            above = up[up]
            if (above == up).all():
                self.up = up
                return up
            up = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join each a[i] with b[i], all at once, by minimum labels."""
        while len(a):
            up = self.roots()
            ra, rb = up[a], up[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def link_sorted(codes: np.ndarray, group: np.ndarray, limit: int = MAX_DIFFERENCES) -> np.ndarray:
    """For each row the least row that it is linked with, over links within its group.

    Rows are sorted by group, then by Gray rank of codes (whose leading 16 bits
    a group shares), without repeats.
    """
    n = len(codes)
    links = Links(n)
    if n < 2:
        return links.up
    near = (group[1:] == group[:-1]) & (np.bitwise_count(codes[1:] ^ codes[:-1]) <= limit)
    links.join(np.flatnonzero(near), np.flatnonzero(near) + 1)
    starts, shared, pattern = [], [], []
    for depth in LEVELS:
        prefix = codes >> np.uint64(64 - depth)
        first = np.r_[True, (group[1:] != group[:-1]) | (prefix[1:] != prefix[:-1])]
        at = np.flatnonzero(first)
        ones, any_one = np.bitwise_and.reduceat(codes, at), np.bitwise_or.reduceat(codes, at)
        starts.append(at)
        shared.append(~(ones ^ any_one))
        pattern.append(ones)
    child = [np.searchsorted(starts[k + 1], np.r_[starts[k], n]) for k in range(len(LEVELS) - 1)]
    size = np.diff(np.r_[starts[0], n])
    tops = np.flatnonzero(size > 1)
    stack = [(0, tops[i : i + FRONTIER], tops[i : i + FRONTIER]) for i in range(0, len(tops), FRONTIER)]
    while stack:
        k, a, b = stack.pop()
        differ = np.bitwise_count((pattern[k][a] ^ pattern[k][b]) & shared[k][a] & shared[k][b])
        keep = differ <= limit
        # A node all of whose members are linked already needs no comparing with one of the same label.
        up = links.roots()
        low, high = np.minimum.reduceat(up, starts[k]), np.maximum.reduceat(up, starts[k])
        keep &= ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
        a, b = a[keep], b[keep]
        if k == len(LEVELS) - 1:
            links.join(starts[k][a], starts[k][b])
            continue
        na, nb = child[k][a + 1] - child[k][a], child[k][b + 1] - child[k][b]
        made = na * nb
        edges = np.cumsum(made)
        cuts = np.searchsorted(edges, np.arange(FRONTIER, edges[-1] + FRONTIER, FRONTIER) if len(edges) else [], side="left") + 1
        last = 0
        for c in [*dict.fromkeys(np.minimum(cuts, len(a)).tolist())]:
            pa_, pb_, m = a[last:c], b[last:c], made[last:c]
            last = c
            of = np.repeat(np.arange(len(pa_)), m)
            step = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
            width = child[k][pb_ + 1] - child[k][pb_]
            ca, cb = child[k][pa_][of] + step // width[of], child[k][pb_][of] + step % width[of]
            once = (pa_[of] != pb_[of]) | (ca <= cb)
            stack.append((k + 1, ca[once], cb[once]))
    return links.roots()


def _upper_nodes(codes: DataFrame) -> DataFrame:
    """node, code: each code under each of its upper nodes (block mask with pattern)."""
    return codes.select("code", F.explode(F.expr(f"transform(sequence(0, {BLOCKS - 1}), b -> struct(cast(b as long) as block, shiftleft(cast(b as long), {BLOCK_BITS}) + (shiftrightunsigned(code, {64 - BLOCK_BITS} - b * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}) as node))")).alias("s")).select("code", "s.node")


def links(codes: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """code, root: links enough to connect all codes that are chained by steps of at most 3 bits.

    `codes` has distinct codes. An upper node with more than `node_rows` members
    is split: of 3 differences outside its block one of four 12-bit parts of
    the rest is free, so (block, part) masks with their patterns take over, and
    their members are dealt out by all 28 bits.
    """
    nodes = _upper_nodes(codes)
    sizes = nodes.groupBy("node").count().where(F.col("count") > node_rows).select(F.col("node").alias("large"))
    marked = nodes.join(sizes, nodes["node"] == sizes["large"], "left")
    rest = f"(shiftleft(code, cast((shiftright(node, {BLOCK_BITS}) + 1) * {BLOCK_BITS} as int) % 64) | IF(shiftright(node, {BLOCK_BITS}) = 3, 0L, shiftrightunsigned(code, 64 - cast((shiftright(node, {BLOCK_BITS}) + 1) * {BLOCK_BITS} as int) % 64)))"
    # The 48 bits after the block, first; rotated so that they lead.
    part = "transform(sequence(0, 3), p -> (node * 4 + p + 1) * 4096L + (shiftrightunsigned(rest, 52 - 12 * p) & 4095))"
    keyed = marked.select("code", "node", "large", F.expr(rest).alias("rest")).select(
        "code", "node", F.explode(F.expr(f"IF(large IS NULL, array(-1L), {part})")).alias("sub")
    )
    schema = pa.schema([("code", pa.int64()), ("root", pa.int64())])

    def run(batches):
        held = []
        for batch in batches:
            held.append([np.asarray(batch.column(k)) for k in range(3)])
        if not held:
            return
        code, node, sub = (np.concatenate(x) for x in zip(*held, strict=True))
        block = node >> BLOCK_BITS
        turned = _rotated(code.view(np.uint64), block)
        order = np.lexsort((gray_rank(turned), sub, node))
        code, turned, node, sub = code[order], turned[order], node[order], sub[order]
        group = np.cumsum(np.r_[0, (node[1:] != node[:-1]) | (sub[1:] != sub[:-1])])
        root = link_sorted(turned, group)
        linked = root != np.arange(len(root))
        out = np.unique(np.stack([code[linked], code[root[linked]]], 1), axis=0)
        for i in range(0, len(out), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(out[i : i + (1 << 17), 0]), pa.array(out[i : i + (1 << 17), 1])], schema=schema)

    return keyed.repartition("node", "sub").mapInArrow(run, "code long, root long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label for the nodes of edges (a, b): label is the least node of its component.

    Each round every node takes the least label among its own and its
    neighbours', then its label's label. Rounds end when nothing changes, and each is cut
    off by a checkpoint. Only a count comes to the driver. Nodes with very many
    neighbours and labels of very many nodes are looked up, not shuffled.
    """
    spark = edges.sparkSession
    both = cut(spark, edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = cut(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = look_up(both, labels.withColumnRenamed("node", "b"), ["b"]).groupBy("a").agg(F.min("label").alias("near"))
        closer = cut(spark, labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        far = closer.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = cut(spark, look_up(closer, far, ["label"]).select("node", "was", F.least("label", "jump").alias("label")))
        changed = new.where("label != was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _labels(codes: DataFrame, node_rows: int) -> DataFrame:
    """code, label (the least code of its component) of the distinct codes that are linked with others."""
    found = links(codes, node_rows)
    return components(found.select(F.col("code").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "code")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """doc_id, code, component_id (the least doc_id reachable by links of at most 3 bits) of every row."""
    docs = cut(df.sparkSession, fingerprints(df, id_col, text_col, size).select("doc_id", "code"))
    codes = docs.groupBy("code").agg(F.min("doc_id").alias("least"))
    labels = _labels(codes.select("code"), node_rows)
    of_label = labels.join(codes, "code").groupBy("label").agg(F.min("least").alias("component"))
    linked = look_up(labels, of_label, ["label"]).select("code", "component")
    of_code = codes.join(linked, "code", "left").select("code", F.coalesce("component", "least").alias("component_id"))
    return look_up(docs, of_code, ["code"]).select("doc_id", "code", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """Of the rows of df, with all their columns, one of each component: that with the least id (null ids last), then the least hash of its text.

    Rows are told apart by id and text, so rows with one id and texts that aren't
    near copies all stay. Of rows with equal id and text any one stays.
    """
    docs = cut(df.sparkSession, fingerprints(df, id_col, text_col, size))
    codes = docs.groupBy("code").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "own")).alias("first"))
    group = F.coalesce("label", "code").alias("group")
    firsts = codes.join(_labels(codes.select("code"), node_rows), "code", "left").groupBy(group).agg(F.min("first").alias("first"))
    # Plain columns without nulls, so that the join's partitions serve the last step too.
    id_, unnamed, own = unused(df, "_id"), unused(df, "_unnamed"), unused(df, "_own")
    named = lambda i: [F.coalesce(i, F.lit(0)).alias(id_), i.isNull().alias(unnamed)]
    chosen = firsts.select(*named(F.col("first.doc_id")), F.col("first.own").alias(own))
    rows = df.select("*", *named(F.col(f"`{id_col}`").cast("long")), _own(F.col(f"`{text_col}`").cast("string")).alias(own))
    keys = [id_, unnamed, own]
    return rows.join(chosen, keys, "left_semi").dropDuplicates(keys).select(*(F.col(f"`{c}`") for c in df.columns))
