"""Secret scans in DataFrame operations only.

Three kinds of pattern (assign, access, hex) are found leftmost and
non-overlapping, and a fourth kind, entropy, adds strings of 20 characters or
more that look random. What patterns have found and the words of the allow list are cut out
first, so a candidate is a run of candidate characters between them. A window of 20 characters
slides over it; its character counts and their sum of c*log2(c) are kept up
by one character in and one out, and the largest Shannon entropy is held
against the threshold of the candidate's character class. Candidates that
are allowed by their form are left out.

All steps are linear in the text, but for sorting and running sums over the
spans, which take n log n. Positions are code points; a span's end is exclusive.
Null counts as empty text; ids, nulls and repeats among them included, are
passed on as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import id_text

# The patterns of the three base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: (class, pattern that the whole candidate matches, least entropy in bits); the first that matches holds.
CLASSES: tuple[tuple[str, str, float], ...] = (
    ("hexadecimal", r"^[0-9A-Fa-f]+$", 3.0),
    ("alphanumeric", r"^[A-Za-z0-9]+$", 3.6),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.75),
)
#: Words that no secret holds, with their lengths: a candidate ends before one and another starts after it.
ALLOWED_WORDS: tuple[tuple[str, int], ...] = (
    (r"(?i)example", 7), (r"(?i)placeholder", 11), (r"(?i)changeme", 8), (r"(?i)xxxx", 4), (r"0{8}", 8), (r"(?i)abcdefgh", 8), (r"012345678|123456789", 9),
    (r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])", 36),
)
#: Candidates that aren't secrets: no digit, no letter.
ALLOWED: tuple[str, ...] = (r"^[^0-9]*$", r"^[^A-Za-z]*$")
#: What dashed words with numbers of up to four digits at their end don't have; nothing else is without it.
NO_SLUG = r"[0-9]{5}|[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9][-_/=+]+[A-Za-z]"
#: c*log2(c) in whole units of 2^-40, so that sums don't drift.
_UNIT = 1 << 40
_C_LOG_C = [0] + [round(c * math.log2(c) * _UNIT) for c in range(1, WINDOW + 2)]


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _with(name: str, value: str, body: str) -> str:
    """SQL for body, where `name` is the value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(array: str, join) -> str:
    """SQL for each element of an array expression joined with all before it, by doubling: join(SQL of what is before, SQL of the element)."""
    step = f"transform(a_, (v_, i_) -> IF(i_ >= shiftleft(1, k_), {join('a_[i_ - shiftleft(1, k_)]', 'v_')}, v_))"
    return _with("z_", array, f"IF(size(z_) < 2, z_, aggregate(sequence(0, cast(ceil(log2(size(z_))) as int)), z_, (a_, k_) -> {step}))")


_SPAN = "struct<s:int,k:int,e:int,b:int>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def _positions(text: str, kind: int, pattern: str, keep: str, group: int = 0) -> Column:
    """Spans of the matches whose group meets `keep` (a condition on g!), by start: s, k, e and b, the bytes before.

    `pattern` has no empty match, and only ASCII ones, so a match has as many bytes as characters.
    """
    p = _quoted(pattern)
    pieces, found = f"split({text}, {p}, -1)", f"regexp_extract_all({text}, {p}, 0)"
    ends = _running(
        "transform(arrays_zip(m.p, m.x), y -> struct(length(y.p) + coalesce(length(y.x), 0) as e, octet_length(y.p) + coalesce(length(y.x), 0) as f))",
        lambda before, own: f"struct({before}.e + {own}.e as e, {before}.f + {own}.f as f)",
    )
    length = "length(y)"
    span = f"struct(n.ends[i].e - {length} as s, {kind} as k, n.ends[i].e as e, n.ends[i].f - {length} as b)"
    kept = keep.replace("g!", "m.g[i]")
    each = f"filter(transform(m.x, (y, i) -> IF({kept}, {span}, NULL)), y -> y IS NOT NULL)"
    groups = found if group == 0 else f"regexp_extract_all({text}, {p}, {group})"
    return F.expr(_with("m", f"struct({pieces} as p, {found} as x, {groups} as g)", _with("n", f"struct({ends} as ends)", each)))


def _replaced(text: str, spans: str, filler: str) -> str:
    """SQL for the text with `filler` (SQL for span i of o.sp; before: where the ones before it end) in place of spans, which are sorted."""
    tops = _running(f"transform({spans}, y -> struct(y.e as e, y.b + y.e - y.s as f))", lambda before, own: f"greatest({before}, {own})")
    at = "IF(i = 0, 0, o.tops[i - 1].f)"
    to = "IF(i < size(o.sp), o.sp[i].b, length(o.raw))"
    gap = f"cast(substring(o.raw, {at} + 1, greatest({to} - {at}, 0)) as string)"
    part = f"concat({gap}, IF(i < size(o.sp), {filler.replace('before!', 'IF(i = 0, 0, o.tops[i - 1].e)')}, ''))"
    return _with("o", f"struct(cast({text} as binary) as raw, {spans} as sp, {tops} as tops)", f"array_join(transform(sequence(0, size(o.sp)), i -> {part}), '')")


def lowest_window(candidate: str, enough: str = "-1L", window: int = WINDOW) -> str:
    """SQL for the least sum of c*log2(c), in units of 2^-40, over the character counts c of `window` successive characters of an ASCII string expression.

    Counts are kept twelve to a number of 60 bits. They and the sum change by
    the character that comes in and the one that goes out; the scan rests once
    `enough` is reached.
    """
    table = "array(" + ", ".join(f"{x}L" for x in _C_LOG_C) + ")"
    shift = lambda c: f"(5 * ({c} % 12))"
    count = lambda c: f"cast(shiftright(acc.n[{c} div 12], {shift(c)}) & 31 as int)"
    a, o = "x.a", "x.o"
    moved = f"transform(acc.n, (v, j) -> v + IF(j = {a} div 12, shiftleft(1L, {shift(a)}), 0L) - IF({o} >= 0 AND j = {o} div 12, shiftleft(1L, {shift(o)}), 0L))"
    come = f"{table}[{count(a)} + 1] - {table}[{count(a)}]"
    left = f"({count(o)} + IF({a} = {o}, 1, 0))"
    gone = f"IF({o} >= 0, {table}[{left} - 1] - {table}[{left}], 0L)"
    noted = f"struct(acc.n as n, acc.s as s, acc.i as i, IF(acc.i < {window}, acc.low, least(acc.low, acc.s)) as low)"
    step = _with("acc", f"struct({moved} as n, acc.s + {come} + {gone} as s, acc.i + 1 as i, acc.low as low)", noted)
    codes = f"transform(split({candidate}, ''), y -> ascii(y) - 32)"
    both = _with("c_", codes, f"transform(c_, (y, i) -> struct(y as a, IF(i < {window}, -1, c_[i - {window}]) as o))")
    start = f"struct(array_repeat(0L, 8) as n, 0L as s, 0 as i, {max(_C_LOG_C)}L as low)"
    return f"aggregate({both}, {start}, (acc, x) -> IF(acc.low <= {enough}, acc, {step}), acc -> acc.low)"


def max_window_entropy(candidate: str, window: int = WINDOW) -> str:
    """SQL for the largest entropy, in bits, of `window` successive characters."""
    return f"round(log2({window}) - {lowest_window(candidate, window=window)} / {_UNIT}D / {window}, 9)"


def most_sum(entropy: float, window: int = WINDOW) -> int:
    """The largest sum of c*log2(c) that a window of at least `entropy` bits can have."""
    return math.floor((math.log2(window) - entropy + 5e-10) * window * _UNIT)


def _entropy_spans() -> Column:
    """Of the candidates at `cands` in the text `m`, those that are random enough and not allowed."""
    allowed = " OR ".join(f"w RLIKE {_quoted(p)}" for p in ALLOWED) + f" OR NOT w RLIKE {_quoted(NO_SLUG)}"
    most = "CASE " + " ".join(f"WHEN w RLIKE {_quoted(p)} THEN {most_sum(h)}L" for _, p, h in CLASSES) + " END"
    random = _with("q", most, lowest_window("w", enough="q") + " <= q")
    text = "cast(substring(r, x.b + 1, x.e - x.s) as string)"
    return F.expr(_with("r", "cast(m as binary)", f"filter(cands, x -> {_with('w', text, f'NOT ({allowed}) AND {random}')})"))


def _scanned(rows: DataFrame) -> DataFrame:
    """own, t: the same with base and added, arrays of spans (s, k, e, b)."""
    none, t = F.expr(_NONE), F.col("t")
    kinds = rows.select(
        "own",
        "t",
        F.when(t.rlike(ASSIGN), _positions("t", 0, ASSIGN, "length(g!) >= 12", 2)).otherwise(none).alias("a"),
        F.when(t.contains("AKIA"), _positions("t", 1, ACCESS, "length(g!) >= 18")).otherwise(none).alias("k"),
        # A run of 16 or more starts where the run starts, so shorter runs need not be listed.
        F.when(t.rlike("[0-9a-f]{16}"), _positions("t", 2, "[0-9a-f]{16,}", "true")).otherwise(none).alias("h"),
    )
    based = kinds.select("own", "t", F.expr("array_sort(concat(a, k, h))").alias("base"))
    masked = _with("u", _replaced("t", "base", r"repeat('\n', o.tops[i].e - greatest(o.sp[i].s, before!))"), "u")
    for pattern, size in ALLOWED_WORDS:
        masked = f"regexp_replace({masked}, {_quoted(pattern)}, repeat('\n', {size}))"
    # A text without a run that could be a candidate isn't masked.
    found = based.select("own", "t", "base", F.when(t.rlike(CANDIDATE), F.expr(masked)).otherwise("").alias("m"))
    cands = found.select("own", "t", "base", "m", F.when(F.col("m").rlike(CANDIDATE), _positions("m", 3, CANDIDATE, "true")).otherwise(none).alias("cands"))
    return cands.select("own", "t", "base", F.when(F.size("cands") > 0, _entropy_spans()).otherwise(none).alias("added"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t (the text; null: empty), base and added of every row: arrays of spans (s, k: the kind's index, e, b: bytes before), by start, then kind."""
    rows = id_text(df, id_col, text_col, binary=False).select(F.col("doc_id").alias("own"), F.coalesce("text", F.lit("")).alias("t"))
    return _scanned(rows).withColumnRenamed("own", "doc_id")


def spans_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.k = {k})) as bigint)")
    every = scanned.withColumn("every", F.array_sort(F.concat("base", "added")))
    return every.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text("base").cast("binary"), 256).alias("base_sha256"), spans_text("every").alias("spans"))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with each span of `text_col` (what overlaps, as one) replaced by `mark`; null texts stay null, other columns as they are."""
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("own"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("t"))
    spans = _scanned(rows).select("own", "t", F.array_sort(F.concat("base", "added")).alias("spans"))
    quoted = mark.replace("'", "\\'")
    hidden = _replaced("t", "spans", f"IF(o.sp[i].s >= before!, '{quoted}', '')")
    text = F.expr(f"CASE WHEN own.`{text_col}` IS NULL THEN NULL WHEN size(spans) = 0 THEN t ELSE {hidden} END")
    return spans.select(*((text if c == text_col else F.col(f"own.`{c}`")).alias(c) for c in df.columns))
