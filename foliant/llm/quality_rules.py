"""Quality rules as a bitmask ledger.

Every rule is evaluated once. The ledger keeps each document's measurements
and one failure bit per rule; policies are versioned masks over those bits,
and ablations are counts over the distinct bit patterns. A null or empty text
has no words: it fails too_few_words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import batched, id_text, pairs

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_SYMBOLS, _SPACES = b"#*$%&|<>", b" \t\n\v\f\r"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")
SCHEMA = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES)])

#: (name, failure condition); a rule's bit is its position.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 10 * n_words"),
    ("shouting", "n_upper > n_lower"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: What a policy of each version rejects.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_words"),
    "v1": tuple(name for name, _ in RULES),
}


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def measure(text: bytes) -> tuple[int, ...]:
    """MEASURES of a text; words are runs of bytes other than ASCII white space."""
    words = text.split()
    n = len(words)
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    drop = lambda chars: len(text) - len(text.translate(None, chars))
    continued = drop(bytes(range(0x80, 0xC0)))
    return (n, len(text) - continued - drop(_SPACES), drop(_SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), len(lines), drop(_UPPER), drop(_LOWER))


def repeat_words(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that occurs twice or more."""
    if len(words) < 4:
        return 0
    number = dict.fromkeys(words)
    for k, w in enumerate(number):
        number[w] = k
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pair = ids[:-2] * len(number) + ids[1:-1]
    if len(number) > 2_000_000:  # three numbers would not fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * len(number) + ids[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(key, twice)
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : len(words) - 2 + shift] |= again
    return int(inside.sum())


def measurements(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        yield from batched(((doc_id, *measure(text or b"")) for doc_id, text in pairs(batches)), SCHEMA, lambda row: 64)

    return id_text(df, id_col, text_col).mapInArrow(run, ", ".join(["doc_id long", *(f"{m} long" for m in MEASURES)]))


def failure_bits() -> Column:
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(0) for k, (_, condition) in enumerate(RULES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("long")


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, MEASURES and failed_bits: one row for each input row, repeated and null ids included."""
    return measurements(df, id_col, text_col).withColumn("failed_bits", failure_bits())


def apply_policy(led: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with kept: no bit of the policy's mask is set."""
    return led.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def filter_rows(df: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns as they are, that the policy keeps: the ledger stands beside each row, without a join."""

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t or b"") for t in texts], columns=MEASURES)

    text = F.coalesce(df[text_col].cast("string").cast("binary"), F.lit(b""))
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("__row"), measured(text).alias("__m"))
    kept = apply_policy(rows.select("__row", "__m.*").withColumn("failed_bits", failure_bits()), policy).where("kept")
    return kept.select(*(F.col(f"__row.`{c}`").alias(c) for c in df.columns))


def ablations(led: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: rule, n_failed, n_only (fail it alone), n_kept_without (kept if the rule were dropped).

    Bit patterns are counted first (at most 2^rules rows, combined before the
    shuffle); all else is bitwise arithmetic over those counts.
    """
    full = mask(policy)
    patterns = led.groupBy("failed_bits").agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]))
    inside = F.col("failed_bits").bitwiseAND(F.lit(full))
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long")
    return (
        patterns.select("n", inside.alias("bits"), F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            total(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
            total(F.col("bits") == F.col("r.bit")).alias("n_only"),
            total(F.col("bits").bitwiseAND(F.lit(full) - F.col("r.bit")) == 0).alias("n_kept_without"),
        )
    )
