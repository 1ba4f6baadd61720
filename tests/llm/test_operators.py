import glob
import gzip
import hashlib
import random
import zlib

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import bpe, quality_rules, simhash, warc
from foliant.llm.common import look_up, shared_path
from foliant.llm.queries import RANKS

SCHEMA = "doc_id long, text string, lang string, n_words string, fingerprint int, token_ids string"


def frame(spark, texts):
    rows = [(i, t, None, "x", 1, "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "a b c a b c\nx\nx\n\n"), (6, "a b c a b c\nx\nx\n\n"), (6, "a b c a b c\nx\nx\n\n"),
    (7, "é  ü   　 z\x1c q's 'll  1234abc"), (8, "word " * 3000 + "x" * 5000), (9, " " * 3000 + "end" + " " * 700), (None, "no id here"), (10, "ÄÖ #*$%&|<> A-Z"),
]


def test_bpe_matches_whole_text_encoding(spark):
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    plain = bpe.Codec(path, pattern).encoding
    texts = [t for _, t in ODD] + ["a \n b", "a\n b\r\n  c ", "x  y", " lead", "trail ", "'s it's", "\n\n word", "a" * 70000 + " b" * 40000]
    got = bpe.encode_documents(frame(spark, list(enumerate(texts))), path, pattern, outputs=("token_ids", "ids_text", "decoded")).collect()
    for r in got:
        text = texts[r.doc_id] or ""
        assert r.token_ids == plain.encode_ordinary(text), text[:40]
        assert r.n_tokens == len(r.token_ids) and r.ids_text == ",".join(map(str, r.token_ids))
        assert bytes(r.decoded) == text.encode()
    back = bpe.decode_documents(bpe.encode_documents(frame(spark, list(enumerate(texts))), path, pattern), path, pattern).collect()
    assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() for r in back)


def test_bpe_very_long_white_space():
    c = bpe.Codec(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    for text in ("x" + " " * 2_000_000 + "y", " " * 1_000_000, "\n " * 300_000 + "z"):
        assert c.decode(c.encode(text)) == text.encode()


@pytest.mark.parametrize("seed", range(3))
def test_bpe_random_texts(seed):
    rng = random.Random(seed)
    c = bpe.Codec(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    for _ in range(400):
        text = "".join(rng.choice(["a", "é", " ", "  ", "\n", "\t", "1", "'s", "'", " ", "\x1c", "!", "字", " x"]) for _ in range(rng.randrange(60)))
        assert c.encode(text) == c.encoding.encode_ordinary(text), repr(text)


def brute_repeat(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def test_quality_ledger(spark):
    rng = random.Random(3)
    texts = ODD + [(100 + i, " ".join(rng.choice("ab cd ef\n gh".split(" ")) for _ in range(rng.randrange(90)))) for i in range(40)]
    led = quality_rules.ledger(frame(spark, texts))
    rows = led.collect()
    assert len(rows) == len(texts)
    by = {}
    for i, t in texts:
        by[i] = t or ""
    for r in rows:
        text = by[r.doc_id]
        words = text.encode().split()
        assert r.n_words == len(words) and r.word_chars == sum(len(w.decode()) for w in words)
        assert r.n_repeat_words == brute_repeat(words)
        assert r.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert r.n_dup_lines == len(lines) - len(set(lines))
    kept = quality_rules.apply_policy(led, "v1").where("kept").count()
    for a in quality_rules.ablations(led, "v1").collect():
        bits = quality_rules.mask("v1") & ~quality_rules.BIT[a.rule]
        assert a.n_kept_without == sum(r.failed_bits & bits == 0 for r in rows) == kept + a.n_only
    assert quality_rules.ablations(led.limit(0)).count() == 0


def brute_components(rows):
    codes = {}
    for i, c in rows:
        codes.setdefault(c, []).append(i)
    keys = list(codes)
    up = {k: k for k in keys}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in keys:
        for b in keys:
            if bin(a ^ b).count("1") <= 3:
                up[find(a)] = find(b)
    least = {}
    for k in keys:
        ids = [i for i in codes[k] if i is not None]
        if ids:
            least[find(k)] = min([least.get(find(k), ids[0]), *ids])
    return {(i, c): least.get(find(c)) if i is not None else None for i, c in rows}


def brute_code(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("node_rows", [1 << 16, 3])
def test_simhash(spark, sf_dir, node_rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(frame(spark, ODD).select("doc_id", "text"))
    rng = random.Random(5)
    base = ("alpha beta gamma delta epsilon zeta eta theta iota kappa " * 30).split()
    near = []
    for i in range(30):
        words = base[:]
        words[rng.randrange(len(words))] = f"w{i}"
        near.append((5000 + i, " ".join(words)))
    docs = docs.union(frame(spark, near).select("doc_id", "text"))
    rows = docs.collect()
    want = brute_components([(r.doc_id, brute_code(r.text)) for r in rows])
    got = simhash.near_duplicates(docs, node_rows=node_rows).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[r.doc_id, r.code % (1 << 64)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_keeps_one_of_each_component(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(n))
    base = text(400).split()
    rows = [(7, text(80)), (7, text(80)), (None, text(80)), (None, text(80)), (None, None), (None, ""), (20, text(60))]
    rows += [(20, rows[6][1]), (21, rows[6][1]), (None, rows[6][1])] + [(30 + i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(40)]
    df = spark.createDataFrame([(t, d, 1, 2) for d, t in rows], "text string, doc_id long, _own int, __id int")
    least = {}
    parts = brute_components([(i, brute_code(t)) for i, (_, t) in enumerate(rows)])
    for i, (d, t) in enumerate(rows):
        g = parts[i, brute_code(t)]
        least[g] = min(least.get(g, (True, 0, "")), (d is None, d or 0, t or "")) if g in least else (d is None, d or 0, t or "")
    got = simhash.keep_one(df, node_rows=3)
    assert got.columns == df.columns
    found = got.collect()
    assert len(found) == len(least) and sum(r.doc_id == 7 for r in found) == 2 and sum(r.doc_id is None for r in found) == 3
    assert {(r.doc_id is None, r.doc_id or 0) for r in found} == {x[:2] for x in least.values()}
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_look_up(spark):
    rng = random.Random(2)
    left = [(rng.choice([1, 1, 1, 2, 3, 4, 5, 6, None]), i) for i in range(300)]
    right = {k: f"v{k}" for k in (1, 2, 3, 9)}
    a, b = spark.createDataFrame(left, "k int, i int"), spark.createDataFrame(list(right.items()), "k int, v string")
    for share in (1, 4, 1 << 14):
        got = sorted((r.i, r.v) for r in look_up(a, b, ["k"], share).collect())
        assert got == [(i, right.get(k)) for k, i in left]


def test_shingle_hash_is_sparks(spark):
    assert spark.sql("select xxhash64('é b c') as h").first().h % (1 << 64) == xxhash.xxh64_intdigest("é b c".encode(), 42)


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>\r\n\r\nWARC/1.1\r\n\r\n"), (2, None, None), (3, "u", ""), (4, "u", "same"), (4, "u", "same"), (4, "t", "other"), (5, "v", "same"), (5, "v", "same"), (None, "w", "same"), (-7, "q", "Zsame")]
    pages = spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, html string, record_type string, payload_bytes int")
    path = shared_path(spark, "warc-test")
    warc.write_archives(warc.deduplicated(spark, warc.headers(pages)), path)
    back = warc.payloads(warc.read_archives(spark, path)).collect()
    assert len(back) == len(rows)
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = sorted((str(i), html or "", None if i is None or first[html or ""] == i else first[html or ""]) for i, _, html in rows)
    assert sorted((str(r.record_id), bytes(r.payload).decode(), r.refers_to) for r in back) == want
    for r in back:
        import base64

        assert r.payload_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() and r.payload_bytes == len(r.payload)
    empty = shared_path(spark, "warc-test")
    warc.write_archives(warc.deduplicated(spark, warc.headers(pages.limit(0))), empty)
    assert warc.read_archives(spark, empty).count() == 0
    assert warc.resolve(warc.headers(pages), least_bytes=10).where(F.col("record_type") == "revisit").count() == 0


def test_warc_archives_are_bounded_by_bytes(spark):
    """Records of many sizes, one beyond 16 MB: small archives, a member for each record, texts as they were."""
    draw = random.Random(5)
    texts = ["".join(draw.choices("abcdefgh <>é", k=n)) for n in (0, 10, 200_000, 300_000, 50, 400_000)] + ["long " * 3_600_000]
    pages = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts + texts[3:])], "page_id long, url string, html string").coalesce(1)
    path = shared_path(spark, "warc-test")
    warc.write_archives(warc.deduplicated(spark, warc.headers(pages)), path, most_bytes=100_000)
    back = {r.record_id: bytes(r.payload).decode() for r in warc.payloads(warc.read_archives(spark, path)).collect()}
    assert back == dict(enumerate(texts + texts[3:]))
    files = [f for f in glob.glob(path.removeprefix("file://") + "/part-*")]
    assert len(files) >= 3
    for file in files:
        rest, members, records = open(file, "rb").read(), 0, len(list(warc.parse(open(file, "rb").read())))
        assert gzip.decompress(rest).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") or not rest
        while rest:
            unpacked = zlib.decompressobj(wbits=31)
            text = unpacked.decompress(rest)
            assert text == b"" or (text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n"))
            rest, members = unpacked.unused_data, members + (text != b"")
        assert members == records
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
