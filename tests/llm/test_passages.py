import random

import numpy as np
import pytest

from foliant.llm import passages


def brute(rows, length=50):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        if d is not None:
            for i in range(len(raw) - length + 1):
                w = raw[i : i + length]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        if d is not None:
            for i in range(len(raw) - length + 1):
                if first[raw[i : i + length]] < d:
                    gone[i : i + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((str(d), len(raw), int(gone.sum()), runs, bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return sorted(out)


def got(df, **kw):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in passages.remove_repeats(df, **kw).collect())


@pytest.mark.parametrize(("hot", "flush_hot"), [(passages.HOT, passages.FLUSH_HOT), (1, 1 << 20), (1, 1)])
def test_against_brute_force(spark, hot, flush_hot):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [text(rng.choice([40, 49, 50, 51, 80, 300])) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "z" * 49), (3, "z" * 50), (4, "z" * 51), (-5, "y" * 200), (9, "y" * 70), (None, "y" * 70), (10, "ab" * 90), (11, "ab" * 60)]
    rows += [(100 + i, text(rng.randrange(120)) + "".join(rng.choice(shared)[rng.randrange(5) :] + text(rng.randrange(60)) for _ in range(rng.randrange(5)))) for i in range(150)]
    rows += [(100, shared[5] + "other text with an old id"), (120, rows[40][1]), rows[30], rows[30]]
    df = spark.createDataFrame([(d, t, 3, "s") for d, t in rows], "doc_id long, text string, n_bytes int, kept string")
    want = brute(rows)
    assert got(df, hot=hot, flush_hot=flush_hot) == want
    assert sum(r[2] for r in want) > 3000
    assert got(df.limit(0)) == []


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_long_texts(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(passages, "BUFFER", 700)
    text = "".join(rng.choice("abcdefgh") for _ in range(9000))
    rows = [(1, text), (2, "x" + text[100:8000] + "y"), (3, text[650:760])]
    pieces = list(passages._pieces(iter([(d, t.encode()) for d, t in rows]), 50))
    found = passages._concat([passages.regions(p, most=7) for p in pieces])
    assert found["count"].max() == 7
    for d, t in rows:  # the regions cover each window once
        mine = found["doc"] == d
        at = sorted(s + k for s, c in zip(found["start"][mine], found["count"][mine]) for k in range(c))
        assert at == list(range(len(t) - 49))


def test_previous_factors():
    rng = random.Random(8)
    for _ in range(50):
        n = rng.randrange(1, 30)
        doc, lcp = np.array([rng.randrange(5) for _ in range(n)]), np.array([0] + [rng.randrange(6) for _ in range(n - 1)])
        want = [max([min(lcp[min(r, q) + 1 : max(r, q) + 1]) for q in range(n) if doc[q] < doc[r]], default=0) for r in range(n)]
        assert passages.previous_factors(doc, lcp).tolist() == want


def test_pack():
    rng = np.random.default_rng(1)
    found = {k: rng.integers(0, 1000, 50).astype(t) for k, t in passages._PACK}
    back = passages._unpack(passages._pack(found))
    assert all((back[k] == found[k]).all() for k in found)
    doc, records = rng.integers(-9, 9, 40), np.zeros(40, passages._LATE)
    records["start"] = np.arange(40)
    bundles = [*passages._bundles(doc, records, 4)]
    rows = passages.pa.RecordBatch.from_arrays([passages.pa.array([b for b, _ in sorted(bundles * 2)]), passages.pa.array([x for _, x in sorted(bundles * 2)])], ["docs", "blob"])
    for out in passages._gather(passages._LATE)([rows]):
        for d, x in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            assert passages._records(x, passages._LATE)["start"].tolist() == sorted(np.flatnonzero(doc == d).tolist() * 2)


def test_suffix_order_against_sorting():
    rng = random.Random(3)
    for alphabet, longest in ((b"ab", 40), (b"a", 300), (b"abcd\0", 200), (b"ab", 400)):
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, longest))) for _ in range(12)]
        strings += [strings[0] * 3, strings[1] + strings[2]]
        text = b"".join(strings)
        begin = np.cumsum([0, *map(len, strings)])
        start = np.arange(len(text))
        end = np.repeat(begin[1:], [len(x) for x in strings])
        order, lcp = passages.suffix_order(np.frombuffer(text, np.uint8), start, end)
        suffixes = [text[a:b] for a, b in zip(start[order], end[order])]
        assert sorted(order.tolist()) == start.tolist()
        plain = [x.rstrip(b"\0") for x in suffixes]
        assert plain == sorted(plain)  # zero bytes at the end are no matter
        for r in range(1, len(suffixes)):
            a, b = suffixes[r - 1], suffixes[r]
            n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert lcp[r] == n


def test_factors_against_all_pairs():
    rng = random.Random(9)
    for _ in range(100):
        n = rng.randrange(1, 30)
        doc, lcp = np.array([rng.randrange(5) for _ in range(n)]), np.array([0] + [rng.randrange(6) for _ in range(n - 1)])
        want = passages.previous_factors(doc, lcp)
        assert passages.factors(doc, lcp, 3).tolist() == np.where(want >= 3, want, 0).tolist()


def test_a_mark_that_ten_thousand_documents_have(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage = word(70)
    rows = [(i, word(20) + passage + word(20)) for i in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df) == brute(rows)
    found = passages._concat([passages.regions(p) for p in passages._pieces(((d, t.encode()) for d, t in rows), 50)])
    batch = passages.pa.RecordBatch.from_arrays([passages.pa.array([d for d, _ in rows]), passages.pa.array([t.encode() for _, t in rows])], ["doc_id", "text"])
    packs = [b for out in passages._scan(8, 4, 50, passages.FLUSH_HOT)([batch]) for d, b in zip(out.column(1).to_pylist(), out.column(2).to_pylist()) if d is None]
    marks = np.concatenate([passages._unpack(b)["mark"] for b in packs])
    assert np.unique(found["mark"], return_counts=True)[1].max() > 9_000 and np.unique(marks, return_counts=True)[1].max() <= passages.FLUSH_HOT


def test_copies_of_whole_texts_move_little(spark, sf_dir):
    def written():
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    many = [(d + 1000 * k, t) for k in range(12) for d, t in rows]
    rest = [(2050, rows[7][1] + "no copy"), (2050, rows[8][1]), (40, rows[8][1])]  # one id, two texts; and one text twice by one id
    counts = []
    for corpus in (rows, many + rest):
        before = written()
        assert got(spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)) == brute(corpus)
        counts.append(written() - before)
    assert counts[1] < 8 * counts[0]
