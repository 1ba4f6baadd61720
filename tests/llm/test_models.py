import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from foliant.llm import bpe, lm_score, ordinal, quality_rules
from foliant.llm.queries import RANKS
from tests.llm.test_native import added, base, shingles
from tests.llm.test_operators import brute_code, brute_components

ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "a b c"), (4, "x " * 40000)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1.0, True) for d, t in rows], "doc_id long, text string, pll double, kept boolean")


def brute_scores(rows, net, classes, numbers, counts):
    """pll of each row, word by word."""
    W, C, S = lm_score.WIDTH, lm_score.CLASSES, lm_score.SIDE
    number = lambda w: numbers[w] if numbers[w] is not None else lm_score.hashed(w)
    mass = np.zeros(lm_score.BUCKETS)
    for w, n in counts.items():
        mass[number(w)] += n
    out = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        places = [int(classes.place[number(w)]) for w in words]
        padded = [lm_score.PAD] * 2 + places + [lm_score.PAD] * 2
        total = 0.0
        for i, (w, p) in enumerate(zip(words, places)):
            h = np.r_[np.tanh(net["hidden"] + sum(net["embed"][padded[i + 2 + k]] * net["place"][j] for j, k in enumerate((-2, -1, 1, 2)))), 1]
            of_class = np.exp(net["out"] @ h)
            within = np.exp(net["turn"].reshape(C, S, W + 1)[p // S] @ h)
            total += np.log(of_class[p // S] / of_class.sum()) + np.log(within[p % S] / within.sum()) + np.log(counts[w] / mass[number(w)])
        out.append(total)
    return out


def test_lm_scores_word_by_word(spark, sf_dir, monkeypatch):
    from collections import Counter

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60)
    rows = [(r.doc_id + 100, r.text) for r in docs.collect()] + ODD
    df = frame(spark, rows)
    held = {}
    learnt = lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda *a, **k: held.setdefault("net", learnt(*a, **k)))
    counts = Counter(w for _, t in rows for w in (t or "").encode().lower().split())
    for share in (lm_score.SHARE, 300):  # all words broadcast; most joined
        held.clear()
        got = lm_score.score(df, share=share, block=20000).collect()
        numbers = lm_score.Numbers([(w, n) for w, n in counts.items() if n * share >= sum(counts.values())])
        mass = np.zeros(lm_score.BUCKETS, np.int64)
        for w, n in counts.items():
            mass[numbers[w] if numbers[w] is not None else lm_score.hashed(w)] += n
        want = brute_scores(rows, held["net"], lm_score.Classes(mass), numbers, counts)
        assert len(got) == len(rows)
        words = [len((t or "").split()) for _, t in rows]
        for (d, n, x), (e, m, y) in zip(sorted((str(r.doc_id), r.n_tokens, r.pll) for r in got), sorted((str(d), n, p) for (d, _), n, p in zip(rows, words, want))):
            assert d == e and n == m and abs(x - y) < 1e-3 * max(1, n)
        assert all((r.mean_logp is None) if not r.n_tokens else abs(r.mean_logp * r.n_tokens - r.pll) < 1e-6 for r in got)
    assert lm_score.score(df.limit(0)).count() == 0


def strip_of(words):
    gap = [lm_score.PAD] * 2
    return np.r_[gap, words, gap].astype(np.int64)


def test_lm_is_normalised_starts_at_frequencies_and_learns_from_neighbours():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 50, lm_score.BUCKETS)
    classes = lm_score.Classes(counts)
    net = lm_score.start(classes)
    every = np.r_[[lm_score.PAD] * 2, np.ravel([[x, *[lm_score.PAD] * 2] for x in range(lm_score.BUCKETS)])]
    said = lm_score.log_likelihood(net, every)[2::3]
    share = (counts + 0.5) / (counts + 0.5).sum()
    assert np.allclose(said, np.log(share)[np.argsort(classes.place[:-1])], atol=1e-3)
    a, b = 70, 71  # of one class
    p, q = 400, 900
    one, other = [p, p, a, p, p, lm_score.PAD, lm_score.PAD], [q, q, b, q, q, lm_score.PAD, lm_score.PAD]
    for _ in range(60):
        lm_score.learn(net, strip_of((one + other) * 300))
    assert abs(np.exp(lm_score.log_likelihood(net, every)[2::3]).sum() - 1) < 1e-3
    likely = lambda near, x: lm_score.log_likelihood(net, strip_of([near, near, x, near, near]))[4]
    assert likely(p, a) - likely(p, b) > 1 and likely(q, b) - likely(q, a) > 1


def test_lm_gains_over_frequency_on_held_out_texts():
    import duckdb

    texts = [x.encode() for (x,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()]
    from collections import Counter

    counts = Counter(w for t in texts for w in lm_score.words_of(t))
    numbers = lm_score.Numbers(list(counts.items()))
    mass = np.zeros(lm_score.BUCKETS, np.int64)
    for w, n in counts.items():
        mass[numbers[w]] += n
    classes = lm_score.Classes(mass)
    coded = [classes.place[np.array([numbers[w] for w in lm_score.words_of(t)], np.int64)] for t in texts]
    net, frequency = lm_score.start(classes), lm_score.start(classes)
    for _ in range(4):
        for _, _, words in lm_score.strips((0, c) for i, c in enumerate(coded) if i % 10):
            lm_score.learn(net, words)
    held = [w for _, _, w in lm_score.strips((0, c) for c in coded[::10])]
    n = sum((w != lm_score.PAD).sum() for w in held)
    gain = sum(lm_score.log_likelihood(net, w).sum() - lm_score.log_likelihood(frequency, w).sum() for w in held) / n
    assert gain > 0.05, gain


def test_lm_scores_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    one, many = ({r.doc_id: r.mean_logp for r in lm_score.score(docs.repartition(n), block=6000).collect()} for n in (1, 37))
    assert one.keys() == many.keys() and all((one[k] is None and many[k] is None) or abs(one[k] - many[k]) < 1e-3 for k in one)


def test_lm_rounds():
    assert lm_score.rounds_of(1) == (1, 1) and lm_score.rounds_of(50 * lm_score.BLOCK) == (50, 3)
    assert lm_score.rounds_of(10**13)[1] == lm_score.MOST


def test_lm_rare_words_have_their_own_counts(spark):
    texts = [f"a often{i % 2} b" for i in range(60)] + ["a rare b", None]
    df = frame(spark, [(i, t) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in lm_score.score(df, share=1).collect()}  # all words are joined, and hashed
    assert got[61].pll == 0
    from foliant.llm.common import id_text

    counts = {bytes(r.word).decode(): r.n for r in lm_score.word_counts(id_text(df)).collect()}
    assert counts == {"a": 61, "b": 61, "often0": 30, "often1": 30, "rare": 1}


def test_ordinal_classifier(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, grades = [], []
    for i in range(900):
        g = int(rng.integers(0, 3))
        words = list(rng.choice(vocabulary, 60)) + {0: ["awful"], 1: ["meh"], 2: []}[g] * 2
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        grades.append((i, g))
    df = frame(spark, rows + [(-1, None), (None, "awful"), (5, rows[5][1])])
    labels = spark.createDataFrame(grades[:600] + [(None, 1), (7000, 1), (3, None)], "doc_id long, grade int")
    got = ordinal.classify(df, labels).collect()
    assert len(got) == 903
    held = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 600}
    right = np.mean([round(held[i].expected_grade) == g for i, g in grades[600:]])
    assert right > 0.9
    for r in got:
        assert 1 >= r.tail[0] >= r.tail[1] >= 0 and abs(r.expected_grade - sum(r.tail)) < 1e-9
    assert ordinal.classify(df, labels.limit(0)).count() == 903
    assert ordinal.classify(df.limit(0), labels).count() == 0
    assert len(ordinal.sample(df.selectExpr("doc_id", "cast(text as binary) text"), labels, rows=100)) == 100


def test_ordinal_scores_word_by_word(spark):
    """Each row's tails from the model's weights, feature by feature; the fit against a search over all weights."""
    import math
    import re
    import zlib

    texts = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i + 1))) for i in range(60)] + ODD + [(99, "Ünïcode É wörds é 7x_y! #$% #$%\n" * 3), (98, "CAPS ONLY HERE " * 9)]
    df, labels = frame(spark, texts), spark.createDataFrame([(i, i % 3) for i in range(60)], "doc_id long, grade int")
    model = ordinal.fit(ordinal.sample(df.selectExpr("doc_id", "cast(text as binary) text"), labels), 3)
    want = []
    for i, text in texts:
        raw = (text or "").encode()
        found = {zlib.crc32(w.lower()) % ordinal.FEATURES for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)}
        m = dict(zip(quality_rules.MEASURES, quality_rules.measure(raw), strict=True))
        n = max(m["n_words"], 1)
        steps = {"symbols": min(4, 10 * m["n_symbols"] // n), "repeats": min(4, 5 * m["n_repeat_words"] // n), "capitals": int(m["n_upper"] > m["n_lower"]), "lines": min(4, 5 * m["n_dup_lines"] // max(m["n_lines"], 1)), "none": int(not m["n_words"])}
        found |= {zlib.crc32(f"\0{name}{k}".encode()) % ordinal.FEATURES for name, top in steps.items() for k in range(1, top + 1)}
        score = math.fsum(float(model.weights[f]) for f in found)
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        want.append((str(i), *(round(x, 6) for x in (sum(tails), *tails)), tails[1] >= 0.5))
    got = [(str(r.doc_id), *(round(x, 6) for x in (r.expected_grade, *r.tail)), r.kept) for r in ordinal.classify(df, labels).collect()]
    assert sorted(got) == sorted(want)

    counts = {(0, 0): 60, (0, 1): 30, (0, 2): 10, (1, 0): 20, (1, 1): 40, (1, 2): 40}
    rows = [(g, np.array([7] if has else [], np.int32)) for (has, g), n in counts.items() for _ in range(n)]

    def loss(w, t1, t2):
        tail = lambda t, has: 1 / (1 + math.exp(t - w * has))
        p = {(has, g): (1, tail(t1, has), tail(t2, has), 0)[g] - (1, tail(t1, has), tail(t2, has), 0)[g + 1] for has, g in counts}
        return -sum(n * math.log(p[k]) for k, n in counts.items()) / 200

    fitted = ordinal.fit(rows, 3)
    least = min(loss(w, t1, t2) for w in np.arange(0, 3, 0.05) for t1 in np.arange(-1, 2, 0.05) for t2 in np.arange(t1 + 0.05, 4, 0.05))
    assert loss(fitted.weights[7], *fitted.thresholds) < least + 0.002


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    from tests.conftest import SF

    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(d_, t, None, None, None) for d_, t in ODD] + [(9000, "good words " + " ".join(f"v{i}" for i in range(80)) + " token = abcdefghijklmnop1", "en", "s", 5), (9001, " ".join(f"one{i}" for i in range(90)), "en", "s", 5), (9001, " ".join(f"two{i}" for i in range(90)), "en", "s", 5)] * 2, docs.schema)
    docs.unionByName(odd).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_pipeline(spark, small):
    got = corpus_pipeline.run(spark, small).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [shingles(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]

    def good(text):
        m = dict(zip(quality_rules.MEASURES, quality_rules.measure((text or "").encode()), strict=True))
        return not any(eval(c, {}, m) for _, c in quality_rules.RULES)

    rows = [r for r in rows if good(r[1])]
    group = brute_components([(i, brute_code(t)) for i, (_, t) in enumerate(rows)])
    first = {}
    for i, (d, t) in enumerate(rows):
        first.setdefault(group[i, brute_code(t)], []).append((d is None, d, t))
    rows = [min(same, key=lambda x: x[:2])[1:] for same in first.values()]
    rows = [(d, t) for d, t in rows if not any(q and 5 * len(q & shingles(t)) >= 4 * len(q) for q in items)]
    c = bpe.Codec(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    want = {}
    for d, t in rows:
        spans = base(t)
        spans = sorted((s, e) for _, s, e in spans + added(t, spans))
        out, at = "", 0
        for s, e in spans:
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        want[d, out + t[at:]] = c.encoding.encode_ordinary(out + t[at:])
    assert {(r.doc_id, c.decode(r.token_ids).decode()): r.token_ids for r in got} == want and len(got) == len(rows)
    assert sum(d == 9000 for d, _ in want) == 1 and sum(d == 9001 for d, _ in want) == 2
    assert all(r.decoded_ok and r.n_tokens == len(r.token_ids) for r in got)


def test_stages_keep_columns_and_take_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
        assert stage(spark, docs.limit(0), small).count() == 0
