import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.operators import boxes as bx
from foliant.plans import detections  # noqa: F401  (adds its queries)
from foliant.plans.queries import ORACLES, QUERIES
from foliant.sources import annotations

# Hand-derived cases of field cleaning.
CASES = [
    (t.numbers, "No. l23-45 6", "123-456"), (t.title, "名称：某公司", "名称某公司"), (t.float_amount, "0.50", "¥ 8.50"), (t.float_amount, "", "¥ 0.00"), (t.float_amount, None, "¥ 0.00"),
    (t.amount, "￥1,234.50元", "¥ 1234.50"), (t.amount, "(12.00)", "¥ -12.00"), (t.amount, "12.00-", "¥ -12.00"), (t.amount, "RMB100", "¥ 8100.00"), (t.amount, None, "¥ 0.00"),
    (t.page, "第l页/共3页", "1/3"), (t.page, "无", "-1/-1"), (t.half_width, "ＡＢ　１", "AB 1"), (t.label_path, "/a/images/b/images/c.d.jpg", "/a/images/b/labels/c.d.txt"),
]


@pytest.mark.parametrize("f,given,want", CASES)
def test_field(spark, f, given, want):
    df = spark.createDataFrame([(given,)], "s string")
    assert df.select(f(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("given,want", [("2024年03月05日", "2024年03月05日"), ("2024/03/05", "2024年03月05日"), ("2024-03-05", "2024-03-05"), ("0305", "2024年03月05日"), (None, "")])
def test_date(spark, given, want):
    df = spark.createDataFrame([(given,)], "s string")
    assert df.select(t.full_date(F.col("s"), F.lit("2024-12-31").cast("date"))).first()[0] == want


def plain(v):
    return str(round(v, 6)) if isinstance(v, float) else repr(v) if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("lineitem", "orders", "documents", "labels", "events", "pages", "conversations", "embeddings", "supplier", "part", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    found = con.execute(ORACLES[name])
    at = {c[0]: k for k, c in enumerate(found.description)}
    assert sorted(at) == sorted(df.columns)
    cols = sorted(at)
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[at[c]]) for c in cols) for r in found.fetchall())


def ratio(a, b):
    inter = max(0, min(a.x2, b.x2) - max(a.x1, b.x1)) * max(0, min(a.y2, b.y2) - max(a.y1, b.y1))
    return inter / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - inter)


@pytest.mark.parametrize(("most", "most_in"), [(300, 30000), (6, 30000), (300, 11), (4, 11)])
@pytest.mark.parametrize("small", [0, 64])
def test_suppression(spark, most, most_in, small):
    rows = [(k % 7, i, (i * 37 + k) % 60, (i * 17) % 40, (i * 37 + k) % 60 + 25, (i * 17) % 40 + 20, i % 5, i % 3) for k in range(7) for i in range(30)]
    df = spark.createDataFrame(rows, "page long, det long, x1 int, y1 int, x2 int, y2 int, conf int, cls int")
    got = bx.suppress(df, "page", "cls", ["det"], 0.3, most, most_in, small).collect()
    want = []
    for page in range(7):
        kept = []
        for r in sorted((r for r in df.collect() if r.page == page), key=lambda r: (-r.conf, r.det))[:most_in]:
            if all(k.cls != r.cls or ratio(r, k) <= 0.3 for k in kept):
                kept.append(r)
        want += kept[:most]
    assert sorted(got) == sorted(want)


def test_matching(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.85), (1, 2, 2, 0.6), (2, 5, 5, 0.5)], "page long, a long, b long, iou double")
    assert sorted((r.page, r.a, r.b) for r in bx.greedy_match(pairs, "page", "a", "b").collect()) == [(1, 1, 1), (1, 2, 2), (2, 5, 5)]


def test_annotations_round_trip(spark, tmp_path):
    line = 'a.jpg\t[{"transcription":"x","points":[[0.0,1.0],[2.0,3.0]],"score":"0.5"},{"transcription":"y","points":[]}]'
    (tmp_path / "in.txt").write_text(line + "\n")
    got = annotations.read_lines(spark, str(tmp_path / "in.txt"))
    assert [(r.image, r.line_no, r.text, r.score) for r in got.orderBy("line_no").collect()] == [("a.jpg", 0, "x", 0.5), ("a.jpg", 1, "y", None)]
    annotations.write_lines(got, str(tmp_path / "out"))
    assert sorted(annotations.read_lines(spark, str(tmp_path / "out")).collect()) == sorted(got.collect())


def test_labels(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 0.5 0.5 0.1 0.1\n\n2 0.5 1.5 0.1 0.1\n3 0.5\n")
    got = annotations.read_labels(spark, str(tmp_path / "a.txt")).orderBy("line_no").collect()
    assert [(r.line_no, r.cls, r.valid) for r in got] == [(0, 1, True), (2, 2, False), (3, 3, False)]
    (tmp_path / "b.txt").write_text("1 0.1 0.2 0.5 0.2 0.5 0.6\n1 0.1 0.2 0.5 0.2 0.5 0.6\n2 0.1 0.2 0.5\n-1 0.1 0.2 0.5 0.2 0.5 0.6\n")
    got = annotations.read_labels(spark, str(tmp_path / "b.txt")).orderBy("line_no").collect()
    assert [(r.line_no, r.cls, r.valid, len(r.points)) for r in got] == [(0, 1, True, 3), (2, 2, False, 2), (3, -1, False, 3)]
    assert (round(got[0].x, 9), round(got[0].y, 9), round(got[0].w, 9), round(got[0].h, 9)) == (0.3, 0.4, 0.4, 0.4)


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_of_whole_texts(spark, tmp_path):
    same = "x" * 200
    texts = [same + "abc", same + "éb" * 20, same + "校验", "", None, "z"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.edits for r in QUERIES["q_edit_distance"](spark, str(tmp_path)).collect()}
    assert got == {i: None if None in pair else brute_edits(*pair) for i, pair in enumerate(zip(texts, texts[1:], strict=False))} and got[0] > 0


def test_url_files_of_encoded_and_missing_addresses(spark, tmp_path):
    urls = {1: "https://h.org/a/b%20c.txt?k=v", 2: "https://h.org/a/50%zz", 3: None, 4: "h/d+e"}
    spark.createDataFrame([(k, u, "a") for k, u in urls.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.file, bool(r.is_url)) for r in QUERIES["q_url_files"](spark, str(tmp_path)).collect()}
    assert got == {1: ("b c.txt", True), 2: ("50%zz", True), 3: ("", False), 4: ("d+e", False)}


def test_entry_without_what_the_optional_subpackage_needs():
    import os
    import subprocess
    import sys

    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q = e.queries(); assert 'q_row_group' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=here, check=True)


def test_triangles_and_curves_by_hand(spark):
    import math
    import random

    import numpy as np

    from foliant.functions import geometry as g
    from foliant.operators import metrics

    def direction(x, y):
        return -90 if x == y == 0 else math.degrees(math.atan2(y, x))

    def corner(p, i):
        (ax, ay), (bx, by) = [(p[j][0] - p[i][0], p[j][1] - p[i][1]) for j in range(3) if j != i]
        return math.degrees(abs(math.atan2(ax * by - ay * bx, ax * bx + ay * by)))

    draw = random.Random(3)
    rows = [[[draw.randint(0, 40) + 0.5, draw.randint(0, 40) + 0.25] for _ in range(3)] for _ in range(300)]
    got = spark.createDataFrame([(k, r) for k, r in enumerate(rows)] + [(300, rows[0][:2]), (301, None)], "k int, p array<array<double>>").select("k", g.triangle(F.col("p")).alias("t"))
    for r in got.collect():
        if r.k >= 300:
            assert r.t is None
            continue
        p = [(int(x), int(y)) for x, y in rows[r.k]]
        first = next((i for i in range(2) if 70 <= corner(p, i) <= 110), 2)
        rest = sorted((i for i in range(3) if i != first), key=lambda i: direction(p[i][0] - p[first][0], p[first][1] - p[i][1]))
        assert [tuple(q) for q in r.t] == [p[i] for i in (first, *rest)]

    found = [(c, round(draw.random() * 0.8 + 0.1, 6), int(draw.random() < 0.6)) for c in (1, 2) for _ in range(200)] + [(1, None, 1)]
    df = spark.createDataFrame(found, "cls int, conf double, tp int")
    true = spark.createDataFrame([(1, 150), (2, 300), (3, 4)], "cls int, n_true long")
    curves = metrics.score_curves(df, "cls", true).cache()
    x, mean = np.linspace(0, 1, 1000), []
    for c, n in ((1, 150), (2, 300), (3, 4)):
        own = sorted((-conf, tp) for k, conf, tp in found if k == c and conf is not None)
        p, r = np.zeros(1000), np.zeros(1000)
        if own:
            hits = np.cumsum([tp for _, tp in own])
            p, r = (np.interp(-x, [conf for conf, _ in own], v, left=at) for v, at in ((hits / np.arange(1, len(own) + 1), 1), (hits / n, 0)))
        got = sorted((q.k, q.precision, q.recall) for q in curves.where(F.col("cls") == c).collect())
        assert np.allclose([q[1] for q in got], p) and np.allclose([q[2] for q in got], r)
        mean.append(2 * p * r / (p + r + 1e-16))
    mean = np.mean(mean, 0)
    smooth = np.convolve(np.concatenate([np.full(50, mean[0]), mean, np.full(50, mean[-1])]), np.ones(101) / 101, "valid")
    best = metrics.best_scores(curves, "cls").collect()
    assert len(best) == 3 and {q.k for q in best} == {int(np.round(smooth, 12).argmax())}
    assert metrics.score_curves(df.limit(0), "cls", true.limit(0)).count() == 0


def test_words_of_a_table_are_no_single_task(spark, sf_dir, monkeypatch):
    from foliant.plans import queries

    monkeypatch.setattr(queries, "PART", 1 << 14, raising=False)
    n = [r["count"] for r in queries.lines(spark, sf_dir).groupBy(F.spark_partition_id()).count().collect()]
    plan = QUERIES["q_row_group"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(n) > 8 and plan.count("Sort [") == 1  # words are sorted once
