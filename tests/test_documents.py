import io
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliant import engines
from foliant.functions import geometry as g
from foliant.functions import text as t
from foliant.operators import anchors, boxes, layout, metrics, ranking
from foliant.sources import files, sinks
from foliant.streaming import sampling

# Hand-derived cases of field cleaning.
CASES = [
    (t.chinese_amount, "壹万贰仟叁佰肆拾伍元陆角柒分", "¥ 12345.67"), (t.chinese_amount, "拾贰万元", "¥ 20010.00"), (t.chinese_amount, None, "¥ 0.00"), (t.chinese_amount, "三百元整五角", "¥ 300.00"),
    (t.address, "地址：某市 某路1号，电话123", "某市 某路1号"), (t.address, "", ""), (t.bank, "开户行:工商银行 62 22", "工商银行 6222"), (t.bank, "账号：62", "62"), (t.bank, "无账户", "无账户"),
    (t.title_type, "增值税电子普通发票（通行费）", "14"), (t.title_type, "专用发票", "01"), (t.title_type, "x", None), (t.type_name, "08", "增值税电子专用发票"), (t.page, "第|页/共页", "1/1"), (t.page, "2 -3", "2/-3"),
    (t.url_file, "https://h.org/a/b%20c.txt?k=v", "b c.txt"), (t.listed, "1/2", "1、2"), (t.strip, "　a b\t", "a b"), (t.is_chinese, "a发", True), (t.is_ascii, "aé", False), (t.is_url, "RTSP://x", True), (t.is_url, None, False),
]


@pytest.mark.parametrize("f,given,want", CASES)
def test_field(spark, f, given, want):
    assert spark.createDataFrame([(given,)], "s string").select(f(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("given", ["2O24年O3月05日", "２０２４年03月05日", "20240305号"])
def test_misread_date(spark, given):
    df = spark.createDataFrame([(given,)], "s string")
    assert df.select(t.full_date(F.col("s"), F.lit("2024-12-31").cast("date"))).first()[0] == "2024年03月05日"


def test_points(spark):
    square, other = [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0]], [[2.0, -1.0], [6.0, 1.0], [4.0, 3.0], [1.0, 1.0]]
    p = F.col("p")
    r = spark.createDataFrame([(square,)], "p array<array<double>>").select(g.rotated_box(p).alias("b"), g.clockwise(F.shuffle(p)).alias("c"), g.resampled(p, 5).alias("s"), g.direction(F.lit(-1.0), F.lit(0.0)).alias("d"), g.even_parity(F.array(*map(F.lit, (1, 0, 1)))).alias("e"), g.rotated_points(F.lit(2.0), F.lit(1.0), F.lit(4.0), F.lit(2.0), F.lit(0.0)).alias("q"), F.array(*g.bounds(p)).alias("bounds")).first()
    assert tuple(r.b) == (0.0, 4.0, 2.0, 2.0, 1.0) and r.c == square and r.s == [*square, square[0]] and (r.d, r.e, r.q, r.bounds) == (180.0, True, square, [0.0, 0.0, 4.0, 2.0])
    # Against a count of fine grid points.
    a, b = (g.hull([tuple(x) for x in y]) for y in (square, other))
    inside = lambda h, x: all(g._turn(s, e, x) >= 0 for s, e in zip(h, h[1:] + h[:1], strict=True))
    cells = [(inside(a, x), inside(b, x)) for i in range(-50, 400) for j in range(-50, 200) if (x := (i / 50 + 0.01, j / 50 + 0.01))]
    assert g.polygon_iou(square, other) == pytest.approx(sum(m and n for m, n in cells) / sum(m or n for m, n in cells), abs=0.01)
    assert g.polygon_iou(square, [[9.0, 9.0]] * 4) == 0.0 and g.polygon_iou(square, square) == 1.0
    quads = spark.createDataFrame([(1, 0, square), (1, 1, other), (2, 0, square)], "page int, idx int, points array<array<double>>")
    assert sorted((x.l_page, x.l_idx, x.r_idx) for x in boxes.quad_pairs(quads, quads, "page", 0.9).collect()) == [(1, 0, 0), (1, 1, 1), (2, 0, 0)]


def test_ranks_and_curves(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.randrange(5), k, rnd.randrange(2)) for k in range(300)]
    df = spark.createDataFrame(rows, "cls string, conf int, k int, tp int")
    order, coarse = [F.desc("conf"), F.col("k")], [-F.col("conf"), F.floor(F.col("k") / 50)]
    whole = metrics.running_precision(df, "cls", order, F.lit(100)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, metrics.running_precision(df, "cls", order, F.lit(100), coarse).collect()))
    ranked = ranking.global_rank(df, coarse, order, "rank").collect()
    assert [r.k for r in sorted(ranked, key=lambda r: r.rank)] == [r[2] for r in sorted(rows, key=lambda r: (-r[1], r[2]))]
    assert metrics.running_precision(df.limit(0), "cls", order, F.lit(1), coarse).count() == 0
    none = metrics.average_precision(metrics.running_precision(df.limit(0), "cls", order, F.lit(1)), "cls", spark.createDataFrame([("a", 4)], "cls string, n_true long"))
    assert [(r.cls, r.ap) for r in none.collect()] == [("a", 0.0)]


def test_end_to_end(spark):
    true = spark.createDataFrame([("p", 0, 0, 0, 10, 10, "ＡＢ", False), ("p", 1, 20, 0, 30, 10, "cd", False), ("q", 0, 0, 0, 9, 9, "zz", True)], "page string, idx int, x1 int, y1 int, x2 int, y2 int, text string, ignored boolean")
    read = spark.createDataFrame([("p", 0, 0, 0, 10, 10, "AB"), ("p", 1, 50, 0, 60, 10, "xyz"), ("q", 0, 0, 0, 9, 9, "a")], "page string, idx int, x1 int, y1 int, x2 int, y2 int, text string")
    r = metrics.end_to_end(true, read, "page").first()
    # One hit; "xyz" is all wrong, "cd" was not read, and the ignored line counts nowhere.
    assert (r.hits, r.n_read, r.n_true, r.edits, r.n_chars, r.n_pages) == (1, 2, 2, 5, 4, 2)
    assert metrics.end_to_end(true.limit(0), read.limit(0), "page").first().hits == 0


def test_layout(spark):
    rows = [(1, 0, 30, 10), (1, 1, 5, 14), (1, 2, 60, 12), (1, 3, 1, 40), (2, 0, None, None)]
    df = spark.createDataFrame(rows[:4], "page int, idx int, x int, y int")
    assert [r.idx for r in sorted(layout.reading_order(df, "page", "x", "y").collect(), key=lambda r: r.place)] == [1, 0, 2, 3]
    lines = spark.createDataFrame([(1, 0, 5.0, 10.0, 4.0, 8.0, "b"), (1, 1, 1.0, 10.2, 2.0, 8.0, "a"), (1, 2, 1.0, 30.0, 2.0, 8.0, None)], "page int, n int, cx double, cy double, w double, h double, text string")
    assert [(r.row_id, r.text, r.x1, r.x2) for r in layout.merged_rows(lines, "page", "n").orderBy("row_id").collect()] == [(0, "a b", 0.0, 7.0), (1, "", 0.0, 2.0)]
    cells = spark.createDataFrame([(1, 0, 1, "x"), (1, 1, 0, "y")], "t int, row_idx int, col_idx int, text string")
    assert layout.grid(cells, "t").first().rows == [["", "x"], ["y", ""]]


def test_anchors(spark):
    rnd = random.Random(1)
    sizes = spark.createDataFrame([(c + rnd.random(), 2 * c + rnd.random()) for c in (10.0, 50.0, 200.0) for _ in range(40)], "w double, h double")
    found = anchors.cluster(sizes, 3)
    assert [round(w / 10) for w, _ in found] == [1, 5, 20]
    start = [(20.0, 20.0), (30.0, 90.0)]
    better = anchors.evolve(sizes, start, rounds=3)
    assert anchors.fit(sizes, better).first().fitness >= anchors.fit(sizes, start).first().fitness


def test_files(spark, tmp_path):
    for name in ("a.ofd", "b.ofd"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("OFD.xml", '<ofd:OFD xmlns:ofd="u"><ofd:CustomDatas><ofd:CustomData Name="税">1</ofd:CustomData> <ofd:CustomData Name="b"/></ofd:CustomDatas></ofd:OFD>')
    (tmp_path / "c.ofd").write_bytes(b"no archive")
    assert sorted(str(r.info) for r in files.read_ofd(spark, str(tmp_path / "*.ofd")).collect()) == ["None", "{'税': '1', 'b': ''}", "{'税': '1', 'b': ''}"]
    (tmp_path / "cats").mkdir()
    for name, data in (("x.JPG", b"1"), ("y.png", b""), ("z.doc", b"2")):
        (tmp_path / "cats" / name).write_bytes(data)
    assert [(r["class"], r.size, r.kind) for r in files.read_files(spark, str(tmp_path / "cats"), content=False).collect()] == [("cats", 1, "image")]
    (tmp_path / "page.txt").write_text("0\t0\t1\t0\t1\t1\t0\t1\t0\thello\n1\t2\n0\t0\t1\t0\t1\t1\t0\t1\t1\n")
    assert [(r.idx, r.text, r.ignored, r.points[2]) for r in files.read_flat_lines(spark, str(tmp_path / "page.txt"), True).orderBy("idx").collect()] == [(0, "hello", False, [1.0, 1.0]), (2, "", True, [1.0, 1.0])]
    (tmp_path / "classes.txt").write_text("a\nb\n")
    assert [tuple(r) for r in files.read_classes(spark, str(tmp_path / "classes.txt")).collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "m.csv").write_text("   epoch,    x/lr\n   1,  0.5\n")
    assert files.read_metrics(spark, str(tmp_path / "m.csv")).first().asDict() == {"epoch": 1, "x/lr": 0.5}
    got = files.fetch(spark.createDataFrame([("u",), ("",)], "url string"), "url", lambda u: {"u": b"x"}[u]).collect()
    assert sorted((r.content, r.error) for r in got if r.content) == [(b"x", None)] and [r.error for r in got if not r.content] == ["KeyError: ''"]


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([("r", 2, True, None, {"a": "1"}), ("r", 1, False, 'b"d', None)], "req string, attachment_id int, success boolean, message string, data map<string,string>")
    r = sinks.responses(items, "req").first()
    assert r.body == '{"result":[{"attachment_id":1,"success":false,"message":"b\\"d","data":{}},{"attachment_id":2,"success":true,"message":"","data":{"a":"1"}}],"code":200}' and r.succeeded == 1
    pages = spark.createDataFrame([("p", 1, "two"), ("p", 0, "one"), ("q", 0, "x")], "page string, n int, line string")
    sinks.write_pages(pages, "page", "n", "line", str(tmp_path / "pages"))
    assert [r.value for r in spark.read.text(str(tmp_path / "pages" / "page=p")).collect()] == ["one", "two"]
    sinks.write_cache(pages, str(tmp_path / "cache"), "v1")
    assert sorted(sinks.read_cache(spark, str(tmp_path / "cache"), "v1").collect()) == sorted(pages.collect()) and sinks.read_cache(spark, str(tmp_path / "cache"), "v2").count() == 0
    assert "a.png" in sinks.gallery(spark.createDataFrame([("g", "a", "a.png")], "g string, n string, s string"), "g", "n", "s").first().html


def test_streams(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "source string, at timestamp, n int"
    for k in range(3):
        spark.createDataFrame([(s, start + timedelta(seconds=10 * k + j), 10 * k + j) for s in "ab" for j in range(5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    q = sampling.run_latest(sampling.read_stream(spark, str(tmp_path / "in"), batch.schema), "source", "at", "n", str(tmp_path / "newest"), str(tmp_path / "c1"))
    q.processAllAvailable()
    assert sorted((r.source, r.n) for r in sampling.read_latest(spark, str(tmp_path / "newest")).collect()) == [("a", 24), ("b", 24)]
    spark.createDataFrame([("a", start, 99), ("c", start, 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    assert sorted((r.source, r.n) for r in sampling.read_latest(spark, str(tmp_path / "newest")).collect()) == [("a", 24), ("b", 24), ("c", 1)]
    q.stop()
    batch = spark.read.parquet(str(tmp_path / "in"))
    out = sampling.every_nth_stream(sampling.read_stream(spark, str(tmp_path / "in"), batch.schema), "source", ["at"], 4).writeStream.format("memory").queryName("strided").option("checkpointLocation", str(tmp_path / "c2")).start()
    out.processAllAvailable()
    assert sorted(spark.table("strided").collect()) == sorted(sampling.every_nth(batch, "source", ["at"], 4).collect())
    out.stop()


def test_engines(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, "c")], "k int, s string")

    def strict():
        return lambda rows: [{"text": {"a": "A", "c": "C"}[s], "score": 0.9} for (s,) in rows]

    def other():
        return lambda rows: [{"text": "else", "score": 0.5} for _ in rows]

    got = engines.run(df, strict, ["s"], "struct<text:string,score:double>").orderBy("k").collect()
    assert [(r.success, r.result and r.result.text) for r in got] == [(True, "A"), (False, None), (True, "C")] and got[1].message == "KeyError: ''"
    assert [r.text for r in engines.read_text(df, [strict, other], ["s"]).orderBy("k").collect()] == ["A", "else", "C"]


def test_rates(spark):
    got = [r.rate for r in metrics.rates(spark.range(3).toDF("step"), "step", 2, 1.0, 0.1).orderBy("step").collect()]
    assert got == pytest.approx([1.0, 0.55, 0.1])
