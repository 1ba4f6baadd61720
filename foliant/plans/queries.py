"""The engine's own queries over relations derived from the driver's tables, each with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import geometry as g
from foliant.functions import text as t
from foliant.operators import boxes as bx
from foliant.operators import anchors, layout, metrics, ranking, records
from foliant.streaming.latest import latest
from foliant.streaming.sampling import every_nth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ORDER = ("l_linenumber", "l_partkey", "l_suppkey")
#: Bytes of a table's files for each partition that its texts are dealt out to before they are taken apart.
PART = 4 << 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS image_id", *ORDER, "CAST(l_partkey % 900 AS INT) AS x1", "CAST((l_suppkey * 7) % 600 AS INT) AS y1",
        "CAST(l_partkey % 900 AS INT) + 10 + CAST(l_quantity AS INT) AS x2", "CAST((l_suppkey * 7) % 600 AS INT) + 8 + l_linenumber * 3 AS y2",
        "CAST(round(l_discount * 100) AS INT) AS conf", "l_linenumber % 3 AS cls",
    )


def by_conf() -> dict[str, list]:
    """Falling confidence, then the row's key; and steps of that order for windows of bounded size."""
    return {"order": [F.desc("conf"), F.col("image_id"), *(F.col(c) for c in ORDER)], "coarse": [-F.col("conf"), F.floor(F.col("image_id") / 4096)]}


BOXES = """boxes AS (SELECT l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey, (l_partkey % 900)::INT AS x1, ((l_suppkey * 7) % 600)::INT AS y1,
  (l_partkey % 900)::INT + 10 + l_quantity::INT AS x2, ((l_suppkey * 7) % 600)::INT + 8 + l_linenumber * 3 AS y2, round(l_discount * 100)::INT AS conf, l_linenumber % 3 AS cls FROM lineitem)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are dealt out by document before they are taken apart, so no word is shuffled by itself.
    # A number of partitions by size keeps adaptive execution from joining small ones, whose words would then be sorted in one task's memory.
    docs = table(spark, sf_dir, "documents")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    words = docs.select("doc_id", "text").repartition(parts, "doc_id").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "text"))
    return words.selectExpr("doc_id", "pos AS word_no", "text", "pos % 12 * 50 AS cx", "CAST(pos / 12 AS INT) * 14 + pos % 3 AS cy")


LINES = """lines AS (SELECT doc_id, (i - 1)::INT AS word_no, w[i] AS text, (i - 1) % 12 * 50 AS cx, (i - 1) // 12 * 14 + (i - 1) % 3 AS cy
  FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents), unnest(range(1, len(w) + 1)) AS r(i))"""


@query("SELECT o_orderkey, array_to_string(regexp_extract_all(translate('l' || o_orderkey || '-i' || o_custkey || o_orderstatus, 'lIi', '111'), '-?[0-9][0-9]*'), '') AS num, "
       "array_to_string(regexp_extract_all('x' || o_orderkey || o_orderstatus || ':' || o_custkey, '-?[0-9][0-9]*[a-zA-Z]*'), '') AS tax, o_orderpriority || 'name' AS title FROM orders")
def q_codes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", t.numbers(F.concat(F.lit("l"), "o_orderkey", F.lit("-i"), "o_custkey", "o_orderstatus")).alias("num"),
        t.tax_code(F.concat(F.lit("x"), "o_orderkey", "o_orderstatus", F.lit(":"), "o_custkey")).alias("tax"), t.title(F.concat("o_orderpriority", F.lit("：name:"))).alias("title"),
    )


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice * 100)::BIGINT AS c FROM orders)
SELECT o_orderstatus, count(*) AS n, sum(CASE WHEN o_orderkey % 4 IN (1, 3) THEN -c ELSE c END)::BIGINT AS cents FROM a GROUP BY 1""")
def q_amounts(spark, sf_dir):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    text = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    noisy = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("￥ "), text)).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("("), text, F.lit(")"))).when(F.col("o_orderkey") % 4 == 2, F.concat(text, F.lit(" 元"))).otherwise(F.concat(text, F.lit("-")))
    value = table(spark, sf_dir, "orders").select("o_orderstatus", F.round(t.amount_value(noisy) * 100).cast("long").alias("c"))
    return value.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("c").alias("cents"))


@query("SELECT o_orderkey, o_custkey || '/' || o_orderkey AS page, CASE WHEN o_orderkey % 2 = 0 THEN '校验码' || o_custkey ELSE greatest(o_custkey::VARCHAR, o_orderkey::VARCHAR) END AS code FROM orders")
def q_pages_codes(spark, sf_dir):
    code = t.check_code(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("校验码"), "o_custkey")).otherwise(F.col("o_custkey").cast("string")), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.page(F.concat(F.lit("第"), "o_custkey", F.lit("页/共"), "o_orderkey", F.lit("页"))).alias("page"), code.alias("code"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '32' WHEN 1 THEN '31' WHEN 2 THEN '08' WHEN 3 THEN '04' ELSE CASE WHEN o_custkey % 2 = 0 THEN '04' ELSE '01' END END AS kind FROM orders")
def q_invoice_type(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    title = F.when(k == 0, "电子发票(普通)").when(k == 1, "电子发票").when(k == 2, "电子专用发票").when(k == 3, "普通发票").otherwise("发票")
    return table(spark, sf_dir, "orders").select("o_orderkey", t.invoice_type(title, F.when(F.col("o_custkey") % 2 == 0, "7")).alias("kind"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y年%m月%d日') AS day, o_custkey::VARCHAR AS qr_number FROM orders")
def q_dates_qr(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    qr = t.invoice_qr(F.concat_ws(",", F.lit("01"), F.lit("04"), "o_orderkey", "o_custkey", F.lit("1.0")))
    return o.select("o_orderkey", t.full_date(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("2024-01-01").cast("date")).alias("day"), qr["number"].alias("qr_number"))


@query("SELECT doc_id, (length(text) - ceil(length(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')) / 2))::BIGINT AS width, levenshtein(source, lang || source)::INT + levenshtein(lang, source)::INT AS edits, source || '!a' AS half FROM documents")
def q_text_widths(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", t.display_length(F.col("text")).alias("width"), (F.levenshtein("source", F.concat("lang", "source")) + F.levenshtein("lang", "source")).alias("edits"), t.half_width(F.concat("source", F.lit("！ａ"))).alias("half"))


@query()
def q_edit_distance(spark, sf_dir):
    """Each benchmark item's edit distance from the next one, over whole texts and real characters."""
    b = table(spark, sf_dir, "benchmark")
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("after"))
    return b.join(after, "item_id").select("item_id", F.levenshtein("text", "after").alias("edits"))


@query("SELECT page_id, 'root/labels/' || page_id || '.txt' AS label_path FROM pages")
def q_label_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.label_path(F.concat(F.lit("root/images/"), "page_id", F.lit(".jpg"))).alias("label_path"))


@query(f"WITH {BOXES} SELECT image_id, l_linenumber, l_partkey, l_suppkey, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, least(x1, 640) AS kx1, least(y2, 480) AS ky2, 1000 - y2 AS turned FROM boxes")
def q_box_forms(spark, sf_dir):
    b = g.box()
    centre, kept, turned = g.to_centre(b), g.clip(b, 640, 480), g.quarter_turn(b, 90, 1000, 1000)
    return boxes(spark, sf_dir).select("image_id", *ORDER, centre[0].alias("cx"), centre[1].alias("cy"), kept[0].alias("kx1"), kept[3].alias("ky2"), turned[0].alias("turned"))


@query(f"""WITH {BOXES}, p AS (SELECT a.image_id, a.x1 AS ax, b.x1 AS bx, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM boxes AS a JOIN boxes AS b USING (image_id) WHERE a.l_partkey < b.l_partkey)
SELECT image_id, ax, bx, round(i / (s - i + 1e-7), 6) AS iou FROM p WHERE i / (s - i + 1e-7) > 0.01""")
def q_iou_pairs(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return bx.pairs(b, b, "image_id", 0.01).where("l_l_partkey < r_l_partkey").select(F.col("l_image_id").alias("image_id"), F.col("l_x1").alias("ax"), F.col("r_x1").alias("bx"), F.round("iou", 6).alias("iou"))


@query(f"""WITH {BOXES} SELECT r.image_id, r.l_partkey AS row_idx, c.l_partkey AS col_idx, greatest(r.x1, c.x1) AS x1, greatest(r.y1, c.y1) AS y1, least(r.x2, c.x2) AS x2, least(r.y2, c.y2) AS y2, least(r.conf, c.conf) AS conf
FROM boxes AS r JOIN boxes AS c ON r.image_id = c.image_id AND r.cls = 0 AND c.cls = 1 AND greatest(r.x1, c.x1) < least(r.x2, c.x2) AND greatest(r.y1, c.y1) < least(r.y2, c.y2)""")
def q_table_cells(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("idx", F.col("l_partkey"))
    return bx.cells(b.where("cls = 0"), b.where("cls = 1"), "image_id")


@query(f"""WITH {LINES}, n AS (SELECT *, CASE WHEN cy - lag(cy) OVER w >= 10 THEN 1 ELSE 0 END AS new FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY cy, word_no)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY cy, word_no ROWS UNBOUNDED PRECEDING)::BIGINT AS row_id FROM n)
SELECT doc_id, row_id, count(*) AS n, min(word_no) AS first_word, string_agg(text, ' ' ORDER BY cx, word_no) AS row_text FROM r GROUP BY 1, 2""")
def q_row_group(spark, sf_dir):
    rows = layout.row_groups(lines(spark, sf_dir), "doc_id", [F.col("word_no")])
    # By what pos is ranked by, so that words aren't sorted and ranked once more.
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cx", "word_no", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("doc_id", "row_id").agg(F.count("*").alias("n"), F.min("word_no").alias("first_word"), text.alias("row_text"))


@query("""WITH n AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM n) SELECT user_id, session_no, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY 1, 2""")
def q_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    out = layout.islands(e, "user_id", F.col("at"), 30 * 60 * 1_000_000, [F.col("event_id")], "session_no")
    return out.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(f"WITH {BOXES} SELECT image_id, cls, x1, y1, conf FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, conf DESC, x2 DESC) AS n FROM boxes) WHERE n = 1")
def q_keep_last(spark, sf_dir):
    return bx.keep_last(boxes(spark, sf_dir), ["image_id", "cls"], [F.col(c) for c in (*ORDER, "conf", "x2")]).select("image_id", "cls", "x1", "y1", "conf")


@query(f"""WITH {BOXES}, s AS (SELECT cls, conf, l_partkey, l_suppkey, image_id, l_linenumber, (x1 % 3 = 0)::INT AS tp FROM boxes),
w AS (SELECT *, sum(tp) OVER o AS t, sum(1 - tp) OVER o AS f FROM s WINDOW o AS (PARTITION BY cls ORDER BY conf DESC, image_id, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, max(t / (t + f)) OVER (PARTITION BY cls ORDER BY conf DESC, image_id, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM w)
SELECT image_id, l_linenumber, l_partkey, l_suppkey, t::BIGINT AS tp_sum, f::BIGINT AS fp_sum, round(t / (t + f), 6) AS "precision", round(env, 6) AS envelope FROM e""")
def q_pr_curve(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("tp", (F.col("x1") % 3 == 0).cast("int"))
    out = metrics.running_precision(b, "cls", n_true=F.lit(1000), **by_conf())
    return out.select("image_id", *ORDER, "tp_sum", "fp_sum", F.round("precision", 6).alias("precision"), F.round("envelope", 6).alias("envelope"))


@query(f"WITH {BOXES}, n AS (SELECT cls, count(*) AS n FROM boxes GROUP BY 1) SELECT cls, n, round(1.0 / n / (SELECT sum(1.0 / n) FROM n), 6)::DOUBLE AS weight FROM n")
def q_class_weights(spark, sf_dir):
    return metrics.class_weights(boxes(spark, sf_dir), "cls").select("cls", "n", F.round("weight", 6).alias("weight"))


@query(f"WITH {BOXES} SELECT cls, count(*) AS instances, count(DISTINCT image_id) AS images FROM boxes GROUP BY GROUPING SETS ((cls), ())")
def q_dataset_stats(spark, sf_dir):
    return boxes(spark, sf_dir).cube("cls").agg(F.count("*").alias("instances"), F.countDistinct("image_id").alias("images"))


@query("SELECT l_orderkey, list_filter(s, lambda x, i: x <> 0 AND (i = 1 OR x <> s[i - 1])) AS symbols FROM (SELECT l_orderkey, list(l_linenumber % 3 ORDER BY l_linenumber, l_partkey, l_suppkey) AS s FROM lineitem GROUP BY 1)")
def q_ctc_decode(spark, sf_dir):
    seq = F.transform(F.sort_array(F.collect_list(F.struct(*ORDER))), lambda x: x["l_linenumber"] % 3)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(seq.alias("s")).select("l_orderkey", t.collapse(F.col("s")).alias("symbols"))


@query("SELECT event_type, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS k_sum FROM events GROUP BY 1")
def q_json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k long")["k"]).alias("k_sum"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def q_latest(spark, sf_dir):
    return latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query(f"WITH {BOXES} SELECT image_id, '<tr>' || string_agg('<td>' || l_partkey || '</td>', '' ORDER BY l_linenumber, l_partkey, l_suppkey) || '</tr>' AS html FROM boxes GROUP BY 1")
def q_html_rows(spark, sf_dir):
    parts = F.transform(F.sort_array(F.collect_list(F.struct(*ORDER))), lambda x: x["l_partkey"].cast("string"))
    return boxes(spark, sf_dir).groupBy("image_id").agg(parts.alias("p")).select("image_id", t.html_row(F.col("p")).alias("html"))


@query("""WITH d AS (SELECT o_orderkey, o_orderkey // 10000 % 10 AS a, o_orderkey // 1000 % 10 AS b, o_orderkey // 100 % 10 AS c, o_orderkey // 10 % 10 AS d, o_orderkey % 10 AS e, o_custkey % 10 AS f, o_custkey // 10 % 10 AS g FROM orders)
SELECT o_orderkey, '¥ ' || (greatest(a, 1) * 10000 + greatest(b, 1) * 1000 + greatest(c, 1) * 100 + greatest(d, 1) * 10 + e) || '.' || f || g AS amount FROM d""")
def q_chinese_amount(spark, sf_dir):
    digit = lambda c, k: F.substring(F.lit("零壹贰叁肆伍陆柒捌玖"), (F.floor(F.col(c) / 10**k) % 10 + 1).cast("int"), F.lit(1))
    spelt = F.concat(digit("o_orderkey", 4), F.lit("万"), digit("o_orderkey", 3), F.lit("仟"), digit("o_orderkey", 2), F.lit("百"), digit("o_orderkey", 1), F.lit("拾"), digit("o_orderkey", 0), F.lit("圆"), digit("o_custkey", 0), F.lit("角"), digit("o_custkey", 1), F.lit("分"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.chinese_amount(spelt).alias("amount"))


@query("""SELECT s_suppkey, s_name || ' 路' || s_nationkey || '号，' || s_suppkey AS addr, CASE WHEN s_nationkey % 2 = 0 THEN '工商' || ' ' || s_suppkey || s_nationkey ELSE s_suppkey::VARCHAR END AS bank,
s_name AS title, s_suppkey || 'AB' AS tax FROM supplier""")
def q_party_fields(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    addr = F.concat(F.lit(" 单位地址： "), "s_name", F.lit("  路【"), "s_nationkey", F.lit("】号；,"), "s_suppkey", F.lit("， 电话 010-1 开户行"))
    bank = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("开户行及账号:工商★"), "s_suppkey", F.lit(" "), "s_nationkey")).otherwise(F.concat(F.lit("账号： "), "s_suppkey", F.lit(" ")))
    field = lambda label, text: t.field_text("vat", F.lit(label), text, F.lit("2024-01-01").cast("date")).alias(label.split("_")[1])
    return s.select("s_suppkey", field("buy_addr", addr), field("sale_bank", bank), field("buy_title", F.concat(F.lit(" "), "s_name", F.lit("："))), field("sale_tax", F.concat(F.lit("号"), "s_suppkey", F.lit("AB "))))


@query(r"""SELECT page_id, split_part(list_last(string_split(rtrim(url, '/'), '/')), '?', 1) AS file, regexp_matches(lower(url), '^(rtsp|rtmp|https?)://') AS is_url, NOT regexp_matches(html, '[^\x00-\x7F]') AS is_ascii FROM pages WHERE NOT contains(url, '%')""")
def q_url_files(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", t.url_file(F.col("url")).alias("file"), t.is_url(F.col("url")).alias("is_url"), t.is_ascii(F.col("html")).alias("is_ascii"))


@query(f"""WITH {BOXES}, d AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY conf DESC, image_id, l_linenumber, l_partkey, l_suppkey) AS rn, (x1 % 3 = 0)::INT AS tp FROM boxes),
n AS (SELECT cls, count(*) // 2 AS n FROM boxes GROUP BY 1), w AS (SELECT cls, rn, sum(tp) OVER (PARTITION BY cls ORDER BY rn) AS t FROM d),
pts AS (SELECT cls, 0 AS rn, 0::BIGINT AS t, 1.0::DOUBLE AS p FROM n UNION ALL SELECT cls, rn, t, t / rn FROM w),
e AS (SELECT *, max(p) OVER (PARTITION BY cls ORDER BY rn DESC) AS env FROM pts),
lo AS (SELECT e.cls, t, arg_max(env, rn) AS a, max(rn) AS rn FROM e GROUP BY ALL),
hi AS (SELECT e.cls, t, arg_min(env, rn) AS b FROM e GROUP BY ALL),
seg AS (SELECT lo.cls, lo.t, a, coalesce(b, 0.0) AS b, n.n, hi.t IS NULL AS last FROM lo JOIN n USING (cls) LEFT JOIN hi ON hi.cls = lo.cls AND hi.t = lo.t + 1),
v AS (SELECT cls, k, a + (k / 100 - t / n) / (CASE WHEN last THEN 1 - t / n ELSE 1 / n END) * (b - a) AS v FROM seg, range(0, 100) AS r(k) WHERE k * n >= 100 * t AND (last OR k * n < 100 * (t + 1)))
SELECT cls, n AS n_true, (SELECT max(t) FROM w WHERE w.cls = n.cls)::BIGINT AS tp, round((SELECT sum(v) - sum(CASE WHEN k = 0 THEN v ELSE 0 END) / 2 FROM v WHERE v.cls = n.cls) / 100, 6) AS ap FROM n""")
def q_ap(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("tp", (F.col("x1") % 3 == 0).cast("int"))
    n = b.groupBy("cls").agg(F.expr("count(*) div 2").alias("n_true"))
    return metrics.average_precision(metrics.running_precision(b, "cls", n_true=F.lit(1), **by_conf()), "cls", n).select("cls", "n_true", "tp", F.round("ap", 6).alias("ap"))


def shifted(b: DataFrame) -> DataFrame:
    """True boxes: those found, moved by up to two pixels; every eleventh is missing and every seventh has another class."""
    by = F.col("l_partkey") % 5 - 2
    return b.where("l_partkey % 11 <> 0").withColumns({"x1": F.col("x1") + by, "x2": F.col("x2") + by, "cls": F.when(F.col("l_partkey") % 7 == 0, (F.col("cls") + 1) % 3).otherwise(F.col("cls")).cast("int")})


def of_conf(b: DataFrame) -> DataFrame:
    return b.withColumn("conf", F.col("conf") / 10)


TRUE = "gt AS (SELECT image_id, l_linenumber, l_partkey, l_suppkey, x1 + l_partkey % 5 - 2 AS x1, y1, x2 + l_partkey % 5 - 2 AS x2, y2, CASE WHEN l_partkey % 7 = 0 THEN (cls + 1) % 3 ELSE cls END AS cls FROM boxes WHERE l_partkey % 11 <> 0)"


@query(f"""WITH {BOXES}, {TRUE}, det AS (SELECT * FROM boxes WHERE conf / 10 > 0.25),
p AS (SELECT d.image_id, d.l_linenumber AS a1, d.l_partkey AS a2, d.l_suppkey AS a3, g.l_linenumber AS b1, g.l_partkey AS b2, g.l_suppkey AS b3, d.cls AS dc, g.cls AS gc,
  greatest(0, least(d.x2, g.x2) - greatest(d.x1, g.x1)) * greatest(0, least(d.y2, g.y2) - greatest(d.y1, g.y1)) AS i, (d.x2 - d.x1) * (d.y2 - d.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) AS s FROM det AS d JOIN gt AS g USING (image_id)),
q AS (SELECT *, i / (s - i + 1e-7) AS iou FROM p WHERE i / (s - i + 1e-7) > 0.45),
m1 AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY image_id, a1, a2, a3 ORDER BY iou DESC, b1, b2, b3) = 1),
m AS (SELECT * FROM m1 QUALIFY row_number() OVER (PARTITION BY image_id, b1, b2, b3 ORDER BY iou DESC, a1, a2, a3) = 1)
SELECT dc AS pred, gc AS "true", count(*) AS n FROM m GROUP BY 1, 2
UNION ALL SELECT NULL, cls, n FROM (SELECT cls, count(*) - (SELECT count(*) FROM m WHERE m.gc = gt.cls) AS n FROM gt GROUP BY 1) WHERE n > 0
UNION ALL SELECT cls, NULL, n FROM (SELECT cls, count(*) - (SELECT count(*) FROM m WHERE m.dc = det.cls) AS n FROM det WHERE image_id IN (SELECT image_id FROM m) GROUP BY 1) WHERE n > 0""")
def q_confusion(spark, sf_dir):
    b = of_conf(boxes(spark, sf_dir))
    return metrics.confusion(b, shifted(b), "image_id", ORDER, ORDER)


@query(f"""WITH {BOXES} SELECT c.image_id, c.l_linenumber, c.l_partkey, c.l_suppkey,
(SELECT arg_min(r.l_partkey, (abs((r.y1 + r.y2) / 2 - (c.y1 + c.y2) / 2), r.l_partkey)) FROM boxes AS r WHERE r.image_id = c.image_id AND r.cls = 0) AS row_idx FROM boxes AS c WHERE c.cls = 2""")
def q_nearest_row(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("cy", (F.col("y1") + F.col("y2")) / 2).withColumn("idx", F.col("l_partkey"))
    return bx.nearest_line(b.where("cls = 2").drop("idx"), b.where("cls = 0"), "image_id", "cy", "row_idx").select("image_id", *ORDER, "row_idx")


@query(f"""WITH {BOXES}, s AS (SELECT *, floor((row_number() OVER (ORDER BY (y2 - y1) / (x2 - x1), image_id, l_linenumber, l_partkey, l_suppkey) - 1) / 64)::BIGINT AS batch, (y2 - y1) / (x2 - x1) AS ar FROM boxes)
SELECT batch, count(*) AS n, (ceil(round((CASE WHEN max(ar) < 1 THEN max(ar) ELSE 1 END) * 640 / 32 + 0.5, 9)) * 32)::BIGINT AS batch_h, (ceil(round((CASE WHEN min(ar) > 1 THEN 1 / min(ar) ELSE 1 END) * 640 / 32 + 0.5, 9)) * 32)::BIGINT AS batch_w FROM s GROUP BY 1""")
def q_rect_batches(spark, sf_dir):
    b = boxes(spark, sf_dir)
    ratio = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    out = ranking.shape_batches(b, ratio, [F.col("__ratio"), F.floor(F.col("image_id") / 4096)], [F.col("image_id"), *(F.col(c) for c in ORDER)], 64)
    return out.groupBy("batch").agg(F.count("*").alias("n"), F.first("batch_h").alias("batch_h"), F.first("batch_w").alias("batch_w"))


@query(f"""WITH {BOXES}, s AS (SELECT x2 - x1 AS w, y2 - y1 AS h FROM boxes), r AS (SELECT [least(least(w / 10, 10 / w), least(h / 13, 13 / h)), least(least(w / 16, 16 / w), least(h / 30, 30 / h)), least(least(w / 33, 33 / w), least(h / 23, 23 / h))] AS x FROM s)
SELECT round(avg((list_max(x) > 0.25)::INT), 6) AS recall, round(avg(len(list_filter(x, lambda v: v > 0.25))), 6) AS per_box, round(avg(CASE WHEN list_max(x) > 0.25 THEN list_max(x) ELSE 0 END), 6) AS fitness FROM r""")
def q_anchor_fit(spark, sf_dir):
    sizes = boxes(spark, sf_dir).selectExpr("x2 - x1 AS w", "y2 - y1 AS h")
    return anchors.fit(sizes, [(10, 13), (16, 30), (33, 23)]).select(*(F.round(c, 6).alias(c) for c in ("recall", "per_box", "fitness")))


@query(f"""WITH {BOXES}, c AS (SELECT cls, count(*) AS n FROM boxes GROUP BY 1), w AS (SELECT cls, (1.0::DOUBLE / n) / (SELECT sum(1.0::DOUBLE / n) FROM c) AS w FROM c) SELECT image_id, round(sum(w), 6) AS weight FROM boxes JOIN w USING (cls) GROUP BY 1""")
def q_image_weights(spark, sf_dir):
    return metrics.image_weights(boxes(spark, sf_dir), "image_id", "cls").select("image_id", F.round("weight", 6).alias("weight"))


@query(f"""WITH {BOXES}, c AS (SELECT image_id, cls, count(*) AS n FROM boxes GROUP BY 1, 2) SELECT image_id, string_agg(n || ' ' || cls || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY cls) AS summary FROM c GROUP BY 1""")
def q_image_summary(spark, sf_dir):
    return metrics.summary(boxes(spark, sf_dir), "image_id", "cls")


@query("""WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT CASE WHEN hi = lo THEN 0 ELSE least(floor((l_quantity - lo) * 20 / (hi - lo)), 19) END::BIGINT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1""")
def q_hist(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 20)


@query(f"""WITH {BOXES}, e AS (SELECT min(x1) AS lx, max(x1) AS hx, min(y1) AS ly, max(y1) AS hy FROM boxes), b AS (SELECT least(floor((x1 - lx) * 30 / (hx - lx)), 29)::BIGINT AS bin_x, least(floor((y1 - ly) * 30 / (hy - ly)), 29)::BIGINT AS bin_y FROM boxes, e)
SELECT bin_x, bin_y, count(*) AS n, round(ln(count(*)), 6) AS log_n FROM b GROUP BY 1, 2""")
def q_hist2d(spark, sf_dir):
    return metrics.histogram2d(boxes(spark, sf_dir), "x1", "y1", 30).withColumn("log_n", F.round("log_n", 6))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of each kind of event, numbered by day."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("step"))
    return days.agg(F.count("*").alias("value"))


SERIES = "series AS (SELECT event_type, (ts::DATE - DATE '1970-01-01')::INT AS step, count(*) AS value FROM events GROUP BY 1, 2)"


@query(f"""WITH {SERIES} SELECT event_type, step, max(value) OVER w AS best, (step - max(CASE WHEN value >= top THEN step END) OVER w)::INT AS since FROM (SELECT *, max(value) OVER (PARTITION BY event_type ORDER BY step) AS top FROM series) WINDOW w AS (PARTITION BY event_type ORDER BY step)""")
def q_early_stop(spark, sf_dir):
    return metrics.patience(series(spark, sf_dir), "event_type", "step", "value").select("event_type", "step", "best", "since")


@query(f"""WITH {SERIES}, n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY event_type) AS n, first(value) OVER w AS a, last(value) OVER (PARTITION BY event_type ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM series WINDOW w AS (PARTITION BY event_type ORDER BY step))
SELECT x.event_type, x.step, round((sum(y.value) + greatest(2 - x.k, 0) * any_value(x.a) + greatest(x.k + 1 - any_value(x.n), 0) * any_value(x.z)) / 3, 6) AS smooth FROM n AS x JOIN n AS y ON x.event_type = y.event_type AND abs(x.k - y.k) <= 1 GROUP BY x.event_type, x.step, x.k""")
def q_smooth(spark, sf_dir):
    return metrics.smooth(series(spark, sf_dir), "event_type", "step", "value", 50).select("event_type", "step", F.round("smooth", 6).alias("smooth"))


@query(f"""WITH RECURSIVE {SERIES}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY step) - 1 AS k FROM series),
r AS (SELECT event_type, k, value::DOUBLE AS v FROM n WHERE k = 0 UNION ALL SELECT n.event_type, n.k, 0.9 * (1 - exp(-n.k / 5)) * r.v + (1 - 0.9 * (1 - exp(-n.k / 5))) * n.value FROM r JOIN n ON n.event_type = r.event_type AND n.k = r.k + 1)
SELECT event_type, round(arg_max(v, k), 6) AS ema FROM r GROUP BY 1""")
def q_ema(spark, sf_dir):
    return metrics.moving_average(series(spark, sf_dir), "event_type", "step", "value", 0.9, 5.0).select("event_type", F.round("ema", 6).alias("ema"))


@query(f"WITH {SERIES} SELECT event_type, step, value FROM series QUALIFY row_number() OVER (ORDER BY value DESC, step, event_type) = 1")
def q_fitness_best(spark, sf_dir):
    s = series(spark, sf_dir)
    once = s.groupBy("step").agg(F.max_by(F.struct("value", "event_type"), F.struct("value", -F.ascii("event_type"))).alias("r")).select("step", "r.*")
    return metrics.best_row(once, "value", "step").select("event_type", "step", "value")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 4 = 0")
def q_stream_stride(spark, sf_dir):
    return every_nth(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 4).select("user_id", "event_id")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows of orders: number twice, code, total, tax and check code by line."""
    pick = F.array(F.lit("invoice_number"), F.lit("total"), F.lit("tax"), F.lit("check_code"), F.lit("invoice_number2"), F.lit("other"))
    li = table(spark, sf_dir, "lineitem").withColumn("label", F.element_at(pick, (F.col("l_linenumber") % 6 + 1).cast("int")))
    return li.select(F.col("l_orderkey").alias("doc"), F.struct(*ORDER).alias("seq"), "label", F.concat(F.lit(" "), "l_partkey", F.when(F.col("label") == "total", ".50 元").otherwise("")).alias("text"))


@query("""WITH f AS (SELECT l_orderkey AS doc, CASE l_linenumber % 6 WHEN 0 THEN 'number' WHEN 1 THEN 'total' WHEN 2 THEN 'tax' WHEN 3 THEN 'check' WHEN 4 THEN 'number2' ELSE 'other' END AS label, l_partkey::VARCHAR AS text, l_linenumber AS a, l_partkey AS b, l_suppkey AS c FROM lineitem),
g AS (SELECT *, CASE WHEN label = 'check' AND row_number() OVER (PARTITION BY doc, label ORDER BY a, b, c) > 1 THEN 'check2' ELSE label END AS l FROM f), h AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc, l ORDER BY a DESC, b DESC, c DESC) = 1),
r AS (SELECT doc, coalesce(max(text) FILTER (l = 'number'), '') AS n1, coalesce(max(text) FILTER (l = 'number2'), '') AS n2, coalesce('¥ ' || max(text) FILTER (l = 'total') || '.50', '¥ 0.00') AS total_amount, coalesce('¥ ' || max(text) FILTER (l = 'tax') || '.00', '¥ 0.00') AS tax,
  coalesce(' ' || max(text) FILTER (l = 'check'), '') AS c1, coalesce(' ' || max(text) FILTER (l = 'check2'), '') AS c2 FROM h GROUP BY 1 HAVING bool_or(l <> 'other'))
SELECT doc, CASE WHEN length(n1) = 8 THEN n1 WHEN length(n2) = 8 OR length(n2) > length(n1) THEN n2 ELSE n1 END AS invoice_number, total_amount, CASE WHEN tax = '¥ 0.00' THEN '¥ ' || CASE WHEN total_amount = '¥ 0.00' THEN '0.0' ELSE substr(total_amount, 3, length(total_amount) - 3) END ELSE tax END AS tax, greatest(c1, c2) AS check_code FROM r""")
def q_record_pivot(spark, sf_dir):
    rows = records.second_check_codes(fields(spark, sf_dir), "doc", "seq")
    made = records.assemble(rows, "doc", "seq", records.VAT, "vat", F.lit("2024-01-01").cast("date"), records.VAT_AMOUNTS)
    return records.settle_doubles(records.settle_tax(made)).select("doc", "invoice_number", "total_amount", "tax", "check_code")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '02' WHEN o_orderkey % 5 = 0 AND o_custkey % 2 = 0 THEN '01' WHEN o_custkey % 3 = 0 THEN '01' WHEN o_custkey % 4 = 0 THEN '02' ELSE '03' END AS kind FROM orders""")
def q_cascade(spark, sf_dir):
    when = lambda c, v: F.when(F.expr(c), v)
    kind = records.document_kind(when("o_orderkey % 14 = 0", "总务单"), when("o_orderkey % 7 = 0 AND o_orderkey % 14 <> 0", "药品单"), when("o_orderkey % 5 = 0", "收据"), when("o_custkey % 2 = 0", "04"), when("o_custkey % 3 = 0", "01"), F.expr("o_custkey % 4 = 0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"))


def _quad() -> list:
    return [F.array(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))]


@query(f"""WITH {BOXES} SELECT image_id, l_linenumber, l_partkey, l_suppkey, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / 2 AS cx, x2 AS second_x, y1 AS second_y, x1 AS mid_x, (y1 + y2) / 2 + 0.0 AS far_y FROM boxes""")
def q_rotated_box(spark, sf_dir):
    p = F.array(*_quad())
    r, turned, sampled = g.rotated_box(p), g.clockwise(F.reverse(p)), g.resampled(p, 9)
    return boxes(spark, sf_dir).select("image_id", *ORDER, r["w"].cast("int").alias("w"), r["h"].cast("int").alias("h"), r["cx"].alias("cx"), turned[1][0].cast("int").alias("second_x"), turned[1][1].cast("int").alias("second_y"), sampled[8][0].cast("int").alias("mid_x"), sampled[3][1].alias("far_y"))


@query(f"""WITH {BOXES} SELECT image_id, array_to_string(list_transform(range(0, max(l_linenumber) + 1), lambda i: coalesce(map_from_entries(list((l_linenumber, l_partkey)))[i]::VARCHAR, '')), '|') AS first_column FROM (SELECT image_id, l_linenumber, min(l_partkey) AS l_partkey FROM boxes GROUP BY 1, 2) GROUP BY 1""")
def q_table_matrix(spark, sf_dir):
    c = boxes(spark, sf_dir).groupBy("image_id", F.col("l_linenumber").alias("row_idx")).agg(F.min("l_partkey").cast("string").alias("text")).withColumn("col_idx", F.lit(0))
    return layout.grid(c, "image_id").select("image_id", F.array_join(F.transform("rows", lambda r: r[0]), "|").alias("first_column"))


@query()
def q_e2e_eval(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("idx", F.struct(*ORDER)).withColumn("text", F.col("l_partkey").cast("string"))
    return metrics.end_to_end(shifted(b).withColumn("ignored", F.col("l_suppkey") % 13 == 0), b, "image_id")


@query()
def q_reading_order(spark, sf_dir):
    return layout.reading_order(boxes(spark, sf_dir).select("image_id", *ORDER, "x1", "y1"), "image_id", "x1", "y1")


@query()
def q_kmeans_anchors(spark, sf_dir):
    sizes = boxes(spark, sf_dir).selectExpr("CAST(x2 - x1 AS DOUBLE) AS w", "CAST(y2 - y1 AS DOUBLE) AS h")
    found = anchors.cluster(sizes, 3)
    return spark.createDataFrame([(k, round(w, 3), round(h, 3)) for k, (w, h) in enumerate(found)], "anchor int, w double, h double")
