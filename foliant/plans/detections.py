"""More of the engine's queries, over the same relations as in queries.py, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import geometry as g
from foliant.functions import text as t
from foliant.operators import boxes as bx
from foliant.operators import layout, metrics, ranking, records
from foliant.plans.queries import BOXES, ORDER, boxes, by_conf, query, table
from foliant.sources import annotations, files

OF = "image_id, l_linenumber, l_partkey, l_suppkey"


def rounded(places: int = 6, **columns):
    return [F.round(c, places).alias(name) for name, c in columns.items()]


#: The last column of `boxes` pairs: each box beside one shifted by its own numbers.
PAIR = f"""{BOXES}, p AS (SELECT *, x1 + l_partkey % 7 AS u1, y1 + l_suppkey % 5 AS v1, x2 + l_partkey % 7 + l_linenumber AS u2, y2 + l_suppkey % 5 AS v2 FROM boxes),
i AS (SELECT *, greatest(least(x2, u2) - greatest(x1, u1), 0) * greatest(least(y2, v2) - greatest(y1, v1), 0) AS inter, (x2 - x1) * (y2 - y1) AS a, (u2 - u1) * (v2 - v1) AS b FROM p)"""


def box_pairs(spark, sf_dir):
    return boxes(spark, sf_dir).selectExpr("*", "x1 + l_partkey % 7 AS u1", "y1 + l_suppkey % 5 AS v1", "x2 + l_partkey % 7 + l_linenumber AS u2", "y2 + l_suppkey % 5 AS v2")


@query(f"""WITH {PAIR}, d AS (SELECT *, inter / (a + b - inter + 1e-7) AS iou, (greatest(x2, u2) - least(x1, u1)) AS cw, (greatest(y2, v2) - least(y1, v1)) AS ch,
  ((u1 + u2 - x1 - x2) ** 2 + (v1 + v2 - y1 - y2) ** 2) / 4 AS rho FROM i),
e AS (SELECT *, cw * ch + 1e-7 AS hull, cw ** 2 + ch ** 2 + 1e-7 AS diag, 4 / pi() ** 2 * (atan((u2 - u1) / (v2 - v1 + 1e-7)) - atan((x2 - x1) / (y2 - y1 + 1e-7))) ** 2 AS v FROM d)
SELECT {OF}, round(iou - (hull - (a + b - inter + 1e-7)) / hull, 6) AS giou, round(iou - rho / diag, 6) AS diou, round(iou - (rho / diag + v * v / (v - iou + 1 + 1e-7)), 6) AS ciou, round(inter / (b + 1e-7), 6) AS inside FROM e""")
def q_iou_kinds(spark, sf_dir):
    a, b = g.box(), tuple(F.col(c) for c in ("u1", "v1", "u2", "v2"))
    kinds = {k: g.iou(a, b, k) for k in ("giou", "diou", "ciou")}
    return box_pairs(spark, sf_dir).select("image_id", *ORDER, *rounded(**kinds, inside=g.inside_share(a, b)))


@query(f"""WITH {PAIR}, s AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, greatest(x2 - x1, y2 - y1) AS side FROM i)
SELECT {OF}, round((x1 - 16) / 0.5, 6) AS unscaled_x1, round((y2 - 8) / 0.5, 6) AS unscaled_y2, round(cx / 1000, 6) AS share_x, round(h / 700, 6) AS share_h,
  round((cx / 1000 - w / 1000.0 / 2) * 1000 + 3, 4) AS back_x1, greatest(x1 - 4, 0)::INT AS grown_x1, least(x2 + 4, 900)::INT AS grown_x2, round(cx - (side * 1.02 + 10) / 2, 6) AS crop_x1,
  round(least(least(w / 30.0, 30.0 / w), least(h / 20.0, 20.0 / h)), 6) AS size_ratio, round(least(w, u2 - u1) * least(h, v2 - v1) / (w * h + (u2 - u1) * (v2 - v1) - least(w, u2 - u1) * least(h, v2 - v1) + 1e-7), 6) AS size_iou,
  (u2 - u1 > 2 AND v2 - v1 > 2 AND b / (a + 1e-16) > 0.1 AND greatest((u2 - u1) / (v2 - v1 + 1e-16), (v2 - v1) / (u2 - u1 + 1e-16)) < 100) AS keeps,
  floor(h * abs(sin(radians(30))) + w * abs(cos(radians(30))))::BIGINT AS canvas_w, round(degrees(atan2(h, w)), 6) AS direction FROM s""")
def q_box_shapes(spark, sf_dir):
    b, o = g.box(), tuple(F.col(c) for c in ("u1", "v1", "u2", "v2"))
    w, h = b[2] - b[0], b[3] - b[1]
    back, share, grown = g.unscale(b, 0.5, 16, 8), g.normalised(b, 1000, 700), g.grown(b, 4, 4, 900, 700)
    return box_pairs(spark, sf_dir).select(
        "image_id", *ORDER, *rounded(unscaled_x1=back[0], unscaled_y2=back[3]), share[0].alias("share_x"), share[3].alias("share_h"),
        F.round(g.denormalised((g.to_centre(b)[0] / 1000, g.to_centre(b)[1] / 700, w / 1000, h / 700), 1000, 700, 3, 3)[0], 4).alias("back_x1"),
        grown[0].alias("grown_x1"), grown[2].alias("grown_x2"), *rounded(crop_x1=g.crop_square(b, square=True)[0], size_ratio=g.size_ratio(w, h, 30.0, 20.0), size_iou=g.size_iou(w, h, o[2] - o[0], o[3] - o[1])),
        g.keeps_shape(b, o).alias("keeps"), g.turned_canvas(w, h, 30)[0].alias("canvas_w"), F.round(g.direction(w, h), 6).alias("direction"),
    )


@query(f"""WITH {BOXES}, q AS (SELECT *, greatest(x1 - 5, 0) AS a, greatest(y1 - 5, 0) AS b, least(x2 + 5, 900) AS c, least(y2 + 5, 600) AS d, x2 - x1 AS w, y2 - y1 AS h FROM boxes),
f AS (SELECT *, CASE WHEN 416.0 / least(w, h) * greatest(w, h) > 608 THEN 608.0 / greatest(w, h) ELSE 416.0 / least(w, h) END AS f FROM q)
SELECT {OF}, CASE WHEN c - a < 270 THEN 0 ELSE greatest(least(a, 899), 0) END::INT AS line_x1, greatest(greatest(least(b, 599), 0) + 1, least(d, 600))::INT AS line_y2,
  (floor(floor(w * f) / 32) * 32)::BIGINT AS fit_w, (floor(floor(h * f) / 32) * 32)::BIGINT AS fit_h, (l_partkey + l_suppkey + l_linenumber) % 2 = 0 AS even, (2 * y1 + 2 * y2)::DOUBLE AS height FROM f""")
def q_line_boxes(spark, sf_dir):
    b = g.box()
    line, fit = g.line_box(b, 900, 600), g.fitted_size(b[2] - b[0], b[3] - b[1])
    bits = F.array(*(F.col(c).cast("long") % 2 for c in ("l_partkey", "l_suppkey", "l_linenumber"))).cast("array<int>")
    corners = F.array(*(g.point(b[x], b[y]) for x, y in ((0, 1), (2, 1), (2, 3), (0, 3))))
    return boxes(spark, sf_dir).select("image_id", *ORDER, line[0].cast("int").alias("line_x1"), line[3].cast("int").alias("line_y2"), fit[0].cast("long").alias("fit_w"), fit[1].cast("long").alias("fit_h"), g.even_parity(bits).alias("even"), g.height_of(corners).alias("height"))


@query(f"""WITH RECURSIVE {BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM boxes),
f AS (SELECT image_id, 0::BIGINT AS k, []::STRUCT(x1 INT, y1 INT, x2 INT, y2 INT, cls BIGINT, part BIGINT)[] AS kept FROM (SELECT DISTINCT image_id FROM boxes)
UNION ALL SELECT f.image_id, r.k, CASE WHEN len(list_filter(f.kept, lambda b: b.cls = r.cls AND
  greatest(least(b.x2, r.x2) - greatest(b.x1, r.x1), 0) * greatest(least(b.y2, r.y2) - greatest(b.y1, r.y1), 0) / ((b.x2 - b.x1) * (b.y2 - b.y1) + (r.x2 - r.x1) * (r.y2 - r.y1)
  - greatest(least(b.x2, r.x2) - greatest(b.x1, r.x1), 0) * greatest(least(b.y2, r.y2) - greatest(b.y1, r.y1), 0))::DOUBLE > 0.3)) > 0 THEN f.kept
  ELSE list_append(f.kept, struct_pack(x1 := r.x1, y1 := r.y1, x2 := r.x2, y2 := r.y2, cls := r.cls::BIGINT, part := r.l_partkey)) END FROM f JOIN r ON r.image_id = f.image_id AND r.k = f.k + 1),
l AS (SELECT image_id, max_by(kept, k) AS kept FROM f GROUP BY 1) SELECT image_id, b.part AS l_partkey, b.cls::INT AS cls, b.x1, b.y2 FROM l, unnest(kept) AS u(b)""")
def q_nms(spark, sf_dir):
    return bx.suppress(boxes(spark, sf_dir), "image_id", "cls", ORDER, 0.3).select("image_id", "l_partkey", "cls", "x1", "y2")


@query(f"""WITH RECURSIVE {BOXES}, d AS (SELECT *, l_partkey * 100 + l_linenumber AS det, x1 + l_partkey % 5 - 2 AS tx1, x2 + l_partkey % 5 - 2 AS tx2 FROM boxes),
p AS (SELECT a.image_id, a.det AS l_det, b.det AS r_det, greatest(least(a.x2, b.tx2) - greatest(a.x1, b.tx1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.tx2 - b.tx1) * (b.y2 - b.y1) AS s FROM d AS a JOIN d AS b USING (image_id)),
o AS (SELECT image_id, l_det, r_det, i / (s - i + 1e-7) AS iou, row_number() OVER (PARTITION BY image_id ORDER BY i / (s - i + 1e-7) DESC, l_det, r_det) AS k FROM p WHERE i / (s - i + 1e-7) > 0.5),
f AS (SELECT image_id, 0::BIGINT AS k, []::STRUCT(a BIGINT, b BIGINT, iou DOUBLE)[] AS kept FROM (SELECT DISTINCT image_id FROM o)
UNION ALL SELECT f.image_id, o.k, CASE WHEN len(list_filter(f.kept, lambda m: m.a = o.l_det OR m.b = o.r_det)) > 0 THEN f.kept ELSE list_append(f.kept, struct_pack(a := o.l_det, b := o.r_det, iou := o.iou)) END
  FROM f JOIN o ON o.image_id = f.image_id AND o.k = f.k + 1), l AS (SELECT image_id, max_by(kept, k) AS kept FROM f GROUP BY 1)
SELECT image_id, m.a AS l_det, m.b AS r_det, round(m.iou, 6) AS iou FROM l, unnest(kept) AS u(m)""")
def q_greedy_match(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("det", F.col("l_partkey") * 100 + F.col("l_linenumber"))
    truth = b.withColumn("x1", F.col("x1") + F.col("l_partkey") % 5 - 2).withColumn("x2", F.col("x2") + F.col("l_partkey") % 5 - 2)
    return bx.greedy_match(bx.pairs(b, truth, "image_id", 0.5).withColumn("image_id", F.col("l_image_id")), "image_id", "l_det", "r_det").withColumn("iou", F.round("iou", 6))


@query(f"""WITH {BOXES}, k AS (SELECT * FROM boxes WHERE l_linenumber = 1), p AS (SELECT k.image_id, k.l_partkey, r.conf + 1 AS c, r.x1, r.y2,
  greatest(least(k.x2, r.x2) - greatest(k.x1, r.x1), 0) * greatest(least(k.y2, r.y2) - greatest(k.y1, r.y1), 0) AS i, (k.x2 - k.x1) * (k.y2 - k.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) AS s
  FROM k JOIN boxes AS r ON k.image_id = r.image_id AND k.cls = r.cls)
SELECT image_id, l_partkey, round(sum(x1 * c) / sum(c), 6) AS x1, round(sum(y2 * c) / sum(c), 6) AS y2 FROM p WHERE i / (s - i + 1e-7) > 0.1 GROUP BY ALL""")
def q_merged_boxes(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("conf", F.col("conf") + 1)
    kept = b.where("l_linenumber = 1").select("image_id", "l_partkey", "cls", "x1", "y1", "x2", "y2")
    return bx.merged(kept, b, "image_id", 0.1).select("image_id", "l_partkey", *rounded(x1=F.col("x1"), y2=F.col("y2")))


@query("""WITH e AS (SELECT vec_id, (vec_id % 10) / 10.0::DOUBLE AS obj, [abs(embedding[i]::DOUBLE) FOR i IN range(1, 4)] AS s FROM embeddings)
SELECT vec_id, (i - 1)::INT AS cls, round(obj * s[i], 6) AS conf FROM e, unnest(range(1, 4)) AS r(i) WHERE obj > 0.3 AND obj * s[i] > 0.05""")
def q_labelled(spark, sf_dir):
    scores = F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", ((F.col("vec_id") % 10) / 10.0).alias("obj"), scores.alias("scores"))
    return bx.labelled(rows.where("obj > 0.3"), "scores", 0.05).select("vec_id", "cls", F.round("conf", 6).alias("conf"))


@query("""WITH m AS (SELECT vec_id, [(x > 0)::INT::DOUBLE FOR x IN embedding] AS a, [(x > 0.02)::INT::DOUBLE FOR x IN embedding] AS b FROM embeddings)
SELECT vec_id, round(list_dot_product(a, b) / (list_sum(a) + list_sum(b) - list_dot_product(a, b) + 1e-7), 6) AS iou FROM m""")
def q_mask_iou(spark, sf_dir):
    mask = lambda least: F.transform("embedding", lambda x: (x.cast("double") > least).cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(bx.mask_iou(mask(0.0), mask(0.02)), 6).alias("iou"))


COUNTS = f"{BOXES}, m AS (SELECT cls AS pred, l_partkey % 3 AS said, count(*) AS n FROM boxes GROUP BY ALL)"


@query(f"WITH {COUNTS} SELECT pred AS cls, sum(CASE WHEN pred = said THEN n ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN pred = said THEN 0 ELSE n END)::BIGINT AS fp FROM m GROUP BY 1")
def q_right_wrong(spark, sf_dir):
    matrix = boxes(spark, sf_dir).groupBy(F.col("cls").alias("pred"), (F.col("l_partkey") % 3).cast("int").alias("true")).agg(F.count("*").alias("n"))
    return metrics.right_and_wrong(matrix)


@query(f"""WITH {BOXES}, p AS (SELECT a.image_id, a.l_partkey AS d, b.l_partkey AS t, greatest(least(a.x2, b.x2 + 3) - greatest(a.x1, b.x1 + 3), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM boxes AS a JOIN boxes AS b USING (image_id)),
e AS (SELECT image_id, d, t, i / (s - i + 1e-7) AS iou, (50 + 5 * j) / 100.0::DOUBLE AS threshold FROM p, unnest(range(0, 10)) AS r(j) WHERE i / (s - i + 1e-7) > (50 + 5 * j) / 100.0::DOUBLE),
a AS (SELECT *, row_number() OVER (PARTITION BY threshold, image_id, d ORDER BY iou DESC, t) AS n FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY threshold, image_id, t ORDER BY iou DESC, d) AS m FROM a WHERE n = 1)
SELECT round(threshold, 2) AS threshold, count(*) AS n, count(DISTINCT image_id) AS images FROM b WHERE m = 1 GROUP BY 1""")
def q_matches_at(spark, sf_dir):
    b = boxes(spark, sf_dir)
    found = bx.pairs(b, b.withColumn("x1", F.col("x1") + 3).withColumn("x2", F.col("x2") + 3), "image_id", 0.5)
    best = metrics.matches_at(found, ["l_image_id", "l_l_partkey"], ["r_image_id", "r_l_partkey"], [(50 + 5 * k) / 100 for k in range(10)])
    return best.groupBy(F.round("threshold", 2).alias("threshold")).agg(F.count("*").alias("n"), F.countDistinct("l_image_id").alias("images"))


@query(f"""WITH {BOXES} SELECT image_id, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY image_id ORDER BY (y1 + y2) / 2, l_linenumber, l_partkey, l_suppkey) - 1 AS row_idx FROM boxes""")
def q_ordinal(spark, sf_dir):
    found = layout.ordinal(boxes(spark, sf_dir), "image_id", (F.col("y1") + F.col("y2")) / 2, [F.col(c) for c in ORDER], "row_idx")
    return found.select("image_id", *ORDER, F.col("row_idx").cast("long").alias("row_idx"))


@query("""WITH c AS (SELECT l_orderkey AS table_id, (l_linenumber - 1) // 3 AS r, (l_linenumber - 1) % 3 AS c, min(l_returnflag) || l_linenumber AS t FROM lineitem GROUP BY l_orderkey, l_linenumber),
s AS (SELECT table_id, max(r) AS mr, max(c) AS mc FROM c GROUP BY 1), k AS (SELECT s.table_id, i, j FROM s, unnest(range(0, 9)) AS a(i), unnest(range(0, 3)) AS b(j) WHERE i <= mr AND j <= mc),
l AS (SELECT k.table_id, i, string_agg(coalesce(c.t, ''), ',' ORDER BY j) AS line FROM k LEFT JOIN c ON c.table_id = k.table_id AND c.r = i AND c.c = j GROUP BY 1, 2) SELECT table_id, string_agg(line, ';' ORDER BY i) AS grid FROM l GROUP BY 1""")
def q_grid(spark, sf_dir):
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    cells = one.selectExpr("l_orderkey AS table_id", "CAST((l_linenumber - 1) DIV 3 AS INT) AS row_idx", "(l_linenumber - 1) % 3 AS col_idx", "concat(f, l_linenumber) AS text")
    return layout.grid(cells, "table_id").select("table_id", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("grid"))


@query("""SELECT d.doc_id, CASE WHEN l.p IS NULL THEN 'missing' WHEN l.v THEN 'found' ELSE 'corrupt' END AS state FROM documents AS d
LEFT JOIN (SELECT doc_id AS p, min(toxic) = 0 AS v FROM labels GROUP BY 1) AS l ON d.doc_id = l.p""")
def q_label_files(spark, sf_dir):
    images = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("set/images/"), "doc_id", F.lit(".png")).alias("path"))
    labels = table(spark, sf_dir, "labels").select(F.concat(F.lit("set/labels/"), "doc_id", F.lit(".txt")).alias("label_path"), (F.col("toxic") == 0).alias("valid"))
    return files.with_labels(images, labels).select("doc_id", "state")


@query(r"""SELECT s_suppkey, 'x' || s_suppkey AS stock_code, regexp_replace(s_name || '|' || s_suppkey || '?', '[|@#!¡·$€%&()=?¿^*;:,¨´><+]', '_', 'g') AS name, md5((s_suppkey + s_nationkey)::VARCHAR || s_name || 'b') AS listing,
  s_suppkey::DOUBLE::VARCHAR || chr(9) || '2.5' AS points, '工商 ' || s_suppkey AS bank, (s_suppkey * 1.0)::DOUBLE AS payload FROM supplier""")
def q_payloads(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    pairs = t.stock_qr(F.concat(F.lit("code:x"), "s_suppkey", F.lit(" n:1 d:2 e:3 f:4")))
    name = t.clean_name(F.concat("s_name", F.lit("|"), "s_suppkey", F.lit("?")))
    listing = t.listing_hash(F.array(F.col("s_name"), F.lit("b")), F.array(F.col("s_suppkey").cast("long"), F.col("s_nationkey").cast("long")))
    points = t.points_text(F.array(F.array(F.col("s_suppkey").cast("double"), F.lit(2.5))))
    payload = t.decode_payload(F.base64(F.col("s_suppkey").cast("string").cast("binary"))).cast("string").cast("double")
    return s.select("s_suppkey", pairs["code"].alias("stock_code"), name.alias("name"), listing.alias("listing"), points.alias("points"), t.address_bank(F.concat(F.lit("工商"), "s_suppkey")).alias("bank"), payload.alias("payload"))


@query("""SELECT o_orderkey, right('20240' || o_orderkey, 12) AS code, '2024年' || strftime(o_orderdate, '%m月%d日') AS idate, o_orderkey::VARCHAR AS doc_number, '2/3' AS page, o_custkey::VARCHAR AS cnt, o_orderpriority AS other FROM orders""")
def q_field_kinds(spark, sf_dir):
    o, today = table(spark, sf_dir, "orders"), F.lit("2024-01-01").cast("date")
    of = lambda kind, label, s: t.field_text(kind, F.lit(label), s, today)
    return o.select(
        "o_orderkey", of("bill", "invoice_code", F.concat(F.lit("20240"), "o_orderkey")).alias("code"), of("stock", "idate", F.concat(F.lit("2024/"), F.date_format("o_orderdate", "MM/dd"))).alias("idate"),
        of("stock2", "doc_number", F.col("o_orderkey").cast("string")).alias("doc_number"), of("stock", "page", F.lit("第2页/共3页")).alias("page"), of("stock", "cnt", F.col("o_custkey").cast("string")).alias("cnt"), of("bill", "other", F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).alias("other"),
    )


@query(f"WITH {BOXES} SELECT image_id, cls, count(*) AS n, round(avg(conf / 10.0), 6) AS mean_conf FROM boxes WHERE conf / 10.0 >= 0.25 GROUP BY 1, 2")
def q_image_confidence(spark, sf_dir):
    rows = boxes(spark, sf_dir).withColumn("conf", F.col("conf") / 10.0)
    return metrics.image_confidence(rows, "image_id", "cls").withColumn("mean_conf", F.round("mean_conf", 6))


#: Scores by class: a stand-in for average_precision()'s rows, which q_ap checks.
SCORES = "s AS (SELECT o_custkey % 20 AS cls, count(*) AS n_true, sum((o_orderstatus = 'F')::INT)::BIGINT AS tp, round(avg(o_totalprice) / 1e6, 6) AS ap, sum((o_orderstatus <> 'O')::INT)::BIGINT AS n FROM orders WHERE o_custkey % 20 < 15 GROUP BY 1)"


def scores(spark, sf_dir):
    one = lambda c: F.sum(c.cast("int")).cast("long")
    status = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").withColumn("cls", F.col("o_custkey") % 20).where("cls < 15").groupBy("cls")
    found = rows.agg(F.count("*").alias("n_true"), one(status == "F").alias("tp"), F.round(F.avg("o_totalprice") / 1e6, 6).alias("ap"), one(status != "O").alias("n"))
    return metrics.class_table(found.drop("n"), found.select("cls", "n"), "cls")


TABLE = f"{SCORES}, c AS (SELECT *, tp / (n + 1e-16) AS p, tp / (n_true + 1e-16) AS r FROM s)"


@query(f"WITH {TABLE} SELECT cls, ap, tp, n - tp AS fp, round(p, 6) AS \"precision\", round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-16), 6) AS f1, n_true AS support FROM c")
def q_class_table(spark, sf_dir):
    return scores(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"WITH {TABLE}, a AS (SELECT DISTINCT o_custkey % 20 AS cls FROM orders) SELECT a.cls, round(coalesce(c.ap, (SELECT avg(ap) FROM c)), 6) AS ap FROM a LEFT JOIN c USING (cls)")
def q_filled_scores(spark, sf_dir):
    classes = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("cls")).distinct()
    return metrics.filled_scores(scores(spark, sf_dir), classes, "cls").withColumn("ap", F.round("ap", 6))


@query(f"WITH {TABLE} SELECT round(avg(p), 6) AS mean_precision, round(avg(r), 6) AS mean_recall, round(avg(ap), 6) AS mean_ap, round(0.1 * avg(p) + 0.9 * avg(ap) + 0.1 * avg(r) + 0.9 * avg(ap), 6) AS fitness FROM c")
def q_mean_scores(spark, sf_dir):
    m = metrics.mean_scores(scores(spark, sf_dir))
    p, r, ap = (F.col(c) for c in ("mean_precision", "mean_recall", "mean_ap"))
    return m.select(*rounded(mean_precision=p, mean_recall=r, mean_ap=ap, fitness=metrics.mask_fitness((p, r, p, ap), (p, r, r, ap))))


SPLIT = "CASE WHEN h % 100 < 80 THEN 'train' WHEN h % 100 < 90 THEN 'val' ELSE 'test' END"
SHARES = (("train", 80), ("val", 10), ("test", 10))


@query(f"SELECT doc_id, {SPLIT} AS split FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM documents)")
def q_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", records.split_of(F.col("doc_id"), SHARES).alias("split"))


@query(f"""WITH i AS (SELECT o_orderkey AS k, {SPLIT} AS split FROM (SELECT o_orderkey, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT AS h FROM orders)),
l AS (SELECT l_orderkey AS k, l_linenumber AS cls FROM lineitem WHERE l_linenumber BETWEEN 2 AND 7), z AS (SELECT DISTINCT split, c AS cls FROM i, unnest([1, 2, 3, 4, 5, 6, 7, 9]) AS u(c)),
p AS (SELECT split, cls, count(*) AS instances, count(DISTINCT k) AS images FROM i JOIN l USING (k) GROUP BY 1, 2)
SELECT split, z.cls::INT AS cls, coalesce(instances, 0) AS instances, coalesce(images, 0) AS images, NULL::BIGINT AS unlabelled FROM z LEFT JOIN p USING (split, cls)
UNION ALL SELECT split, NULL, sum((l.k IS NOT NULL)::INT)::BIGINT, count(DISTINCT i.k), count(DISTINCT CASE WHEN l.k IS NULL THEN i.k END) FROM i LEFT JOIN l USING (k) GROUP BY 1""")
def q_dataset_splits(spark, sf_dir):
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), records.split_of(F.col("o_orderkey"), SHARES).alias("split"))
    labels = table(spark, sf_dir, "lineitem").where("l_linenumber BETWEEN 2 AND 7").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("cls"))
    classes = spark.createDataFrame([(c,) for c in (1, 2, 3, 4, 5, 6, 7, 9)], "cls int")
    return metrics.dataset_stats(images, labels, classes, "k", "cls", "split")


@query("""SELECT count(*) FILTER (quality IS NOT NULL AND coalesce(toxic, 0) <> 1 AND length(text) > 0) AS found, count(*) FILTER (quality IS NULL) AS missing, count(*) FILTER (quality IS NOT NULL AND coalesce(length(text), 0) = 0) AS empty,
  count(*) FILTER (quality IS NOT NULL AND length(text) > 0 AND toxic = 1) AS corrupt FROM documents LEFT JOIN labels USING (doc_id)""")
def q_scan_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return metrics.scan_summary(d, F.col("quality").isNull(), F.coalesce(F.length("text"), F.lit(0)) == 0, F.col("toxic") == 1)


@query("SELECT label, pos - 1 AS dim, round(avg(embedding[pos]::DOUBLE), 4) + 0.0 AS mean FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(pos) WHERE vec_id % 3 <> 0 GROUP BY 1, 2")
def q_center(spark, sf_dir):
    found = metrics.centers(table(spark, sf_dir, "embeddings"), "label", "embedding", F.col("vec_id") % 3 != 0)
    return found.withColumn("mean", F.round("mean", 4) + 0.0)


@query("SELECT event_type, count(*) AS n, round(count(value) / sum(value), 4) AS per_second, round(avg(value), 4) AS latency FROM events GROUP BY 1")
def q_throughput(spark, sf_dir):
    return metrics.throughput(table(spark, sf_dir, "events"), F.col("value"), "event_type").withColumns({c: F.round(c, 4) for c in ("per_second", "latency")})


@query("SELECT o_orderstatus, count(o_totalprice) AS n, round(avg(o_totalprice), 2) AS mean, round(stddev_pop(o_totalprice), 2) AS deviation FROM orders GROUP BY 1")
def q_moments(spark, sf_dir):
    return metrics.moments(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice").withColumns({c: F.round(c, 2) for c in ("mean", "deviation")})


@query("""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem)
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(a, 6) AS corr FROM c UNION ALL SELECT 'l_quantity', 'l_discount', round(b, 6) FROM c UNION ALL SELECT 'l_extendedprice', 'l_discount', round(c, 6) FROM c""")
def q_correlations(spark, sf_dir):
    return metrics.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("corr", F.round("corr", 6))


@query("SELECT label, sum(len(embedding))::BIGINT AS n_values, round(sum(len(list_filter(embedding, lambda x: round(x, 1) = 0))) / sum(len(embedding)), 6) AS sparsity FROM embeddings GROUP BY 1")
def q_sparsity(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: F.round(x, 1)).alias("v"))
    return metrics.sparsity(rows, "label", "v").withColumn("sparsity", F.round("sparsity", 6))


@query("""WITH v AS (SELECT l_orderkey AS k, l_linenumber % 3 - 1 AS angle, round(var_pop(l_quantity), 9) AS v FROM lineitem GROUP BY 1, 2), m AS (SELECT k, arg_max(angle, struct_pack(v := v, a := -angle)) AS best FROM v GROUP BY 1),
a AS (SELECT l_orderkey AS k, coalesce(avg(CASE WHEN abs(l_quantity - 25) <= 10 THEN l_quantity - 25 END), 0.0) AS mean FROM lineitem GROUP BY 1) SELECT k, best::INT AS best, round(mean, 6) AS mean FROM m JOIN a USING (k)""")
def q_angles(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 3 - 1).alias("best"), "l_quantity", (F.col("l_quantity") - 25).alias("mean"))
    return metrics.best_angle(li, "k", "best", "l_quantity").join(metrics.mean_angle(li, "k", "mean", 10), "k").select("k", F.col("best").cast("int").alias("best"), F.round("mean", 6).alias("mean"))


@query("SELECT l_orderkey, coalesce(string_agg(DISTINCT CASE WHEN l_linenumber <> 2 THEN l_partkey::VARCHAR END, '、' ORDER BY CASE WHEN l_linenumber <> 2 THEN l_partkey::VARCHAR END), '') AS number FROM lineitem GROUP BY 1")
def q_distinct_joined(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("number", F.col("l_partkey").cast("string"))
    return records.distinct_joined(rows, "l_orderkey", "number", F.col("l_linenumber") != 2)


@query("SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY role, turn, text) AS entities FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def q_entities(spark, sf_dir):
    found = records.entities(table(spark, sf_dir, "conversations").where("text IS NOT NULL"), "conv_id", "role", "text", ["turn"])
    return found.select("conv_id", F.array_join(F.transform("entities", lambda x: F.concat(x["role"], F.lit(":"), F.length(x["text"]).cast("string"))), "|").alias("entities"))


@query("SELECT a.conv_id, a.turn AS first, b.turn AS second FROM conversations AS a JOIN conversations AS b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant'")
def q_entity_pairs(spark, sf_dir):
    return records.entity_pairs(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn", "user", "assistant")


@query("""WITH a AS (SELECT l_orderkey AS k, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS l, list(l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey)[1:2] AS t FROM lineitem GROUP BY 1)
SELECT k, (i - 1)::INT AS seq, l[i] AS label, t[i] AS text FROM a, unnest(range(1, least(len(l), len(t)) + 1)) AS r(i)""")
def q_zipped(spark, sf_dir):
    one = lambda c: F.transform(F.sort_array(F.collect_list(F.struct(*ORDER, c))), lambda x: x[c])
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(one("l_returnflag").alias("l"), one("l_linestatus").alias("t"))
    return records.zipped(rows.withColumn("t", F.slice("t", 1, 2)), "l", "t")


@query("SELECT page_id, url, page_id * 10 AS id FROM pages WHERE page_id % 4 <> 0")
def q_path_ids(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".jpg")).alias("path"), "url")
    known = pages.where("page_id % 4 <> 0").select("path", (F.col("page_id") * 10).alias("id"))
    return records.with_ids(pages, known, "path", "id").select("page_id", "url", "id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)")
def q_unmatched(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return bx.unmatched(orders, lines, ["o_orderkey"])


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey IN (SELECT p_partkey FROM part WHERE p_size % 2 = 0 OR p_partkey % 3 = 0) AND (p_size % 2 = 0 OR p_size % 5 <> 0 AND p_partkey % 3 = 0)")
def q_shared_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    other = part.where("p_size % 2 = 0").union(part.where("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_size")).otherwise(-1)))
    return records.shared_rows(part, other.distinct(), ["p_partkey", "p_size"])


@query(f"""WITH {BOXES}, e AS (SELECT image_id, cls, x1, conf / 10.0 AS conf FROM boxes WHERE l_linenumber < 3 UNION ALL SELECT image_id, cls, x1, conf / 20.0 FROM boxes WHERE l_linenumber > 3
UNION ALL SELECT image_id, cls, x1, 1.0 FROM boxes WHERE l_linenumber = 3) SELECT cls, count(*) AS n, round(sum(conf), 4)::DOUBLE AS conf, sum(x1)::BIGINT AS x1 FROM e WHERE cls IN (0, 2) GROUP BY 1""")
def q_ensemble(spark, sf_dir):
    b = boxes(spark, sf_dir)
    of = lambda rows, part: rows.select("image_id", "cls", "x1", (F.col("conf") / part).alias("conf"))
    both = bx.ensemble(of(b.where("l_linenumber < 3"), 10.0), of(b.where("l_linenumber > 3"), 20.0))
    every = bx.with_given(both, b.where("l_linenumber = 3").select("image_id", "cls", "x1"))
    return bx.of_classes(every, [0, 2]).groupBy("cls").agg(F.count("*").alias("n"), F.round(F.sum("conf"), 4).alias("conf"), F.sum("x1").alias("x1"))


@query(f"""WITH {BOXES}, s AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x2 - x1 + y2 - y1, l_linenumber, l_partkey, l_suppkey) AS n, count(*) OVER (PARTITION BY image_id) AS c FROM boxes)
SELECT {OF} FROM s WHERE n <= round_even(c / 2, 0)""")
def q_smallest_half(spark, sf_dir):
    return bx.smallest_half(boxes(spark, sf_dir), "image_id", ORDER).select("image_id", *ORDER)


@query(f"WITH {BOXES} SELECT {OF} FROM boxes WHERE cls = (l_partkey * 7) % 3 AND l_partkey % 2 = 0")
def q_confirmed(spark, sf_dir):
    b, key = boxes(spark, sf_dir), ["image_id", *ORDER]
    second = b.where("l_partkey % 2 = 0").select(*key, ((F.col("l_partkey") * 7) % 3).cast("int").alias("cls"))
    return bx.confirmed(b, second, key, "cls").select(*key)


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderdate::DATE END AS day, strftime(o_orderdate, '%Y-%m-%d') AS day_text, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 86400.0 + o_custkey END::DOUBLE AS seconds,
  list_filter(range(1, 91), lambda x: x NOT IN (12, 26, 29, 30, 45, 66, 68, 69, 71, 83))[o_custkey % 80 + 1]::INT AS class91 FROM orders""")
def q_dates(spark, sf_dir):
    bad = F.col("o_custkey") % 5 == 0
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    later = F.date_format(F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 86400 + F.col("o_custkey")), "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", t.qr_date(F.when(bad, "2024133x").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))).alias("day"), t.date_text(F.col("o_orderdate")).alias("day_text"),
        t.seconds_between(stamp, F.when(bad, "no time").otherwise(later)).alias("seconds"), t.class_of_91(F.col("o_custkey") % 80).alias("class91"),
    )


@query("""SELECT item_id, i AS line_no, CASE WHEN i = 1 THEN '###' ELSE 'a b' || item_id END AS text, i = 1 AS ignored FROM benchmark, unnest(range(0, 4)) AS r(i) WHERE (item_id + i) % 3 <> 0 OR i = 2""")
def q_true_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("line_no"))
    text = F.when(F.col("line_no") == 1, "###").otherwise(F.concat(F.lit("a　b"), F.col("item_id").cast("string")))
    score = F.when(F.col("line_no") != 2, F.when((F.col("item_id") + F.col("line_no")) % 3 == 0, 0.49).otherwise(0.5))
    return annotations.true_lines(lines.withColumn("text", text).withColumn("score", score)).select("item_id", "line_no", "text", "ignored")


@query("""WITH l AS (SELECT l_orderkey AS file, l_linenumber AS line_no, l_partkey % 5 AS cls, l_discount AS v, l_tax AS u, l_orderkey % 2 = 0 AS outlined FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY file, cls, v, u ORDER BY line_no) AS n FROM l)
SELECT file::VARCHAR AS file, line_no, cls::INT AS cls, round(CASE WHEN outlined THEN (v + 0.5) / 2 ELSE v END, 6) AS x, round(CASE WHEN outlined THEN (u + 1.25) / 2 ELSE 0.25 END, 6) AS h_or_y, NOT outlined AS valid FROM r WHERE n = 1""")
def q_label_rows(spark, sf_dir):
    parts = [(F.col("l_partkey") % 5).cast("string")]
    box = F.concat_ws(" ", *parts, "l_discount", F.lit("0.25"), "l_tax", F.lit("0.5"))
    outline = F.concat_ws(" ", *parts, "l_discount", "l_tax", F.lit("0.5"), "l_tax", F.lit("0.5"), F.lit("1.25"))
    raw = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("line_no"), F.when(F.col("l_orderkey") % 2 == 0, outline).otherwise(box).alias("line"))
    return annotations.label_rows(raw).select("file", "line_no", "cls", F.round("x", 6).alias("x"), F.round("y", 6).alias("h_or_y"), "valid")


@query("SELECT user_id, event_id FROM events ORDER BY value DESC, event_id LIMIT 100")
def q_first_rows(spark, sf_dir):
    return ranking.first_rows(table(spark, sf_dir, "events"), [F.desc("value"), F.col("event_id")], 100).select("user_id", "event_id")


@query(f"WITH {BOXES} SELECT {OF}, ((row_number() OVER (ORDER BY (x2 - x1) / (y2 - y1), image_id, l_linenumber, l_partkey, l_suppkey) - 1) // 6)::BIGINT AS batch FROM boxes")
def q_crop_batches(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("ratio", (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    coarse = [F.floor("ratio"), F.floor(F.col("ratio") * 64)]
    return ranking.batches(b, coarse, [F.col("ratio"), F.col("image_id"), *map(F.col, ORDER)], 6).select("image_id", *ORDER, "batch")


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: [5, 3, 1, 7][greatest(least(floor(x::DOUBLE * 4)::INT, 3), 0) + 1]), ',') AS v FROM embeddings")
def q_looked_up(spark, sf_dir):
    levels = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * 4), F.lit(3)), F.lit(0)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(t.looked_up(levels, F.array(*map(F.lit, (5, 3, 1, 7)))), ",").alias("v"))


@query("SELECT conv_id, string_agg(role || ',' || coalesce(CASE WHEN turn % 2 = 0 THEN role END, ''), ';' ORDER BY turn, role) AS texts FROM conversations GROUP BY 1")
def q_table_texts(spark, sf_dir):
    row = F.array(F.struct(F.col("role").alias("text")), F.struct(F.when(F.col("turn") % 2 == 0, F.col("role")).alias("text")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    return rows.select("conv_id", F.array_join(F.transform(t.table_texts(F.col("rows")), lambda r: F.array_join(r, ",")), ";").alias("texts"))


#: Running figures of each class over 1,000 confidences, for `of_score` boxes.
CURVES = f"""{BOXES}, d AS (SELECT cls, (conf + 1) / 13.0::DOUBLE AS c, sum((x1 % 3 = 0)::INT) AS t, count(*) AS m FROM boxes GROUP BY 1, 2), n AS (SELECT cls, sum(m) AS n_true FROM d GROUP BY 1),
s AS (SELECT cls, c, sum(t) OVER w AS t, sum(m) OVER w AS m FROM d WINDOW w AS (PARTITION BY cls ORDER BY c DESC)), g AS (SELECT k::INT AS k, k / 999.0::DOUBLE AS x FROM range(1000) AS q(k)),
j AS (SELECT cls, k, x, min(c) FILTER (c >= x) AS a, arg_min(t, c) FILTER (c >= x) AS ta, arg_min(m, c) FILTER (c >= x) AS ma, max(c) FILTER (c < x) AS b, arg_max(t, c) FILTER (c < x) AS tb, arg_max(m, c) FILTER (c < x) AS mb FROM s, g GROUP BY 1, 2, 3),
v AS (SELECT cls, k, x, n_true, CASE WHEN a IS NULL THEN 1 WHEN b IS NULL THEN ta / ma ELSE ta / ma + (tb / mb - ta / ma) * (a - x) / (a - b) END AS p,
  CASE WHEN a IS NULL THEN 0 WHEN b IS NULL THEN ta / n_true ELSE (ta + (tb - ta) * (a - x) / (a - b)) / n_true END AS r FROM j JOIN n USING (cls)),
f AS (SELECT *, 2 * p * r / (p + r + 1e-16) AS f1 FROM v)"""


def score_curves(spark, sf_dir):
    b = boxes(spark, sf_dir).select("cls", ((F.col("conf") + 1) / 13.0).alias("conf"), (F.col("x1") % 3 == 0).cast("int").alias("tp"))
    return metrics.score_curves(b, "cls", b.groupBy("cls").agg(F.count("*").alias("n_true")))


@query(f"WITH {CURVES} SELECT cls, k, round(x, 6) AS score, round(p, 6) AS \"precision\", round(r, 6) AS recall, round(f1, 6) AS f1 FROM f")
def q_score_curves(spark, sf_dir):
    c = score_curves(spark, sf_dir)
    return c.select("cls", "k", *rounded(score=F.col("score"), precision=F.col("precision"), recall=F.col("recall"), f1=F.col("f1")))


@query(f"""WITH {CURVES}, h AS (SELECT k, avg(f1) AS f1 FROM f GROUP BY 1), z AS (SELECT g.k, round(avg(h.f1), 12) AS y FROM g, range(-50, 51) AS o(i) JOIN h ON h.k = greatest(0, least(999, g.k + i)) GROUP BY 1),
b AS (SELECT k FROM z ORDER BY y DESC, k LIMIT 1) SELECT cls, k, round(p, 6) AS "precision", round(r, 6) AS recall, round_even(r * n_true, 0)::BIGINT AS tp, round_even(round_even(r * n_true, 0) / (p + 1e-16) - round_even(r * n_true, 0), 0)::BIGINT AS fp FROM f JOIN b USING (k)""")
def q_best_scores(spark, sf_dir):
    best = metrics.best_scores(score_curves(spark, sf_dir), "cls")
    return best.select("cls", "k", *rounded(precision=F.col("precision"), recall=F.col("recall")), "tp", "fp")


@query("""WITH l AS (SELECT o_custkey::VARCHAR AS file, o_orderkey AS line_no, (o_orderkey % 97) / 100.0::DOUBLE AS s, o_orderkey % 31 AS ms FROM orders),
e AS (SELECT file, min(line_no) AS first, arg_max(line_no, s * 1000000000 - line_no / 1e9) AS last FROM l GROUP BY 1)
SELECT file, line_no, ms::DOUBLE AS ms, round(s * 100, 4) AS score FROM l JOIN e USING (file) WHERE line_no > first AND line_no <= last""")
def q_study_curve(spark, sf_dir):
    line = F.concat_ws(" ", F.lit("1 2  3"), (F.col("o_orderkey") % 97) / 100.0, F.lit("5 6 7 8"), F.col("o_orderkey") % 31)
    found = metrics.study_curve(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").alias("line_no"), line.alias("line")))
    return found.select("file", "line_no", "ms", F.round("score", 4).alias("score"))


@query(f"""WITH {BOXES}, k AS (SELECT *, (l_partkey % 5 - 2) / 4.0::DOUBLE AS k, y2 - y1 AS h FROM boxes), m AS (SELECT *, h * abs(k) / (1 + k * k) AS dx, h * k * k / (1 + k * k) AS dy FROM k)
SELECT {OF}, trunc(x1 - CASE WHEN k < 0 THEN dx ELSE 0 END)::INT AS ax, trunc(k * x1 + y1 - h / 2 + CASE WHEN k < 0 THEN dy ELSE 0 END)::INT AS ay, trunc(x2 + CASE WHEN k < 0 THEN 0 ELSE dx END)::INT AS bx, trunc(k * x2 + y1 - h / 2 + CASE WHEN k < 0 THEN 0 ELSE dy END)::INT AS by_,
  trunc(x2 + CASE WHEN k < 0 THEN dx ELSE 0 END)::INT AS cx, trunc(k * x2 + y1 + h / 2 - CASE WHEN k < 0 THEN dy ELSE 0 END)::INT AS cy, trunc(x1 - CASE WHEN k < 0 THEN 0 ELSE dx END)::INT AS dx, trunc(k * x1 + y1 + h / 2 - CASE WHEN k < 0 THEN 0 ELSE dy END)::INT AS dy FROM m""")
def q_leaning_corners(spark, sf_dir):
    slope = (F.col("l_partkey") % 5 - 2) / 4.0
    found = boxes(spark, sf_dir).select("image_id", *ORDER, g.leaning_corners(F.col("x1"), F.col("x2"), slope, F.col("y1"), F.col("y2") - F.col("y1")).alias("p"))
    return found.select("image_id", *ORDER, *(F.col("p")[i][j].alias(name) for name, (i, j) in zip(("ax", "ay", "bx", "by_", "cx", "cy", "dx", "dy"), [(i, j) for i in range(4) for j in range(2)], strict=True)))


@query(f"WITH {BOXES} SELECT {OF}, x1 || ',' || y1 || ';' || x1 || ',' || y2 || ';' || x2 || ',' || y1 AS corners FROM boxes")
def q_triangle(spark, sf_dir):
    p = lambda x, y: g.point(F.col(x), F.col(y))
    found = g.triangle(F.array(p("x1", "y1"), p("x2", "y1"), p("x1", "y2")))
    return boxes(spark, sf_dir).select("image_id", *ORDER, F.array_join(F.transform(found, lambda q: F.array_join(q, ",")), ";").alias("corners"))


@query(f"WITH {BOXES} SELECT {OF}, dense_rank() OVER (PARTITION BY image_id // 64 ORDER BY image_id) - 1 AS place FROM boxes")
def q_batch_places(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("batch", F.floor(F.col("image_id") / 64))
    return ranking.places(b, "batch", "image_id").select("image_id", *ORDER, "place")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber AS n, l_partkey::VARCHAR AS text, l_linenumber % 4 AS label FROM lineitem)
SELECT o_orderkey, coalesce(a, '0') AS invoice_number, coalesce(b, '0') AS amount, '0' AS ids, coalesce(c, '0') AS billing_date, '0' AS star_station, coalesce(d, '0') AS end_station FROM orders LEFT JOIN
(SELECT l_orderkey, arg_max(text, {'n': n, 't': text}) FILTER (label = 0) AS a, arg_max(text, {'n': n, 't': text}) FILTER (label = 1) AS b, arg_max(text, {'n': n, 't': text}) FILTER (label = 2) AS c, arg_max(text, {'n': n, 't': text}) FILTER (label = 3) AS d FROM l GROUP BY 1) ON l_orderkey = o_orderkey""")
def q_older_records(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, ("invoice_number", "totalAmount", "date", "end"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", label.alias("label"), F.col("l_partkey").cast("string").alias("text"))
    return records.plain(table(spark, sf_dir, "orders"), rows, "o_orderkey", "l_linenumber", records.OLDER["train"])
