"""Assignment, clustering and training, each with the same arithmetic in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import assignment, clusters, fitting, geometry
from eventloom.plans.adapter import BOXES_SQL, STEPS_SQL, boxes, table
from eventloom.plans.registry import query

_SIDES = "greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query("greedy_assignment", f"""WITH {STEPS_SQL}, {BOXES_SQL},
j AS (SELECT a.session_id, a.frame + 1 AS frame, a.event_id AS a_id, b.event_id AS b_id, a.class_name <> b.class_name AS strange, {_SIDES} AS inter, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas FROM boxes a JOIN boxes b ON a.session_id = b.session_id AND b.frame = a.frame + 1),
p AS (SELECT session_id, frame, a_id, b_id, strange, inter / (areas - inter) AS iou FROM j WHERE inter / (areas - inter) >= CASE WHEN strange THEN 0.2 ELSE 0.1 END - 1e-9),
l AS (SELECT session_id, frame, list_reduce(list_prepend({{'a': []::BIGINT[], 'b': []::BIGINT[]}}, list({{'a': [a_id], 'b': [b_id]}} ORDER BY strange, iou DESC, a_id, b_id)), lambda acc, x: CASE WHEN list_contains(acc.a, x.a[1]) OR list_contains(acc.b, x.b[1]) THEN acc ELSE {{'a': list_concat(acc.a, x.a), 'b': list_concat(acc.b, x.b)}} END) AS m FROM p GROUP BY 1, 2)
SELECT session_id, frame, unnest(m.a) AS a_id, unnest(m.b) AS b_id FROM l""")
def greedy_assignment(spark, d):
    """Boxes of a frame matched with those of the next, class first, then overlap."""
    b = boxes(spark, d)
    p = geometry.overlap_pairs(b.withColumn("frame", F.col("frame") + 1), b, ["session_id", "frame"], "event_id", "event_id", 0.1, 0.2)
    return assignment.greedy_matches(p, ["session_id", "frame"], "a_id", "b_id", [~F.col("same_class"), -F.col("iou")]).select("session_id", "frame", "a_id", "b_id")


K, SEED, ROUNDS = 6, 42, 50


def _start_sql() -> str:
    dist = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - {0}[i]) * (v[i] - {0}[i])))"
    pick = "SELECT v FROM (SELECT id, v, sum(w) OVER (ORDER BY id) AS s, sum(w) OVER () AS total FROM {0}) WHERE s > {1!r}::DOUBLE * total ORDER BY id LIMIT 1"
    out = [f"d0 AS (SELECT id, v, 1.0::DOUBLE AS w FROM x), c0 AS MATERIALIZED ({pick.format('d0', clusters.uniform(SEED, 0))})"]
    for i in range(1, K):
        low = dist.format(f"c{i - 1}.c")
        out.append(f"d{i} AS MATERIALIZED (SELECT id, d.v, {'least(w, ' + low + ')' if i > 1 else low} AS w FROM d{i - 1} d, (SELECT v AS c FROM c{i - 1}) c{i - 1}), c{i} AS MATERIALIZED ({pick.format(f'd{i}', clusters.uniform(SEED, i))})")
    return ", ".join(out).replace("d.v, least", "v, least").replace("d.v, list_sum", "v, list_sum")


REPRESENTATIVES_SQL = f"""WITH RECURSIVE x AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), {_start_sql()},
k(r, cs, own, moved) AS (SELECT 0, [{", ".join(f"(SELECT v FROM c{i})" for i in range(K))}], []::INT[], 1
  UNION ALL SELECT r + 1, list_transform(range(1, {K + 1}), lambda j: coalesce(list_filter(ms, lambda m: m.c = j)[1].m, cs[j])), now, CASE WHEN now = own THEN 0 ELSE 1 END
  FROM (SELECT k.r, k.cs, k.own, n.now, n.ms FROM k, LATERAL (
    SELECT list(c ORDER BY id) AS now, (SELECT list({{'c': c, 'm': m}}) FROM (SELECT c, [{", ".join(f"avg(v[{i}])" for i in range(1, 65))}] AS m FROM (SELECT v, list_position(ds, list_min(ds)) AS c FROM (SELECT v, list_transform(k.cs, lambda c: list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))) AS ds FROM x)) GROUP BY c)) AS ms
    FROM (SELECT id, list_position(ds, list_min(ds)) AS c FROM (SELECT id, list_transform(k.cs, lambda c: list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))) AS ds FROM x))) n WHERE k.moved = 1 AND k.r < {ROUNDS})),
f AS (SELECT cs FROM k WHERE moved = 1 ORDER BY r DESC LIMIT 1),
a AS (SELECT id, list_position(ds, list_min(ds)) - 1 AS cluster, list_min(ds) AS d FROM (SELECT id, list_transform(cs, lambda c: list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))) AS ds FROM x, f))
SELECT cluster::INT AS cluster, count(*) AS n, arg_min(id, (d, id)) AS item FROM a GROUP BY cluster"""


@query("representatives", REPRESENTATIVES_SQL)
def representatives(spark, d):
    return clusters.representatives(table(spark, d, "embeddings"), "vec_id", "embedding", K, SEED, ROUNDS)


EPOCHS, RATE = 4, 2.0


def _training_sql() -> str:
    out = """WITH x AS (SELECT vec_id, label, list_append(embedding::DOUBLE[], 1.0::DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL), tr AS (SELECT * FROM x WHERE vec_id % 5 <> 0),
cw AS (SELECT label, (SELECT count(*) FROM tr) / ((SELECT count(DISTINCT label) FROM tr) * count(*))::DOUBLE AS w FROM tr GROUP BY label), ho AS (SELECT x.* FROM x JOIN cw USING (label) WHERE vec_id % 5 = 0),
w0 AS (SELECT label AS c, list_transform(range(65), lambda i: 0.0::DOUBLE) AS w FROM cw)"""
    share = "SELECT *, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY vec_id) AS p FROM (SELECT vec_id, label, x, c, list_dot_product(x, w) AS z, max(list_dot_product(x, w)) OVER (PARTITION BY vec_id) AS top FROM {0}, {1})"
    loss = "SELECT sum(-cw.w * ln(p)) / sum(cw.w) AS loss FROM {0} JOIN cw USING (label) WHERE c = label"
    for e in range(1, EPOCHS + 1):
        out += f""",
p{e} AS MATERIALIZED ({share.format("tr", f"w{e - 1}")}), l{e} AS ({loss.format(f"p{e}")}),
g{e} AS (SELECT c, list(g ORDER BY j) AS g FROM (SELECT c, j, sum(cw.w * (p - (c = label)::INT) * x[j]) / (SELECT sum(w) FROM tr JOIN cw USING (label)) AS g FROM p{e} JOIN cw USING (label), range(1, 66) t(j) GROUP BY c, j) GROUP BY c),
w{e} AS MATERIALIZED (SELECT c, list_transform(range(1, 66), lambda j: w[j] - {RATE} * g[j]) AS w FROM w{e - 1} JOIN g{e} USING (c)), h{e} AS MATERIALIZED ({share.format("ho", f"w{e}")}), m{e} AS ({loss.format(f"h{e}")}),
y{e} AS (SELECT label, c AS predicted FROM h{e} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, c) = 1),
f{e} AS (SELECT sum(CASE WHEN hit > 0 THEN 2.0::DOUBLE * (hit / pr) * (hit / tl) / (hit / pr + hit / tl) ELSE 0 END) / count(*) AS f1 FROM (SELECT cw.label, count(*) FILTER (y.label = cw.label AND predicted = cw.label)::DOUBLE AS hit, count(*) FILTER (predicted = cw.label)::DOUBLE AS pr, count(*) FILTER (y.label = cw.label)::DOUBLE AS tl FROM cw, y{e} y GROUP BY cw.label))"""
    rows = " UNION ALL ".join(f"SELECT {e} AS epoch, l{e}.loss AS train_loss, m{e}.loss AS held_out_loss, f1 AS macro_f1 FROM l{e}, m{e}, f{e}" for e in range(1, EPOCHS + 1))
    return out + f""",
r AS ({rows}), b AS (SELECT *, max(round(macro_f1, 9)) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r),
e AS (SELECT *, min(held_out_loss) OVER (PARTITION BY round(macro_f1, 9) ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM b)
SELECT epoch, round(train_loss, 9) AS train_loss, round(held_out_loss, 9) AS held_out_loss, round(macro_f1, 9) AS macro_f1, coalesce(round(macro_f1, 9) > best OR (round(macro_f1, 9) = best AND held_out_loss < least), true) AS is_best FROM e"""


@query("classifier_training", _training_sql())
def classifier_training(spark, d):
    """The epochs of a classifier of the vectors' labels, a fifth of them held out."""
    v = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    h = fitting.fit(v.filter("vec_id % 5 <> 0"), v.filter("vec_id % 5 = 0"), "v", "label", EPOCHS, RATE, patience=0)
    rows = [(e["epoch"], round(e["train_loss"], 9), round(e["held_out_loss"], 9), round(e["macro_f1"], 9), e["is_best"]) for e in h.epochs]
    return spark.createDataFrame(rows, "epoch int, train_loss double, held_out_loss double, macro_f1 double, is_best boolean")
