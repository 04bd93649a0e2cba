"""Queries of the decode, classify, upload and settings operators, over features, bitmaps, pages and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.functions import tariff
from gridledger.operators import classify, decode, uploads
from gridledger.operators.registry import REGISTRY
from gridledger.sources import adapters, settings

PHANTOM_LIT = 0.15
#: Gates of the template decision; the test bitmaps overlap weakly.
LEAST, MARGIN = 0.40, 0.02
SIDE = 8
#: The registry's numbered labels, which stand for the test bitmaps' numbers.
NAMES = ("IP-Cu", "EP-Cu", "IP-HO", "EP-HO", *(label for label, *_ in REGISTRY if label.startswith("Ld-")), "IP-Cu-Fd", "EP-Cu-Fd")


def segment_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.without_self_test(decode.decode(adapters.features(spark, sf_dir), lit=F.lit(PHANTOM_LIT))).drop("cells", "truth")


def segment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.segment_audit(adapters.features(spark, sf_dir), PHANTOM_LIT)


def _grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, b, s) for i, (b, s) in enumerate((b, s) for b in (0.05, 0.40) for s in (0.04, 0.15, 0.20, 0.50, 0.65))], "setting int, blank double, lit double")


def param_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.sweep(adapters.features(spark, sf_dir), _grid(spark))


def sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.best(param_sweep(spark, sf_dir), 4).select("setting", "n_clean", "n_lead")


def decode_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decode.decode(adapters.features(spark, sf_dir), lit=F.lit(PHANTOM_LIT))
    return got.groupBy("device_id").agg(F.count("*").alias("total"), F.count(F.when(F.col("cents").eqNullSafe(F.col("truth")), 1)).alias("right"))


def template_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.templates(adapters.bitmaps(spark, sf_dir)).select("label", F.posexplode("bits").alias("pos", "bit")).select("label", "pos", F.col("bit").cast("int").alias("bit"))


def _scores(spark: SparkSession, sf_dir: str, bands: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    frames = adapters.bitmaps(spark, sf_dir)
    return classify.overlaps(frames, classify.templates(frames), SIDE, SIDE, bands=bands)


def template_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


BANDS = {"iou": (0.0, 1.0), "first": classify.FIRST, "last": classify.LAST}


def template_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, BANDS)


def label_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame(list(enumerate(NAMES)), "template bigint, label string")
    return classify.decide_label(_scores(spark, sf_dir, BANDS), names, LEAST, MARGIN, 0.5, 0.45)


def template_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.decide(_scores(spark, sf_dir), LEAST, MARGIN)


def unit_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.unit(_scores(spark, sf_dir))


def phase_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.phase(_scores(spark, sf_dir))


def quad_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners from the first eight numbers of the embeddings, with a baseline of the even frames of two devices in three."""
    point = lambda i: F.struct(*(F.round(F.get("embedding", F.lit(2 * i + j)).cast("double") * 1000, 0).cast("int").alias(n) for j, n in enumerate("xy")))
    rows = adapters.read(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 7).alias("device_id"), F.array(*map(point, range(4))).alias("quad"))
    base = decode.quad_baseline(rows.filter("vec_id % 2 = 0 and device_id % 3 <> 2"))
    return decode.quad_drift(rows, base).select("vec_id", F.round("drift", 6).alias("drift"))


def upload_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept and what is put aside, by reason."""
    kept, aside = uploads.split(adapters.uploads(spark, sf_dir))
    return kept.agg(F.count("*").alias("n")).withColumn("reason", F.lit("ok")).unionByName(aside.groupBy("reason").agg(F.count("*").alias("n")))


def template_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.ranked(_scores(spark, sf_dir), 2)


def ink_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = adapters.bitmaps(spark, sf_dir).withColumn("device_id", F.col("id") % 7)
    return decode.ink_profile(frames, 1, SIDE)


def label_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = adapters.read(spark, sf_dir, "supplier").select(F.col("s_name").alias("label")).distinct()
    return classify.siblings(names)


def upload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.judged(adapters.uploads(spark, sf_dir)).select("id", "reason", F.length("content").cast("long").alias("size"))


def settings_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"), "s_nationkey", "s_acctbal")
    pairs = F.array(
        F.struct(F.lit("billing_day").alias("k"), F.when(F.col("device_id") % 3 == 0, (F.col("s_nationkey") + 1).cast("string")).alias("v")),
        F.struct(F.lit("currency").alias("k"), F.when(F.col("device_id") % 4 == 0, "EUR").alias("v")),
        F.struct(F.lit("alert_gap_min").alias("k"), F.when(F.col("device_id") % 5 == 0, (F.col("device_id") % 90).cast("string")).alias("v")),
    )
    stored = rows.select("device_id", F.explode(F.filter(pairs, lambda p: p["v"].isNotNull() | (F.col("device_id") % 2 == 0))).alias("p")).select("device_id", "p.*")
    return settings.pivoted(stored)


def settings_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"))
    stored = rows.select("device_id", F.explode(F.array(F.lit("currency"), F.lit("tz"))).alias("k")).withColumn("v", F.lit("old"))
    changes = rows.filter("device_id % 2 = 0").select("device_id", F.explode(F.array(F.lit("currency"), F.lit("secret"), F.lit("billing_day"))).alias("k"), F.concat(F.lit("  new "), F.col("device_id").cast("string"), F.lit(" ")).alias("v"))
    return settings.updated(stored, changes)


def slab_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"))
    text = F.expr("concat('50:', device_id % 9, '.5,junk, ', 100 + device_id % 50, ' : 4.20', CASE WHEN device_id % 2 = 0 THEN ',*:7.9,10:1' ELSE '' END)")
    slabs = rows.select("device_id", F.posexplode(tariff.parse_slabs(text)).alias("pos", "s"))
    return slabs.select("device_id", "pos", F.col("s.size").cast("double").alias("size"), F.col("s.rate").cast("double").alias("rate"))


QUERIES = {
    f.__name__: f
    for f in (
        segment_decode, segment_audit, param_sweep, sweep_best, decode_accuracy, template_median, template_iou, template_band, template_class, label_class,
        template_top2, ink_profile, label_siblings, upload_gate, unit_glyphs, phase_glyphs, quad_drift, upload_split, settings_pivot, settings_update, slab_parse,
    )
}

_FEATURES = """
WITH f AS (
  SELECT user_id AS device_id, event_id AS id, CAST(round(value * 100) AS BIGINT) AS truth, lpad(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), 6, ' ') AS s FROM events),
d AS (SELECT *, ltrim(s) AS n, length(s) - length(ltrim(s)) AS lead FROM f),
p AS (SELECT *, CASE WHEN id % 10 = 3 THEN translate(left(n, 1), '134579', '???6?8') ELSE left(n, 1) END AS one,
             CASE WHEN id % 10 = 3 THEN translate(left(n, 1), '0268', '??59') ELSE left(n, 1) END AS dim FROM d),
r AS (SELECT *, one || substr(n, 2) AS t, repeat(' ', lead) || one || substr(n, 2) AS raw, position('?' IN one) > 0 AS bad FROM p)
"""
_VALUE = "CASE WHEN NOT bad AND length(n) >= 3 THEN CAST(t AS BIGINT) END"
_DIGITS = "(VALUES ('0','1111110'),('1','0110000'),('2','1101101'),('3','1111001'),('4','0110011'),('5','1011011'),('6','1011111'),('7','1110000'),('8','1111111'),('9','1111011')) m(d, seg)"

_SWEEP = (
    _FEATURES
    + """,
g AS (SELECT CAST(row_number() OVER (ORDER BY b, l) - 1 AS INTEGER) AS setting, b AS blank, l AS lit FROM (VALUES (0.05::DOUBLE), (0.40::DOUBLE)) x(b), (VALUES (0.04::DOUBLE), (0.15::DOUBLE), (0.20::DOUBLE), (0.50::DOUBLE), (0.65::DOUBLE)) y(l)),
w AS (
  SELECT setting, blank, lit, truth, n, CASE WHEN blank > 0.3 THEN '' WHEN lit < 0.05 THEN repeat('8', length(n)) WHEN lit > 0.6 THEN repeat('?', length(n)) WHEN lit < 0.18 THEN t ELSE dim || substr(n, 2) END AS got
  FROM r, g),
sweep AS (
  SELECT setting, blank, lit, count(*) FILTER (WHERE length(got) >= 3 AND position('?' IN got) = 0) AS n_clean,
         count(*) FILTER (WHERE CASE WHEN length(got) >= 3 AND position('?' IN got) = 0 THEN TRY_CAST(got AS BIGINT) END = truth) AS n_right,
         count(*) FILTER (WHERE length(got) = length(n) AND left(got, 1) = left(n, 1)) AS n_lead
  FROM w GROUP BY 1, 2, 3)
"""
)

_BITS = """
WITH b AS (SELECT vec_id AS id, label, CAST(unnest(embedding) > 0 AS INTEGER) AS bit, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
tpl AS (SELECT label, pos, CAST(2 * sum(bit) > count(*) AS INTEGER) AS bit FROM b GROUP BY 1, 2)
"""


def _overlap(name: str, lo: int, hi: int) -> str:
    n = hi - lo
    return f"""
z{name} AS (SELECT id, pos, bit FROM b WHERE pos % 8 >= {lo} AND pos % 8 < {hi}),
m{name} AS (SELECT label, dy, dx, ((pos // 8 + dy + 8) % 8) * 8 + {lo} + (pos % 8 - {lo} + dx + {n * 8}) % {n} AS pos, bit FROM tpl, sh WHERE pos % 8 >= {lo} AND pos % 8 < {hi}),
f{name} AS (SELECT id, sum(bit) AS n FROM z{name} GROUP BY 1),
t{name} AS (SELECT label, sum(bit) AS n FROM tpl WHERE pos % 8 >= {lo} AND pos % 8 < {hi} GROUP BY 1),
h{name} AS (SELECT z.id, m.label, dy, dx, sum(z.bit * m.bit) AS both FROM z{name} z JOIN m{name} m ON z.pos = m.pos GROUP BY 1, 2, 3, 4),
{name} AS (
  SELECT id, CAST(h.label AS BIGINT) AS template, max(CASE WHEN f.n + t.n - h.both > 0 THEN CAST(h.both AS DOUBLE) / (f.n + t.n - h.both) ELSE 0 END) AS {name}
  FROM h{name} h JOIN f{name} f USING (id) JOIN t{name} t USING (label) GROUP BY 1, 2)"""


_SHIFTS = _BITS + ", sh AS (SELECT dy, dx FROM range(-2, 3) y(dy), range(-2, 3) x(dx)),"
_IOU = _SHIFTS + _overlap("iou", 0, 8)
_ALL_BANDS = _IOU + "," + _overlap("head", 0, 1) + "," + _overlap("tail", 6, 8) + ", bands AS (SELECT id, template, iou, head AS \"first\", tail AS \"last\" FROM iou JOIN head USING (id, template) JOIN tail USING (id, template))"
_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(NAMES))

_BEST = """,
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY iou DESC, template DESC) AS rk, lead(iou) OVER (PARTITION BY id ORDER BY iou DESC, template DESC) AS second FROM iou)
SELECT id, CASE WHEN iou >= {least} AND iou - coalesce(second, 0) >= {margin} THEN template END AS label, iou, iou - coalesce(second, 0) AS margin FROM k WHERE rk = 1"""

ORACLE_SQL = {
    "segment_decode": _FEATURES
    + f"SELECT device_id, id, raw, {_VALUE} AS cents, CASE WHEN bad THEN 1 ELSE 0 END AS unknown, CAST(length(n) AS INTEGER) AS n_digits, CASE WHEN {_VALUE} IS NULL THEN 'decode_fail' ELSE 'ok' END AS reason FROM r WHERE NOT regexp_full_match(t, '8+')",
    "segment_audit": _FEATURES
    + f""",
ch AS (SELECT id, i, substr(n, i, 1) AS d FROM r, range(1, 7) t(i) WHERE i <= length(n)),
sg AS (SELECT id, i, CAST(j - 1 AS INTEGER) AS segment, substr(seg, j, 1) = '1' AS lit FROM ch JOIN {_DIGITS} USING (d), range(1, 8) t(j))
SELECT segment, count(*) AS n, count(*) FILTER (WHERE NOT lit AND id % 10 = 3 AND i = 1 AND segment = 4) AS phantom, CAST(0 AS BIGINT) AS missing FROM sg GROUP BY 1""",
    "param_sweep": _SWEEP + "SELECT * FROM sweep",
    "sweep_best": _SWEEP + "SELECT setting, n_clean, n_lead FROM sweep ORDER BY n_clean DESC, n_lead DESC, setting LIMIT 4",
    "decode_accuracy": _FEATURES + f"SELECT device_id, count(*) AS total, count(*) FILTER (WHERE {_VALUE} = truth) AS right FROM r GROUP BY 1".replace("AS right", 'AS "right"'),
    "template_median": _BITS + "SELECT label, CAST(pos AS INTEGER) AS pos, bit FROM tpl",
    "template_iou": _IOU + "SELECT * FROM iou",
    "template_band": _ALL_BANDS + "SELECT * FROM bands",
    "label_class": _ALL_BANDS
    + f""",
n AS (SELECT id, label, iou, "first" AS f, "last" AS l, row_number() OVER (PARTITION BY id ORDER BY iou DESC, label DESC) AS rk FROM bands JOIN (VALUES {_NAMES}) v(template, label) USING (template)),
p AS (SELECT a.id, a.label AS a, b.label AS b, a.iou AS ai, b.iou AS bi, a.f AS af, b.f AS bf, a.l AS al, b.l AS bl FROM n a JOIN n b ON a.id = b.id AND a.rk = 1 AND b.rk = 2)
SELECT id, CASE WHEN ai < {LEAST} THEN NULL
    WHEN length(a) = length(b) AND substr(a, 2) = substr(b, 2) THEN CASE WHEN bf > af THEN CASE WHEN bf >= 0.5 THEN b END WHEN af >= 0.5 THEN a END
    WHEN length(a) = length(b) AND left(a, length(a) - 1) = left(b, length(b) - 1) THEN CASE WHEN bl > al THEN CASE WHEN bl >= 0.45 THEN b END WHEN al >= 0.45 THEN a END
    WHEN ai - bi >= {MARGIN} AND af >= 0.5 AND (NOT starts_with(a, 'Ld-rCt') OR al >= 0.45) THEN a END AS label
FROM p""",
    "unit_glyphs": _IOU + _BEST.format(least=0.55, margin=0.15),
    "phase_glyphs": _IOU + _BEST.format(least=0.48, margin=0.08),
    "quad_drift": """WITH p AS (SELECT vec_id, vec_id % 7 AS device_id, c, CAST(round(CAST(embedding[2 * c + 1] AS DOUBLE) * 1000) AS INTEGER) AS x, CAST(round(CAST(embedding[2 * c + 2] AS DOUBLE) * 1000) AS INTEGER) AS y FROM embeddings, range(4) t(c)),
b AS (SELECT device_id, c, trunc(avg(x)) AS bx, trunc(avg(y)) AS by_ FROM p WHERE vec_id % 2 = 0 AND device_id % 3 <> 2 GROUP BY 1, 2)
SELECT vec_id, round(max(sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_))), 6) AS drift FROM p LEFT JOIN b USING (device_id, c) GROUP BY 1""",
    "upload_split": "SELECT CASE WHEN page_id % 3 <> 0 THEN 'ok' WHEN octet_length(encode(html)) < 1 THEN 'Invalid size' ELSE 'Not a JPEG' END AS reason, count(*) AS n FROM pages GROUP BY 1",
    "template_class": _IOU + _BEST.format(least=LEAST, margin=MARGIN),
    "template_top2": _IOU + "SELECT id, template, iou, CAST(row_number() OVER (PARTITION BY id ORDER BY iou DESC, template DESC) AS INTEGER) AS rank FROM iou QUALIFY rank <= 2",
    "ink_profile": _BITS + "SELECT id % 7 AS device_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos % 8 < 1 OR pos % 8 >= 7 THEN 0.0::DOUBLE ELSE avg(bit) END AS ink FROM b GROUP BY 1, pos",
    "label_siblings": """WITH l AS (SELECT DISTINCT s_name AS label FROM supplier)
SELECT a.label AS a, b.label AS b, CASE WHEN substr(a.label, 2) = substr(b.label, 2) THEN 'first' ELSE 'last' END AS differs
FROM l a JOIN l b ON a.label < b.label AND length(a.label) = length(b.label)
 AND (substr(a.label, 2) = substr(b.label, 2) OR left(a.label, length(a.label) - 1) = left(b.label, length(b.label) - 1))""",
    "upload_gate": """WITH u AS (SELECT page_id AS id, page_id % 3 <> 0 AS jpeg, CAST(octet_length(encode(html)) + CASE WHEN page_id % 3 <> 0 THEN 3 ELSE 0 END AS BIGINT) AS size FROM pages)
SELECT id, CASE WHEN size < 1 OR size > 10485760 THEN 'Invalid size' WHEN NOT jpeg THEN 'Not a JPEG' ELSE 'ok' END AS reason, size FROM u""",
    "settings_pivot": """SELECT s_suppkey AS device_id, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_nationkey + 1 AS INTEGER) WHEN s_suppkey % 2 = 0 THEN NULL ELSE 1 END AS billing_day,
       'ip_cu_fd' AS billing_metric, 'ep_cu_fd' AS export_metric, CAST(0 AS DECIMAL(10, 4)) AS rate_per_kwh, CAST(0 AS DECIMAL(10, 2)) AS fixed_charge,
       CASE WHEN s_suppkey % 4 = 0 THEN 'EUR' WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'INR' END AS currency, 'Asia/Kolkata' AS tz, '' AS tariff_slabs,
       CAST(0 AS DECIMAL(8, 3)) AS surcharge_pct, CAST(0 AS DECIMAL(10, 2)) AS subsidy,
       CASE WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey % 90 AS INTEGER) WHEN s_suppkey % 2 = 0 THEN NULL ELSE 20 END AS alert_gap_min
FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 4 = 0 OR s_suppkey % 5 = 0 OR s_suppkey % 2 = 0""",
    "settings_update": """SELECT s_suppkey AS device_id, k, CASE WHEN s_suppkey % 2 = 0 AND k = 'currency' THEN 'new ' || s_suppkey ELSE 'old' END AS v FROM supplier, (VALUES ('currency'), ('tz')) t(k)""",
    "slab_parse": """SELECT s_suppkey AS device_id, 0 AS pos, 50.0::DOUBLE AS size, CAST(s_suppkey % 9 AS DOUBLE) + 0.5 AS rate FROM supplier
UNION ALL SELECT s_suppkey, 1, CAST(100 + s_suppkey % 50 AS DOUBLE), 4.2 FROM supplier
UNION ALL SELECT s_suppkey, 2, NULL, 7.9 FROM supplier WHERE s_suppkey % 2 = 0""",
}
