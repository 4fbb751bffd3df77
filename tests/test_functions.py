from pyspark.sql import functions as F

from recscan.functions import scalars as S
from recscan.operators import spans as P


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_labels_and_slugs(spark):
    r = one(spark, S.normalize_label(F.lit("Pick-Up   Blue Cup!!")), S.normalize_label(F.lit(" ?! ")), S.slugify(F.lit("  Hello, World! ")), S.slugify(F.lit("--")))
    assert list(r) == ["pick up blue cup", "unknown", "hello-world", "item"]


def test_interval_id_is_stable_to_the_millisecond(spark):
    key = F.lit("a/b.rec")
    r = one(spark, S.interval_id(key, F.lit(1.0), F.lit(2.0)), S.interval_id(key, F.lit(1.0), F.lit(2.0)), S.interval_id(key, F.lit(1.01), F.lit(2.0)))
    assert r[0] == r[1] != r[2] and r[0].startswith("int_")


def test_analysis_windows(spark):
    w = one(spark, P.analysis_windows(F.lit(0.0), F.lit(400.0), 180.0, 15.0), P.analysis_windows(F.lit(0.0), F.lit(10.0)))
    assert [tuple(x) for x in w[0]] == [(0.0, 180.0), (165.0, 345.0), (330.0, 400.0)]
    assert [tuple(x) for x in w[1]] == [(0.0, 10.0)]


def test_text_of_sizes_and_durations(spark):
    r = one(spark, S.human_size(F.lit(100)), S.human_size(F.lit(1536)), S.human_size(F.lit(3 << 30)), S.human_duration(F.lit(42.0)), S.human_duration(F.lit(125.0)), S.human_duration(F.lit(3725.0)))
    assert list(r) == ["100.0 B", "1.5 KB", "3.0 GB", "42s", "2m 05s", "1h 02m 05s"]


def test_relative_time_saturates(spark):
    r = one(spark, S.relative_s(F.lit(2_500_000), F.lit(1_000_000)), S.relative_s(F.lit(5), F.lit(10)), S.relative_s(F.lit(5), F.lit(0)))
    assert list(r) == [1.5, 0.0, 0.0]


def test_json_and_chat_answers(spark):
    r = one(spark, S.json_object(F.lit('```json\n{"a": 1}\n```')), S.json_object(F.lit("none")), S.chat_content(F.lit('[{"type":"text","text":"a"},{"text":"b"}]')), S.chat_content(F.lit('"x"')))
    assert list(r) == ['{"a": 1}', None, "a\nb", "x"]


def test_cosine_area_and_retry(spark):
    points = F.array(F.struct(F.lit(-1.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(0.5).alias("x"), F.lit(0.5).alias("y")))
    arr = lambda *v: F.array(*map(F.lit, v))
    r = one(spark, S.cosine(arr(1.0, 0.0), arr(1.0, 1.0)), S.cosine(arr(0.0, 0.0), arr(1.0, 1.0)), S.area_fraction(points), S.retry_delay(F.lit(3)), S.retry_delay(F.lit(9)))
    assert [round(x, 6) for x in r] == [0.707107, 0.0, 0.25, 80.0, 300.0]
