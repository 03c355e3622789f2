from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cliplab.functions import outcomes, parse
from cliplab.plans.parsing import DEVICE_RULES


def values(spark, fn, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_hms(spark):
    assert values(spark, parse.hms_to_seconds, ["00:01:30", " 1:00:00.5 ", "bad", "1:2", None, ""]) == [90.0, 3600.5, None, None, None, None]


def test_timestamp(spark):
    got = values(spark, parse.parse_timestamp, ["1:02:03.5", "02:03,25", "1:2:3", "x", "90:00"])
    assert got == [3723.5, 123.25, None, None, 5400.0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("ulcer_1", 1), ("normal_12", 12), ("segment_0", 0), ("no_underscore_number_42", 42), ("noint", -1), ("", -1)],
)
def test_segment_number(spark, text, expected):
    assert values(spark, parse.segment_number, [text]) == [expected]


def test_frame_number(spark):
    names = ["frame_001.jpg", "frame_042.png", "vid_01__ulcer_1__frame_100.jpg", "noints.jpg"]
    assert values(spark, parse.frame_number, names) == [1, 42, 100, -1]


def test_sample_name(spark):
    got = values(spark, parse.sample_name, ["vid_9__SAMPLE_3__frame_007", "a__b__ulcer_Ulcer_2__frame_1x", "frame_1"])
    assert tuple(got[0]) == ("vid_9", "SAMPLE_3", 7)
    assert tuple(got[1]) == ("a__b", "ulcer_Ulcer_2", 1)
    assert got[2] is None


def test_video_id_and_causes(spark):
    assert values(spark, parse.normalize_video_id, [" Vid-01 A\t"]) == ["vid_01a"]
    assert values(spark, parse.safe_cause, ["  motion blur! ", "///", "é-x"]) == ["motion_blur", "Unknown", "é-x"]
    assert values(spark, parse.seconds_to_text, [3723.5, 59.999], "double") == ["01:02:03.50", "00:00:60.00"]


def test_stopwatch(spark):
    texts = ["O0:01:3S", "10:00:00 x 11:30:05", "12:34 and 1:05", "nothing", "00:59:59\n01:00:10"]
    assert values(spark, parse.stopwatch_seconds, texts) == [95, 41405, 65, None, 3599]
    hinted = lambda c: parse.stopwatch_seconds(c, hint=F.lit(36000.0))
    assert values(spark, hinted, texts) == [95, 36000, 65, None, 3610]
    short = lambda c: parse.stopwatch_seconds(c, minutes_only=True)
    assert values(spark, short, ["1:02:03", "5:07"]) == [None, 307]


def test_timestamp_fields(spark):
    texts = ["1:2:03", "123:04:05", " 7:08 ", "7:8", "07:08.", "07:08.5.1", "1:02:03:04", "", ":05", "a:05", "-1:05", "1: 05", "1:02:03.", "12", None]
    assert values(spark, parse.parse_timestamp, texts) == [None, 443045.0, 428.0] + [None] * 12


def test_stopwatch_grammar(spark):
    """Hours stand without blanks, minutes may have them; readings don't overlap and aren't parts of others."""
    hours = {"1:02:03": None, "10:00:00:05:06": 36000, "11:22:33:44:55:06": 161706, "10:60:00 20:00:01": 72001, "10-20:30:40": 73840}
    assert values(spark, parse.stopwatch_seconds, list(hours)) == list(hours.values())
    short = lambda c: parse.stopwatch_seconds(c, minutes_only=True)
    minutes = {
        "1 : 02": 62, "1 :\n02": 62, "1234:05": None, "123:05": 7385, "1:60": None, "1:5": None, "1 : 02 : 03": 62, "1:02 : 03": 62,
        "1:02:03 : 04": 184, "9:59-10:01": 601, ":05:06": 306, "1:02: 03": 62, "": None, "12": None, ": 5 :": None,
    }
    got = dict(zip(minutes, values(spark, short, list(minutes)), strict=True))
    # "1:02:03 : 04" has no reading: 02 and 03 continue a tight one
    assert got == {**minutes, "1:02:03 : 04": None}


def test_sample_name_fields(spark):
    texts = {
        "a___sample_1__frame_2": ("a_", "sample_1", 2),
        "__sample_1__frame_1": None,
        "__sample_1__frame_1__sample_2__frame_3": ("__sample_1__frame_1", "sample_2", 3),
        "a__sample_1___frame_2": None,
        "a__sample_x__frame_2": None,
        "a__sample_1__frame_": None,
        "a__sample_1__FRAME_12_left": ("a", "sample_1", 12),
        "a__b__c__ULCER_NONULCER_4__frame_9__x": ("a__b__c", "ULCER_NONULCER_4", 9),
        "sample_1__frame_2": None,
        "": None,
    }
    got = values(spark, parse.sample_name, list(texts))
    assert [g and tuple(g) for g in got] == list(texts.values())


def test_sizes_and_media(spark):
    assert values(spark, parse.size_code, ["<5mm", " 5-20mm", ">20mm", "?", None]) == [1, 2, 3, None, None]
    assert values(spark, parse.size_label, [1, 3, None, 9], "int") == ["<5mm", ">20mm", "unknown", "unknown"]
    assert values(spark, parse.is_media_file, ["a/b.JPG", "a/.b.jpg", "a/b.txt"]) == [True, False, False]


def test_model_names(spark):
    fn = lambda c: parse.model_display_name(c, {"resnet": "ResNet"})
    assert values(spark, fn, ["resnet-allBackbone", "vit-9Backbone", "x"]) == ["ResNet", "vit", "x"]


def test_routing_prefers_uncertain(spark):
    fn = lambda c: outcomes.route(c, 0.5, 0.1)
    assert values(spark, fn, [0.45, 0.55, 0.62, 0.38, 0.9, 0.1], "double") == [
        "uncertain", "uncertain", "informative", "non_informative", "informative", "non_informative",
    ]


def test_vector_moments(spark):
    import numpy as np

    x = np.array([1.0, 2.0, 4.0, 9.0])
    df = spark.createDataFrame([(x.tolist(),), ([],), ([3.0, 3.0],)], "v array<double>")
    got = [r[0] for r in df.select(outcomes.vector_moments(F.col("v"))).collect()]
    d = x - x.mean()
    assert got[0]["mean"] == pytest.approx(4.0)
    assert got[0]["var"] == pytest.approx(d.dot(d) / 4)
    assert got[0]["skew"] == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5)
    assert got[0]["kurt"] == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3)
    assert tuple(got[1]) == (0.0, 0.0, 0.0, 0.0)
    assert got[2]["var"] == 0.0 and got[2]["skew"] is None


def test_device_rule(spark):
    rows = [(0.1, 0.1, 0.1, 0.5, "Olympus"), (5.0, 30.0, 5.0, 13.0, "Fuji"), (13.0, 15.0, 13.5, 14.0, "Olympus"), (1.0, 26.0, 20.0, 30.0, "Fuji"), (1.0, 5.0, 20.0, 30.0, "Olympus")]
    df = spark.createDataFrame(rows, "b double, g double, r double, t double, want string")
    values = {"g": F.col("g"), "r": F.col("r"), "total": F.col("t"), "gap": F.abs(F.col("b") - F.col("r"))}
    assert df.filter(outcomes.first_rule(values, DEVICE_RULES, "Olympus") != F.col("want")).count() == 0
