import pytest

from ledgerlens.functions import parse as P


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "ts string")


def test_the_most_common_shape_wins(spark):
    rows = ["bad"] * 30 + ["2025-01-02"] * 2 + ["2025-01-02T03:04:05"] * 5 + [None, " 2025-01-02T03:04:05 "]
    df = frame(spark, rows).repartition(4)
    assert P.infer_ts_format(df, "ts") == "yyyy-MM-dd'T'HH:mm:ss"
    votes = {v.pattern: v.n for v in P.ts_votes(df, "ts").collect()}
    assert votes == {None: 30, "yyyy-MM-dd": 2, "yyyy-MM-dd'T'HH:mm:ss": 6}


def test_no_known_shape_is_an_error_and_no_values_are_not(spark):
    with pytest.raises(P.UnknownTimestampFormat):
        P.infer_ts_format(frame(spark, ["5 May 2025", "6 May 2025"]), "ts")
    assert P.infer_ts_format(frame(spark, [None, None]), "ts") == P.infer_ts_format(frame(spark, []), "ts") == "yyyy-MM-dd HH:mm:ss"
    assert P.infer_ts_format(spark.range(3), "ts") == "yyyy-MM-dd HH:mm:ss"


def test_every_shape_is_recognised_alone(spark):
    for text, fmt in [("2025-01-02 03:04:05", 0), ("2025-01-02 03:04:05.25", 1), ("2025-01-02T03:04", 5), ("01/02/2025", 9)]:
        assert P.infer_ts_format(frame(spark, [text]), "ts") == P.TS_SHAPES[fmt][1]
