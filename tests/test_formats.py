import pytest

from tidewater.errors import JobError
from tidewater.functions.formats import strftime_to_spark


@pytest.mark.parametrize("fmt,expected", [
    ("%Y-%m-%d", "yyyy'-'M'-'d"),
    ("%Y%m%d", "yyyyMMdd"),
    ("%d/%m/%Y %H:%M:%S", "d'/'M'/'yyyy' 'H':'m':'s"),
    ("%Y-%m-%dT%H:%M:%S.%f", "yyyy'-'M'-'d'T'H':'m':'s'.'SSSSSS"),
    ("%F", "yyyy'-'M'-'d"),
    ("%d %B %Y", "d' 'MMMM' 'yyyy"),
    ("%I:%M %p", "h':'m' 'a"),
    ("it's %Y", "'it''s 'yyyy"),
    ("100%% %Y", "'100% 'yyyy"),
])
def test_translation(fmt, expected):
    assert strftime_to_spark(fmt) == expected


@pytest.mark.parametrize("fmt", ["%a %Y", "%Q"])
def test_unsupported(fmt):
    with pytest.raises(JobError):
        strftime_to_spark(fmt)


def test_parses_in_spark(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("2020-1-5",), ("20200105",), ("2020-13-01",), ("2020-01-05x",)], "s string")
    got = [r[0] for r in df.select(F.try_to_date("s", strftime_to_spark("%Y-%m-%d"))).collect()]
    assert str(got[0]) == "2020-01-05" and got[2] is None and got[3] is None
    got2 = df.select(F.try_to_date("s", strftime_to_spark("%Y%m%d"))).collect()[1][0]
    assert str(got2) == "2020-01-05"
