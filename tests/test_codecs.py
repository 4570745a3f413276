import pytest
from pyspark.sql import functions as F

from tidemark.errors import QueryError
from tidemark.functions.codecs import FieldType, of_name, parse_schema, schema_text
from tidemark.functions.placement import checksum_values, folded_values, partition

U1 = "5c0ffee5-0a1b-4c2d-9e3f-00d15ea5e0d1"
CASES = [
    ("BOOL", "true", "true"), ("BOOL", "false", "false"), ("BOOL", "0", "false"), ("BOOL", "1", "true"), ("BOOL", "9", "true"), ("BOOL", "four", "true"), ("BOOL", "", "false"),
    ("BYTE", "0", "0"), ("BYTE", "255", "255"), ("BYTE", "256", None), ("BYTE", "73", "73"), ("BYTE", "4two", None), ("BYTE", "-1", None), ("BYTE", None, "0"),
    ("INT", "2147483647", "2147483647"), ("INT", "-2147483648", "-2147483648"), ("INT", "-40960", "-40960"), ("INT", "2147483648", None), ("INT", "1.5", None), ("INT", "", "0"),
    ("LONG", "9223372036854775807", "9223372036854775807"), ("LONG", "-17", None), ("LONG", "8eight", None), ("LONG", "9" * 30, None),
    ("STRING", "bread & salt", "bread & salt"), ("STRING", "", ""), ("STRING", None, ""),
    ("UUID", U1, U1), ("UUID", U1.upper(), U1), ("UUID", U1.replace("-", "+"), U1), ("UUID", U1[:-1], None), ("UUID", "g" + U1[1:], None),
    ("IPV4", "255.255.255.255", "255.255.255.255"), ("IPV4", "0.0.0.0", "0.0.0.0"), ("IPV4", "10.20.0.7", "10.20.0.7"), ("IPV4", "256.1.1.1", None), ("IPV4", "1.2.3", None), ("IPV4", "1.2.3.4.", None), ("IPV4", "", "0.0.0.0"),
    ("TIME", "1970-01-01 00:00:01", "1970-01-01 00:00:01"), ("TIME", "2016-02-29 07:08:09", "2016-02-29 07:08:09"), ("TIME", "1414768381000", "2014-10-31 15:13:01"), ("TIME", "2014-13-01 00:00:00", None), ("TIME", "x", None), ("TIME", "", "1970-01-01 00:00:00"),
    ("BYTEARRAY[3]", "abc", "abc"), ("BYTEARRAY[3]", "abcd", None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_parse_and_render(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for name in {c[0] for c in CASES}:
            kind, mine = of_name(name), [c for c in CASES if c[0] == name]
            rows = spark.createDataFrame([(i, c[1]) for i, c in enumerate(mine)], "i int, text string")
            found = {r["i"]: r["out"] for r in rows.select("i", kind.render(kind.parse(F.col("text"))).alias("out")).collect()}
            assert [found[i] for i in range(len(mine))] == [c[2] for c in mine], name
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_schema_text_round_trip():
    text = "uuid(UUID),str(STRING),int(INT),bool(BOOL),long(LONG),ip(IPV4),t(TIME),b(BYTEARRAY[16]),x(BYTE)"
    assert schema_text(parse_schema(text)) == text
    assert schema_text(parse_schema("a , b(INT)")) == "a(STRING),b(INT)"
    for bad in ("a(int)", "a(FLOAT)", "a(INT),,b", "a(INT) b", "", "a,a", "__key(INT)", "a(BYTEARRAY[0])"):
        with pytest.raises(QueryError):
            parse_schema(bad)


def test_placement(spark):
    import pandas as pd

    assert hex(checksum_values(pd.Series(["123456789"]))[0]) == "0x4b37"
    assert checksum_values(pd.Series(["", None])).tolist() == [0xFFFF, 0xFFFF]
    assert folded_values(pd.Series([b"\x01\x02", b"", b"\xff"])).tolist() == [3, 0, -1]

    def placed(uid: str, n: int) -> int:
        digits = int(uid.replace("-", ""), 16)
        mixed = digits >> 96 ^ digits >> 64 & 0xFFFFFFFF ^ digits >> 32 & 0xFFFFFFFF ^ digits & 0xFFFFFFFF
        signed = mixed - (1 << 32) if mixed >> 31 else mixed
        return min(abs(signed), 2**31 - 1) % n

    uids = [U1, "f00dfeed-0a1b-4c2d-9e3f-00d15ea5e0d1", "80000000-0000-0000-0000-000000000000", None]
    rows = spark.createDataFrame([(u,) for u in uids], "u string").select("u", partition(FieldType("UUID"), F.col("u"), 5).alias("p"))
    assert {r["u"]: r["p"] for r in rows.collect()} == {u: placed(u, 5) if u else None for u in uids}
    numbers = spark.createDataFrame([(-7, -(2**40) - 3)], "i int, l long").select(partition(FieldType("INT"), F.col("i"), 4), partition(FieldType("LONG"), F.col("l"), 4)).first()
    assert 0 <= numbers[0] < 4 and 0 <= numbers[1] < 4
