"""Value functions on their edges."""

from pyspark.sql import functions as F

from millrace.functions import values as v


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()


def test_labels_and_bits(spark):
    r = one(spark, v.set_labels(F.lit(5), ["a", "b", "c"]), v.set_text(F.lit(0), ["a"]), v.enum_label(F.lit(0), ["a"]), v.enum_label(F.lit(1), ["a"]), v.enum_label(F.lit(2), ["a"]))
    assert tuple(r) == (["a", "c"], "", "", "a", None)
    r = one(spark, v.bit_text(F.lit(5), 8), F.hex(v.bit_bytes(F.lit("0000000000000101"))), F.hex(v.bit_bytes(F.lit("00000000"))))
    assert tuple(r) == ("00000101", "0005", "00")
    assert one(spark, v.uuid_text(F.unhex(F.lit("0123456789ABCDEF0123456789ABCDEF"))))[0] == "01234567-89ab-cdef-0123-456789abcdef"


def test_texts(spark):
    r = one(spark, v.split_clean(F.lit(" a, ,b ,")), v.middle(F.array(F.lit(4), F.lit(1), F.lit(2))), v.middle(F.array(F.lit(4), F.lit(1))), v.middle(F.array().cast("array<int>")))
    assert tuple(r) == (["a", "b"], 2, 2, None)
    cell = lambda code, x: v.cell_text(F.lit(code), F.lit(x).cast("string"))
    assert tuple(one(spark, cell(17, "5"), cell(3, "5"), cell(253, "it's \\"), cell(253, None))) == ("FROM_UNIXTIME(5)", "5", "'it\\'s \\\\'", "NULL")
    none = F.lit(None).cast("string")
    assert tuple(one(spark, v.empty_not_null(none, F.lit(False), F.lit(252)), v.empty_not_null(none, F.lit(True), F.lit(252)))) == ("", None)
    labels = F.array(F.lit("x"), F.lit("y"))
    assert tuple(one(spark, v.parameter(F.lit(16), F.lit("00000101"), labels), v.parameter(F.lit(248), F.lit(""), labels), v.parameter(F.lit(3), F.lit("7"), labels))) == ("05", "x,y", "7")


def test_fetch_count(spark):
    get = lambda base, filled, latency, faster: tuple(one(spark, *v.fetch_count(F.lit(base).cast("long"), F.lit(filled), F.lit(latency), 1000, F.lit(faster))))
    assert get(None, 5000, 0, False) == (50, 50)
    assert get(100, 5000, 10, True) == (190, 190)
    assert get(100, 5000, 4000, True) == (15, 10)
    assert get(500, 37, 10, False) == (490, 30)
