import random

import pytest
from pyspark.sql import functions as F

from netquarry.functions import netmath
from netquarry.functions.addresses import CODES, addresses, field, template, with_fields
from netquarry.functions.addresses import found as found_in
from netquarry.functions.plain import extract, register

CASES = [
    ("src 10.1.2.3 dst 10.1.2.4", "i:10.1.2.3 i:10.1.2.4"),
    ("010.001.002.003 x", "i:10.1.2.3"),
    ("x10.1.2.3abc", "i:10.1.2.3"),
    ("10.1.2.3. end", ""),
    ("..10.1.2.3", ""),
    ("v1.10.1.2.3 a", ""),
    ("1.2.3.256", ""),
    ("1.2.3.4567", ""),
    ("192.168.100.1001", "i:192.168.100.100"),
    ("at 192.168.100.100. end", "i:192.168.100.100 i:192.168.100.100"),
    ("10.1.2.3:80 -> 10.1.2.4:443 mac AA:BB:CC:DD:EE:FF", "i:10.1.2.3 i:10.1.2.4 m:aa:bb:cc:dd:ee:ff"),
    ("mac aa-bb-cc-dd-ee-ff this is a longer text line", "m:aa:bb:cc:dd:ee:ff"),
    ("ab:cd:ef:01:23:45 10.0.0.1 fe80::2", "i:10.0.0.1 m:ab:cd:ef:01:23:45 I:fe80::2"),
    ("MAC=aa:bb:cc:dd:ee:ff:11:22:33:44:55:66:08:00 SRC=1.2.3.4", "i:1.2.3.4 m:aa:bb:cc:dd:ee:ff"),
    ("fe80::1 ok", "I:fe80::1"),
    ("fe80::1: msg", "I:fe80::1:"),
    ("2001:DB8:0:0:0:0:0:1 up", "I:2001:DB8:0:0:0:0:0:1"),
    ("addr=[2001:db8::5]:443", "I:2001:db8::5"),
    ("std::string x", "I:d::"),
    (":: x", "I:::"),
    ("::ffff:192.168.1.1", "i:192.168.1.1 I:::ffff:192"),
    ("12:34:56 up", ""),
    ("a::b::c", ""),
    ("deadbeef::1", ""),
    ("1:::2", "I:1:::2"),
    ("10.0.0.1\r", "i:10.0.0.1"),
    ("1:2:3:4:5:6:192.0.2.1 x", "i:192.0.2.1 I:1:2:3:4:5:6:192.0.2.1"),
    ("1:2:3:4:5:6:7:192.0.2.1", "i:192.0.2.1 I:1:2:3:4:5:6:7:192"),
    ("a::2:3:4:5:6:7:192.0.2.256", "I:a::2:3:4:5:6:7:192"),
    ("x:1.2.3.80::1", "i:1.2.3.80 I:80::1"),
    ("", ""),
    (None, ""),
]
STRICT = [
    ("::ffff:192.168.1.1", "i:192.168.1.1 I:::ffff:192.168.1.1"),
    ("64:ff9b::192.0.2.33, 1:2:3:4:5:6:192.0.2.1", "i:192.0.2.33 i:192.0.2.1 I:64:ff9b::192.0.2.33 I:1:2:3:4:5:6:192.0.2.1"),
    ("10.1.2.3. end", "i:10.1.2.3"),
    ("192.168.100.1001", ""),
    ("at 192.168.100.100. end", "i:192.168.100.100"),
    ("fe80::1: msg", "I:fe80::1"),
    ("std::string x", ""),
    (":: x", ""),
]


def found(spark, texts, **options):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select("k", addresses("t", **options).alias("a")).collect()
    return [[(CODES[x["kind"]], x["address"]) for x in r["a"]] for r in sorted(rows)]


def listed(pairs):
    return " ".join(f"{c}:{a}" for c, a in pairs)


def test_documented_cases(spark):
    assert [listed(x) for x in found(spark, [t for t, _ in CASES])] == [e for _, e in CASES]


def test_strict_cases(spark):
    assert [listed(x) for x in found(spark, [t for t, _ in STRICT], dialect="strict")] == [e for _, e in STRICT]


@pytest.mark.parametrize("alphabet", ["0123456789. ", "0123abcDEF:- ", "12.:-fe x", "aA0:-."])
def test_same_as_plain_rules(spark, alphabet):
    pick = random.Random(alphabet)
    texts = ["".join(pick.choice(alphabet) for _ in range(pick.randrange(1, 60))) for _ in range(1500)]
    if ":" in alphabet:
        mixed = ["::", "1:2:3:4:5:6:", "a:b::", "ffff:", "10.0.0.1", "1.2.3.4", ".5", "5", " ", "-", "aa:bb:cc:dd:ee:ff", "e", "::1", ":"]
        texts += ["".join(pick.choice(mixed) for _ in range(pick.randrange(1, 7))) for _ in range(2500)]
    for dialect in ("ref", "strict"):
        assert found(spark, texts, dialect=dialect) == [[(CODES[k], a) for k, a in extract(t, dialect)] for t in texts]


def test_limits(spark):
    long = "10.0.0.1 " + "x" * 8191
    many = "10.0.0.1 " * 300
    assert [len(x) for x in found(spark, ["192.168.100.100" + "." * 400, "192.168.100.100" + "." * 240])] == [256, 241]
    assert [len(x) for x in found(spark, [long, many, "10.0.0.1 " + "é" * 4092])] == [0, 256, 0]
    assert [len(x) for x in found(spark, [long], max_line_bytes=None)] == [1]
    assert [len(x) for x in found(spark, [many, long], dialect="strict")] == [300, 1]
    assert [len(x) for x in found(spark, [many], max_addresses=3)] == [3]


def test_fields_template_and_kinds(spark):
    df = spark.createDataFrame([("fe80::2 10.0.0.1 ab:cd:ef:01:23:45",)], "t string").withColumn("a", found_in("t"))
    row = df.select(field(F.col("a"), 2).alias("second"), template(F.col("a")).alias("template"), with_fields(F.col("a"), ["mac"]).alias("macs")).first()
    assert (row["second"], row["template"], [(m["address"], m["field"]) for m in row["macs"]]) == ("fe80::2", "%i%I%m", [("ab:cd:ef:01:23:45", 3)])
    text = "fe80::2 10.0.0.1 ab:cd:ef:01:23:45"
    for kinds, want in ((["ipv4"], "i:10.0.0.1"), (["mac"], "m:ab:cd:ef:01:23:45"), (["mac", "ipv6"], "I:fe80::2 m:ab:cd:ef:01:23:45")):
        assert [listed(x) for x in found(spark, [text], kinds=kinds)] == [want]


def test_wrong_options(spark):
    with pytest.raises(ValueError):
        addresses("t", dialect="other")
    with pytest.raises(ValueError):
        addresses("t", kinds=["ipx"])


def test_table_function(spark):
    register(spark)
    rows = spark.sql("SELECT * FROM extract_addresses('a 10.0.0.1 b fe80::1')").collect()
    assert [tuple(r) for r in rows] == [("ipv4", "10.0.0.1", 1), ("ipv6", "fe80::1", 2)]


def test_table_function_of_lines(spark):
    """The batched function gives what the Column form gives, in as many tasks as the table has; nulls and extra columns are borne."""
    register(spark)
    rows = [("a", k, f"x {k % 256}.1.2.3 and ::{k % 7:x} 02:00:00:00:00:0{k % 10}" * (k % 4), k) for k in range(3000)]
    rows += [("a", 3000, None, 1), ("a", 3001, "", 1), (None, None, "10.0.0.1", None), ("a", 3002, "10.0.0.1 " * 300, 1)]
    lines = spark.createDataFrame(rows, "file string, line_no long, text string, field long").repartition(4)
    call = lambda df: spark.sql("SELECT * FROM extract_from_lines(TABLE(SELECT line_no, text, file, field FROM {df}))", df=df)
    want = lines.select("file", "line_no", F.inline(addresses("text"))).select("file", "line_no", "kind", "address", "field")
    key = lambda r: str(tuple(r))
    assert sorted(map(key, call(lines).collect())) == sorted(map(key, want.collect()))
    assert call(lines).rdd.getNumPartitions() == 4
    assert call(lines.limit(0)).collect() == []


def test_numbers(spark):
    df = spark.createDataFrame([("10.1.2.3",), ("255.255.255.255",), ("fe80::1",), (None,)], "a string")
    a = F.col("a")
    rows = df.select("a", netmath.ipv4_number(a).alias("n"), netmath.ipv4_text(netmath.ipv4_number(a)).alias("t"), netmath.in_network(a, "10.0.0.0/8").alias("net"), netmath.in_range(a, "10.1.2.3", "10.1.2.3").alias("range")).collect()
    assert [tuple(r)[1:] for r in rows] == [(167838211, "10.1.2.3", True, True), (4294967295, "255.255.255.255", False, False), (None, "", False, False), (None, "", False, False)]


def test_ipv6_numbers(spark):
    import ipaddress

    pick = random.Random(2)
    texts = ["::", "::1", "1::", "fe80::1:", "::ffff:192.0.2.33", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:", "2001:DB8::5", "1:2:3:4:5:6:192.0.2.1"]
    texts += [str(ipaddress.IPv6Address(pick.getrandbits(128) & pick.getrandbits(128) & (pick.getrandbits(128) >> pick.randrange(120)))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts] + [("10.0.0.1",), ("1:2",), (None,)], "a string")
    a = F.col("a")
    out = {r["a"]: r for r in rows.select("a", netmath.ipv6_hex(a).alias("x"), netmath.in_network(a, "2001:db8::/32").alias("net"), netmath.in_range(a, "::1", "::ffff:ffff:ffff").alias("range")).collect()}
    for t in texts:
        number = int(ipaddress.IPv6Address(t if t.endswith("::") else t.removesuffix(":")))
        assert out[t]["x"] == f"{number:032x}" and out[t]["range"] == (1 <= number <= (1 << 48) - 1) and out[t]["net"] == (number >> 96 == 0x20010DB8)
    assert out["10.0.0.1"]["x"] is None and out["1:2"]["x"] is None and out[None]["x"] is None and not out[None]["net"]
    with pytest.raises(ValueError):
        netmath.in_range(a, "10.0.0.1", "::1")
