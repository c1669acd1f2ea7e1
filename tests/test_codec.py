import pytest
from pyspark.sql import functions as F

from keyloom.functions import bloom, codec, slices
from keyloom.plans import queries as core
from keyloom.plans.envelope import shortest_separator, successor


def test_varints_and_slices():
    for n in (0, 1, 127, 128, 300, 2**32 - 1, 2**32, 2**64 - 1):
        assert codec.read_varint(codec.varint(n)) == (n, len(codec.varint(n)))
    data = codec.length_prefixed(b"abc") + codec.length_prefixed(b"de")
    a, at = codec.read_length_prefixed(data)
    b, end = codec.read_length_prefixed(data, at)
    assert (a, b, end) == (b"abc", b"de", len(data))
    assert codec.read_internal_key(codec.internal_key(b"user_key", 42, 1)) == (b"user_key", 42, 1)
    for bad in (b"", b"\xff" * 11, b"\x80"):
        with pytest.raises(ValueError):
            codec.read_varint(bad)


def test_hashes_and_runs(spark):
    assert codec.murmur3(b"") == 0 and codec.murmur3(b"hello") == 0x248BFA47 and codec.murmur3(b"hello, world") == 0x149BBB7F
    assert codec.fnv1a(b"a") == 0xE40C292C and codec.fnv1a(b"a", 64) == 0xAF63DC4C8601EC8C
    texts = [b"", b"a", b"aa", b"aaa", b"z" * 5000, bytes(range(256)) * 3 + b"qq" + b"r" * 131, "naïve 𝒳".encode()]
    for t in texts:
        assert codec.unrle(codec.rle(t)) == t
    assert len(codec.rle(b"z" * 5000)) < 100
    df = spark.createDataFrame([(bytearray(t),) for t in texts], "b binary")
    assert df.filter(codec.unrle_col(codec.rle_col(F.col("b"))) != F.col("b")).count() == 0
    assert spark.range(1).select(F.crc32(F.lit("123456789"))).first()[0] == 0xCBF43926


def test_separators():
    assert successor(b"ab") == b"ac" and successor(b"a\xff") == b"b" and successor(b"\xff") is None
    assert b"abc" <= shortest_separator(b"abc", b"abz") < b"abz"


def test_columns_agree_with_functions(spark):
    values = [0, 1, 127, 128, 300, 2**32 - 1, 2**32, 2**63 - 1]
    texts = [b"", b"a", b"abc", b"abcd", b"abcde", b"12345678", b"123456789", bytes(range(256)), "h\u00e9llo".encode(), None]
    n = spark.createDataFrame([(v,) for v in values], "n long")
    for r in n.select("n", codec.varint_col(F.col("n")).alias("v"), codec.fixed_col(F.col("n")).alias("f"), codec.fixed_col(F.col("n"), 32).alias("g"), codec.varint_size(F.col("n")).alias("s")).collect():
        assert bytes(r["v"]) == codec.varint(r["n"]) and len(r["v"]) == r["s"]
        assert bytes(r["f"]) == r["n"].to_bytes(8, "little") and bytes(r["g"]) == (r["n"] & 0xFFFFFFFF).to_bytes(4, "little")
    back = n.select("n", codec.read_varint_col(codec.varint_col(F.col("n"))).alias("v"), codec.read_fixed_col(codec.fixed_col(F.col("n"))).alias("f"))
    assert back.filter("v <> n OR f <> n OR v IS NULL").count() == 0
    assert spark.range(1).select(codec.read_varint_col(F.lit(b"\x80")).alias("x"), codec.read_fixed_col(F.lit(b"abc")).alias("y")).first() == (None, None)
    d = spark.createDataFrame([(i, None if t is None else bytearray(t)) for i, t in enumerate(texts)], "i int, b binary")
    b = F.col("b")
    got = {r["i"]: r for r in d.select("i", codec.murmur3_col(b).alias("murmur"), codec.hash32_col(b, 7).alias("h32"), codec.hash64_col(b).alias("h64"), codec.city32_col(b).alias("c32"), codec.city64_col(b).alias("c64"), codec.fnv1a_col(b).alias("fnv"), codec.fnv1a_col(b, 64, True).alias("fnv64"), codec.slice_hash_col(b).alias("sl"), codec.murmur3_128_col(b).alias("m128"), codec.read_internal_key_col(codec.internal_key_col(b, F.lit(42), F.lit(1))).alias("k")).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        if t is None:
            assert all(v is None for v in r[1:-1])
            continue
        u = lambda x: x & (1 << 64) - 1
        assert (r["murmur"], r["h32"], r["c32"], r["fnv"]) == (codec.murmur3(t), codec.hash32(t, 7), codec.city32(t), codec.fnv1a(t))
        assert (u(r["h64"]), u(r["c64"]), u(r["fnv64"]), u(r["sl"])) == (codec.hash64(t), codec.city64(t), codec.fnv1a(t, 64, True), codec.slice_hash(t))
        assert r["m128"] == "%016x%016x" % codec.murmur3_128(t) and (bytes(r["k"]["key"]), r["k"]["seq"], r["k"]["op"]) == (t, 42, 1)
    assert codec.murmur3_128(b"hello") == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19) and codec.hash64(b"") == 0
    assert all(codec.crc_unmask(codec.crc_mask(x)) == x for x in (0, 1, 0xCBF43926, 2**32 - 1))


def test_bloom_filters_and_names(spark):
    keys = spark.range(500).select(F.lit("a").alias("cf"), F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"))
    probes = spark.range(1500).select(F.lit("a").alias("cf"), F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"), "id")
    sizes = spark.createDataFrame([("a", 9586, 7)], "cf string, bits long, hashes long")
    got = {r["key"]: r["maybe"] for r in bloom.test(probes, bloom.create(keys, sizes, "cf"), sizes, "cf").collect()}
    assert all(got[f"key{i}"] for i in range(500)) and sum(got[f"key{i}"] for i in range(500, 1500)) < 100
    name = spark.createDataFrame([("MANIFEST-000042",), ("000123.wal",), ("x.wal",)], "n string")
    assert [r[0] for r in name.select(slices.file_number(F.col("n"))).collect()] == [42, 123, None]
    one = name.limit(1).select(slices.find(F.lit("abcabc"), "abc", 1), slices.find(F.lit("ab"), "abc"), slices.substr(F.lit("abcdef"), 2, 3), slices.starts_with(F.lit("abc"), "ab"), slices.ends_with(F.lit("abc"), "ab")).first()
    assert tuple(one) == (3, -1, "cde", True, False)


def _few_events(spark, path, seqs):
    rows = [(s - 1, 1, "view", "{}") for s in seqs]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_file_names_beyond_six_digits(spark, tmp_path):
    """Six digits are the least width, so every number keeps a name of its own; the query's SQL cuts names from 1,000,000 on."""
    seqs = [1, 999_999, 1_000_000, 1_000_001, 5_999_999]
    got = {r["seq"]: (r["wal"], r["manifest"]) for r in core.QUERIES["kv_file_names"](spark, _few_events(spark, tmp_path, seqs)).collect()}
    assert got == {s: (f"{s:06d}.wal", f"MANIFEST-{s:06d}") for s in seqs}
    names = spark.createDataFrame([(n,) for pair in got.values() for n in pair], "n string")
    assert sorted(r[0] for r in names.select(slices.file_number(F.col("n"))).collect()) == sorted(seqs * 2)


def test_varints_beyond_three_bytes(spark, tmp_path):
    """Every varint can be read back; the query's SQL has three bytes at most, so it cuts those from 2**21 on."""
    seqs = [127, 128, 2**14, 2**21 - 1, 2**21, 4_194_304, 5_999_999, 2**28, 2**35]
    got = {r["seq"]: (bytes.fromhex(r["bytes"]), r["back"]) for r in core.QUERIES["kv_varint_codec"](spark, _few_events(spark, tmp_path, seqs)).collect()}
    assert got == {s: (codec.varint(s), s) for s in seqs}
    assert all(codec.read_varint(b) == (s, len(b)) for s, (b, _) in got.items())
