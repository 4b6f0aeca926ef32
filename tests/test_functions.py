from pyspark.sql import functions as F

from granary.functions import digest, paths, text
from granary.operators import boot, label
from granary.operators.common import numbered


def column(spark, values, make, kind="string"):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").withColumn("r", make(F.col("v")))
    return [r.r for r in frame.orderBy("k").collect()]


def test_pinned_digest():
    assert digest.verity_bytes(b"hello world").hex() == "1e2eaa4202d750a41174ee454970b92c1bc2f925b1e35076d8c7d5f56362ba64"


def test_digest_expression_equals_kernel(spark):
    data = [b"x" * n for n in (0, 1, 4095, 4096, 4097, 8192, 4096 * 64, 4096 * 64 + 1, 4096 * 128, 4096 * 128 + 1, 4096 * 129)]
    for algorithm in digest.ALGORITHMS:
        assert column(spark, data, lambda c: digest.verity(c, algorithm), "binary") == [digest.verity_bytes(d, algorithm).hex() for d in data]


def test_ids(spark):
    h = "ab" * 32
    assert column(spark, [h], digest.object_path) == ["ab/" + h[2:]]
    assert column(spark, ["x/ab/" + h[2:], "ab/" + h[2:], "abc/d", h], digest.from_object_path) == [h, h, None, None]
    assert column(spark, [h, h[:-1], h[:-1] + "g"], digest.from_hex) == [bytes.fromhex(h), None, None]
    assert column(spark, ["fsverity-sha512-12", "fsverity-sha1-12", "fsverity-sha256-16"], digest.algorithm_name) == [("sha512", 12), None, None]
    assert column(spark, ["a" * 62, "a" * 126, "a"], digest.algorithm_of_name) == ["sha256", "sha512", None]


def test_paths(spark):
    given = ["/", "/a", "/a/b", "/a-b/c"]
    assert column(spark, given, paths.parent) == [None, "/", "/a", "/a-b"]
    assert column(spark, given, paths.name) == ["", "a", "b", "c"]
    assert column(spark, given, lambda c: paths.ancestors(c, itself=True)) == [["/"], ["/", "/a"], ["/", "/a", "/a/b"], ["/", "/a-b", "/a-b/c"]]
    assert column(spark, ["a/b/", "/a", "/", "", "./x"], paths.absolute) == ["/a/b", "/a", "", "", "/./x"]
    assert column(spark, ["/", "/a/b", "a", "/a/", "//a", "/a/./b", "/..", "/" + "x" * 4096], paths.canonical) == [
        True, True, False, False, False, False, False, False
    ]
    frame = spark.createDataFrame([("/images/x", "/images/refs/a/b")], "t string, l string")
    assert frame.select(paths.relative_to(F.col("t"), F.col("l"))).first()[0] == "../../../images/x"


def test_depth_first_order(spark):
    frame = spark.createDataFrame([("/a-b",), ("/a/x",), ("/a",), ("/",)], "path string")
    rows = numbered(frame.withColumn("p", paths.parts(F.col("path"))), ["p"], "n").orderBy("n").collect()
    assert [(r.n, r.path) for r in rows] == [(0, "/"), (1, "/a"), (2, "/a/x"), (3, "/a-b")]
    assert numbered(frame.limit(0), ["path"]).count() == 0


def test_tags(spark):
    given = ["a/b%c", "%%2F", "%2f/", "%25", ""]
    assert column(spark, given, lambda c: text.decode_tag(text.encode_tag(c))) == given
    assert column(spark, ["%%2F", "%2f", "%252F", "%25%2F%"], text.decode_tag) == ["%/", "%2f", "%2F", "%/%"]


def test_command_lines(spark):
    assert column(spark, ['a "b c" d=" e"f "open x', "", '""'], text.split_cmdline) == [["a", '"b c"', 'd=" e"f', '"open x'], [], ['""']]
    h = "0f" * 32
    assert column(spark, [f"ro img=?{h} x", f"img={h}{h}", "img=zz", "x"], lambda c: text.image_address(c, "img=")) == [(h, True), (h + h, False), None, None]
    assert column(spark, ["a b=1 c", "", "b=2", "bb=3"], lambda c: boot.with_argument(c, "b=9")) == ["a b=9 c", "b=9", "b=9", "bb=3 b=9"]


def test_key_values(spark):
    content = "# no\nNAME='My OS'\nVERSION_ID=1\nVERSION_ID=\"2\"\nBAD\n=x\nPRETTY_NAME=\"unterminated\nID=a\\ b"
    assert column(spark, [content], text.key_values)[0] == {"NAME": "'My OS'", "VERSION_ID": '"2"', "PRETTY_NAME": '"unterminated', "ID": "a\\ b"}
    assert tuple(column(spark, [content], boot.os_release)[0]) == ("My OS", "2", "My OS 2")
    for given, want in (("a b", "a b"), ("'a'\"b\"c", "abc"), ("'a", None), ("a\\", None), ('"\\$x\\y"', "$x\\y"), ("'\\'", "\\")):
        assert boot.dequote(given) == want
    assert column(spark, ["title A\nlinux  /v\ninitrd /a\ninitrd\t/b\nlinuxx /n"], lambda c: text.ble_values(c, "initrd")) == [["/a", "/b"]]


def test_numbers_and_bytes(spark):
    assert column(spark, [0, 1, 512, 513], lambda c: text.round_up(c, 512), "long") == [0, 512, 512, 1024]
    assert column(spark, ["100644", "7"], text.octal) == [0o100644, 7]
    assert column(spark, [b"ab", b"\xff\x00"], text.utf8_or_hex, "binary") == ["ab", "ff00"]


def test_labels(spark):
    rules = label.rules(["# comment", "", "/.* -- any_file", "/.* -d any_dir", "/etc(/.*)? etc_t", "/etc/shadow -- shadow_t", "/run/.* <<none>>"])
    frame = spark.createDataFrame(
        [
            ("/x", "reg"),
            ("/x", "dir"),
            ("/etc", "dir"),
            ("/etc/shadow", "reg"),
            ("/etc/shadow", "lnk"),
            ("/run/a", "reg"),
            ("/dev/null", "chr"),
            ("/a\nb", "reg"),
        ],
        "path string, kind string",
    )
    got = frame.select(label.label(F.col("path"), F.col("kind"), rules).alias("l")).collect()
    assert [r.l for r in got] == ["any_file", "any_dir", "etc_t", "shadow_t", "etc_t", None, None, "any_file"]
    assert column(spark, ["/lib64/x/y", "/a/b", "/", "/lib64"], lambda c: label.aliased(c, {"/lib64": "/usr/lib", "/usr/lib/x": "/z"})) == [
        "/z/y", "/a/b", "/", "/usr/lib"
    ]
    tree = spark.createDataFrame(
        [("/a", "reg", 1, {}), ("/etc/b", "reg", 1, {"security.selinux": "old", "k": "v"}), ("/etc", "dir", None, {})],
        "path string, kind string, leaf_id long, xattrs map<string, string>",
    )
    got = {r.path: r.xattrs for r in label.relabelled(tree, rules).collect()}
    assert got == {"/a": {"security.selinux": "etc_t"}, "/etc/b": {"k": "v", "security.selinux": "etc_t"}, "/etc": {"security.selinux": "etc_t"}}
    assert {r.path: r.xattrs for r in label.relabelled(tree, None).collect()} == {"/a": {}, "/etc/b": {"k": "v"}, "/etc": {}}


def test_pe_sections():
    import struct

    image = bytearray(512)
    image[:2], image[0x3C:0x40], image[64:68] = b"MZ", struct.pack("<I", 64), b"PE\0\0"
    image[70:72], image[84:86] = struct.pack("<H", 1), struct.pack("<H", 0)
    image[88:96], image[96:112] = b".osrel\0\0", struct.pack("<IIII", 5, 0, 16, 300)
    image[300:305] = b"ID=a\n"
    assert boot.pe_section(bytes(image), ".osrel") == b"ID=a\n" and boot.pe_section(bytes(image), ".cmdline") is None


def test_verity_has_no_limit_of_size(spark):
    """Just beyond what three levels cover: 64 MiB for sha256 and 16 MiB for sha512."""
    assert [digest.levels_of(x) for x in ("sha256", "sha512")] == [4, 5]
    for algorithm, size in (("sha256", (64 << 20) + 1), ("sha512", (16 << 20) + 1)):
        frame = spark.range(1).select(F.repeat(F.lit("0123456789abcdef"), size // 16 + 1).substr(1, size).cast("binary").alias("data"))
        want = digest.verity_bytes((b"0123456789abcdef" * (size // 16 + 1))[:size], algorithm).hex()
        assert [r.digest for r in frame.select(digest.verity(F.col("data"), algorithm).alias("digest")).collect()] == [want]


def test_checksums_of_any_length():
    """In lanes as byte by byte."""
    import random

    from granary.sources import archive

    def plain(data):
        crc = (1 << 64) - 1
        for byte in data:
            crc = int(archive._CRC[(crc ^ byte) & 255]) ^ crc >> 8
        return crc ^ (1 << 64) - 1

    rnd = random.Random(1)
    for n in (0, 1, 1023, 1024, 1025, 2048, 2049, 5000, 70_000):
        data = rnd.randbytes(n)
        assert archive.crc64(data) == plain(data)
    assert archive.crc64(b"123456789") == 0xB90956C775A41001


def test_labels_try_rules_from_the_last():
    from granary.operators import label

    found = tuple(label.rules(["/.* any", "/usr/bin/?x y", "/usr(/.*)? usr", r"/a\.b+ dots", "/(x|y)z -- alt", "/u{2}v rep", "/etc/.* <<none>>"]))
    of = lambda s: label.context_of(s, found)
    assert [of(x + "-") for x in ("/q", "/usr", "/usr/bin", "/a.b", "/a.bb", "/axb", "/xz", "/yz", "/uuv", "/etc/q")] == [
        "any", "usr", "usr", "dots", "dots", "any", "alt", "alt", "rep", None
    ]
    assert of("/xzd") == "any" and label.context_of("/binx-", tuple(label.rules(["/bi?nx one"]))) == "one"
