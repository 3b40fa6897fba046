import base64
import hashlib
import io
import struct
import zipfile

import pytest

from tessera.llm.shared import file_system
from tessera.llm.warc import directory, read, read_package, records_of, stored, written

SCHEMA = "page_id long, url string, html string"


class File:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows, least=0):
    groups, out = {}, []
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) < least:
            out.append((i, len(data), digest(data), "response", None))
        else:
            groups.setdefault(data, []).append(i)
    for data, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, len(data), digest(data), "revisit" if k else "response", ids[0] if k else None) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def found(df):
    number = lambda x: None if x is None else int(x)
    return sorted(((number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in df.collect()), key=repr)


ROWS = [(1, "u", "<p>a</p>"), (2, "v", "<p>a</p>"), (2, "v", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, "x", "b"), (None, None, "b"), (5, None, None), (4, "é\n", ""), (9, "q", "zé" * 200_000), (10, "r", "c")]


CLASHES = "sha1 string, payload int, place int, copies int, is_head int, refers_to int, record_type int, k int, n int"


@pytest.mark.parametrize("least", [0, 2, 100])
def test_defined_cases(spark, least):
    df = spark.createDataFrame([(*r, "other", *range(8)) for r in ROWS], f"{SCHEMA}, {CLASHES}")
    assert found(read(written(df, least=least))) == expected(ROWS, least)
    assert read(written(df.limit(0), least=least)).count() == 0


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_payloads_go_through_one_exchange(spark, threshold):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = spark.createDataFrame([(i, f"u{i}", "hot" if i % 3 == 0 else f"page {i % 500}") for i in range(3000)], SCHEMA)
        plan = records_of(df)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)

    def exchanges(node):
        own = [node] if "Exchange" in node.nodeName() else []
        below = [node.initialPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.children().apply(k) for k in range(node.children().size())]
        return own + [x for n in below for x in exchanges(n)]

    kinds = [x.schema().simpleString() for x in exchanges(plan)]
    assert sum("binary" in k for k in kinds) == 1 and not any("html" in k for k in kinds)


def test_many_copies_and_packages(spark):
    rows = [(i, f"u{i}", "hot" if i % 3 == 0 else f"page {i}") for i in range(3000)]
    manifest = written(spark.createDataFrame(rows, SCHEMA).repartition(7), limit=4000)
    assert manifest.count() > 7 and manifest.agg({"records": "sum"}).first()[0] == 3000
    assert found(read(manifest)) == expected(rows)


def test_query(spark, sf_dir):
    from tessera.llm.queries import QUERIES

    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    out = QUERIES["op2_warc"](spark, sf_dir)
    assert dict(out.dtypes)["page_id"] == "bigint"
    assert found(out) == expected(pages)


def test_payloads_and_damage(spark, tmp_path):
    manifest = written(spark.createDataFrame(ROWS[:1], SCHEMA), f"file://{tmp_path}/w")
    row = manifest.first()
    assert [r["payload"] for r in read_package(row.uri, row.package)] == [b"<p>a</p>"]
    assert [bytes(r.payload) for r in read(manifest, payloads=True).collect()] == [b"<p>a</p>"]
    with zipfile.ZipFile(tmp_path / "w" / row.package) as z:  # others can read it
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


def test_directory_forms():
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a/é.txt", b"hello")
        z.writestr(zipfile.ZipInfo("b"), b"x" * 10)
        z.writestr("c", b"deflated" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"note PK\5 in a comment"
    data = plain.getvalue()
    members = directory(File(data), len(data))
    assert [m.name for m in members] == ["a/é.txt", "b", "c"]
    assert data[members[0].start :][:5] == b"hello" and data[members[1].start :][: members[1].size] == b"x" * 10
    with pytest.raises(ValueError):
        stored(members, "c")
    with pytest.raises(KeyError):
        stored(members, "d")
    with pytest.raises(ValueError):
        directory(File(b"nothing"), 7)


def test_zip64():
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for k in range(66_000):
            z.writestr(zipfile.ZipInfo(str(k)), str(k))
    data = many.getvalue()
    members = directory(File(data), len(data))
    assert len(members) == 66_000 and data[members[65_999].start :][:5] == b"65999"
    # sizes and offset of an entry in its ZIP64 field, as packages of over 4 GB have them
    name, body = b"big", b"payload"
    local = b"PK\3\4" + struct.pack("<5H3I2H", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<2H2Q", 1, 16, 7, 7)
    extra = struct.pack("<2H", 9, 2) + b"zz" + struct.pack("<2H3Q", 1, 24, 7, 7, 0)
    entry = b"PK\1\2" + struct.pack("<6H3I5H2I", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local) + len(body)
    end64 = b"PK\6\6" + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    whole = local + body + entry + end64 + b"PK\6\7" + struct.pack("<IQI", 0, at + len(entry), 1) + b"PK\5\6" + struct.pack("<4H2IH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    (member,) = directory(File(whole), len(whole))
    assert (member.name, member.size, whole[member.start :][:7]) == ("big", 7, body)


def test_file_system(tmp_path):
    fs, path = file_system(f"file://{tmp_path}/x")
    fs.create_dir(path)
    assert (tmp_path / "x").is_dir()
