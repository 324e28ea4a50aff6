"""Lines by byte ranges: the same ones however files are cut, packed and dealt to tasks."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from tallylog.sources import formats, lines, parse, ranges, storage


def slow_lines(data):
    """(number, bytes, first byte, next line's first byte) of each line."""
    found, at = [], 0
    parts = data.split(b"\n")
    if not parts[-1]:
        parts.pop()
    for k, part in enumerate(parts):
        after = min(len(data), at + len(part) + 1)
        found.append((k + 1, part.removeprefix(b"\xef\xbb\xbf") if not k else part, at, after))
        at = after
    return found


def some_bytes(seed, n=70):
    rng = random.Random(seed)
    data = b"".join(bytes(rng.choice(b"xyz \xc3") for _ in range(rng.choice([0, 1, 6, 50, 400]))) + rng.choice([b"\n", b"\n\n", b"\r\n"]) for _ in range(n))
    return (b"\xef\xbb\xbf" if seed % 2 else b"") + (data if seed % 3 else data.rstrip(b"\n") + b"end")


def packed(data, seed):
    rng, out, k = random.Random(seed), b"", 0
    while k < len(data):
        n = rng.choice([30, 200, 900])
        out += gzip.compress(data[k : k + n])
        k += n
    return out


def read(spark, path, size, starts=None, headers=False):
    spans = ranges.counted(spark, ranges.cut(lines.sizes(spark, [(1, str(path))]), size), starts or {}, headers, size)
    rows = ranges.lines_of(spark, spans, headers, max(size, 300)).select("line_number", "bytes", "start_offset", "next_offset").collect()
    return sorted((r[0], bytes(r[1]), r[2], r[3]) for r in rows), spans


@pytest.mark.parametrize("seed", [1, 3])
def test_any_cut_gives_the_same_lines(spark, tmp_path, seed):
    data = some_bytes(seed)
    plain, zipped = tmp_path / "plain", tmp_path / "zipped"
    plain.write_bytes(data)
    zipped.write_bytes(packed(data, seed))
    for path in (plain, zipped):
        for size in (1, 97, 10**6):
            assert read(spark, path, size)[0] == slow_lines(data)
    assert len(read(spark, zipped, 97)[1]) > 5


def test_a_file_of_a_thousand_members_is_read_by_many_tasks(spark, tmp_path):
    data = b"".join(b"line %d of it\n" % k for k in range(30_000))
    path = tmp_path / "members"
    path.write_bytes(b"".join(gzip.compress(data[k : k + 400]) for k in range(0, len(data), 400)))
    got, spans = read(spark, path, 4000)
    assert got == slow_lines(data) and len(spans) > 30 and sum(s.lines for s in spans) == 30_000


def test_long_lines_are_cut_and_counted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", 50_000)
    data = b"a\n" + b"b" * 300_000 + b"\nc\n" + b"d" * 70_000
    path = tmp_path / "long"
    path.write_bytes(data)
    for size in (60_000, 10**6):
        got = read(spark, path, size)[0]
        assert [(n, a, b) for n, _, a, b in got] == [(n, a, b) for n, _, a, b in slow_lines(data)]
        assert [len(x) for _, x, _, _ in got] == [1, ranges.KEPT, 1, ranges.KEPT]


def test_a_changed_file_is_noticed(spark, tmp_path):
    path = tmp_path / "log"
    path.write_bytes(b"one\ntwo\nthree\n")
    spans = ranges.counted(spark, lines.sizes(spark, [(1, str(path))]), {}, False, 100)
    path.write_bytes(b"one\ntwo\nthr\ne\n")
    with pytest.raises(Exception, match="has changed"):
        ranges.lines_of(spark, spans, False, 100).count()


def test_numbers_do_not_depend_on_how_spark_splits_files(spark, tmp_path):
    """The settings of file splits change between the look and the reading."""
    path = tmp_path / "log"
    path.write_text("".join(f"{k}\n" for k in range(300_000)))
    found, counts = lines.read_counted(spark, [(7, str(path))])
    assert counts == {7: 300_000}
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for parts in ("64k", "512k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", parts)
            spark.conf.set("spark.sql.files.minPartitionNum", "16")
            row = found.agg(F.count("*").alias("n"), F.count_if(F.col("value").cast("long") + 1 == F.col("line_number")).alias("same")).first()
            assert (row.n, row.same) == (300_000, 300_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_headers_are_carried_without_a_join(spark, tmp_path):
    """Ten thousand header changes; each line gets the columns named before it."""
    path = tmp_path / "iis.log"
    body = []
    for k in range(10_000):
        names = ["c-ip", "sc-status", f"x-{k}"] if k % 3 else ["sc-status", f"x-{k}", "c-ip"]
        body.append("#Fields: " + " ".join(names))
        body.append(" ".join({"c-ip": "192.0.2.7", "sc-status": str(200 + k % 300)}.get(n, f"v{k}") for n in names))
        if k % 500 == 0:
            body += ["#Fields:", "192.0.2.8"]
    path.write_text("\n".join(body))
    spans = ranges.counted(spark, ranges.cut(lines.sizes(spark, [(1, str(path))]), 5000), {}, True, 5000)
    assert len(spans) > 100
    outcomes = parse.parse(lines.read_spans(spark, spans, True, 5000), formats.preset("w3c"))
    assert "Join" not in outcomes._jdf.queryExecution().optimizedPlan().toString()
    told = {r.kind: r["count"] for r in outcomes.groupBy("kind").count().collect()}
    assert told == {"record": 10_000, "skipped": 10_000, "error": 40}
    bad = outcomes.where("kind = 'record'").where((F.col("record.client_ip") != "192.0.2.7") | (F.size("record.extra") != 1)).count()
    assert bad == 0
    # a reader that doesn't tell headers gives the same outcomes
    plain = parse.parse(lines.read_spans(spark, spans, True, 5000).drop("header"), formats.preset("w3c"))
    names = ["line_number", "kind", "code", F.to_json("record")]
    assert outcomes.select(names).exceptAll(plain.select(names)).isEmpty()


@pytest.fixture
def far(spark, tmp_path):
    """A folder by a path that Python can't open."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./in", f"file://{tmp_path}")
    return "viewfs://far/in"


def test_files_that_only_hadoop_opens(spark, tmp_path, far):
    data = b"".join(b"%d\n" % k for k in range(5000))
    (tmp_path / "a.log").write_bytes(data)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.gz").write_bytes(gzip.compress(data[:1000]))
    assert storage.mounted(spark, f"{far}/a.log") is None
    found = lines.scan(far, include=("*.log", "*.gz"), spark=spark)
    assert found.files == [f"{far}/a.log", f"{far}/sub/b.gz"]
    got, counts = lines.read_counted(spark, [(1, found.files[0]), (2, found.files[1])])
    assert counts == {1: 5000, 2: len(slow_lines(data[:1000]))}
    assert got.where("source_id = 1").where(F.col("value").cast("long") + 1 != F.col("line_number")).count() == 0
    assert {k: v for k, v in lines.identity(spark, found.files[0]).items() if k != "modified_unix"} == {k: v for k, v in lines.identity(spark, str(tmp_path / "a.log")).items() if k != "modified_unix"}
    heads = lines.read_heads(spark, [(1, found.files[0]), (2, found.files[1])], 100)
    near = lines.read_heads(spark, [(1, str(tmp_path / "a.log")), (2, str(tmp_path / "sub" / "b.gz"))], 100)
    assert sorted(heads.where("source_id = 1").collect()) == sorted(near.where("source_id = 1").collect()) and heads.where("source_id = 2").count() > 0
