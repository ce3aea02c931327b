"""Lookups without record numbers, archives by place, code pages."""

import io
import zipfile

import pytest
from sluicework import functions as fn
from sluicework.operators.lookup import Lookup
from sluicework.plans.template import Rule, Template
from sluicework.sources import archive, text
from sluicework.sources.text import JVM_NAME, decode_bytes, decode_column


def test_lookups_need_no_numbers(spark, tmp_path):
    """The last definition wins by place alone; the text is read once for the probes and once for the block."""
    body = "kind,id,name\n" + "".join(f"c,{i % 50},n{i}\n" for i in range(300)) + "".join(f"o,{i % 60},\n" for i in range(200))
    (tmp_path / "a.csv").write_text(body)
    f = fn.field
    t = Template("t", {"id": f("id"), "x": fn.lookup(f("id"), "name"), "y": fn.lookup(f("id") + 1, "name")}, {"id": "id", "x": "x", "y": "y"}, [Rule(f("kind") == "o")], {"c": Lookup(f("id"), {"name": f("name")}, f("kind") == "c")})
    results = []
    for numbers in (True, False):
        out = t.run(text.scan(spark, text.TextSource(str(tmp_path), record_numbers=numbers))).output()
        results.append(sorted(tuple(r) for r in out.collect()))
    assert results[0] == results[1] and ("7", "n257", "n258") in results[1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    ran = plan.split("Initial Plan")[0]
    assert ran.count("FileScan") == 2 and "_line" not in ran


def test_archive_directory_is_read_once(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(300):
            z.writestr(f"d/p{i}.csv", f"id;naïve\r\n{i};é\r\n\r\n{i + 1000};x".encode("windows-1252"), zipfile.ZIP_STORED if i % 3 else None)
        z.writestr("d/large.csv", ("id;naïve\n" + "".join(f"{i};{'y' * 30}\n" for i in range(2000, 90_000))).encode("windows-1252"))
    (tmp_path / "a.zip").write_bytes(out.getvalue())
    src = archive.ArchiveSource(str(tmp_path), ".csv", text.TextSource("", delimiter=";", encoding="windows-1252"))
    df = archive.scan(spark, src)
    rows = df.select("_file", "_record_num", "id", "naïve").collect()
    assert len(rows) == 600 + 88_000
    assert {(r["_record_num"], r["naïve"]) for r in rows if r["_file"] == "p7.csv"} == {(1, "é"), (3, "x")}
    assert all(r["_record_num"] == int(r.id) - 1999 for r in rows if r["_file"] == "large.csv")
    damaged = bytearray(out.getvalue())
    damaged[damaged.find("naïve".encode("windows-1252")) - 3] ^= 1
    (tmp_path / "a.zip").write_bytes(bytes(damaged))
    with pytest.raises(Exception, match="checksum|invalid|incorrect"):
        archive.scan(spark, src).collect()


@pytest.mark.parametrize("encoding", sorted(JVM_NAME))
def test_jvm_code_pages(spark, encoding):
    df = spark.createDataFrame([(bytes([i]),) for i in range(32, 256)], "b binary").selectExpr("cast(b as string) as s", "b")
    got = {bytes(r.b): r.s for r in decode_column(spark, df, "s", encoding).collect()}
    differ = [b for b, s in got.items() if s != decode_bytes(b, encoding)]
    assert differ == []
