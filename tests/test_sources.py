"""Readers and writers on files made here."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from millrace.sources import dumps, ledger, objects, tables
from millrace.streaming import gains


def test_ledger(spark, tmp_path):
    at = str(tmp_path / "log")
    assert ledger.load(spark, at).count() == 0  # absent
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"command": "match", "unit": "u", "symbol": "f", "tried": 3}\n\n{"command": "permute", "unit": "u"}\n')
    got = ledger.load(spark, at)
    assert got.count() == 2
    assert got.select(F.try_variant_get("payload", "$.tried", "int")).where("command = 'match'").first()[0] == 3
    ledger.record(spark.createDataFrame([("match", "u", "g")], "command string, unit string, symbol string"), at)
    assert ledger.load(spark, at).where("symbol = 'g' and date is not null").count() == 1
    (tmp_path / "log" / "b.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        ledger.load(spark, at).collect()


def test_symbol_table(spark, tmp_path):
    good = tmp_path / "good.tsv"
    good.write_text('address\tsize\tsymbol\tevidence\n0x10\t4\tf\t"a\tb"\n0xffffffffffffffff\t0\tg\tsay ""x""\n')
    got = {r.symbol: (int(r.address), r.size, r.evidence) for r in tables.symbol_table(spark, str(good)).collect()}
    assert got["f"] == (16, 4, "a\tb") and got["g"][0] == 2**64 - 1
    for bad in ("address\tsize\tsymbol\tevidence\n10\t4\tf\te\n", "address\tsize\tsymbol\tevidence\n0x1\t-4\tf\te\n", "address\tsize\tsymbol\tevidence\n0x1\t4\tf\te\n0x2\t4\tf\te\n", "place\tsize\tsymbol\tevidence\n0x1\t4\tf\te\n"):
        (tmp_path / "bad.tsv").write_text(bad)
        with pytest.raises(Exception):
            tables.symbol_table(spark, str(tmp_path / "bad.tsv")).collect()
    out = str(tmp_path / "out")
    tables.write_symbol_table(tables.symbol_table(spark, str(good)).where("symbol = 'f'"), out)
    assert tables.symbol_table(spark, out).first().evidence == "a\tb"


def test_reports(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"units": [{"name": "u", "functions": [{"name": "f", "size": "20", "fuzzy_match_percent": 100.0, "metadata": {"virtual_address": "4096"}}, {"name": "g", "size": "30"}], "metadata": {"source_path": "src/u.cpp"}}, {"name": "empty"}]}))
    got = {r.name: (r.size, r.score, r.exact) for r in tables.report_functions(spark, str(tmp_path / "p.json")).collect()}
    assert got == {"f": (20, 100.0, True), "g": (30, 0.0, False)}
    (tmp_path / "m.json").write_text(json.dumps({"unit": "u", "sections": [{"name": ".text", "functions": [{"symbol": "T.12", "address": "0x20", "size": 3, "exact": True}]}]}))
    assert tables.match_functions(spark, str(tmp_path / "m.json")).first().key == "0x20"


def test_rules(spark):
    text = '[[idiom]]\nid = "a"\ncause = "c"\n[[idiom.evidence]]\ncommit = "1"\nfunction = "f"\n'
    assert tables.rules(spark, text).first().evidence[0].function == "f"


def _coff() -> bytes:
    code = b"\x55\xc3\x90\x90" + b"\x31\xc0\xc3\xcc"
    section_at = 20 + 40
    lines_at = section_at + len(code)
    lines = struct.pack("<IHIHIH", 0, 0, 1, 7, 0, 0)
    symbols_at = lines_at + len(lines)
    head = struct.pack("<HHIIIHH", 0x14C, 1, 0, symbols_at, 3, 0, 0)
    section = struct.pack("<8sIIIIIIHHI", b".text", 0, 0, len(code), section_at, 0, lines_at, 0, 3, 0)
    symbols = struct.pack("<8sIhHBB", b"_first", 0, 1, 0x20, 2, 0) + struct.pack("<8sIhHBB", b"\0\0\0\0" + struct.pack("<I", 4), 4, 1, 0x20, 2, 0) + struct.pack("<8sIhHBB", b"_data", 0, 1, 0, 2, 0)
    return head + section + code + lines + symbols + struct.pack("<I", 30) + b"_a_long_function_name\0"


def test_coff(spark, tmp_path):
    (tmp_path / "a.obj").write_bytes(_coff())
    got = {r.name: (r.start, r.size, bytes(r.code)) for r in objects.coff_functions(spark, str(tmp_path / "a.obj")).collect()}
    assert got == {"_first": (0, 2, b"\x55\xc3"), "_a_long_function_name": (4, 3, b"\x31\xc0\xc3")}
    assert [(r.name, r.offset, r.line) for r in objects.coff_lines(spark, str(tmp_path / "a.obj")).collect()] == [("_first", 1, 7)]


def test_lines_count_from_the_opening_brace(spark, tmp_path):
    code = b"\x55" * 8
    section_at = 20 + 40
    lines = struct.pack("<IHIHIH", 0, 0, 2, 1, 5, 4)
    symbols_at = section_at + len(code) + len(lines)
    function = struct.pack("<8sIhHBB", b"_f", 0, 1, 0x20, 2, 1) + struct.pack("<IIIIH", 2, 8, 0, 0, 0)
    begins = struct.pack("<8sIhHBB", b".bf", 0, 1, 0, 101, 1) + struct.pack("<IH12s", 0, 40, b"")
    head = struct.pack("<HHIIIHH", 0x14C, 1, 0, symbols_at, 4, 0, 0)
    section = struct.pack("<8sIIIIIIHHI", b".text", 0, 0, len(code), section_at, 0, section_at + len(code), 0, 3, 0)
    (tmp_path / "b.obj").write_bytes(head + section + code + lines + function + begins + struct.pack("<I", 4))
    assert [(r.name, r.offset, r.line) for r in objects.coff_lines(spark, str(tmp_path / "b.obj")).collect()] == [("_f", 0, 41), ("_f", 2, 41), ("_f", 5, 44)]


def test_dumps(spark):
    lines = spark.createDataFrame([("00401000  0000002a ffffffff",), ("other",)], "value string")
    assert sorted(map(tuple, dumps.memory_words(lines).collect())) == [(0x401000, 42), (0x401004, 2**32 - 1)]
    text = spark.createDataFrame([("max-inline = 30, large = 200",)], "value string")
    over = spark.createDataFrame([("large", 1, 1), ("large", 2, 2)], "name string, value long, ord long")
    assert sorted(map(tuple, dumps.parameters(text, over).collect())) == [("large", 2), ("max-inline", 30)]
    log = spark.createDataFrame([(1, "in f"), (2, "grant"), (3, "in g"), (4, "grant")], "ord long, value string")
    tag = F.when(F.col("value").startswith("in "), F.substring("value", 4, 9))
    assert [r.function for r in dumps.carried(log, "ord", F.lit(1), tag, "function").orderBy("ord").collect()] == ["f", "f", "g", "g"]


def test_stream(spark, tmp_path):
    schema = "unit string, symbol string, before double, after double"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"unit": "u", "symbol": "f", "before": 1, "after": 3}\n{"unit": "u", "symbol": "f", "before": 1, "after": 2}\n')
    from pyspark.sql.types import _parse_datatype_string

    best = gains.best_gains(ledger.stream(spark, str(tmp_path / "in"), _parse_datatype_string(schema)))
    q = best.writeStream.outputMode("complete").format("memory").queryName("best_gains").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.gain, r.n_rows) for r in spark.table("best_gains").collect()] == [(2.0, 2)]
