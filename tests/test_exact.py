"""Ordinals over several files, typed exports, exact texts and edits."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rowscope.explorer import Explorer, Query, Superseded, matching
from rowscope.functions.access import ORD
from rowscope.operators.edits import Edit
from rowscope.plans.filters import Condition, Filter
from rowscope.plans.projection import ColumnSpec, Transform, hide, rename
from rowscope.queries import QUERIES
from rowscope.sources import open_source


def write(path, text):
    path.write_text(text)
    return str(path)


def test_filters_reach_the_scan_of_several_files(spark, tmp_path):
    (tmp_path / "t.parquet").mkdir()
    for name, ids in (("b", range(5, 9)), ("a", range(5)), ("c", range(9, 200))):  # the last is the largest
        pq.write_table(pa.table({"id": pa.array(ids, pa.int64()), "s": [f"v{i}" for i in ids]}), tmp_path / "t.parquet" / f"{name}.parquet")
    df = open_source(spark, str(tmp_path / "t.parquet")).df
    assert all(r["id"] == r[ORD] for r in df.collect()) and df.count() == 200
    got = matching(df, Filter((Condition("id", "gt", 6),)))
    plan = got._jdf.queryExecution().toString()
    assert "GreaterThan(id,6)" in plan.split("PushedFilters")[1].split("]")[0]
    assert [r[ORD] for r in got.orderBy(ORD).limit(2).collect()] == [7, 8]


def test_exports_of_records_are_typed(spark, tmp_path):
    rows = [{"i": 1, "f": 1.5, "b": True, "s": "x", "o": {"z": 1, "a": [1]}, "d": 1}, {"i": None, "f": 2, "b": False, "s": None, "o": None, "d": "two"}, {"i": 3, "f": 3, "s": "y"}]
    p = write(tmp_path / "a.ndjson", "".join(json.dumps(r) + "\n" for r in rows) + '{"i":99999999999999999999999,"f":4.5}\n')
    e = Explorer(spark)
    h = e.open(p)
    target = str(tmp_path / "a.parquet")
    done = e.export(h, Query(), target, "parquet")
    t = pq.read_table(target)
    assert {f.name: str(f.type) for f in t.schema if f.name in "ifbsd"} == {"i": "int64", "f": "double", "b": "bool", "s": "string", "d": "string"}
    assert t["i"].to_pylist() == [1, None, 3, None] and t["f"].to_pylist() == [1.5, 2.0, 3.0, 4.5] and t["b"].to_pylist() == [True, False, None, None] and t["d"].to_pylist() == ["1", "two", None, None]
    assert done.warnings == ["i: 1 values do not fit the column and were left null"]
    e.export(h, Query(Filter((Condition("i", "eq", -1),))), target, "parquet")
    assert pq.read_table(target).num_rows == 0


@pytest.mark.parametrize("kind", ["ndjson", "json"])
def test_texts_stay_as_written(spark, tmp_path, kind):
    lines = ['{"z":1.50,"a":{"y":2.00,"b":1e3},"t":["q",1.0]}', '{"a":null,"z":12345678901234567890123}']
    p = write(tmp_path / f"a.{kind}", "\n".join(lines) + "\n" if kind == "ndjson" else "[" + " ,\n ".join(lines) + "]")
    e = Explorer(spark)
    h = e.open(p)
    assert e.get_cell(h, 0) == (lines[0], True) and e.get_cell(h, 0, "a") == ('{"y":2.00,"b":1e3}', True) and e.get_cell(h, 0, "a.y") == ("2.00", True)
    assert e.get_cell(h, 1, "a") == ("null", True) and e.get_cell(h, 1, "t") == (None, False)
    specs = Transform((ColumnSpec("z"), ColumnSpec("a"), ColumnSpec("t[]")))
    page = e.query(h, Query(transform=specs, limit=1))
    assert page.rows[0]["z"]["text"] == "1.50" and page.rows[0]["a"] == {"kind": "object", "text": '{"y":2.00,"b":1e3}', "count": 2, "more": False} and not page.truncated
    out = str(tmp_path / "out.ndjson")
    e.export(h, Query(transform=specs), out, "ndjson")
    assert open(out).read() == '{"z":1.50,"a":{"y":2.00,"b":1e3},"t[]":"q"}\n{"z":12345678901234567890123,"a":null}\n'
    e.export(h, Query(transform=Transform((ColumnSpec("z"),))), str(tmp_path / "out.csv"), "csv")
    assert open(tmp_path / "out.csv").read() == "z\n1.50\n12345678901234567890123\n"
    saved = str(tmp_path / f"saved.{kind}")
    assert e.save_edits(h, [], saved) == (2, 0) and [json.dumps(x) for x in map(json.loads, lines)] == [json.dumps(r) for r in (map(json.loads, open(saved)) if kind == "ndjson" else json.load(open(saved)))]
    assert e.save_edits(h, [Edit(1, "a.n", 5), Edit(0, "t[]", 1), Edit(7, "z", 1)], saved) == (2, 2)
    assert lines[0] in open(saved).read() and '{"a":{"n":5},"z":12345678901234567890123}' in open(saved).read()


def test_broken_documents(spark, tmp_path):
    for text in ("[1,2", '{"a":1', "[1 2]", "[1] x"):
        with pytest.raises(Exception):  # noqa: B017
            open_source(spark, write(tmp_path / "a.json", text)).df.collect()
    assert open_source(spark, write(tmp_path / "b.json", " [] ")).df.count() == 0
    assert [r["_raw"] for r in open_source(spark, write(tmp_path / "c.json", ' {"a":1.0} \n')).df.collect()] == ['{"a":1.0}']


def test_drafts_of_columns():
    specs = [ColumnSpec("a"), ColumnSpec("b.c")]
    assert rename(specs, 0, "x") == [ColumnSpec("a", "x"), ColumnSpec("b.c")] and hide(specs, 0) == [ColumnSpec("b.c")] and hide(specs[:1], 0) == specs[:1]
    with pytest.raises(ValueError, match="twice"):
        rename(specs, 0, "c")


def test_a_later_query_supersedes(spark, tmp_path, monkeypatch):
    p = write(tmp_path / "a.ndjson", "".join(f'{{"i":{i}}}\n' for i in range(50)))
    e = Explorer(spark)
    h = e.open(p)
    assert e.source(h).df.is_cached and not e.source(e.open(p, budget_mb=0)).df.is_cached
    real = e._specs
    monkeypatch.setattr(e, "_specs", lambda *a: (monkeypatch.setattr(e, "_specs", real), e.query(h, Query(limit=3), request="r"), real(*a))[2])
    with pytest.raises(Superseded):  # another query of the request ran meanwhile
        e.query(h, Query(limit=2), request="r")
    assert len(e.query(h, Query(limit=2), request="r").rows) == 2 and [r["index"] for r in e.query(h, Query(offset=48, limit=5)).rows] == [48, 49]


def test_caveats():
    from rowscope.operators import codegen

    f = Filter((Condition("a", "regex", "x", True), Condition("b", "in", [])))
    assert len(codegen.sql(f, "q", ("a", True), None, ["a", "b"]).notes) == 6 and len(codegen.jq(f, "q", ("a", True)).notes) == 6
    assert codegen.sql(Filter(), table="t").notes == [] and "left out" in codegen.sql(Filter(), "q").notes[-1]
    assert codegen.jq(Filter(), "", None, Transform((ColumnSpec("a"),))).text == '{"a": ([.["a"]?] | .[0])}'


@pytest.fixture
def several_partitions(spark):
    """A sort keeps its four ranges, as large tables do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


N = 20_000


def test_sort_nulls_first_over_several_partitions(spark, tmp_path, several_partitions):
    quality = {i: i % 2 for i in range(0, N, 3)}
    pq.write_table(pa.table({"doc_id": pa.array(range(N), pa.int64())}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(list(quality), pa.int64()), "quality": pa.array(list(quality.values()), pa.int32()), "toxic": pa.array([0] * len(quality), pa.int32())}), tmp_path / "labels.parquet")
    order = sorted(range(N), key=lambda i: (quality.get(i, -1), i))
    got = QUERIES["sort_nulls_first"](spark, str(tmp_path)).select("doc_id", "quality", "place").collect()
    assert sorted(got, key=lambda r: r["place"]) == [(i, quality.get(i), place) for place, i in enumerate(order)]


def test_sort_mixed_kinds_over_several_partitions(spark, tmp_path, several_partitions):
    name = {i: f"c{i * 7919 % N}" for i in range(N)}
    pq.write_table(pa.table({"c_custkey": pa.array(list(name), pa.int64()), "c_name": list(name.values())}), tmp_path / "customer.parquet")
    order = sorted(range(N), key=lambda i: (i % 5, name[i] if i % 5 == 3 else "", i))
    got = QUERIES["sort_mixed_kinds"](spark, str(tmp_path)).select("c_custkey", "kind", "place").collect()
    assert sorted(got, key=lambda r: r["place"]) == [(i, i % 5, place) for place, i in enumerate(order)]
