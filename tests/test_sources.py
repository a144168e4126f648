"""The same logical rows give the same answers from every format; edges of JSON, CSV and SQLite."""

import json
import sqlite3

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rowscope.explorer import Explorer, Query, matching, query_from
from rowscope.functions.access import ORD
from rowscope.functions.kinds import number_text_py
from rowscope.operators import codegen, diff, schema, visual
from rowscope.operators.edits import Edit
from rowscope.operators.profile import profile
from rowscope.paths import PathError, parse, render
from rowscope.plans.filters import Condition, Filter, FilterError, draft
from rowscope.plans.projection import ColumnSpec, Transform
from rowscope.sources import open_source
from rowscope.sources.detect import detect, json_mode

ROWS = [{"id": i, "name": f"n{i % 7}", "score": i + 0.5, "tag": None if i % 5 == 0 else f"t{i % 3}"} for i in range(37)]
FILTERS = [
    Filter((Condition("id", "gte", 10), Condition("id", "lt", 20))),
    Filter((Condition("score", "gt", 30.25),)),
    Filter((Condition("tag", "isnull"),)),
    Filter((Condition("tag", "eq", "t1"),), negate=True),
    Filter((Condition("name", "in", ["n1", "n2"]), Condition("tag", "ne", "t0")), combinator="or"),
    Filter((Condition("name", "contains", "N3", True),)),
    Filter((Condition("name", "regex", "^n[45]$"),)),
    Filter((Condition("id", "eq", "3"),)),
    Filter((Condition("name", "gt", "n4"),)),
]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("rows")
    out = {k: str(d / f"rows.{k}") for k in ("ndjson", "json", "csv", "tsv", "parquet", "sqlite")}
    (d / "rows.ndjson").write_text("".join(json.dumps(r) + "\n" for r in ROWS))
    (d / "rows.json").write_text(json.dumps(ROWS))
    for k, sep in (("csv", ","), ("tsv", "\t")):
        (d / f"rows.{k}").write_text("\n".join([sep.join(ROWS[0])] + [sep.join("" if v is None else str(v) for v in r.values()) for r in ROWS]) + "\n")
    pq.write_table(pa.Table.from_pylist(ROWS), out["parquet"])
    with sqlite3.connect(out["sqlite"]) as db:
        db.execute("create table t (id integer, name text collate nocase, score real, tag text)")
        db.executemany("insert into t values (:id, :name, :score, :tag)", ROWS)
    return out


@pytest.mark.parametrize("kind", ["ndjson", "json", "csv", "tsv", "parquet", "sqlite"])
def test_all_formats_agree(spark, files, kind):
    df = open_source(spark, files[kind]).df.cache()
    for f in FILTERS:
        got = [r[ORD] for r in matching(df, f).orderBy(ORD).collect()]
        want = [i for i, r in enumerate(ROWS) if holds(f, r)]
        assert got == want, f
    assert [r[ORD] for r in matching(df, Filter(), "T2").orderBy(ORD).collect()] == [i for i, r in enumerate(ROWS) if r["tag"] == "t2"]
    df.unpersist()


def holds(f, r):
    """The plain meaning of a filter."""
    import re

    def one(c):
        v = r.get(c.path)
        if c.op in ("isnull", "notnull"):
            return (v is None) == (c.op == "isnull")
        if v is None:
            return False
        if c.op == "in":
            return v in c.value
        if isinstance(v, str) != isinstance(c.value, str):
            return False
        a, b = (v.lower(), c.value.lower()) if c.ci else (v, c.value)
        return {"eq": lambda: a == b, "ne": lambda: a != b, "lt": lambda: a < b, "lte": lambda: a <= b, "gt": lambda: a > b, "gte": lambda: a >= b, "contains": lambda: b in a, "regex": lambda: re.search(b, a) is not None}[c.op]()

    parts = [one(c) for c in f.conditions] + [holds(g, r) for g in f.groups]
    return (any(parts) if f.combinator == "or" else all(parts)) != f.negate


def write(path, *lines):
    path.write_text("".join(x + "\n" for x in lines))
    return str(path)


def test_ndjson_drift_missing_and_skipped(spark, tmp_path):
    p = write(tmp_path / "a.ndjson", '{"id":1,"tags":["a","b"],"x":{"y":1.50}}', "", "{bad", '{"id":"three","tags":[],"x":null}', '{"id":2,"meta":{"a.b":1}}')
    s = open_source(spark, p)
    got = profile(s)
    assert (got.records, got.skipped) == (3, 1)
    f = got.get("id")
    assert f.drift and f.kinds == {"int": 2, "string": 1}
    assert got.get("tags[]").observations == 2 and got.get("tags").presence == 2
    assert got.get("x").kinds == {"null": 1, "object": 1}
    ids = lambda c: [r[ORD] for r in matching(s.df, Filter((c,))).orderBy(ORD).collect()]
    assert ids(Condition("tags[]", "eq", "a")) == [0]
    assert ids(Condition("tags[]", "isnull")) == [1, 2]
    assert ids(Condition("x", "isnull")) == [1, 2]
    assert ids(Condition('meta["a.b"]', "eq", 1)) == [2]
    assert ids(Condition("id", "ne", 1)) == [2]


def test_csv_cells(spark, tmp_path):
    p = write(tmp_path / "a.csv", "a,b", '1,"x,""y"""', "007,true", "1e3,", "NaN,1.5", "1234567890123456,_")
    kinds = profile(open_source(spark, p)).get("a").kinds
    assert kinds == {"int": 1, "string": 3, "float": 1}
    assert profile(open_source(spark, p)).get("b").kinds == {"string": 2, "bool": 1, "null": 1, "float": 1}
    assert profile(open_source(spark, p, raw=True)).get("a").kinds == {"string": 5}


def test_sqlite_gaps_and_ordinals(spark, tmp_path):
    p = str(tmp_path / "a.db")
    with sqlite3.connect(p) as db:
        db.execute("create table t (id integer, v text)")
        db.executemany("insert into t values (?, ?)", [(i, f"v{i}") for i in range(10)])
        db.execute("delete from t where id in (2, 5)")
        db.execute("create table u (a text)")
    with pytest.raises(ValueError, match="name one"):
        open_source(spark, p)
    df = open_source(spark, p, table="t").df
    assert [tuple(r) for r in df.where("id > 6").orderBy(ORD).collect()] == [(7, "v7", 5), (8, "v8", 6), (9, "v9", 7)]


def test_detection():
    assert detect("a.parquet") == "parquet" and detect("x", b"PAR1....") == "parquet" and detect("x", b"SQLite format 3\x00") == "sqlite" and detect("x") == "json"
    assert json_mode("x", b"  [1]") == "document" and json_mode("x", b"{}") == "lines" and json_mode("a.jsonl") == "lines"


def test_paths():
    for p in ("a.b", "a[]", "a[].b", "[]", 'a["x.y"].z', "a[][]"):
        assert render(parse(p)) == p
    for p in ("a[", "a..b", ".a", "a]b", 'a["x'):
        with pytest.raises(PathError):
            parse(p)


def test_explorer(spark, files, tmp_path):
    e = Explorer(spark, str(tmp_path / "views"))
    h = e.open(files["ndjson"])
    assert [c.path for c in e.columns(h)] == ["id", "name", "score", "tag"]
    q = Query(Filter((Condition("id", "lt", 20),)), sort=("tag", True), limit=5, transform=Transform((ColumnSpec("id"), ColumnSpec("tag", "label"))))
    page = e.query(h, q, want_total=True)
    assert page.total == 20 and not page.truncated and [r["index"] for r in page.rows] == [2, 8, 11, 14, 17]
    assert page.rows[0]["label"]["text"] == "t2" and page.rows[0]["label"]["kind"] == "string"
    assert e.get_cell(h, 0, "tag") == ("null", True) and e.get_cell(h, 0, "nope") == (None, False) and e.get_cell(h, 3, "score") == ("3.5", True)
    with pytest.raises(IndexError):
        e.get_cell(h, 99, "id")
    e.save_view("mine", q)
    assert e.views() == {"mine": q} and query_from({}) == Query()
    e.save_view("mine", None)
    assert e.views() == {}
    for kind in ("json", "ndjson", "csv", "tsv", "parquet"):
        target = str(tmp_path / f"out.{kind}")
        assert e.export(h, Query(Filter((Condition("id", "gte", 30),))), target, kind).rows == 7
        again = open_source(spark, target)
        assert profile(again).get("score").min == 30.5
    with pytest.raises(ValueError):
        e.export(h, Query(), files["ndjson"], "ndjson")
    out = str(tmp_path / "saved.ndjson")
    assert e.save_edits(h, [Edit(1, "name", "new"), Edit(2, "deep.er", [1]), Edit(3, "name.x", 1), Edit(99, "id", 1)], out) == (37, 2)
    lines = [json.loads(x) for x in open(out)]
    assert lines[1]["name"] == "new" and lines[2]["deep"] == {"er": [1]} and lines[3] == ROWS[3]
    e.close(h)


def test_edits_keep_number_texts(spark, tmp_path):
    p = write(tmp_path / "a.ndjson", '{"a":1.50,"b":12345678901234567890123,"c":1}')
    e = Explorer(spark)
    out = str(tmp_path / "b.ndjson")
    e.save_edits(e.open(p), [Edit(0, "c", 2)], out)
    assert open(out).read() == '{"a":1.50,"b":12345678901234567890123,"c":2}\n'


def test_generated_sql_runs_in_sqlite(spark, files):
    e = Explorer(spark)
    h = e.open(files["sqlite"])
    db = sqlite3.connect(files["sqlite"])
    for f in (FILTERS[0], FILTERS[2], FILTERS[3], FILTERS[4]):
        text = e.code(h, Query(f, sort=("id", False))).text.replace('"data"', '"t"')
        assert [r[0] for r in db.execute(text)] == [i for i, r in enumerate(ROWS) if holds(f, r)]
    assert "select(" in codegen.jq(FILTERS[0]).text


def test_schema_diff_and_visual(spark, tmp_path):
    old = profile(open_source(spark, write(tmp_path / "o.ndjson", '{"id":1,"email":"a","status":"open"}', '{"id":2,"email":"b","status":"closed"}')))
    new = profile(open_source(spark, write(tmp_path / "n.ndjson", '{"id":1,"status":"open"}', '{"id":"x","status":"pending"}')))
    d = diff.diff(old, new)
    assert [(c.path, c.kind, c.breaking) for c in d.changes] == [("email", "removed", True), ("id", "changed", True), ("status", "changed", True)]
    assert diff.gate(d) == 1 and diff.gate(d, "none") == 0 and diff.gate(diff.diff(old, old), "any") == 0
    s = schema.json_schema(old)
    assert s["required"] == ["email", "id", "status"] and s["properties"]["status"] == {"type": "string", "enum": ["closed", "open"]}
    assert schema.json_schema(new)["properties"]["id"] == {"type": ["string", "integer"]}
    m = visual.model(new)
    assert {c.path: c.form for c in m.cards} == {"id": "mixed", "status": "categorical"} and m.score == 75
    assert visual.diff_model(d)["verdict"] == "breaking"


def test_drafts_and_errors(spark, files):
    f = draft([{"path": "id", "op": "gt", "value": "5"}, {"path": "id", "op": "contains", "value": "x"}, {"path": "name", "op": "regex", "value": "("}, {"path": "id", "op": "in", "value": "1, 2"}], {"id": "int", "name": "string"})
    assert f == Filter((Condition("id", "gt", 5), Condition("id", "in", [1, 2])))
    df = open_source(spark, files["parquet"]).df
    for c in (Condition("id", "like", 1), Condition("name", "regex", "(?=a)"), Condition("name", "regex", r"(a)\1")):
        with pytest.raises(FilterError):
            matching(df, Filter((c,)))


def test_number_texts(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from rowscope.functions.kinds import number_text

    xs = [0.0, 1.0, -2.5, 1e6, 123456.5, 1234567.25, 1e-4, 0.00012, 1e-5, -3.25e-7, 1e21, 100000.0, 0.1]
    want = ["0", "1", "-2.5", "1e+06", "123456.5", "1.23456725e+06", "0.0001", "0.00012", "1e-05", "-3.25e-07", "1e+21", "100000", "0.1"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    assert [r[0] for r in df.orderBy("i").select(number_text(F.col("x"), T.DoubleType())).collect()] == want
    assert [number_text_py(x) for x in xs] == want
