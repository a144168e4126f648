"""Exact quantiles, and profiles of deep and of many values."""

import json

import numpy as np

from rowscope.functions.access import ORD
from rowscope.operators import profile
from rowscope.sources import open_source
from rowscope.sources.readers import Source


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    cols = {"x": [1.0, 2.0, 4.0, 9.0] * 500, "y": (rng.standard_normal(2000) ** 5).tolist(), "z": [7.5] * 1999 + [1e300], "s": ["a"] * 2000, "n": [None, float("nan")] * 1000}
    rows = [(i, *r) for i, r in enumerate(zip(*cols.values(), strict=True))]
    p = profile.profile(Source(spark.createDataFrame(rows, f"{ORD} long, x double, y double, z double, s string, n double"), "parquet", "t"))
    for c in "xyz":
        f = p.get(c)
        assert np.allclose([f.median, f.p95], np.quantile(cols[c], [0.5, 0.95]), rtol=1e-12)
    assert p.get("s").median is None and p.get("n").median is None and p.get("n").kinds == {"null": 1000, "float": 1000}


def test_any_depth(spark, tmp_path):
    deep = 1
    for i in range(100):
        deep = {f"k{i}": deep} if i % 10 else [deep]
    path = tmp_path / "deep.ndjson"
    path.write_text(json.dumps(deep) + "\n")
    p = profile.profile(open_source(spark, str(path)))
    assert max(len(f.path.replace("[]", ".[]").split(".")) for f in p.fields) >= 100 and any(f.kinds == {"int": 1} for f in p.fields)


def test_many_values_are_sketched_if_asked(spark):
    df = spark.range(20_000).selectExpr(f"id as {ORD}", "id as u", "concat('v', if(id % 4 = 0, 1, id)) as s", "id % 100 as few")
    p = profile.profile(Source(df, "parquet", "t"), approximate=True)
    u, s, few = (p.get(c) for c in ("u", "s", "few"))
    assert not u.exact and abs(u.distinct / 20_000 - 1) < 0.05 and abs(u.median - 9999.5) < 100 and u.min == 0 and u.max == 19_999
    assert few.exact and few.distinct == 100 and few.median == 49.5
    assert s.exact == (s.distinct <= profile.EXACT_DISTINCT) and s.top[0][0] == "v1"
