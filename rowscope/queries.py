"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscope.explorer import Explorer, matching, projected, window
from rowscope.explorer import Query as ExplorerQuery
from rowscope.functions.access import ORD, Accessor
from rowscope.functions.kinds import number_text
from rowscope.llm.common import stored
from rowscope.operators import codegen, diff, profile, schema, visual
from rowscope.plans.filters import Condition, Filter
from rowscope.plans.ordering import sort_keys
from rowscope.plans.projection import ColumnSpec, Transform
from rowscope.sources.readers import Source, numbered, parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return parquet(spark, f"{sf_dir}/{name}.parquet")


# filters ---------------------------------------------------------------------------------------------------------

_LINE = "l_orderkey l_partkey l_suppkey l_quantity l_discount l_returnflag".split()


def _filter(name: str, table: str, f: Filter, keep: list[str], where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return projected(matching(load(spark, sf_dir, table), f), [ColumnSpec(c) for c in keep]).drop(ORD)

    add(name, run, f"SELECT {', '.join(keep)} FROM {table} WHERE {where}")


def _one(path: str, op: str, value=None, ci: bool = False) -> Filter:
    return Filter((Condition(path, op, value, ci),))


for _name, _table, _f, _keep, _where in [
    ("flt_eq_str", "lineitem", _one("l_returnflag", "eq", "R"), _LINE, "l_returnflag = 'R'"),
    ("flt_eq_num", "lineitem", _one("l_quantity", "eq", 17), _LINE, "l_quantity = 17"),
    ("flt_eq_ci", "customer", _one("c_mktsegment", "eq", "building", True), ["c_custkey", "c_mktsegment"], "lower(c_mktsegment) = 'building'"),
    ("flt_ne", "lineitem", _one("l_returnflag", "ne", "N"), _LINE, "l_returnflag <> 'N'"),
    ("flt_ne_ci", "orders", _one("o_orderstatus", "ne", "f", True), ["o_orderkey", "o_orderstatus"], "lower(o_orderstatus) <> 'f'"),
    ("flt_lt", "lineitem", _one("l_quantity", "lt", 5), _LINE, "l_quantity < 5"),
    ("flt_lte", "lineitem", _one("l_quantity", "lte", 5), _LINE, "l_quantity <= 5"),
    ("flt_gt", "lineitem", _one("l_discount", "gt", 0.05), _LINE, "l_discount > 0.05"),
    ("flt_gte", "part", _one("p_size", "gte", 45), ["p_partkey", "p_size"], "p_size >= 45"),
    ("flt_str_range", "customer", Filter((Condition("c_name", "gte", "Customer#00000050"), Condition("c_name", "lt", "Customer#00000090"))), ["c_custkey", "c_name"], "c_name >= 'Customer#00000050' AND c_name < 'Customer#00000090'"),
    ("flt_contains", "part", _one("p_name", "contains", "a"), ["p_partkey", "p_name"], "contains(p_name, 'a')"),
    ("flt_contains_ci", "part", _one("p_name", "contains", "A", True), ["p_partkey", "p_name"], "contains(lower(p_name), 'a')"),
    ("flt_regex", "part", _one("p_brand", "regex", "#[1-3][24]$"), ["p_partkey", "p_brand"], "regexp_matches(p_brand, '#[1-3][24]$')"),
    ("flt_regex_ci", "part", _one("p_brand", "regex", "^BRAND", True), ["p_partkey", "p_brand"], "regexp_matches(p_brand, '(?i)^BRAND')"),
    ("flt_in_num", "part", _one("p_size", "in", [1, 7, 49]), ["p_partkey", "p_size"], "p_size IN (1, 7, 49)"),
    ("flt_in_str", "orders", _one("o_orderpriority", "in", ["1-URGENT", "5-LOW", None]), ["o_orderkey", "o_orderpriority"], "o_orderpriority IN ('1-URGENT', '5-LOW')"),
    ("flt_and", "lineitem", Filter((Condition("l_returnflag", "eq", "A"), Condition("l_quantity", "gt", 40))), _LINE, "l_returnflag = 'A' AND l_quantity > 40"),
    ("flt_or", "lineitem", Filter((Condition("l_quantity", "lt", 3), Condition("l_discount", "gte", 0.1)), combinator="or"), _LINE, "l_quantity < 3 OR l_discount >= 0.1"),
    ("flt_nested_groups", "lineitem", Filter((Condition("l_returnflag", "eq", "R"),), (Filter((Condition("l_quantity", "lt", 4), Condition("l_quantity", "gt", 48)), combinator="or"), Filter((Condition("l_linestatus", "eq", "O"),), negate=True))), _LINE, "l_returnflag = 'R' AND (l_quantity < 4 OR l_quantity > 48) AND NOT (l_linestatus = 'O')"),
    ("flt_negate", "orders", Filter((Condition("o_orderstatus", "eq", "F"), Condition("o_totalprice", "gt", 1000.5)), negate=True), ["o_orderkey", "o_orderstatus"], "NOT (o_orderstatus = 'F' AND o_totalprice > 1000.5)"),
    ("flt_match_all", "nation", Filter(), ["n_nationkey", "n_name"], "TRUE"),
]:
    _filter(_name, _table, _f, _keep, _where)


def _count(name: str, table: str, f: Filter, sql: str) -> None:
    add(name, lambda spark, d: matching(load(spark, d, table), f).agg(F.count(F.lit(1)).alias("n")), sql)


_count("flt_eq_cross_kind", "lineitem", _one("l_quantity", "eq", "17"), "SELECT 0::BIGINT AS n")
_count("flt_ne_cross_kind", "lineitem", _one("l_returnflag", "ne", 5), "SELECT 0::BIGINT AS n")
_count("flt_in_empty", "lineitem", _one("l_quantity", "in", []), "SELECT 0::BIGINT AS n")
_count("flt_empty_or", "orders", Filter(combinator="or"), "SELECT 0::BIGINT AS n")
_count("flt_missing_path", "orders", _one("nope", "isnull"), "SELECT count(*) AS n FROM orders")
_count("flt_negated_missing", "orders", Filter((Condition("nope", "eq", 1),), negate=True), "SELECT count(*) AS n FROM orders")
_count("cnt_rows", "lineitem", Filter(), "SELECT count(*) AS n FROM lineitem")
_count("cnt_matches", "lineitem", Filter((Condition("l_quantity", "gt", 25), Condition("l_returnflag", "eq", "N"))), "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'N'")

_LABELLED = "(SELECT d.doc_id, l.quality, CASE WHEN l.toxic IS NULL THEN NULL ELSE l.toxic = 1 END AS toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    return docs.select("doc_id").join(labels, "doc_id", "left").select("doc_id", "quality", (F.col("toxic") == 1).alias("toxic"), F.col("doc_id").alias(ORD))


for _name, _f, _where in [
    ("flt_isnull", _one("quality", "isnull"), "quality IS NULL"),
    ("flt_notnull", _one("quality", "notnull"), "quality IS NOT NULL"),
    ("flt_bool", _one("toxic", "bool", True), "toxic"),
    ("flt_negate_null", Filter((Condition("quality", "eq", 1),), negate=True), "NOT coalesce(quality = 1, false)"),
    ("flt_or_null", Filter((Condition("quality", "eq", 0), Condition("toxic", "bool", False)), combinator="or"), "coalesce(quality = 0, false) OR coalesce(NOT toxic, false)"),
]:
    add(_name, lambda spark, d, f=_f: matching(labelled(spark, d), f).select("doc_id"), f"SELECT doc_id FROM {_LABELLED} WHERE {_where}")


# arrays and nested values ----------------------------------------------------------------------------------------

def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turn = F.struct("turn", "role", "text", F.octet_length("text").alias("size"))
    return c.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).withColumn(ORD, F.col("conv_id"))


add("arr_exists", lambda s, d: projected(matching(load(s, d, "embeddings"), _one("embedding[]", "gt", 0.3)), [ColumnSpec("vec_id")]).drop(ORD), "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x::DOUBLE > 0.3)) > 0")
add("arr_isnull", lambda s, d: matching(load(s, d, "embeddings"), _one("embedding[]", "isnull")).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM embeddings WHERE embedding IS NULL OR len(embedding) = 0")
add("arr_nested_exists", lambda s, d: matching(_turns(s, d), _one("turns[].size", "gt", 400)).select("conv_id"), "SELECT DISTINCT conv_id FROM conversations WHERE octet_length(encode(text)) > 400")
add("arr_nested_eq", lambda s, d: matching(_turns(s, d), _one("turns[].role", "eq", "assistant")).select("conv_id"), "SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant'")
add("arr_notnull", lambda s, d: matching(_turns(s, d), _one("turns[].role", "notnull")).select("conv_id"), "SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) = count(role)")
add("first_elem", lambda s, d: projected(_turns(s, d), [ColumnSpec("conv_id"), ColumnSpec("turns[].role", "first_role")]).drop(ORD), "SELECT conv_id, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as VARIANT records, the form of JSON sources."""
    e = load(spark, sf_dir, "events")
    rec = F.to_variant_object(F.struct("event_id", "event_type", "value", F.parse_json("props").alias("props"), F.array("event_type", F.lit("x")).alias("tags")))
    return e.select(rec.alias("_rec"), ORD)


def _ids(df: DataFrame) -> DataFrame:
    return projected(df, [ColumnSpec("event_id")]).select(F.try_variant_get("event_id", "$", "bigint").alias("event_id"))


for _name, _f, _where in [
    ("var_nested_num", _one("props.k", "gte", 50), "(props::JSON->>'k')::BIGINT >= 50"),
    ("var_eq_str", _one("event_type", "eq", "click"), "event_type = 'click'"),
    ("var_cross_kind", _one("props.k", "ne", "50"), "false"),
    ("var_arr", _one("tags[]", "eq", "view"), "event_type = 'view'"),
    ("var_missing", Filter((Condition("props.nope", "isnull"), Condition("value", "lt", 20.5))), "value < 20.5"),
    ("var_in", _one("props.k", "in", [1, 2, 3, "4"]), "(props::JSON->>'k')::BIGINT IN (1, 2, 3)"),
]:
    add(_name, lambda s, d, f=_f: _ids(matching(_events(s, d), f)), f"SELECT event_id FROM events WHERE {_where}")

# search ----------------------------------------------------------------------------------------------------------

add("search_part", lambda s, d: projected(matching(load(s, d, "part"), Filter(), "BRAND#1"), [ColumnSpec("p_partkey")]).drop(ORD), "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(chr(1), p_partkey, p_name, p_brand, p_type, p_size)), 'brand#1')")
add("search_documents", lambda s, d: projected(matching(load(s, d, "documents"), Filter(), "general public license"), [ColumnSpec("doc_id")]).drop(ORD), "SELECT doc_id FROM documents WHERE contains(lower(text), 'general public license')")
add("search_filtered", lambda s, d: projected(matching(load(s, d, "customer"), _one("c_nationkey", "lt", 5), "building"), [ColumnSpec("c_custkey")]).drop(ORD), "SELECT c_custkey FROM customer WHERE c_nationkey < 5 AND contains(lower(c_mktsegment), 'building')")
add("search_nested", lambda s, d: matching(_turns(s, d), Filter(), "ASSIST").select("conv_id"), "SELECT DISTINCT conv_id FROM conversations WHERE contains(lower(role), 'assist') OR contains(lower(text), 'assist')")
add("search_variant", lambda s, d: _ids(matching(_events(s, d), Filter(), "purch")), "SELECT event_id FROM events WHERE contains(lower(event_type), 'purch')")

# sort, window, projection, cells ---------------------------------------------------------------------------------


def _page(name: str, table: str, sort: tuple[str, bool], offset: int, limit: int, keep: list[str], sql: str) -> None:
    add(name, lambda s, d: projected(window(load(s, d, table), sort, offset, limit), [ColumnSpec(c) for c in keep]).drop(ORD), sql)


# ordinals of one file are its row order, which the SQL side does not promise; each order below is total by its keys
_page("sort_asc", "orders", ("o_orderkey", False), 0, 100, ["o_orderkey", "o_totalprice"], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
_page("sort_desc", "customer", ("c_name", True), 0, 50, ["c_custkey", "c_name"], "SELECT c_custkey, c_name FROM customer ORDER BY c_name DESC LIMIT 50")
_page("sort_window", "orders", ("o_orderkey", True), 500, 40, ["o_orderkey", "o_orderstatus"], "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 40 OFFSET 500")


def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn(ORD, F.col("c_custkey"))
    return projected(window(df, ("c_nationkey", True), 10, 200), [ColumnSpec("c_custkey"), ColumnSpec("c_nationkey")]).drop(ORD)


add("sort_desc_ties", _ties, "SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey DESC, c_custkey LIMIT 200 OFFSET 10")


def _ranked(df: DataFrame, sort: tuple[str, bool], *keep: str) -> DataFrame:
    """The whole table, sorted once: ``keep`` of each row, its ordinal as ``key`` and its place in the order."""
    rows = df.orderBy(*sort_keys(*sort, Accessor(df))).select(*keep, F.col(ORD).alias("key"))
    return numbered(rows, stored).withColumnRenamed(ORD, "place")


add("sort_nulls_first", lambda s, d: _ranked(labelled(s, d), ("quality", False), "doc_id", "quality").drop("key"), f"SELECT doc_id, quality, row_number() OVER (ORDER BY quality NULLS FIRST, doc_id) - 1 AS place FROM {_LABELLED}")
add("sort_filtered", lambda s, d: projected(window(matching(load(s, d, "events"), _one("event_type", "eq", "click")), ("event_id", False), 20, 30), [ColumnSpec("event_id")]).drop(ORD), "SELECT event_id FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 30 OFFSET 20")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a value whose kind depends on the key, sorted; the rank in the order is the result."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey") % 5
    text = F.when(k == 0, "null").when(k == 1, "true").when(k == 2, F.col("c_custkey").cast("string")).when(k == 3, F.concat(F.lit('"'), "c_name", F.lit('"'))).otherwise("[1]")
    df = c.select(F.parse_json(F.concat(F.lit('{"id":'), "c_custkey", F.lit(',"v":'), text, F.lit("}"))).alias("_rec"), F.col("c_custkey").alias(ORD))
    return _ranked(df, ("v", False)).select(F.col("key").alias("c_custkey"), (F.col("key") % 5).alias("kind"), "place")


add("sort_mixed_kinds", _mixed, "SELECT c_custkey, c_custkey % 5 AS kind, row_number() OVER (ORDER BY c_custkey % 5, CASE WHEN c_custkey % 5 = 2 THEN c_custkey END, CASE WHEN c_custkey % 5 = 3 THEN c_name END, c_custkey) - 1 AS place FROM customer")
add("window_source_order", lambda s, d: projected(window(spark_keyed(s, d), None, 100, 50), [ColumnSpec("o_orderkey")]).drop(ORD), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")


def spark_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn(ORD, F.col("o_orderkey"))


def _select(name: str, table: str, t: Transform, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = load(spark, sf_dir, table)
        return projected(df, t.columns([c for c in df.columns if c != ORD])).drop(ORD)

    add(name, run, sql)


_select("sel_rename", "nation", Transform((ColumnSpec("n_name", "name"), ColumnSpec("n_nationkey", "id"))), "SELECT n_name AS name, n_nationkey AS id FROM nation")
_select("sel_reorder", "region", Transform((ColumnSpec("r_name"), ColumnSpec("r_regionkey"))), "SELECT r_name, r_regionkey FROM region")
_select("drop_cols", "customer", Transform(drop=("c_acctbal", "c_name")), "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
_select("base_columns", "supplier", Transform(), "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
_select("sel_flatten_noop", "region", Transform(flatten_objects=True), "SELECT r_regionkey, r_name FROM region")


def _cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the table, one by one, through the session interface."""
    e = Explorer(spark)
    h = e.open(f"{sf_dir}/region.parquet")
    got = [(i, c.path, *e.get_cell(h, i, c.path)) for i in range(e.profile(h).records) for c in e.columns(h)]
    return spark.createDataFrame(got, "row long, path string, cell string, found boolean")


add("getcell", _cell, "SELECT r_regionkey::BIGINT AS row, path, CASE path WHEN 'r_name' THEN '\"' || r_name || '\"' ELSE r_regionkey::VARCHAR END AS cell, true AS found FROM region, (VALUES ('r_regionkey'), ('r_name')) t(path)")
add("number_text", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", number_text(F.col("p_retailprice"), s.read.parquet(f"{d}/part.parquet").schema["p_retailprice"].dataType).alias("price")), "SELECT p_partkey, regexp_replace(p_retailprice::VARCHAR, '\\.0$', '') AS price FROM part")

# profile ---------------------------------------------------------------------------------------------------------


def _source(spark: SparkSession, sf_dir: str, table: str) -> Source:
    return Source(load(spark, sf_dir, table), "parquet", table)


def _told(read: Callable[[SparkSession, str], DataFrame], schema: str, tell: Callable[[profile.Field], tuple | None], approximate: bool = False) -> Query:
    """Rows of a profile's fields: ``tell`` gives the columns after the path, or None for no row."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = profile.profile(Source(read(spark, sf_dir), "parquet", ""), approximate)
        return spark.createDataFrame([(f.path, *got) for f in p.fields if (got := tell(f)) is not None], f"path string, {schema}")

    return run


def _of(table: str) -> Query:
    return lambda s, d: load(s, d, table)


_COLS = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
}
_NUMS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


add("prof_presence", _told(_of("lineitem"), "presence long, observations long", lambda f: (f.presence, f.observations)), _union([f"SELECT '{c}' AS path, count(*) AS presence, count(*) AS observations FROM lineitem" for c in _COLS["lineitem"]]))
add(
    "prof_types", _told(_of("lineitem"), "n_int long, n_float long, n_string long, n_null long", lambda f: tuple(f.kinds.get(k, 0) for k in ("int", "float", "string", "null"))),
    _union([f"SELECT '{c}' AS path, {'count(*)' if c in _NUMS[:4] else '0::BIGINT'} AS n_int, {'count(*)' if c in _NUMS[4:] else '0::BIGINT'} AS n_float, {'count(*)' if c not in _NUMS else '0::BIGINT'} AS n_string, 0::BIGINT AS n_null FROM lineitem" for c in _COLS["lineitem"]]),
)
add("prof_minmax", _told(_of("lineitem"), "min double, max double", lambda f: (f.min, f.max) if f.min is not None else None), _union([f"SELECT '{c}' AS path, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem" for c in _NUMS]))
add("prof_strlen", _told(_of("customer"), "min_len int, max_len int", lambda f: (f.min_len, f.max_len) if f.min_len is not None else None), _union([f"SELECT '{c}' AS path, min(octet_length(encode({c})))::INTEGER AS min_len, max(octet_length(encode({c})))::INTEGER AS max_len FROM customer" for c in ("c_name", "c_mktsegment")]))
add("prof_nulls", _told(labelled, "observations long, n_null long", lambda f: (f.observations, f.kinds.get("null", 0))), _union([f"SELECT '{c}' AS path, count(*) AS observations, count(*) - count({c}) AS n_null FROM {_LABELLED}" for c in ("doc_id", "quality", "toxic")]))
add("prof_bool_distinct", _told(labelled, "n long", lambda f: (f.distinct,)), _union([f"SELECT '{c}' AS path, {f'count(DISTINCT {c})' if c != 'toxic' else 'count(DISTINCT NULL)'} AS n FROM {_LABELLED}" for c in ("doc_id", "quality", "toxic")]))
add("prof_distinct", _told(_of("customer"), "n long", lambda f: (f.distinct,)), _union([f"SELECT '{c}' AS path, count(DISTINCT {c}) AS n FROM customer" for c in _COLS["customer"]]))


def _approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each path is counted exactly, and whether the number is within a twentieth of the exact profile's."""
    exact = {f.path: f.distinct for f in profile.profile(_source(spark, sf_dir, "lineitem")).fields}
    return _told(_of("lineitem"), "exact boolean, near boolean", lambda f: (f.exact, abs(f.distinct - exact[f.path]) <= exact[f.path] / 20), True)(spark, sf_dir)


add("prof_distinct_approx", _approximate, _union([f"SELECT '{c}' AS path, count(DISTINCT {c}) <= 16384 AS exact, true AS near FROM lineitem" for c in _COLS["lineitem"]]))


def _tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.profile(_source(spark, sf_dir, "orders"))
    return spark.createDataFrame([(f.path, i + 1, k, n) for f in p.fields for i, (k, n) in enumerate(f.top)], "path string, rank int, key string, n long")


_KEYS = {"o_orderkey": "o_orderkey::VARCHAR", "o_custkey": "o_custkey::VARCHAR", "o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority", "o_totalprice": "regexp_replace(o_totalprice::VARCHAR, '\\.0$', '')", "o_orderdate": "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')"}
add("prof_top10", _tops, _union([f"(SELECT '{c}' AS path, row_number() OVER (ORDER BY count(*) DESC, {k})::INTEGER AS rank, {k} AS key, count(*) AS n FROM orders GROUP BY {c} ORDER BY n DESC, key LIMIT 10)" for c, k in _KEYS.items()]))
add("prof_quantiles", _told(_of("lineitem"), "median double, p95 double", lambda f: (round(f.median, 6), round(f.p95, 6)) if f.median is not None else None), _union([f"SELECT '{c}' AS path, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({c}::DOUBLE, 0.95), 6) AS p95 FROM lineitem" for c in _NUMS]))


def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.profile(_source(spark, sf_dir, "part"))
    return spark.createDataFrame([(f.path, i, n) for f in p.fields for i, (_, _, n) in enumerate(f.bars) if n], "path string, bar int, n long")


add("prof_hist20", _hist, _union([f"(WITH e AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM part) SELECT '{c}' AS path, least(19, floor(({c} - lo) / ((hi - lo) / 20)))::INTEGER AS bar, count(*) AS n FROM part, e GROUP BY ALL)" for c in ("p_partkey", "p_size", "p_retailprice")]))
add("prof_nested", _told(_turns, "observations long, presence long", lambda f: (f.observations, f.presence)), _union([
    "SELECT 'conv_id' AS path, count(DISTINCT conv_id) AS observations, count(DISTINCT conv_id) AS presence FROM conversations",
    "SELECT 'turns' AS path, count(DISTINCT conv_id) AS observations, count(DISTINCT conv_id) AS presence FROM conversations",
    *[f"SELECT 'turns[]{c}' AS path, count(*) AS observations, count(DISTINCT conv_id) AS presence FROM conversations" for c in ("", ".turn", ".role", ".text", ".size")],
]))
add("prof_arrays", _told(_of("embeddings"), "observations long, presence long, n_float long, n_array long", lambda f: (f.observations, f.presence, f.kinds.get("float", 0), f.kinds.get("array", 0))), _union([
    "SELECT 'embedding' AS path, count(*) AS observations, count(*) AS presence, 0::BIGINT AS n_float, count(*) AS n_array FROM embeddings",
    "SELECT 'embedding[]' AS path, sum(len(embedding))::BIGINT AS observations, count(*) AS presence, sum(len(embedding))::BIGINT AS n_float, 0::BIGINT AS n_array FROM embeddings",
    *[f"SELECT '{c}' AS path, count(*) AS observations, count(*) AS presence, 0::BIGINT AS n_float, 0::BIGINT AS n_array FROM embeddings" for c in ("vec_id", "label")],
]))


def _profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.profile(_source(spark, sf_dir, "lineitem"))
    return spark.createDataFrame([(f.path, f.observations, f.distinct, f.min, f.max) for f in p.fields], "path string, observations long, distinct_values long, min double, max double")


add("profile_lineitem", _profile_rows, _union([f"SELECT '{c}' AS path, count(*) AS observations, count(DISTINCT {c}) AS distinct_values, {f'min({c})::DOUBLE' if c in _NUMS else 'NULL::DOUBLE'} AS min, {f'max({c})::DOUBLE' if c in _NUMS else 'NULL::DOUBLE'} AS max FROM lineitem" for c in _COLS["lineitem"]]))

# schema, diff, visual --------------------------------------------------------------------------------------------


def _schema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schema.json_schema(profile.profile(_source(spark, sf_dir, "orders")))
    return spark.createDataFrame([(k, v["type"], k in s["required"], ",".join(v.get("enum", []))) for k, v in s["properties"].items()], "path string, type string, required boolean, enum string")


add("schema_orders", _schema_rows, _union([f"SELECT '{c}' AS path, '{t}' AS type, true AS required, {f'(SELECT string_agg(v, chr(44) ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM orders))' if c in ('o_orderstatus', 'o_orderpriority') else chr(39) * 2} AS enum" for c, t in (("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"), ("o_totalprice", "number"), ("o_orderdate", "string"), ("o_orderpriority", "string"))]))


def _split(spark: SparkSession, sf_dir: str, old: str, new: str, drop: str = "", extra: str = "") -> DataFrame:
    df = load(spark, sf_dir, "orders")
    a = df.where(old)
    b = df.where(new)
    if extra:
        b = b.withColumn(extra, F.lit(1))
    pa, pb = (profile.profile(Source(x, "parquet", n), skipped=0) for x, n in ((a, "old"), (b.drop(drop) if drop else b, "new")))
    return diff.rows(spark, diff.diff(pa, pb)).select("path", "kind", "breaking")


_YEARS = ("o_orderdate < timestamp'1998-01-01'", "o_orderdate >= timestamp'1998-01-01'")


def _drift(old: str, new: str) -> str:
    """SQL of the columns whose values, up to ten on each side, differ between two parts of orders."""
    sides = [f"(SELECT count(DISTINCT v) FROM v WHERE {w}) BETWEEN 2 AND 10" for w in (old, new)]
    gone, come = [f"(SELECT count(*) FROM (SELECT v FROM v WHERE {x} EXCEPT SELECT v FROM v WHERE {y}))" for x, y in ((old, new), (new, old))]
    return _union([f"(WITH v AS (SELECT o_orderdate, o_orderpriority, {c} AS v FROM orders) SELECT '{c}' AS path, 'changed' AS kind, {come} > 0 AS breaking WHERE {sides[0]} AND {sides[1]} AND {gone} + {come} > 0)" for c in ("o_orderstatus", "o_orderpriority")])


_DRIFT = _drift(*_YEARS)
add("diff_removed_col", lambda s, d: _split(s, d, *_YEARS, "o_custkey"), f"SELECT 'o_custkey' AS path, 'removed' AS kind, count(*) > 0 AS breaking FROM orders WHERE {_YEARS[0]} UNION ALL {_DRIFT}")
add("diff_added_col", lambda s, d: _split(s, d, *_YEARS, extra="o_new"), f"SELECT 'o_new' AS path, 'added' AS kind, count(*) < 0 AS breaking FROM orders WHERE {_YEARS[1]} UNION ALL {_DRIFT}")
add("diff_enum", lambda s, d: _split(s, d, "o_orderpriority < '4'", "o_orderpriority > '2'"), _drift("o_orderpriority < '4'", "o_orderpriority > '2'"))
add("diff_orders_by_year", lambda s, d: _split(s, d, *_YEARS).agg(F.count(F.lit(1)).alias("n_changes")), f"SELECT count(*) AS n_changes FROM ({_DRIFT})")


def _visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.profile(_source(spark, sf_dir, "customer"))
    m = visual.model(p, "parquet")
    return spark.createDataFrame([(c.path, c.form, c.badges[0][0], m.score) for c in m.cards], "path string, form string, badge string, score long")


_SEEN = _union([f"SELECT '{c}' AS path, count({c}) AS n, count(DISTINCT {c}) AS k, count(*) AS rows FROM customer" for c in _COLS["customer"]])
_TEXTS = "path IN ('c_name', 'c_mktsegment')"
_BADGE = f"CASE WHEN n = 0 THEN 'all_null' WHEN n <= rows * 0.5 THEN 'null_high' WHEN n <= rows * 0.8 THEN 'null_elevated' WHEN k = 1 AND n > 1 THEN 'constant' WHEN {_TEXTS} AND k > 25 AND k >= 0.9 * n THEN 'high_cardinality' ELSE 'clean' END"
add("vis_form", lambda s, d: _visual(s, d).select("path", "form"), f"SELECT path, CASE WHEN n = 0 THEN 'empty' WHEN {_TEXTS} THEN CASE WHEN k <= 25 THEN 'categorical' ELSE 'high_cardinality' END WHEN k <= 12 THEN 'categorical' ELSE 'histogram' END AS form FROM ({_SEEN})")
add("vis_badges", lambda s, d: _visual(s, d).select("path", "badge"), f"SELECT path, {_BADGE} AS badge FROM ({_SEEN})")
add("vis_health", lambda s, d: _visual(s, d).select("score").distinct(), f"SELECT round(100 * (1 - avg(CASE {_BADGE} WHEN 'all_null' THEN 1 WHEN 'null_high' THEN 0.5 WHEN 'null_elevated' THEN 0.15 WHEN 'constant' THEN 0.15 ELSE 0 END)))::BIGINT AS score FROM ({_SEEN})")

# generated code and exports --------------------------------------------------------------------------------------


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "orders").createOrReplaceTempView("_rowscope_data")
    f = Filter((Condition("o_orderstatus", "in", ["F", "P"]), Condition("o_orderpriority", "contains", "high", True)))
    t = Transform((ColumnSpec("o_orderkey", "id"), ColumnSpec("o_totalprice", "price")))
    return spark.sql(codegen.sql(f, "", ("o_orderkey", True), t, table="_rowscope_data", dialect="spark", limit=300).text)


add("gen_sql_exec", _generated, "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderstatus IN ('F', 'P') AND contains(lower(o_orderpriority), 'high') ORDER BY o_orderkey DESC LIMIT 300")


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an export of the whole table."""
    import tempfile

    e = Explorer(spark)
    h = e.open(f"{sf_dir}/nation.parquet")
    with tempfile.TemporaryDirectory() as d:  # the export itself is a file of the driver
        e.export(h, ExplorerQuery(), f"{d}/out.ndjson", "ndjson")
        with open(f"{d}/out.ndjson", encoding="utf-8") as f:
            return spark.createDataFrame([(x.rstrip("\n"),) for x in f], "line string")


add("exp_ndjson", _exported, "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS line FROM nation")

