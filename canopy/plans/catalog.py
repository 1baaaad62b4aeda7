"""The queries that the driver runs over the virtual tree, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import filters as f
from canopy.functions import names, url
from canopy.model import ResultCode, Scope, SearchRequest, SortKey
from canopy.operators import cursors, updates
from canopy.operators.search import Directory, expected_count, register_control, size_limited
from canopy.sources import generic
from canopy.sources.relation import Attribute, Relation
from canopy.sources.tree import directory, read
from canopy.streaming import changes

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

# The DNs as SQL.
_REGION = "'r_regionkey=' || r_regionkey || ',dc=tpch'"
_NATION = "'n_nationkey=' || n_nationkey || ',r_regionkey=' || n_regionkey || ',dc=tpch'"
_CUST = f"'c_custkey=' || c_custkey || ',' || {_NATION}"
_SUPP = f"'s_suppkey=' || s_suppkey || ',' || {_NATION}"
_ORDER = f"'o_orderkey=' || o_orderkey || ',' || {_CUST}"
_PART = "'p_partkey=' || p_partkey || ',ou=parts,dc=tpch'"
_DOC = "'doc_id=' || doc_id || ',ou=docs,dc=tpch'"
_C = "customer join nation on c_nationkey = n_nationkey"
_S = "supplier join nation on s_nationkey = n_nationkey"
_O = "orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"
_D = "documents left join labels using (doc_id)"


def query(sql: str | None):
    def add(function):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def _search(name: str, condition, attributes: tuple, sql: str, **options):
    def run(spark, sf_dir):
        return directory(spark, sf_dir).search(filter=condition, attributes=attributes, **options)

    _QUERIES[name], _SQL[name] = run, sql


def _customers(name, condition, where, **options):
    sql = f"select {_CUST} as dn, 'customer' as \"objectClass\", c_name, c_acctbal from {_C} where {where}"
    _search(name, condition, ("c_name", "c_acctbal"), sql, **options)


def _parts(name, condition, where, **options):
    sql = f"select {_PART} as dn, 'part' as \"objectClass\", p_name, p_size from part where {where}"
    _search(name, condition, ("p_name", "p_size"), sql, **options)


def _documents(name, condition, where):
    sql = f"select {_DOC} as dn, 'document' as \"objectClass\", lang, toxic from {_D} where {where}"
    _search(name, condition, ("lang", "toxic"), sql)


def _orders(name, condition, where):
    sql = f"select {_ORDER} as dn, 'salesOrder' as \"objectClass\", o_orderstatus, o_totalprice from {_O} where {where}"
    _search(name, condition, ("o_orderstatus", "o_totalprice"), sql)


# Filters
_customers("filter_equality", "(c_mktsegment=BUILDING)", "c_mktsegment = 'BUILDING'")
_customers("filter_equality_ci", "(&(objectClass=customer)(segment=building))", "lower(c_mktsegment) = 'building'")
_parts("filter_gte_int", "(p_size>=40)", "p_size >= 40")
_customers("filter_lte_double", "(c_acctbal<=0)", "c_acctbal <= 0")
_orders("filter_gte_time", "(o_orderdate>=19980101000000Z)", "o_orderdate >= timestamp '1998-01-01'")
_documents("filter_present", "(&(objectClass=document)(toxic=*))", "toxic is not null")
_documents("filter_not_present", f.all_of(f.equal("objectClass", "document"), f.negate(f.present("toxic"))), "toxic is null")
_documents("filter_not_equal_missing", f.all_of(f.equal("objectClass", "document"), f.negate(f.equal("toxic", "1"))), "toxic is null or toxic <> 1")
_customers(
    "filter_and_or_not",
    "(&(objectClass=customer)(|(c_mktsegment=BUILDING)(c_acctbal>=9000))(!(n_nationkey=3)))",
    "(c_mktsegment = 'BUILDING' or c_acctbal >= 9000) and c_nationkey <> 3",
)
_customers(
    "filter_not_container",
    f.all_of(f.equal("objectClass", "customer"), f.negate(f.any_of(f.equal("c_mktsegment", "BUILDING"), f.at_least("c_acctbal", "0")))),
    "c_mktsegment <> 'BUILDING' and c_acctbal < 0",
)
_customers(
    "filter_not_and",
    f.all_of(f.equal("objectClass", "customer"), f.negate(f.all_of(f.equal("c_mktsegment", "BUILDING"), f.at_least("c_acctbal", "0")))),
    "not (c_mktsegment = 'BUILDING' and c_acctbal >= 0)",
)
_parts("filter_startswith", "(p_name=small*)", "starts_with(p_name, 'small')")
_parts("filter_endswith", "(p_name=*bolt)", "ends_with(p_name, 'bolt')")
_parts("filter_contains", "(p_name=*a*)", "contains(p_name, 'a')")
_parts("filter_substring_mixed", "(p_name=s*l*t*)", "p_name like 's%l%t%'")
_parts("filter_substring_overlap", f.Substring("p_type", "S", ("A", "D"), "D"), "p_type like 'S%A%D%D'")
_parts("filter_not_substring", "(&(objectClass=part)(!(p_name=*a*)))", "not contains(p_name, 'a')")
_customers("filter_escaped", "(c_name=Customer\\23000000001)", "c_name = 'Customer#000000001'")
_customers("filter_approx", "(c_mktsegment~=MACHINERY)", "c_mktsegment = 'MACHINERY'")
_parts("filter_ext_bitand", "(p_size:1.2.840.113556.1.4.803:=4)", "p_size & 4 = 4")
_parts("filter_ext_bitor", "(p_size:1.2.840.113556.1.4.804:=6)", "p_size & 6 <> 0")
_parts("filter_ext_ignore_case", "(p_brand:caseIgnoreMatch:=brand#13)", "lower(p_brand) = 'brand#13'")
_orders("filter_multivalue", "(l_returnflag=R)", "exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
_orders(
    "filter_multivalue_not",
    "(&(objectClass=salesOrder)(!(l_returnflag=R)))",
    "not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')",
)
_orders("filter_multivalue_range", "(l_quantity>=50)", "exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity >= 50)")
_orders(
    "filter_multivalue_absent",
    "(&(objectClass=salesOrder)(!(l_partkey=*)))",
    "not exists (select 1 from lineitem where l_orderkey = o_orderkey)",
)
_customers(
    "filter_many_branches",
    f.all_of(f.equal("objectClass", "customer"), f.any_of(*(f.equal("c_custkey", str(7 * k)) for k in range(20_000)), f.at_least("c_acctbal", "9900"))),
    "c_custkey % 7 = 0 and c_custkey < 140000 or c_acctbal >= 9900",
)
_customers(
    "filter_many_not",
    f.all_of(f.equal("objectClass", "customer"), *(f.negate(f.equal("c_custkey", str(3 * k))) for k in range(2_000))),
    "not (c_custkey % 3 = 0 and c_custkey < 6000)",
)
_parts(
    "filter_deep",
    "(&(objectClass=part)" * 1500 + "(p_size>=40)" + ")" * 1500,
    "p_size >= 40",
)
_orders(
    "filter_multivalue_or",
    "(|(&(l_returnflag=R)(o_totalprice<=20000))(l_quantity>=50))",
    "exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') and o_totalprice <= 20000"
    " or exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity >= 50)",
)
_customers("filter_undefined", "(&(objectClass=customer)(!(noSuchAttribute=1)))", "false")
_customers("filter_empty_and", f.all_of(f.equal("objectClass", "customer"), f.all_of()), "true")


@query(
    f"select {_NATION} as dn, 'nation' as \"objectClass\" from nation where n_nationkey = 3"
    f" union all select {_CUST}, 'customer' from {_C} where n_nationkey = 3 union all select {_SUPP}, 'supplier' from {_S} where n_nationkey = 3"
    f" union all select {_ORDER}, 'salesOrder' from {_O} where n_nationkey = 3"
)
def filter_ext_dn(spark, sf_dir):
    return directory(spark, sf_dir).search(filter="(n_nationkey:dn:=3)").select("dn", "objectClass")


# Scopes and names
_BASE = "n_nationkey=3,r_regionkey=3,dc=tpch"


@query(f"select {_NATION} as dn, n_name from nation where n_nationkey = 3 and n_regionkey = 3")
def scope_base(spark, sf_dir):
    return directory(spark, sf_dir).search(base=_BASE, scope=Scope.BASE).select("dn", "n_name")


@query(
    f"select {_CUST} as dn, 'customer' as \"objectClass\" from {_C} where n_nationkey = 3 and n_regionkey = 3"
    f" union all select {_SUPP}, 'supplier' from {_S} where n_nationkey = 3 and n_regionkey = 3"
)
def scope_one(spark, sf_dir):
    return directory(spark, sf_dir).search(base=_BASE, scope=Scope.ONE).select("dn", "objectClass")


@query(
    f"select {_NATION} as dn, 'nation' as \"objectClass\" from nation where n_nationkey = 3 and n_regionkey = 3"
    f" union all select {_CUST}, 'customer' from {_C} where n_nationkey = 3 and n_regionkey = 3"
    f" union all select {_SUPP}, 'supplier' from {_S} where n_nationkey = 3 and n_regionkey = 3"
    f" union all select {_ORDER}, 'salesOrder' from {_O} where n_nationkey = 3 and n_regionkey = 3"
)
def scope_sub(spark, sf_dir):
    return directory(spark, sf_dir).search(base=_BASE).select("dn", "objectClass")


@query(
    "select 'region' as \"objectClass\", count(*) as entries from region where r_regionkey = 3"
    " union all select 'nation', count(*) from nation where n_regionkey = 3"
    f" union all select 'customer', count(*) from {_C} where n_regionkey = 3"
    f" union all select 'supplier', count(*) from {_S} where n_regionkey = 3"
    f" union all select 'salesOrder', count(*) from {_O} where n_regionkey = 3"
)
def tree_by_class(spark, sf_dir):
    return directory(spark, sf_dir).by_class("r_regionkey=3,dc=tpch")


@query(
    f"select {_CUST} as dn, 'c_custkey=' || c_custkey as rdn, 'c_custkey' as rdn_name, cast(c_custkey as varchar) as rdn_value,"
    f" {_NATION} as parent, cast(4 as bigint) as depth, true as valid, false as multi, 'dn:' || {_CUST} as authz from {_C}"
)
def dn_parts(spark, sf_dir):
    found = directory(spark, sf_dir).search(filter="(objectClass=customer)", attributes=("1.1",))
    dn, own = F.col("dn"), names.rdn(F.col("dn"))
    return found.select(
        "dn",
        own.alias("rdn"),
        names.rdn_name(own).alias("rdn_name"),
        names.rdn_value(own).alias("rdn_value"),
        names.parent_of(dn).alias("parent"),
        names.depth(dn).cast("long").alias("depth"),
        names.is_valid_column(dn).alias("valid"),
        names.is_multivalued(own).alias("multi"),
        names.authorization_id(dn).alias("authz"),
    )


@query("select event_id, replace(replace(replace(event_type, ',', '\\2c'), '=', '\\3d'), '+', '\\2b') as escaped from events")
def dn_escape(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", names.escape_value_column(F.col("event_type")).alias("escaped"))


@query("select 'n_nationkey=' || n_nationkey || ',r_regionkey=' || n_regionkey || ',dc=tpch' as dn, r_name, n_name from nation join region on n_regionkey = r_regionkey")
def parent_join(spark, sf_dir):
    d = directory(spark, sf_dir)
    nations = d.search(filter="(objectClass=nation)", attributes=("n_name",)).withColumn("parent", names.parent_of(F.col("dn")))
    regions = d.search(filter="(objectClass=region)", attributes=("r_name",)).select(F.col("dn").alias("parent"), "r_name")
    return nations.join(regions, "parent").select("dn", "r_name", "n_name")


# Projection
_search(
    "project_types_only",
    "(objectClass=document)",
    ("lang", "toxic", "quality"),
    f"select {_DOC} as dn, 'document' as \"objectClass\", lang is not null as lang, toxic is not null as toxic, quality is not null as quality from {_D}",
    types_only=True,
)
_search("project_none", "(objectClass=supplier)", ("1.1",), f"select {_SUPP} as dn, 'supplier' as \"objectClass\" from {_S}")
_search(
    "project_all",
    "(objectClass=supplier)",
    (),
    f"select {_SUPP} as dn, 'supplier' as \"objectClass\", s_suppkey, s_name, s_acctbal from {_S}",
)


@query(
    f"select '<GUID=' || md5({_CUST}) || '>;' || case when c_acctbal < 0 then '' else '<SID=' || c_custkey || '>;' end || {_CUST} as extended from {_C}"
)
def project_extended_dn(spark, sf_dir):
    """Names with identifiers in front; a missing one is left out."""
    found = directory(spark, sf_dir).search(filter="(objectClass=customer)", attributes=("c_custkey", "c_acctbal"))
    sid = F.when(F.col("c_acctbal") >= 0, F.col("c_custkey"))
    return found.select(names.extended_dn(F.col("dn"), F.md5("dn"), sid).alias("extended"))


@query(
    f"select {_CUST} as dn, case when c_custkey % 16 % 2 = 1 then c_name end as owner, case when c_custkey % 16 // 2 % 2 = 1 then c_mktsegment end as group_name,"
    f" case when c_custkey % 16 // 4 % 2 = 1 then n_name end as dacl from {_C}"
)
def project_sd_flags(spark, sf_dir):
    """Parts of a security descriptor by the flags asked for."""
    found = directory(spark, sf_dir).search(filter="(objectClass=customer)", attributes=("c_custkey", "c_name", "c_mktsegment", "n_nationkey"))
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    flags = (F.col("c_custkey") % 16).cast("int")
    part = lambda column, flag, name: names.descriptor_part(F.col(column), flag, flags).alias(name)
    return found.join(nation, "n_nationkey").select(
        "dn", part("c_name", names.OWNER, "owner"), part("c_mktsegment", names.GROUP, "group_name"), part("n_name", names.DACL, "dacl")
    )


@query(f"select {_PART} as dn, 'p_size' as attribute, cast(p_size as varchar) as value from part union all select {_PART}, 'p_brand', p_brand from part")
def generic_layout(spark, sf_dir):
    found = directory(spark, sf_dir).search(filter="(objectClass=part)", attributes=("p_size", "p_brand", "p_name"))
    entries = generic.project(generic.from_mapped(found, ["p_size", "p_brand", "p_name"]), ["p_size", "P_BRAND"])
    return entries.select("dn", F.explode("attrs").alias("attribute", "values")).select("dn", "attribute", F.explode("values").alias("value"))


# Order, limits, cursors
_BY_BALANCE = (SortKey("c_acctbal"),)
_RANKED = f"(select {_CUST} as dn, c_name, c_acctbal, row_number() over (order by c_acctbal, {_CUST}) as rn, count(*) over () as n from {_C})"


def _balances(**options):
    return SearchRequest(filter="(objectClass=customer)", attributes=("c_name", "c_acctbal"), sort=_BY_BALANCE).with_(**options)


@query(f"select {_CUST} as dn, c_mktsegment, c_acctbal, row_number() over (order by c_mktsegment, c_acctbal desc, {_CUST}) as pos from {_C}")
def sort_multi(spark, sf_dir):
    request = _balances(attributes=("c_mktsegment", "c_acctbal"), sort=(SortKey("c_mktsegment"), SortKey("c_acctbal", descending=True)))
    rows, order = directory(spark, sf_dir).sorted_keys(request)
    return cursors.ranked(rows, order, "pos").select("dn", "c_mktsegment", "c_acctbal", "pos")


@query(f"select {_DOC} as dn, toxic, row_number() over (order by toxic desc nulls first, {_DOC}) as pos from {_D}")
def sort_desc_nulls(spark, sf_dir):
    rows, order = directory(spark, sf_dir).sorted_keys(
        _balances(filter="(objectClass=document)", attributes=("toxic",), sort=(SortKey("toxic", descending=True),))
    )
    return cursors.ranked(rows, order, "pos").select("dn", "toxic", "pos")


@query(
    f"select dn, low, row_number() over (order by low nulls last, dn) as pos from (select {_ORDER} as dn,"
    f" (select min(l_partkey) from lineitem where l_orderkey = o_orderkey) as low from {_O} where n_nationkey = 3)"
)
def sort_multivalue(spark, sf_dir):
    rows, order = directory(spark, sf_dir).sorted_keys(
        _balances(filter="(objectClass=salesOrder)", base=_BASE, attributes=("1.1",), sort=(SortKey("l_partkey"),))
    )
    return cursors.ranked(rows, order, "pos").select("dn", F.col("_sort_l_partkey").alias("low"), "pos")


@query(f"select dn, c_name, c_acctbal from {_RANKED} where rn <= 25")
def size_limit(spark, sf_dir):
    found = directory(spark, sf_dir).search(_balances())
    return size_limited(found, 25)[0].drop("objectClass")


@query(f"select {_ORDER} as dn, o_totalprice from {_O} order by o_totalprice desc, {_ORDER} limit 20")
def top_k(spark, sf_dir):
    request = _balances(filter="(objectClass=salesOrder)", attributes=("o_totalprice",), sort=(SortKey("o_totalprice", True),), size_limit=20)
    return directory(spark, sf_dir).search(request).drop("objectClass")


@query(f"select * from (select dn, 'first' as place from {_RANKED} where rn = 1 union all select dn, 'last' from {_RANKED} where rn = n)")
def first_last(spark, sf_dir):
    d = directory(spark, sf_dir)
    rows, order = d.sorted_keys(_balances())
    back = [F.col("_sort_c_acctbal").desc_nulls_first(), F.col("dn").desc()]
    first = rows.orderBy(*order).limit(1).select("dn", F.lit("first").alias("place"))
    return first.unionByName(rows.orderBy(*back).limit(1).select("dn", F.lit("last").alias("place")))


@query(f"select dn, c_name, c_acctbal, rn as pos from {_RANKED} where rn between 201 and 300")
def paging_page_k(spark, sf_dir):
    return cursors.Pages(directory(spark, sf_dir), _balances(), 100).page(3).drop("objectClass")


@query(f"select dn, rn as rank, cast(ceil(rn / 100.0) as bigint) as page, n - least(n, cast(ceil(rn / 100.0) as bigint) * 100) as remaining from {_RANKED}")
def paging_all(spark, sf_dir):
    rows, order = directory(spark, sf_dir).sorted_keys(_balances())
    held = cursors.ranked(rows, order, "rank", "n").withColumn("page", F.ceil(F.col("rank") / 100).cast("long"))
    return held.select("dn", "rank", "page", (F.col("n") - F.least(F.col("n"), F.col("page") * 100)).alias("remaining"))


@query(f"select dn, c_name, c_acctbal, rn as list_offset, n as list_size from {_RANKED} where rn between 40 and 70")
def vlv_offset(spark, sf_dir):
    return cursors.ListView(directory(spark, sf_dir), _balances(), 10, 20).at_offset(50).drop("objectClass")


@query(f"select dn, c_name, c_acctbal, rn as list_offset, n as list_size from {_RANKED} where rn between round(n * 0.5) - 100 and round(n * 0.5) + 100")
def vlv_percent(spark, sf_dir):
    return cursors.ListView(directory(spark, sf_dir), _balances(), 100, 100).at_percent(50).drop("objectClass")


@query(
    f"with r as (select * from {_RANKED}), g as (select min(rn) as goal from r where c_acctbal >= 5000)"
    " select dn, c_name, c_acctbal, rn as list_offset, n as list_size from r, g where rn between goal - 5 and goal + 10"
)
def vlv_value(spark, sf_dir):
    return cursors.ListView(directory(spark, sf_dir), _balances(), 5, 10).at_value(5000).drop("objectClass")


_MEMBER = "(select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) - 1 as value_index from customer)"


@query(f"select {_NATION} as dn, c_custkey as value, value_index from nation join {_MEMBER} on c_nationkey = n_nationkey where value_index between 10 and 19")
def range_values(spark, sf_dir):
    low, high = cursors.range_option("range=10-19")
    return cursors.ranged_values(directory(spark, sf_dir).values("nation", "member"), low, high)


@query(f"select {_NATION} as dn, c_custkey as value, value_index from nation join {_MEMBER} on c_nationkey = n_nationkey")
def range_all(spark, sf_dir):
    return cursors.ranged_values(directory(spark, sf_dir).values("nation", "member"))


@query(
    f"select {_NATION} as dn, 'member' as attribute, cast(n_nationkey as bigint) as low, case when n_nationkey % 2 = 0 then cast(n_nationkey as bigint) + 9 end as high,"
    f" n_name as value from nation where n_nationkey <> 7"
)
def range_options(spark, sf_dir):
    """Attributes that came in part, by their range option."""
    found = directory(spark, sf_dir).search(filter="(objectClass=nation)", attributes=("n_nationkey", "n_name"))
    k = F.col("n_nationkey")
    part = F.concat(F.lit("member;Range="), k, F.lit("-"), F.when(k % 2 == 0, (k + 9).cast("string")).otherwise("*"))
    key = F.when(k == 7, F.lit("member")).otherwise(part)
    entries = found.select("dn", F.create_map(key, F.array("n_name"), F.lit("cn"), F.array("n_name")).alias("attrs"))
    return generic.ranged(entries, "MEMBER").select("dn", "attribute", "low", "high", F.col("values")[0].alias("value"))


@query(
    "select event_id, 'CN' as name, list_aggregate(list_sort(['lang-en', event_type]), 'string_agg', ',') as options,"
    " 'cn;' || list_aggregate(list_sort(['lang-en', event_type]), 'string_agg', ';') as printed, event_type = 'click' as has_click from events"
)
def attribute_options(spark, sf_dir):
    """Options of attribute descriptions, read, printed and asked for."""
    written = F.concat(F.lit("CN;"), F.upper("event_type"), F.lit(";Lang-EN"))
    rows = read(spark, sf_dir, "events").select("event_id", written.alias("description"))
    name, own = names.attribute_name(F.col("description")), names.options_column(F.col("description"))
    return rows.select(
        "event_id",
        name.alias("name"),
        F.array_join(own, ",").alias("options"),
        names.description_column(name, own).alias("printed"),
        F.array_contains(own, "click").alias("has_click"),
    )


@query(
    "select n_nationkey, count(c_custkey) as members, min(c_custkey) as first_value, max(c_custkey) as last_value,"
    " count(*) filter (c_custkey = 7) > 0 as has_seven, count(*) > 20 as has_more from nation left join customer on c_nationkey = n_nationkey group by n_nationkey"
)
def multi_counts(spark, sf_dir):
    """Counts over the values of a long attribute, combined before any shuffle."""
    values = directory(spark, sf_dir).values("nation", "member")
    counts = values.groupBy("dn").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.max(F.col("value") == 7).alias("seven")
    )
    nations = directory(spark, sf_dir).search(filter="(objectClass=nation)", attributes=("n_nationkey",))
    n = F.coalesce("n", F.lit(0))
    return nations.join(counts, "dn", "left").select(
        "n_nationkey",
        n.alias("members"),
        F.col("low").alias("first_value"),
        F.col("high").alias("last_value"),
        F.coalesce("seven", F.lit(False)).alias("has_seven"),
        (n > 20).alias("has_more"),
    )


@query(f"select {_CUST} as dn, 'customer' as \"objectClass\", c_name from {_C} where c_custkey = 7")
def entry_get(spark, sf_dir):
    """An entry by its name, the name taken from the directory itself."""
    d = directory(spark, sf_dir)
    dn = d.search(filter="(c_custkey=7)", attributes=("1.1",)).where("objectClass = 'customer'").first()["dn"]
    return d.get(dn, "c_name")


@query(f"select {_CUST} as dn, c_custkey from {_C} where c_custkey = 11")
def entries_get(spark, sf_dir):
    every = directory(spark, sf_dir).search(filter="(objectClass=customer)", attributes=("c_custkey",)).drop("objectClass")
    return cursors.get(every, every.where("c_custkey = 11").first()["dn"])


def _events_with_tombstones(spark, sf_dir):
    """Events as entries, where errors are tombstones."""
    own = Relation(
        "event",
        lambda needed: read(spark, sf_dir, "events"),
        [("dc", "log"), ("event_id", None)],
        {"event_id": Attribute("event_id", "int"), "event_type": Attribute("event_type"), "user_id": Attribute("user_id", "int")},
        deleted="event_type = 'error'",
    )
    return Directory([own], "dc=log")


@query("select event_type, count(*) as entries from events where event_type <> 'error' and user_id >= 10 group by event_type")
def deleted_hidden(spark, sf_dir):
    found = _events_with_tombstones(spark, sf_dir).search(filter="(user_id>=10)", attributes=("event_type",))
    return found.groupBy("event_type").agg(F.count("*").alias("entries"))


@query("select event_type, count(*) as entries from events where user_id >= 10 group by event_type")
def deleted_shown(spark, sf_dir):
    found = _events_with_tombstones(spark, sf_dir).search(filter="(user_id>=10)", attributes=("event_type",), show_deleted=True)
    return found.groupBy("event_type").agg(F.count("*").alias("entries"))


@query(f"select {_SUPP} as dn, s_name as name from {_S} where s_suppkey % 3 = 0 or s_suppkey % 3 = 1 and s_acctbal >= 0")
def alias_dereference(spark, sf_dir):
    """Aliases of suppliers, aliases of these, one that leads nowhere and two in a ring; suppliers of three kinds."""
    found = directory(spark, sf_dir).search(filter="(objectClass=supplier)", attributes=("s_suppkey", "s_name", "s_acctbal"))
    k = F.col("s_suppkey")
    entry = lambda dn, key, value: F.struct(dn.alias("dn"), F.create_map(F.lit(key), F.array(value)).alias("attrs"))
    alias = lambda tag: F.concat(F.lit(f"cn={tag}"), k, F.lit(",dc=tpch"))
    own = found.select(k.alias("k"), "s_acctbal", entry(F.col("dn"), "name", F.col("s_name")).alias("e"), *(entry(alias(t), "aliasedobjectname", x).alias(t) for t, x in (("a", F.col("dn")), ("b", alias("a")))))
    shown = own.where("k % 3 = 0").select("e.*")
    aliased = own.where("k % 3 = 1 AND s_acctbal >= 0").select(F.explode(F.array("a", "b")).alias("x")).select("x.*")
    ring = spark.createDataFrame([(f"cn=r{j},dc=tpch", {"aliasedobjectname": [f"CN=R{1 - j},dc=tpch"]}) for j in range(2)] + [("cn=x", {"aliasedobjectname": ["cn=nowhere"]})], generic.SCHEMA)
    entries = shown.unionByName(aliased).unionByName(ring)
    out = generic.dereference(entries, own.select("e.*").unionByName(aliased).unionByName(ring))
    return out.select("dn", F.col("attrs")["name"][0].alias("name"))


@query(f"select {_CUST} as dn, c_name from {_C} where c_custkey = 7")
def expected_one(spark, sf_dir):
    return expected_count(directory(spark, sf_dir).search(filter="(&(objectClass=customer)(c_custkey=7))", attributes=("c_name",)), 1, 1).drop("objectClass")


@query(
    f"select {_CUST} as dn, c_mktsegment = 'BUILDING' as matches from {_C} where c_custkey in (1, 2, 3)"
)
def compare_true_false(spark, sf_dir):
    d = directory(spark, sf_dir)
    wanted = d.search(filter="(|(c_custkey=1)(c_custkey=2)(c_custkey=3))", attributes=("1.1",)).where("objectClass = 'customer'")
    return cursors.union(*(d.compare(r["dn"], "c_mktsegment", "BUILDING") for r in wanted.collect()))


# Updates
def _entries(spark, sf_dir):
    found = directory(spark, sf_dir).search(filter="(|(objectClass=nation)(objectClass=customer))", attributes=("n_name", "c_name", "c_mktsegment"))
    return found.select("dn", F.coalesce("n_name", "c_name").alias("name"))


_ENTRIES = f"(select {_NATION} as dn, n_name as name from nation union all select {_CUST}, c_name from {_C})"


@query(f"select dn, name from {_ENTRIES} union all select 'c_custkey=0,{_BASE}', 'new'")
def update_add(spark, sf_dir):
    return updates.add(_entries(spark, sf_dir), spark.createDataFrame([(f"c_custkey=0,{_BASE}", "new")], "dn string, name string"))


@query(f"select dn, name from {_ENTRIES} where dn not like 'c_custkey=7,%'")
def update_delete(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    dn = entries.where(F.startswith("dn", F.lit("c_custkey=7,"))).first()["dn"]
    return updates.delete(entries, dn)


@query(f"select dn, name from {_ENTRIES} where dn <> '{_BASE}' and dn not like '%,{_BASE}'")
def update_subtree_delete(spark, sf_dir):
    return updates.delete_subtree(_entries(spark, sf_dir), _BASE)


@query(f"select case when dn = '{_BASE}' then 'n_nationkey=99,r_regionkey=3,dc=tpch' when dn like '%,{_BASE}' then replace(dn, ',{_BASE}', ',n_nationkey=99,r_regionkey=3,dc=tpch') else dn end as dn, name from {_ENTRIES}")
def update_rename(spark, sf_dir):
    return updates.rename(_entries(spark, sf_dir), _BASE, "n_nationkey=99")


@query(f"select case when dn = '{_BASE}' then 'n_nationkey=3,r_regionkey=0,dc=tpch' when dn like '%,{_BASE}' then replace(dn, ',{_BASE}', ',n_nationkey=3,r_regionkey=0,dc=tpch') else dn end as dn, name from {_ENTRIES}")
def update_move(spark, sf_dir):
    return updates.rename(_entries(spark, sf_dir), _BASE, new_parent="r_regionkey=0,dc=tpch")


@query(
    f"select {_PART} as dn, case when p_partkey = 7 then p_brand || ',new,x' else p_brand end as brands,"
    " case when p_partkey = 7 then 'big' else cast(p_size as varchar) end as size, case when p_partkey = 7 then null else p_type end as type from part"
)
def update_modify(spark, sf_dir):
    """Replace, add, delete a value and drop an attribute, in order, on one entry."""
    found = directory(spark, sf_dir).search(filter="(objectClass=part)", attributes=("p_brand", "p_size", "p_type"))
    entries = generic.from_mapped(found, ["p_brand", "p_size", "p_type"])
    steps = [
        updates.Change("add", "p_brand", ("new", "old", "x")),
        updates.Change("delete", "p_brand", ("old",)),
        updates.Change("replace", "p_size", ("big",)),
        updates.Change("delete", "p_type"),
    ]
    out = updates.modify(entries, "p_partkey=7,ou=parts,dc=tpch", steps)
    text = lambda a: F.array_join(F.try_element_at("attrs", F.lit(a)), ",")
    return out.select("dn", text("p_brand").alias("brands"), text("p_size").alias("size"), text("p_type").alias("type"))


@query(
    f"select {_PART} as dn, case when p_partkey = 9 then p_brand || ',extra' else p_brand end as brands, case when p_partkey = 9 then '1,2' else cast(p_size as varchar) end as size,"
    " case when p_partkey = 9 then null else p_type end as type from part"
)
def update_edit(spark, sf_dir):
    """An entry edited through an object that keeps the changes, then applied with the checks on."""
    found = directory(spark, sf_dir).search(filter="(objectClass=part)", attributes=("p_brand", "p_size", "p_type"))
    entries = generic.from_mapped(found, ["p_brand", "p_size", "p_type"])
    edit = updates.Edit("p_partkey=9,ou=parts,dc=tpch").add("p_brand", "extra", "gone").remove("p_brand", "gone").remove("p_brand").set("p_size", 1, 2).reset("p_type")
    out = edit.apply(entries, check=True)
    text = lambda a: F.array_join(F.try_element_at("attrs", F.lit(a)), ",")
    return out.select("dn", text("p_brand").alias("brands"), text("p_size").alias("size"), text("p_type").alias("type"))


@query(
    "select * from (values (0::bigint, 'cn=a', 0, 'mail', 'x,y'), (1::bigint, 'cn=a', 1, 'mail', 'x'), (2::bigint, 'cn=a', 2, 'sn', 'z'), (3::bigint, 'cn=a', 1, 'uid', ''))"
    " t(seq, dn, kind, attribute, given)"
)
def update_change_log(spark, sf_dir):
    """The changes of an edit as rows."""
    edit = updates.Edit("cn=a").add("mail", "x", "y").remove("mail", "x").remove("sn").set("sn", "z").reset("uid")
    return edit.rows(spark).select("seq", "dn", "kind", "attribute", F.array_join("values", ",").alias("given"))


# Change feed
def _feed(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


@query("select event_id, user_id, event_type, value from events where event_type = 'purchase'")
def dirsync_initial(spark, sf_dir):
    return changes.since(_feed(spark, sf_dir), "event_id", None, F.col("event_type") == "purchase")


@query("select event_id, user_id, event_type, value from events where event_id > 500 and event_type = 'purchase'")
def dirsync_since(spark, sf_dir):
    return changes.since(_feed(spark, sf_dir), "event_id", 500, F.col("event_type") == "purchase")


@query("select event_id, user_id, event_type, value from events where event_id > 500 order by event_id limit 100")
def dirsync_chunk(spark, sf_dir):
    return changes.chunk(_feed(spark, sf_dir), "event_id", 500, 100)


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def dirsync_latest(spark, sf_dir):
    return changes.latest(_feed(spark, sf_dir), "user_id", "event_id")


@query("select event_id, user_id, event_type, value from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1")
def dirsync_incremental_values(spark, sf_dir):
    return changes.new_values(_feed(spark, sf_dir), "user_id", "event_id", "event_type")


@query(
    f"select {_NATION} as dn, cast(3 as bigint) as depth from nation union all select {_REGION}, cast(2 as bigint) from region"
)
def dirsync_ancestors_first(spark, sf_dir):
    found = directory(spark, sf_dir).search(filter="(|(objectClass=nation)(objectClass=region))", attributes=("1.1",))
    return changes.ancestors_first(found.select("dn", names.depth(F.col("dn")).cast("long").alias("depth")), "depth", "dn")


@query("select event_id, user_id, row_number() over (partition by user_id order by event_id) as version from events")
def dirsync_versions(spark, sf_dir):
    return changes.numbered(_feed(spark, sf_dir).select("event_id", "user_id"), "user_id", "event_id")


# Front ends and set operations
@query(f"select {_CUST} as dn, 'customer' as \"objectClass\", c_name from {_C} where n_nationkey = 3 and n_regionkey = 3 and c_acctbal >= 0")
def url_query(spark, sf_dir):
    parsed = url.parse(f"ldap:///{_BASE}?c_name?one?(c_acctbal>=0)")
    return directory(spark, sf_dir).search(parsed.request()).select("dn", "objectClass", "c_name")


@query(
    "select 'dc=tpch' as \"namingContexts\", '1.3.6.1.4.1.4203.1.11.3' as \"supportedExtension\", '3' as \"supportedLDAPVersion\","
    " 'Canopy' as \"vendorName\", '1.2.840.113556.1.4.319' as \"supportedControl\""
)
def root_dse(spark, sf_dir):
    return generic.root_dse(spark, ["dc=tpch"], ["1.3.6.1.4.1.4203.1.11.3"], "Canopy")


@query("select 'dc=tpch' as \"namingContexts\", 'Canopy 2' as \"vendorName\"")
def root_dse_project(spark, sf_dir):
    """Attributes asked for without regard to case, after a hook."""
    hook = lambda row: row.withColumn("vendorName", F.concat("vendorName", F.lit(" 2")))
    return generic.root_dse(spark, ["dc=tpch"], [], "Canopy", attributes=("VENDORNAME", "namingcontexts"), hook=hook)


@query(f"select {_CUST} as dn, c_name, c_acctbal from {_C} where c_mktsegment = 'BUILDING' and c_acctbal < 100")
def filter_edited(spark, sf_dir):
    """A container taken apart and put together again."""
    node = f.all_of(f.equal("objectClass", "customer"), f.at_least("c_acctbal", "0"), f.equal("c_mktsegment", "BUILDING"))
    node = node.removed(f.at_least("c_acctbal", "0")).added(f.negate(f.at_least("c_acctbal", "100")))
    assert len(node) == 3 and node.has(f.equal("c_mktsegment", "BUILDING"))
    return directory(spark, sf_dir).search(filter=node, attributes=("c_name", "c_acctbal")).drop("objectClass")


@register_control("1.1.1.1")
def _sampled_by_key(found, value):
    return found.where(F.col("c_custkey") % int(value) == 0)


@query(f"select {_CUST} as dn, c_custkey from {_C} where c_acctbal >= 0 and c_custkey % 10 = 0")
def control_custom(spark, sf_dir):
    """A control of one's own, in a search."""
    request = SearchRequest(filter="(&(objectClass=customer)(c_acctbal>=0))", attributes=("c_custkey",), controls=(("1.1.1.1", 10),))
    return directory(spark, sf_dir).search(request).drop("objectClass")


@query("select 16 as code, 'no such attribute' as words union all select 20, 'attribute or value exists' union all select 68, 'entry already exists'")
def result_code_words(spark, sf_dir):
    rows = [(int(c), c.words) for c in (ResultCode.NO_SUCH_ATTRIBUTE, ResultCode.ATTRIBUTE_OR_VALUE_EXISTS, ResultCode.ENTRY_ALREADY_EXISTS)]
    return spark.createDataFrame(rows, "code int, words string")


@query(f"select {_REGION} as dn, r_name as name from region union all select {_NATION}, n_name from nation union all select {_REGION}, r_name from region")
def entries_union(spark, sf_dir):
    d = directory(spark, sf_dir)
    regions = d.search(filter="(objectClass=region)", attributes=("r_name",)).select("dn", F.col("r_name").alias("name"))
    nations = d.search(filter="(objectClass=nation)", attributes=("n_name",)).select("dn", F.col("n_name").alias("name"))
    return cursors.union(regions, nations, regions)


@query(f"select {_CUST} as dn, c_name from {_C} where c_acctbal >= 0")
def entries_remove(spark, sf_dir):
    d = directory(spark, sf_dir)
    every = d.search(filter="(objectClass=customer)", attributes=("c_name",)).select("dn", "c_name")
    return cursors.remove(every, d.search(filter="(!(c_acctbal>=0))", attributes=("1.1",)).where("objectClass = 'customer'"))


@query("select event_type, count(*) as entries from events group by event_type")
def entries_count(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("entries"))
