"""A virtual tree over the relational tables.

    dc=tpch / r_regionkey / n_nationkey / c_custkey / o_orderkey
                                        / s_suppkey
            / ou=parts / p_partkey
            / ou=docs  / doc_id
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators.search import Directory
from canopy.sources.relation import Attribute, Detail, Relation

ROOT = "dc=tpch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _attributes(detail: Detail | None = None, **kinds: str) -> dict[str, Attribute]:
    """name = syntax, with [] behind it for several values, which stand in the detail's rows."""
    return {n.lower(): Attribute(n, k.removesuffix("[]"), k.endswith("[]"), detail if k.endswith("[]") else None) for n, k in kinds.items()}


def directory(spark: SparkSession, sf_dir: str) -> Directory:
    table = lambda name: read(spark, sf_dir, name)

    def regions(needed):
        return table("region")

    def nations(needed):
        out = table("nation").withColumnRenamed("n_regionkey", "r_regionkey")
        if "member" in needed:
            members = table("customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("member"))
            out = out.join(members, out["n_nationkey"] == members["c_nationkey"], "left").drop("c_nationkey")
        return out

    def _placed(frame, nation: str):
        return frame.withColumnRenamed(nation, "n_nationkey").join(table("nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey")

    def customers(needed):
        return _placed(table("customer"), "c_nationkey")

    def suppliers(needed):
        return _placed(table("supplier"), "s_nationkey")

    lines = ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity"]

    def orders(needed):
        out = table("orders").withColumnRenamed("o_custkey", "c_custkey")
        if needed & {"n_nationkey", "r_regionkey"}:
            out = out.join(customers(needed).select("c_custkey", "n_nationkey", "r_regionkey"), "c_custkey")
        wanted = [c for c in lines if c in needed]
        if wanted:
            own = table("lineitem").groupBy("l_orderkey").agg(*(F.array_sort(F.collect_list(c)).alias(c) for c in wanted))
            out = out.join(own, out["o_orderkey"] == own["l_orderkey"], "left").drop("l_orderkey")
        return out

    def parts(needed):
        return table("part")

    def documents(needed):
        out = table("documents")
        if needed & {"quality", "toxic"}:
            out = out.join(table("labels"), "doc_id", "left")
        return out

    members = Detail(lambda: table("customer").select("c_nationkey", F.col("c_custkey").alias("member")), "c_nationkey", "n_nationkey")
    items = Detail(lambda: table("lineitem").select("l_orderkey", *lines), "l_orderkey", "o_orderkey")
    top, region, nation = ("dc", "tpch"), ("r_regionkey", None), ("n_nationkey", None)
    return Directory(
        [
            Relation("region", regions, [top, region], _attributes(r_regionkey="int", r_name="cs_string")),
            Relation(
                "nation", nations, [top, region, nation], _attributes(members, n_nationkey="int", n_name="cs_string", member="int[]")
            ),
            Relation(
                "customer",
                customers,
                [top, region, nation, ("c_custkey", None)],
                _attributes(c_custkey="int", c_name="cs_string", n_nationkey="int", c_acctbal="double", c_mktsegment="cs_string")
                | {"segment": Attribute("c_mktsegment", "ci_string")},
            ),
            Relation(
                "supplier",
                suppliers,
                [top, region, nation, ("s_suppkey", None)],
                _attributes(s_suppkey="int", s_name="cs_string", s_acctbal="double"),
            ),
            Relation(
                "salesOrder",
                orders,
                [top, region, nation, ("c_custkey", None), ("o_orderkey", None)],
                _attributes(
                    o_orderkey="int", o_orderstatus="cs_string", o_totalprice="double", o_orderdate="time", o_orderpriority="cs_string"
                )
                | _attributes(items, l_partkey="int[]", l_suppkey="int[]", l_returnflag="cs_string[]", l_linestatus="cs_string[]", l_quantity="double[]"),
            ),
            Relation(
                "part",
                parts,
                [top, ("ou", "parts"), ("p_partkey", None)],
                _attributes(p_partkey="int", p_name="cs_string", p_brand="cs_string", p_type="cs_string", p_size="int", p_retailprice="double"),
            ),
            Relation(
                "document",
                documents,
                [top, ("ou", "docs"), ("doc_id", None)],
                _attributes(doc_id="int", text="cs_string", lang="ci_string", source="cs_string", n_chars="int", quality="int", toxic="int"),
            ),
        ],
        ROOT,
    )
