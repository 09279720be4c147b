"""Sky-like projections of the generic test tables.

Each fixture is a source table and a list of SQL expressions that mean the
same in Spark and in ANSI SQL (``e0`` literals are DOUBLE in both).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

IMAGE_WIDTH = 120

FIXTURES: dict[str, tuple[str, list[str]]] = {
    "catalog": ("orders", [
        "o_orderkey as source_number",
        "150e0 + ((o_orderkey*137.50776405e0) % 100e0)/100e0 as ra",
        "2e0 + ((o_orderkey*7.391e0) % 100e0)/100e0 as dec_",
        "case when o_orderkey % 17 = 0 then null else 18e0 + (o_totalprice % 7000e0)/1000e0 end as mag_auto",
        "18e0 + (o_totalprice % 7000e0)/1000e0 + (o_orderkey % 10)*0.1e0 as mag_apauto",
        "(0.5e0 + (o_custkey % 30)*0.1e0)/3600e0 as fwhm_world",
        "0.6e0 + (o_orderkey % 5)*0.05e0 as prediq",
        "(0.3e0 + (o_orderkey % 40)*0.05e0)/3600e0 as a_world",
        "(0.3e0 + (o_orderkey % 40)*0.05e0)*(0.3e0 + (o_custkey % 8)*0.1e0)/3600e0 as b_world",
        "case when o_orderkey % 23 = 0 then null else (o_custkey % 720)*0.5e0 - 90e0 end as theta_j2000",
        "3e0 + (o_custkey % 20)*0.1e0 as kron_radius",
        "cast(o_orderkey % 6 as double) as flags",
        "17.9e0 + (o_totalprice % 7000e0)/1000e0 as mag_cog",
        "18.2e0 + (o_totalprice % 7000e0)/1000e0 as mag_2arc",
        "24.5e0 as predmaglim",
        "0.01e0 + (o_orderkey % 25)*0.01e0 as magerr_cog",
        "0.01e0 + (o_custkey % 25)*0.01e0 as magerr_2arc",
        "case when o_custkey % 13 = 0 then null else 0.01e0 + (o_custkey % 30)*0.008e0 end as magerr_auto",
        "1e0 + (o_orderkey % 997)*1.03e0 as x_image",
        "1e0 + (o_custkey % 991)*1.07e0 as y_image",
    ]),
    "stars": ("customer", [
        "c_custkey as source_id",
        "150e0 + ((c_custkey*91.7313e0) % 100e0)/100e0 as ra",
        "2e0 + ((c_custkey*33.1771e0) % 100e0)/100e0 as dec_",
        "case when c_custkey % 19 = 0 then null else 12e0 + (c_custkey % 80)*0.1e0 end as phot_g_mean_mag",
        "0.5e0 + (c_custkey % 50)*0.01e0 as p_star",
        "(c_custkey % 7)*0.1e0 as p_galaxy",
        "case when c_custkey % 29 = 0 then null else (c_custkey % 3)*0.1e0 end as p_quasar",
    ]),
    "samples": ("lineitem", [
        "cast(l_linenumber as integer) as exposure",
        "cast((l_orderkey % 120) as integer) as y",
        "cast((l_partkey % 100) as integer) as x",
        "l_extendedprice/997e0 as sci",
        "case when l_quantity > 48e0 then 0e0 else l_quantity end as wht",
    ]),
    "morpho": ("lineitem", [
        "cast(l_orderkey as varchar(20)) as object_id",
        "l_linenumber as part_no",
        "l_partkey as tie",
        "150e0 + ((l_orderkey*0.377e0) % 10e0) as ra",
        "-20e0 + ((l_orderkey*0.191e0) % 40e0) as dec_",
        "l_extendedprice as flux_vis_psf",
        "l_extendedprice/(10e0 + l_quantity) as fluxerr_vis_psf",
        "0.2e0 + l_tax*10e0 as fwhm",
        "0.85e0 + l_discount as extended_prob",
        "case when l_partkey % 11 = 0 then null else l_discount*1.5e0 end as point_like_prob",
    ]),
    "observations": ("events", [
        "event_id as obsid",
        "case when event_type in ('view','click') then ' jwst ' else upper(event_type) end as obs_collection",
        "concat('P', cast(user_id as varchar(20))) as proposal_id",
        "value as distance",
        "case when event_id % 9 = 0 then null else 60310e0 + event_id*0.001e0 end as t_min",
        "props",
    ]),
    "labels": ("part", [
        "cast(p_size as integer) as label",
        "cast(p_partkey % 100 as integer) as x",
        "cast(floor(p_partkey/100e0) as integer) as y",
        "p_retailprice as v",
    ]),
    # One row per pixel; the image gets taller as the table grows.
    "image": ("orders", [
        f"cast(floor(o_orderkey/{IMAGE_WIDTH}e0) as integer) as y",
        f"cast(o_orderkey % {IMAGE_WIDTH} as integer) as x",
        "(o_totalprice % 1000e0)/9.97e0 + case when o_totalprice > 440000e0 then 400e0 else 0e0 end as v",
    ]),
    "whole_sky": ("orders", [
        "o_orderkey as id",
        "(o_orderkey*137.50776405e0) % 360e0 as ra",
        "-89.9e0 + ((o_orderkey*7.391e0) % 1798e0)/10e0 as dec_",
    ]),
    "targets": ("customer", [
        "cast(c_custkey as varchar(20)) as id",
        "150e0 + ((c_custkey*91.7313e0) % 100e0)/100e0 as ra",
        "2e0 + ((c_custkey*33.1771e0) % 100e0)/100e0 as dec_",
        "3e0 + (c_custkey % 13) as size",
    ]),
    "mosaics": ("supplier", [
        "s_suppkey as mosaic_id",
        "concat('mosaic_', cast(s_suppkey as varchar(20)), '.fits') as file_name",
        "case when s_nationkey % 5 = 0 then 'NISP' else 'VIS' end as instrument_name",
        "s_acctbal as creation_date",
        "150e0 + ((s_suppkey*61.803398e0) % 100e0)/100e0 as ra0",
        "2e0 + ((s_suppkey*41.421356e0) % 100e0)/100e0 as dec0",
        "0.02e0 + (s_nationkey % 6)*0.01e0 as half",
    ]),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, expressions = FIXTURES[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*expressions)


def fixture_sql(name: str) -> str:
    table, expressions = FIXTURES[name]
    return f"(select {', '.join(expressions)} from {table})"
