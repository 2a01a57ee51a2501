"""The point views of :mod:`starloom.sources.points` in SQL, and a registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

GALAXIES = """galaxies as (
  select o_orderkey as id, (o_orderkey * 7919 + o_custkey * 104729) % 1000 as x,
    cast(floor(o_totalprice) as bigint) % 1000 as y,
    (cast(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as bigint) * 31 + o_custkey * 17) % 1000 as z,
    o_custkey % 5 + 1 as w, o_orderpriority as tracer
  from orders)"""

RANDOMS = """randoms as (
  select (l_partkey * 6151 + l_orderkey * 389) % 1000 as x, (l_suppkey * 9973 + l_orderkey * 617) % 1000 as y,
    cast(floor(l_extendedprice) as bigint) % 1000 as z, cast(1 as bigint) as w
  from lineitem)"""

MEASUREMENTS = """measurements as (
  select l_suppkey % 10 as cosmo_idx, cast(l_linenumber as bigint) as hod_idx,
    cast(case l_returnflag when 'A' then 0 when 'N' then 2 else 4 end as bigint) as ell, cast(l_quantity as bigint) as s,
    cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / count(*) / 100.0 as value
  from lineitem group by all)"""

MOCKS = """mocks as (
  select user_id as sample, event_type as feature,
    cast(sum(cast(round(value * 100) as bigint)) as double) / count(*) / 100.0 as value
  from events group by all)"""


def image(d: str) -> str:
    """Nearest periodic image of a difference, in SQL."""
    return f"case when {d} > 500 then {d} - 1000 when {d} < -500 then {d} + 1000 else {d} end"


def differences(a: str = "a", b: str = "b") -> str:
    return ", ".join(f"{image(f'({b}.{c} - {a}.{c})')} as d{c}" for c in "xyz")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add
