"""Projections of relational tables into the shapes of a code index.

Each text is valid in Spark and in other SQL engines; ``{name}`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from weftline.session import table

VIEWS = {
    "v_files": "select s_suppkey as id, concat('mod', cast(s_nationkey as string), '/', s_name, '.py') as path, n_name as lang from {supplier} join {nation} on s_nationkey = n_nationkey",
    "v_symbols": "select p_partkey as id, p_partkey % (select count(*) from {supplier}) as file_id, replace(p_name, ' ', '_') as name, "
    "case p_size % 5 when 0 then 'class' when 1 then 'function' when 2 then 'method' when 3 then 'async_function' else 'async_method' end as kind, "
    "p_size as line, concat('(', lower(p_type), ' ', p_brand, ')') as signature from {part}",
    "v_edges": "select distinct src, dst, 'call' as kind from (select l_partkey as src, l_quantity, l_returnflag, lead(l_partkey) over (partition by l_orderkey "
    "order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as dst from {lineitem}) o where dst is not null and l_returnflag = 'R' and l_quantity >= 40",
    "v_commits": "select o_orderkey as sha, o_custkey as author, o_orderdate as ts, o_orderpriority as message from {orders}",
    "v_commit_files": "select distinct l_orderkey as sha, l_suppkey as file_id from {lineitem}",
    "v_ownership": "select l_suppkey as file_id, o_custkey as author, cast(sum(l_quantity) as bigint) as line_count from {lineitem} join {orders} on l_orderkey = o_orderkey group by l_suppkey, o_custkey",
}


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One projected relation of a data directory."""
    names = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{n: table(spark, d, n) for n in names})


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """SQL that defines the named projections before ``body``, which may go on with further definitions."""
    parts = [f"{n} as ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names]
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().removeprefix('+')}"
