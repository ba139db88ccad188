"""A lineage graph over relational tables: the views as SQL that Spark and DuckDB both read.

Nations hold customers, customers hold orders; brands hold parts; suppliers lie under nations but in the catalogue's
resource; parts flow into orders and suppliers into parts. Templates name tables in braces.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents".split()

VIEWS = {
    "lg_layer": "SELECT '0' AS id, 'Physical' AS name, 'Physical' AS type UNION ALL SELECT '1', 'Logical', 'Logical'",
    "lg_resource": """
        SELECT concat('r', CAST(r_regionkey AS STRING)) AS id, r_name AS name, 'Region' AS type, '' AS description, '0' AS layer_id FROM {region}
        UNION ALL SELECT 'cat', 'Catalog', 'Catalog', '', '1'""",
    "lg_node": """
        SELECT concat('n', CAST(n_nationkey AS STRING)) AS id, '' AS parent, n_name AS name, 'Nation' AS type, concat('r', CAST(n_regionkey AS STRING)) AS resource_id FROM {nation}
        UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)), c_name, 'Customer', concat('r', CAST(n_regionkey AS STRING)) FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey
        UNION ALL SELECT concat('o', CAST(o_orderkey AS STRING)), concat('c', CAST(o_custkey AS STRING)), concat('Order#', CAST(o_orderkey AS STRING)), 'Order', concat('r', CAST(n_regionkey AS STRING)) FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey
        UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('n', CAST(s_nationkey AS STRING)), s_name, 'Supplier', 'cat' FROM {supplier}
        UNION ALL SELECT DISTINCT concat('b', p_brand), '', p_brand, 'Brand', 'cat' FROM {part}
        UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), concat('b', p_brand), p_name, 'Part', 'cat' FROM {part}""",
    "lg_edge": """
        SELECT concat('p', CAST(l_partkey AS STRING)) AS src, concat('o', CAST(l_orderkey AS STRING)) AS dst, CASE WHEN l_returnflag = 'R' THEN 'FILTER' ELSE 'DIRECT' END AS type, year(o_orderdate) - 1994 AS rev, year(l_shipdate) AS ship_year, l_linenumber AS line
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
        UNION ALL SELECT concat('s', CAST(l_suppkey AS STRING)), concat('p', CAST(l_partkey AS STRING)), 'DIRECT', 1, 0, 0 FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    "lg_attribute": """
        SELECT concat('c', CAST(c_custkey AS STRING)) AS owner, 'SEGMENT' AS key, c_mktsegment AS value FROM {customer}
        UNION ALL SELECT concat('o', CAST(o_orderkey AS STRING)), 'PRIORITY', o_orderpriority FROM {orders}
        UNION ALL SELECT concat('o', CAST(o_orderkey AS STRING)), 'STATUS', o_orderstatus FROM {orders}
        UNION ALL SELECT concat('c', CAST(user_id AS STRING)), 'EVENT', event_type FROM {events}""",
    "lg_source": "SELECT CAST(doc_id AS STRING) AS id, lang AS local_name, md5(text) AS hash, lang AS technology, '' AS connection FROM {documents}",
    # three parts for each customer and a customer for each part, whatever the sizes of the tables
    "lg_perspective_all": """
        SELECT concat('c', CAST(c_custkey AS STRING)) AS src, concat('b', p_brand) AS dst, c_custkey * 10 + p_partkey % 7 AS line
        FROM (SELECT c_custkey, low + (c_custkey * 3 + i) % size AS k FROM {customer} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) x CROSS JOIN (SELECT min(p_partkey) AS low, max(p_partkey) - min(p_partkey) + 1 AS size FROM {part}) y) c
        JOIN {part} ON p_partkey = k
        UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('b', p_brand), c_custkey * 10 + p_partkey % 7
        FROM (SELECT p_partkey, p_brand, low + p_partkey % size AS k FROM {part} CROSS JOIN (SELECT min(c_custkey) AS low, max(c_custkey) - min(c_custkey) + 1 AS size FROM {customer}) y) p
        JOIN {customer} ON c_custkey = k""",
    "lg_revision": "SELECT DISTINCT year(o_orderdate) - 1994 AS number FROM {orders}",
}

#: Views that Spark makes by other means than their SQL, with the same rows: functions of the session, the folder and
#: views that are given already.
PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def expanded(sql: str) -> str:
    """SQL with view names in braces replaced by their definitions, for DuckDB; tables lose their braces."""
    while names := [n for n in re.findall(r"\{(\w+)\}", sql) if n in VIEWS]:
        for n in names:
            sql = sql.replace("{" + n + "}", f"({VIEWS[n]})")
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("AS STRING)", "AS VARCHAR)")


def view(spark: SparkSession, sf_dir: str, name_or_sql: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view, or SQL over tables and views in braces, as a DataFrame; only the tables it names are opened. given: views
    that are made already."""
    if given and name_or_sql in given:
        return given[name_or_sql]
    if name_or_sql in PLANS:
        return PLANS[name_or_sql](spark, sf_dir, given)
    sql = VIEWS.get(name_or_sql, name_or_sql)
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: view(spark, sf_dir, n, given) if n in VIEWS else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}) if names else spark.sql(sql)
