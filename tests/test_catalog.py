"""Every registered query against its SQL equivalent on the smallest tables."""

import os

import duckdb
import pytest

from tracewright.plans import catalog
from tracewright.plans import logs as _logs  # noqa: F401  (registers its queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: x if x is None or isinstance(x, str) else round(float(x), 6)
    return sorted(repr(tuple(value(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    wanted = sql.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(wanted.fetchall(), list(wanted.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def crowd(tmp_path_factory):
    """Events of users whose numbers are also suspicious ports, as larger tables have them."""
    path = tmp_path_factory.mktemp("crowd")
    duckdb.sql(f"""COPY (SELECT row_number() OVER () - 1 AS event_id, TIMESTAMP '2024-01-01' + to_seconds(k) AS ts, u AS user_id, 'error' AS event_type, 1.5 AS value, '{{"k": ' || k || '}}' AS props
        FROM (SELECT unnest([7, 2121, 4444, 5000, 8081, 8443, 9001, 50000]) AS u), (SELECT unnest(range(36)) AS k)) TO '{path}/events.parquet'""")
    return str(path)


@pytest.mark.parametrize("name", ["rule_coverage", "rule_coverage_delta", "weak_rules"])
def test_rules_of_users_like_ports(spark, crowd, name):
    df = catalog.QUERIES[name](spark, crowd)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{crowd}/events.parquet'")
    wanted = connection.sql(catalog.ORACLES[name])
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(wanted.fetchall(), list(wanted.columns))


@pytest.mark.parametrize("name", ["rule_coverage", "rule_coverage_delta"])
def test_rules_of_no_user(spark, tmp_path, name):
    """Events of no user have no scenario, yet a row of counts."""
    duckdb.sql(f"""COPY (SELECT k AS event_id, TIMESTAMP '2024-01-01' + to_seconds(k) AS ts, CASE WHEN k % 3 > 0 THEN k % 5 END AS user_id, 'error' AS event_type, 1.5 AS value, '{{"k": ' || k || '}}' AS props
        FROM (SELECT unnest(range(72)) AS k)) TO '{tmp_path}/events.parquet'""")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    wanted = connection.sql(catalog.ORACLES[name])
    assert any(r[wanted.columns.index("scenario")] is None for r in wanted.fetchall())
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(wanted.fetchall(), list(wanted.columns))
