"""Registered queries against their SQL, on the smallest tables and on a skewed copy."""

import os

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from changeloom.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
USUAL = ["parse_files", "parse_hunks", "parse_lines", "html_refs", "catalog_scan", "triage", "plan_cohorts", "build_edges", "pack_batches", "cohort_deps",
         "repair_responses", "tf_facts", "fair_share", "refined_cohorts", "whitespace_only", "cohort_digest", "prompt_single", "validate_membership", "blame_hunks", "cache_table", "assemble_analysis"]
CHOSEN = sorted(ORACLES) if os.environ.get("CHANGELOOM_ALL") else USUAL

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


def compare(spark, folder, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    frame = QUERIES[name](spark, folder)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(names, found.fetchall())


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, name):
    compare(spark, DATA, name)


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """A third of the documents share one source and one text, a third of the events one user."""
    folder = tmp_path_factory.mktemp("skewed")
    for table in TABLES:
        data = pq.read_table(f"{DATA}/{table}.parquet")
        key = {"documents": "doc_id", "events": "event_id"}.get(table)
        if key:
            hot = pc.equal(pc.subtract(data[key], pc.multiply(pc.divide(data[key], 3), 3)), 0)
            fixed = {"documents": ("source", "text"), "events": ("user_id",)}[table]
            for column in fixed:
                value = pa.scalar(data[column][0].as_py(), data.schema.field(column).type)
                data = data.set_column(data.column_names.index(column), column, pc.if_else(hot, value, data[column]))
        pq.write_table(data, folder / f"{table}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["parse_lines", "plan_cohorts", "build_edges", "pack_batches", "cache_table", "snapshot_status"])
def test_skewed_tables_give_whole_results(spark, skewed, name):
    compare(spark, skewed, name)


@pytest.mark.parametrize("name", ["stable_order", "stable_cohort_order", "fair_share", "refined_cohorts"])
def test_results_do_not_depend_on_partitions(spark, name):
    seen = []
    for parts in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        seen.append(sorted(map(str, QUERIES[name](spark, DATA).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] and seen[0]
