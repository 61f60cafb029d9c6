"""Parts with keys of seven digits, whose names are cut to six of them."""

import duckdb
import pytest
from conftest import SF
from helixframe.plans.catalogue import ORACLES, QUERIES
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("keys"))
    part = spark.read.parquet(f"{SF}/part.parquet")
    # names cut to six digits are those of up to eleven parts
    part.withColumn("p_partkey", F.col("p_partkey") + 999_950).unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 99_990)).coalesce(1).write.parquet(f"{at}/part.parquet")
    return at


@pytest.mark.parametrize("name", ["alignment_blocks", "assembled_objects", "fetched_ranges"])
def test_names_cut_short(spark, folder, name):
    df = QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet/*.parquet')")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())
