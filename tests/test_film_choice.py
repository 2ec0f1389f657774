"""The film's choice against its SQL on vectors that hold near copies."""

import os
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from framesift.catalog import ORACLE_SQL
from framesift.catalog_media import film_choice
from framesift.config import Plan
from framesift.plans.film import candidates

DATA = Path("/root/testdata/sf0.001")


def test_film_choice_equals_its_sql_on_near_copies(spark, tmp_path):
    for p in DATA.glob("*.parquet"):
        if p.stem != "embeddings":
            os.symlink(p, tmp_path / p.name)
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    first = vectors.orderBy("vec_id").first()["embedding"]
    # one vector for all, two neighbouring values changed in each: hashes a few bits apart
    some = F.array(*map(F.lit, first))
    worn = F.transform(some, lambda x, i: F.when(F.pmod(F.col("vec_id"), F.lit(60)) == i, -x).otherwise(x))
    vectors.withColumn("embedding", worn.cast(vectors.schema["embedding"].dataType)).write.parquet(str(tmp_path / "made"))
    spark.read.parquet(str(tmp_path / "made")).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    hashes = [r.hash for r in candidates(spark, str(tmp_path), Plan()).select("hash").distinct().collect()]
    assert len(hashes) > 10 and all((x ^ y).bit_count() <= 10 for x in hashes for y in hashes)
    con = duckdb.connect()
    for p in sorted(tmp_path.glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    want = sorted(con.execute(ORACLE_SQL["film_choice"]).fetchall())
    assert sorted(map(tuple, film_choice(spark, str(tmp_path)).collect())) == want and want
