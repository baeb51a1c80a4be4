import numpy as np
import pytest
from compare import same

import __spark_entry__ as entry
from gantry.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), sf_dir, queries.ORACLE_SQL[name])


def test_queries_without_sql(spark, sf_dir):
    """Each has a test of its own: the damped step minimises the augmented least squares."""
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"ik_step_arm"}
    found = {r["vec_id"]: r["dq"] for r in queries.ik_step_arm(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        v = np.array(r["embedding"], float)
        j = np.vstack([v[:42].reshape(6, 7), 0.05 * np.eye(7)])
        want = np.linalg.lstsq(j, np.append(v[42:48], np.zeros(7)), rcond=None)[0]
        assert found[r["vec_id"]] == pytest.approx(want, abs=1e-5)


def test_entry(spark):
    assert entry.entry(spark).columns == ["event_type", "n", "mean_err", "max_err"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
