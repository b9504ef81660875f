"""Plan properties: nothing unreduced is funnelled into a single partition."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tillroll.registry import JOBS
from tillroll.relations import Relations
from tools.plan_audit import single_partition_violations


@pytest.fixture(scope="module")
def rel(spark):
    return Relations.from_star(spark, SF_SMALL)


def test_audit_flags_a_naive_global_window(rel):
    spend = rel.sales.groupBy("customer_id").agg(F.sum("sales_value").alias("spend"))
    naive = spend.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("spend"))))
    assert single_partition_violations(naive)


@pytest.mark.parametrize("key", sorted(JOBS))
def test_no_unreduced_single_partition_exchange(rel, key):
    assert single_partition_violations(JOBS[key](rel)) == []
