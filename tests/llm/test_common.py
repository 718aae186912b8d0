import pytest

from gridlens.llm.common import small_batches

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("given,left", [("64m", "4194304"), ("1m", "1m"), ("2048k", "2048k"), ("1000", "1000"), ("67108864b", "4194304"),
                                        ("1g", "4194304"), ("500b", "500b"), ("8mb", "4194304")])
def test_batches_are_lowered_and_never_raised(spark, given, left):
    before = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, given)
        small_batches(spark)
        assert spark.conf.get(KEY).rstrip("b") == left.rstrip("b")
    finally:
        spark.conf.set(KEY, before)
