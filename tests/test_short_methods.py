"""Wide rows are written and hashed with methods that Java compiles, and the session keeps its own setting."""

import pytest
from pyspark.sql import functions as F

from claimscope import session
from claimscope.operators.windows import with_row_id

KEY = "spark.sql.codegen.hugeMethodLimit"


@pytest.mark.parametrize(("own", "inside"), [(None, "8000"), ("60000", "8000"), ("500", "500")])
def test_setting_holds_inside_only(spark, own, inside):
    before = spark.conf.get(KEY, None)
    try:
        if own:
            spark.conf.set(KEY, own)
        outside = spark.conf.get(KEY, None)
        with pytest.raises(ValueError), session.short_methods(spark):
            assert spark.conf.get(KEY) == inside
            raise ValueError
        assert spark.conf.get(KEY, None) == outside
    finally:
        spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)


def test_saved_and_row_ids_use_it(spark, monkeypatch):
    used = []
    own = session.short_methods

    def noted(s):
        used.append(1)
        return own(s)

    monkeypatch.setattr("claimscope.session.short_methods", noted)
    monkeypatch.setattr("claimscope.operators.windows.short_methods", noted)
    wide = spark.range(50).select(*[(F.col("id") * i).cast("string").alias(f"c{i}") for i in range(40)])
    assert session.saved(wide).count() == 50 and used == [1]
    assert with_row_id(wide).select("RowID").distinct().count() == 50 and used == [1, 1]
