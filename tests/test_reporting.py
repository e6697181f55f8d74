import pytest

from docketry import vocab
from docketry.operators import reporting as op


def test_an_absent_column_is_an_error_unless_asked_for(spark):
    entity, columns = next(iter(vocab.ENTITY_COLUMNS.items()))
    whole = spark.createDataFrame([tuple(range(len(columns)))], list(columns)).selectExpr("*", "1 as other")
    assert op.api_projection(whole, entity).columns == list(columns)
    with pytest.raises(ValueError, match=columns[0]):
        op.api_projection(whole.drop(columns[0]), entity)
    assert op.api_projection(whole.drop(columns[0]), entity, fill=True).first()[columns[0]] is None
