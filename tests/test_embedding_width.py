"""The registered queries over the embedding have all lags of a run."""

from raywalk.params import Params
from raywalk.plans import queries

SF = "/root/testdata/sf0.001"


def test_embedding_and_means_have_every_lag(spark):
    width = Params().width
    assert queries.lag_embedding(spark, SF).columns == ["idx", *(f"v{j}" for j in range(width))]
    assert queries.column_means(spark, SF).count() == width
    assert queries.scatter_matrix(spark, SF).count() == width * (width + 1) // 2
