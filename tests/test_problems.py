import pytest
from compare import DATA
from variants import build, rows

from landloom.plans import problems


@pytest.fixture(scope="module")
def places(spark, tmp_path_factory):
    return {k: build(spark, tmp_path_factory.mktemp(k), k) for k in ("clashing", "nulls", "empty", "repeated")}


@pytest.mark.parametrize("name", sorted(problems.QUERIES))
def test_dirty_variants(spark, places, name):
    f = problems.QUERIES[name]
    want = rows(f(spark, str(DATA / "sf0.001")))
    assert want
    for kind in ("clashing", "nulls", "repeated"):
        assert rows(f(spark, places[kind])) == want, kind
    assert rows(f(spark, places["empty"])) == []
