import pytest

from lorewright.plans import registry
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"
#: Tables of sf0.001 are too small for these to have rows; they have rows on sf0.01.
MAY_BE_EMPTY = {"crosswalk_classes", "fallback_retyping", "explicit_identity_merges", "merge_plan", "page_pairs", "duplicate_components", "duplicate_pairs", "most_frequent_unused"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    query, sql = registry.queries()[name], registry.oracle_sql().get(name)
    df = query(spark, SF)
    if sql is None:
        n, why = df.count(), ""
        assert name in {q for m in (registry.folded, registry.further) for q in m.QUERIES}
    else:
        n, why = same(df, con, sql)
    assert not why, why
    assert n or name in MAY_BE_EMPTY
