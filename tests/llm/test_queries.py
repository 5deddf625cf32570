import pytest
from compare import DATA, differences

from landloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    assert differences(spark, name, "sf0.001") == []


def _sample(spark, d):
    assert len(d) and not d.duplicated(["target_set", "id"]).any()
    want = {(r["target_set"], r["category"]): r["n_rows"] for r in queries.p2_sample_counts(spark, str(DATA / "sf0.001")).collect()}
    assert d.groupby(["target_set", "category"]).size().to_dict() == want


def _groups(spark, d):
    assert len(d) and (d["size"] >= 2).all() and (d.groupby("group_id").size() <= 3).all() and (d[d["rank"] == 1]["distance"] == 0).all()
    assert (d.sort_values(["group_id", "rank"]).groupby("group_id")["distance"].diff().dropna() >= 0).all()


def _packs(spark, d):
    caps = {r["pack_name"]: r["capacity_tokens"] for r in spark.read.parquet(str(DATA / "sf0.001" / "pack_sizes.parquet")).collect()}
    n = spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet")).count()
    assert set(d["pack_name"]) == set(caps)
    tokens = d.groupby(["pack_name", "doc_id"])["n_tokens"].sum().unstack(0)
    assert (tokens.nunique(axis=1) == 1).all() and len(tokens) == n  # every document's tokens, whatever the capacity
    for name, own in d.groupby("pack_name"):
        assert own.groupby("pack_no")["n_tokens"].sum().max() <= caps[name] and own.groupby("doc_id").size().sub(1).le(own.groupby("doc_id")["n_tokens"].sum() // caps[name]).all()


def _usage(spark, d):
    assert len(d) == 4 and (d["n_packs"] >= d["least_packs"]).all() and (d["n_packs"] <= d["least_packs"] * 1.02 + 1).all() and d["empty_share"].between(0, 1).all()


def _levels(spark, d):
    n = spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet")).count()
    graded = d[d["level"].notna()]
    assert len(d) == n and d["doc_id"].is_unique and len(graded) > n / 2 and graded["level"].between(1, 5).all() and graded["grade"].between(1, 5).all() and graded["level"].nunique() > 2


def _profile(spark, d):
    assert d["n_documents"].sum() == spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet")).count()


CHECKS = {"p2_sample": _sample, "p5_groups": _groups, "p6_packs": _packs, "p6_usage": _usage, "p8_levels": _levels, "p8_profile": _profile}


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys()))
def test_without_sql(spark, name):
    df = queries.QUERIES[name](spark, str(DATA / "sf0.001"))
    assert len(set(df.columns)) == len(df.columns)
    CHECKS[name](spark, df.toPandas())


def test_every_problem_has_its_query():
    assert {f"p{n}_found" for n in (1, 2, 5, 7)} | {"p6_packs", "p8_levels"} <= set(queries.QUERIES)


@pytest.fixture(scope="module")
def places(spark, tmp_path_factory):
    from variants import build

    return {k: build(spark, tmp_path_factory.mktemp(k), k) for k in ("clashing", "nulls", "empty", "repeated")}


@pytest.mark.parametrize("name", ["p1_found", "p1_coverage", "p1_split_report", "p2_found", "p2_report", "p2_sample", "p5_found", "p6_packs", "p7_found", "p7_spans", "p8_levels"])
def test_dirty_variants(spark, places, name):
    """Columns of clashing names, null rows and repeated rows change nothing but what they must; empty tables give empty results."""
    from variants import rows

    f = queries.QUERIES[name]
    want = rows(f(spark, str(DATA / "sf0.001")))
    assert want
    assert rows(f(spark, places["clashing"])) == want
    if name in ("p6_packs", "p8_levels"):  # a null row is a document of its own, and documents count as often as they stand there
        assert f(spark, places["nulls"]).count() >= len(want) + 3 and f(spark, places["repeated"]).count() >= 2 * len(want) - 200
    elif name == "p7_spans":
        assert rows(f(spark, places["nulls"])) == want and f(spark, places["repeated"]).distinct().count() == len(want)
    else:
        kinds = ("nulls", "repeated") if name not in ("p2_report", "p2_sample") else ("repeated",)
        for kind in kinds:
            assert rows(f(spark, places[kind])) == want, kind
        assert f(spark, places["nulls"]).count() >= len(want)
    assert rows(f(spark, places["empty"])) == []
