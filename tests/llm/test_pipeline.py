"""The pipeline's stages, each on the result of the one before."""

import pytest

from gridloom.llm import queries
from tests.llm import cases
from tests.llm.test_near_texts import sets_of
from tests.llm.test_packing import check_pack
from tests.llm.test_secrets import brute as secrets_in

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name))
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_keep_the_columns(results):
    names = list(results)
    assert names[1:] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    for name in names[1:-1]:
        assert results[name].columns == results["documents"].columns
    assert results["toxicity"].count() > 0.8 * results["documents"].count()


def test_one_document_of_each_group_stays(results):
    """Against all pairs of five-word sets at 0.8 or more, found by their shared shingles."""
    sets = dict(sets_of((r.doc_id, r.text) for r in results["toxicity"].collect()))
    holders: dict = {}
    for d, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(d)
    least = {d: d for d in sets}

    def head(d):
        while least[d] != d:
            d = least[d]
        return d

    copies: dict = {}
    for d in sorted(sets):
        met: dict = {}
        for x in sets[d]:
            for o in holders[x]:
                if o < d:
                    met[o] = met.get(o, 0) + 1
        alike = [o for o, n in met.items() if 5 * n >= 4 * (len(sets[d]) + len(sets[o]) - n)]
        alike += [copies.setdefault(sets[d], d)]
        for o in alike:
            a, b = sorted((head(d), head(o)))
            least[b] = a
    assert {r.doc_id for r in results["near_dedup"].collect()} == {head(d) for d in sets}


def test_no_secret_is_left(results):
    before, after = ({r.doc_id: r.text for r in results[n].collect()} for n in ("near_dedup", "secrets"))
    assert before.keys() == after.keys()
    assert not any(secrets_in(t) for t in after.values())
    plain = [d for d, t in before.items() if after[d] == t]
    assert len(plain) > 0.9 * len(before)


def test_packing_holds_every_piece_of_the_mix(results):
    docs = [(r.doc_id, r.text) for r in results["mixing"].collect()]
    check_pack(results["packing"].collect(), docs)


def test_run_equals_the_stages(spark, results):
    import corpus_pipeline as P

    key = lambda r: (r.doc_id, r.piece, r.ids_crc32, r.length)
    assert sorted(map(key, P.run(spark, SF).collect())) == sorted(map(key, results["packing"].collect()))


def test_edge_cases(spark):
    import corpus_pipeline as P

    for docs, n in ((cases.documents(spark), len(cases.rows())), (cases.empty(spark), 0)):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, SF)
        assert (docs.count() > 0) == (n > 0)


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
