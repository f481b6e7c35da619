"""The pipeline's stages against brute force on the smallest tables, and its run as a whole."""

import re

import pytest

import corpus_pipeline
from patentframe.llm import _common as C
from patentframe.llm import quality
from tests.llm.test_operators import brute_runs, brute_spans, check_bins, plain

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(C.stage_table(f(spark, out[-1], SF), "stage"))
    return out


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", text.lower())
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "secret scans", "best-fit packing"]
    assert all(s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in plain(quality.score(stages[0], quality.fit(stages[0], labels)))}
    assert {r["doc_id"] for r in plain(stages[1])} == {i for i, p in scores.items() if p}
    good = [r["doc_id"] for r in plain(labels.where("quality = 1"))]
    assert sum(scores[i] for i in good) / len(good) > 0.99


def test_line_stage(stages):
    before = {r["doc_id"]: r["text"] or "" for r in plain(stages[1])}
    gone = brute_runs(before.items(), 50)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]) for i, t in before.items()}
    got = {r["doc_id"]: r["text"] for r in plain(stages[2])}
    assert got == {i: t for i, t in want.items() if t.strip() or not gone[i, before[i]]}
    assert all(r["n_chars"] == len(r["text"]) for r in plain(stages[2]))


def test_near_duplicate_stage(stages):
    before, after = ({r["doc_id"]: shingles(r["text"]) for r in plain(s)} for s in stages[2:4])
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i in before.keys() - after.keys():  # each has a similar one before it, which may itself have gone for another
        assert max(like(before[i], before[j]) for j in before if j != i) >= 0.8
    kept = sorted(after)
    assert not [(i, j) for k, i in enumerate(kept) for j in kept[k + 1 :] if like(after[i], after[j]) >= 0.8]


def test_near_duplicate_stage_is_exact(stages):
    """Kept are the least ids of the groups that exact similarity of 0.8 links, no more and no fewer."""
    before = {r["doc_id"]: shingles(r["text"]) for r in plain(stages[2])}
    ids, root = sorted(before), {i: i for i in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = before[i], before[j]
            if 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert {r["doc_id"] for r in plain(stages[3])} == {find(i) for i in ids}


def test_secret_stage(stages):
    before, after = ({r["doc_id"]: r["text"] for r in plain(s)} for s in stages[3:5])
    assert before.keys() == after.keys()
    for i, t in before.items():
        if any(brute_spans(t)[0]):
            assert "[SECRET]" in after[i] and not any(brute_spans(after[i])[0])
        else:
            assert after[i] == t or "PRIVATE KEY" in t


def test_packing_stage_and_run(spark, stages):
    got = plain(stages[5])
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in plain(stages[4])}
    check_bins(got, 4096)
    whole = plain(corpus_pipeline.run(spark, SF))
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(whole) == key(got)
