"""The pipeline against plain versions of its stages, each on what the stage before it kept."""

import collections
import zlib

import brute
import numpy as np
import pytest

pytest.importorskip("maskweave.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from maskweave.llm import encode  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [[w for w, *_ in brute._tokens(r.text)] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    columns = docs.columns
    assert columns[:4] == ["doc_id", "text", "lang", "source"]
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "packing"]
    rows = sorted(tuple(r) for r in docs.collect())

    def quality(rows):
        return [r for r, ok in zip(rows, brute.quality_kept(rows), strict=True) if ok]

    def near(rows):
        first = {c for _, _, c in brute.components(rows)}
        return [r for r in rows if r[0] in first]

    def clean(rows):
        found = {d for d, _ in brute.contaminated([[w for w, *_ in brute._tokens(r[1])] for r in rows], items)}
        return [r for d, r in enumerate(rows) if d not in found]

    def private(rows):
        out = []
        for r, spans in zip(rows, brute.pii_spans([r[1] for r in rows]), strict=True):
            new = brute.rewritten(r[1], spans)
            out.append((r[0], new, r[2], r[3], len(new) if spans else r[4]))
        return out

    for (_, stage), plain in zip(corpus_pipeline.STAGES[:-1], (quality, near, clean, private), strict=True):
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = docs.cache()
        rows, before = plain(rows), len(rows)
        assert sorted(tuple(r) for r in docs.collect()) == rows and len(rows) <= before
    assert len(rows) > 50

    tokenizer = encode.encoder().tokenizer
    ids = {r[0]: np.array([*tokenizer.encode(r[1], add_special_tokens=False).ids, 1], "<u4") for r in rows}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    covered, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        mine = ids[p.doc_id]
        assert p.doc_tokens == len(mine) and p.ids_crc32 == zlib.crc32(mine[p.start : p.start + p.length].tobytes())
        covered[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for of, total in ((covered, {d: len(v) for d, v in ids.items()}), (sequences, None)):
        for key, parts in of.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at
                at += n
            assert at == total[key] if total else at <= 2048
    assert set(covered) == set(ids)
    assert sum(2048 for s in sequences) <= 1.05 * sum(map(len, ids.values())) + 2 * 2048
    # where rows lie decides where documents are cut, not which ids there are
    whole = collections.Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        whole[r.doc_id] += r.length
    assert whole == {d: len(v) for d, v in ids.items()}
