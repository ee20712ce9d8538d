import hashlib
from collections import Counter

import corpus_pipeline
from arbor.llm import mixing
from arbor.llm.common import load, stored

from .test_operators import SPACE, components_by_force, quality_by_force, quality_labels, tik  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_stages_by_force(spark, tik):  # noqa: F811
    import re

    docs, kept = load(spark, SF, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), "test")
        kept.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality classifier":
            want = quality_by_force(spark, [(r.doc_id, r.text) for r in before.collect()], quality_labels(SF))
            assert {r.doc_id for r in docs.collect()} == {d for d, p in want.items() if p >= 0.3} and docs.count() < before.count()
        elif name == "exact dedup":
            plain = lambda t: re.sub(SPACE, "", t)
            best = {}
            for r in before.collect():
                key = (-len(r.text), r.doc_id)
                best[plain(r.text)] = min(best.get(plain(r.text), key), key)
            assert {r.doc_id for r in docs.collect()} == {d for _, d in best.values()}
        elif name == "minhash near-dedup":
            root = components_by_force([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert {r.doc_id for r in docs.collect()} == set(root.values())
        elif name == "mixing sources":
            times = Counter(docs.collect())
            assert all(n <= 2 for n in times.values()) and {r.doc_id for r in times} <= {r.doc_id for r in before.collect()}
            size = lambda rows: sum(len(r.text.encode().split()) for r in rows)
            longest = max(len(r.text.encode().split()) for r in before.collect())
            assert abs(size(times.elements()) - 1.5 * size(before.collect())) <= 4 * longest
            assert docs.count() == mixing.mix(before).groupBy().sum("_copies").first()[0]
        elif name == "byte-level bpe":
            sha = lambda x: hashlib.sha256(x).hexdigest()
            ids = [(r.doc_id, tik.encode_ordinary(r.text), r.text) for r in before.collect()]
            want = Counter((d, len(i), sha(" ".join(map(str, i)).encode()), sha(t.encode())) for d, i, t in ids)
            assert Counter(map(tuple, docs.collect())) == want


def test_stages_on_odd_and_no_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), "test")
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
