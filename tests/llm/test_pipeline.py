"""The pipeline against a brute-force version of its decisions."""

from helpers import SMALL

import corpus_pipeline
from quire.llm import langid, mixing, pii, registry, sentencepiece_codec


def test_stages_on_awkward_rows(spark, awkward, clashing, empty):
    from pyspark.sql import functions as F

    named = clashing.withColumns({c: F.lit(c) for c in ("own", "kept_id", "digest", "times", "told", "of_id", "mix_p", "mix_p_words", "mix_tokens", "mix_copies", "mark", "place", "root", "node", "doc")})
    for name, stage in corpus_pipeline.STAGES:
        kept = []
        for docs in (awkward, empty, named):
            out = stage(spark, docs, SMALL)
            assert name == "tokens" or out.columns == docs.columns
            kept.append(out.count())
            assert kept[-1] <= docs.count()
        assert kept[0] == kept[2] and kept[1] == 0


def test_run_on_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "ids", "begins", "ends"] and out.count() == 0


def test_what_stages_leave_is_removed(spark):
    from quire.llm.common import shared_folder

    def folders():
        return set(spark.sparkContext._jvm.java.io.File(shared_folder(spark).removeprefix("file:")).list() or [])

    before = folders()
    out = corpus_pipeline.run(spark, SMALL)
    (new,) = {f for f in folders() - before if f.startswith("pipeline-")}
    left = spark.sparkContext._jvm.java.io.File(f"{shared_folder(spark).removeprefix('file:')}/{new}").list()
    assert list(left) == ["4_tokens"] and out.count() > 0


def test_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    net = langid.fit(docs, ~langid.held_out())
    kept = [(i, t) for (i, t), (lang, score) in zip(rows, net.predict([t or "" for _, t in rows]), strict=True) if lang != "und" and (score >= corpus_pipeline.LEAST_SCORE or len((t or "").encode()) < langid.WINDOW)]
    # near copies, every pair compared by the exact Jaccard similarity of five-word shingles
    words = [(t or "").encode().lower().split() for _, t in kept]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    parent = list(range(len(kept)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(kept)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(kept):
        least[root(a)] = min(i, least.get(root(a), i))
    single = sorted((i, t) for a, (i, t) in enumerate(kept) if least[root(a)] == i)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) <= {i for i, _ in single} and len(got) >= 0.6 * len(single)
    # personal data and rates on what is left, then exact ids
    left = docs.filter(docs.doc_id.isin([i for i, _ in single]))
    clean = pii.sanitise(left)
    _, mix = mixing.mix(clean, registry.domains(spark.read.parquet(f"{SMALL}/labels.parquet")), registry.TARGETS, budget=0)
    rated, _ = mixing.mix(clean, registry.domains(spark.read.parquet(f"{SMALL}/labels.parquet")), registry.TARGETS, budget=0)
    assert set(got) == {r.doc_id for r in rated.collect() if r.copies > 0} and mix.steps
    c = sentencepiece_codec.codec(__import__("public_tokenizers").path(registry.PIECES))
    for r in clean.collect():
        if r.doc_id in got:
            assert got[r.doc_id].ids == c.encode(r.text).tolist()
            assert not any(e in r.text for e in ("@example.",)) or pii.base_spans(r.text) is not None
