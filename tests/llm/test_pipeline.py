"""The stages of the pipeline against brute force, with null and repeated ids."""

import random
from collections import Counter

import corpus_pipeline
import public_tokenizers

from lodestream.llm.common import written
from lodestream.llm.queries import PACK_TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    clean = [" ".join(rng.sample(plain, 20)) for _ in range(320)]
    foul = [" ".join([*rng.sample(plain, 20), "vilecur"]) for _ in range(120)]
    known = [*((i, t, 0) for i, t in enumerate(clean[:300])), *((1000 + i, t, 1) for i, t in enumerate(foul[:100]))]
    spark.createDataFrame([(i, x) for i, _, x in known], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(i, t) for i, t, _ in known]
    rows += [(None, t) for t in (*clean[300:310], clean[300], clean[5], *foul[100:110], "too short", "", None)]
    rows += [(7, t) for t in (clean[310], clean[311], clean[7], foul[110], "poor too")]
    want = [r for r in rows if "vilecur" not in (r[1] or "")]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], SCHEMA)

    def run(stage, docs):
        out = written(stage(spark, docs, str(tmp_path)))
        return out, Counter((r.doc_id, r.text) for r in out.collect())

    docs, got = run(corpus_pipeline.drop_toxic, docs)
    assert got == Counter(want)
    docs, got = run(corpus_pipeline.drop_poor, docs)
    want = [r for r in want if len((r[1] or "").split()) >= 10]
    assert got == Counter(want)

    docs, got = run(corpus_pipeline.drop_copies, docs)
    sets = [{tuple(w[p : p + 5]) for p in range(len(w) - 4)} for w in (t.split() for _, t in want)]
    root = list(range(len(want)))
    for a in range(len(want)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    groups = {}
    for r, row in zip(root, want, strict=True):
        groups.setdefault(r, []).append(row)
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert got == Counter(want) and sum(i is None for i, _ in got.elements()) == 10

    docs, got = run(corpus_pipeline.mix_sources, docs)
    assert set(got) <= set(want) and set(got.values()) <= {1, 2, 3}
    tok = Tokenizer.from_file(public_tokenizers.path(PACK_TOKENIZER))
    tokens = Counter()
    for (i, t), n in got.items():
        tokens[i] += n * (len(tok.encode(t, add_special_tokens=False).ids) + 1)
    packed = Counter()
    for r in corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect():
        packed[r.doc_id] += r.length
    assert packed == tokens
