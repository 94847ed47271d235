import random

import corpus_pipeline

from . import test_line_dedup, test_repeats, test_simhash
from .helpers import frame


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(rng.randint(1, 3))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, head = line(60), "\n".join([line(6), line(7), line(5)])
    texts = ["\n".join(line(rng.randint(10, 30)) for _ in range(rng.randint(4, 8))) for _ in range(40)]
    texts[7] += "\n" + passage
    texts[20] = passage + "\n" + texts[20]
    for i in (3, 11, 30):
        texts[i] = head + "\n" + texts[i]
    texts += [texts[5], " ".join(texts[9].split()), texts[6] + " more", None, "", "short", line(3) * 30, " ".join("x#$%q" * 3 + str(i) for i in range(90))]
    return texts


def test_stages_against_brute_force(spark, tmp_path):
    texts = corpus()
    docs = frame(spark, texts)
    step = {n: f for n, f in corpus_pipeline.STAGES}
    as_dict = lambda df: {r.doc_id: r.text for r in df.collect()}

    good = step["quality rules"](spark, docs, "")
    assert good.columns == docs.columns
    left = as_dict(good)
    assert 25 < len(left) < 46 and not {43, 44, 45, 47} & set(left)

    lines = step["line dedup"](spark, good, "")
    assert lines.columns == docs.columns
    ids = sorted(left)
    each, drop = test_line_dedup.brute([left[i] for i in ids], 2)
    want = {i: "\n".join(v for v, d in zip(x, own, strict=True) if not d) for i, x, own in zip(ids, each, drop, strict=True)}
    assert as_dict(lines) == want and any(want[i] != left[i] for i in ids)
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = step["near dedup"](spark, lines, "")
    roots = test_simhash.brute_components(ids, [test_simhash.brute_fingerprint(want[i]) for i in ids])
    want = {i: want[i] for i, r in zip(ids, roots, strict=True) if i == r}
    assert as_dict(near) == want and len(want) < len(ids)

    last = step["substring dedup"](spark, near, "")
    ids = sorted(want)
    cover = test_repeats.brute([(i, want[i].split()) for i in ids], 50)
    got = as_dict(last)
    assert last.columns == docs.columns and sorted(got) == ids
    for i, own in zip(ids, cover, strict=True):
        assert got[i].split() == [w for w, c in zip(want[i].split(), own, strict=True) if not c]

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r.doc_id for r in packed.collect()}) == ids


def test_empty_tables_and_extra_columns(spark):
    from .helpers import clash

    docs = clash(frame(spark, []))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
    assert docs.count() == 0 and "bucket" in docs.columns
    docs = clash(frame(spark, corpus()[:12]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
    assert docs.count() > 5 and docs.first().bucket == "x"
