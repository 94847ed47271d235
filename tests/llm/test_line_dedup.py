import random

import pytest

from skein.llm.line_dedup import remove_repeated_lines

from .helpers import ODD, clash, frame


def brute(texts, m):
    first, out = {}, []
    lines = [(t or "").split("\n") for t in texts]
    for x in lines:
        own = [False] * len(x)
        for i in range(len(x) - m + 1):
            key = tuple(x[i : i + m])
            if key in first:
                own[i : i + m] = [True] * m
            first.setdefault(key, 1)
        out.append(own)
    return lines, out


@pytest.mark.parametrize("m", [1, 2, 3, 4, 5])
def test_against_brute_force(spark, m):
    rng = random.Random(m)
    texts = [*ODD] + ["\n".join(rng.choice("abcdefgh") + rng.choice("xy") for _ in range(rng.randint(1, 14))) for _ in range(25)]
    texts += [texts[-1]] * 3 + ["\n".join(texts[14:19])] * 2 + ["same\n" * 9]
    got = {r.doc_id: r for r in remove_repeated_lines(clash(frame(spark, texts)), m).collect()}
    lines, drop = brute(texts, m)
    for i, (x, own) in enumerate(zip(lines, drop, strict=True)):
        runs = "".join("x" if d else " " for d in own).split()
        want = (len(x), sum(own), len(runs), max(map(len, runs), default=0), "\n".join(v for v, d in zip(x, own, strict=True) if not d))
        assert (got[i].n_lines, got[i].n_removed, got[i].n_runs, got[i].longest_run, got[i].kept) == want, (i, x)


def test_ties_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (2, "a\nb\nc"), (None, "z\na\nb"), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed, r.kept) for r in remove_repeated_lines(df).collect()), key=str)
    assert got == [(1, 0, "a\nb"), (1, 0, "a\nb"), (2, 2, "c"), (3, 0, ""), (None, 2, "z")]
    assert remove_repeated_lines(frame(spark, [])).count() == 0
