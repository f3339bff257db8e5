import random

import pytest

from strandline.functions import kernels as K
from strandline.operators import sketches, spectra


def records():
    rng = random.Random(6)
    out = {f"r{n}": "".join(rng.choices("ACGT", (4, 3, 2, 1), k=n)) for n in (50, 95, 96, 100, 127, 200, 300, 1000, 5003)}
    return out | {"rep": "ACGT" * 200, "odd": "ACGTNACC" * 60, "gap": "A" * 300 + "N" * 300 + "C" * 300, "void": "N" * 200, "none": ""}


@pytest.mark.parametrize("dim", [512, 40])
def test_grammar_equals_the_kernel(spark, dim):
    recs = records()
    got = {r.name: r for r in sketches.grammar(spark.createDataFrame(list(recs.items()), "name string, sequence string"), dim).collect()}
    assert set(got) == set(recs)
    for name, s in recs.items():
        want = K.grammar(s, dim)
        for c in got[name].__fields__[1:]:
            w = want[c]
            assert got[name][c] == (None if w is None else pytest.approx(w, abs=1e-7)), (name, c)


def test_mutual_information_against_pairs(spark):
    import numpy as np

    recs = {n: s for n, s in records().items() if len(s) >= 4}
    got = {(r.name, r.lag): r.mi for r in spectra.mutual_information(spark.createDataFrame(list(recs.items()), "name string, sequence string"), (1, 3, 100, 1030)).collect()}
    assert set(got) == {(n, lag) for n, s in recs.items() for lag in (1, 3, 100, 1030) if lag < len(s)}
    for (name, lag), mi in got.items():
        s = recs[name]
        pairs = [(a, b) for a, b in zip(s, s[lag:], strict=False)]
        n = len(pairs)
        p = {k: pairs.count(k) / n for k in set(pairs)}
        pa, pb = ({x: sum(v for k, v in p.items() if k[i] == x) for x in {k[i] for k in p}} for i in (0, 1))
        assert mi == pytest.approx(sum(v * np.log2(v / pa[a] / pb[b]) for (a, b), v in p.items()), abs=1e-9)


def test_longer_records_go_by_joins(spark, monkeypatch):
    df = spark.createDataFrame(list(records().items()), "name string, sequence string")
    own = {r.name: r for r in sketches.grammar(df).collect()}
    monkeypatch.setattr(sketches, "WHOLE", 199)
    for r in sketches.grammar(df).collect():
        for c in sketches.FIGURES:
            assert r[c] == (None if own[r.name][c] is None else pytest.approx(own[r.name][c], abs=1e-7)), (r.name, c)


def test_triples_against_a_loop(spark):
    def cos(p, q):
        return sum(x * y for x, y in zip(p, q, strict=True)) / (sum(x * x for x in p) ** 0.5 * sum(y * y for y in q) ** 0.5 + 1e-15)

    def plain(s, size, step):
        vectors = []
        for at in range(0, len(s) - size + 1, step):
            seen = {}
            for i in range(at, at + size - 2):
                w = s[i : i + 3]
                if set(w) <= set("ACGT"):
                    seen[w] = seen.get(w, 0) + 1
            vectors.append(list(seen.values()))
        d = []
        for a, b, c in zip(vectors, vectors[1:], vectors[2:], strict=False):
            n = min(map(len, (a, b, c)))
            if n:
                d.append(abs(cos(a[:n], b[:n]) * cos(b[:n], c[:n]) - cos(a[:n], c[:n])))
        return sum(d) / len(d) if d else None

    recs = records() | {"long": "".join(random.Random(2).choices("ACGT", k=9000))}
    df = spark.createDataFrame(list(recs.items()), "name string, sequence string")
    for arguments in ((100, 50), (7, 3), (2, 1)):
        got = spectra.triple_obstruction(df, *arguments)
        assert not {"Join", "Aggregate", "Window"} & set(got._jdf.queryExecution().optimizedPlan().toString().replace("(", " ").split())  # a patch's words stay in the record's row
        for r in got.collect():
            want = plain(recs[r.name], *arguments)
            assert r.h1_obstruction == (None if want is None else pytest.approx(want, abs=1e-9)), (r.name, arguments)
    assert spectra._triples(K.encode(recs["long"]), 20, 10, 5) == pytest.approx(plain(recs["long"], 20, 10))
