from collections import Counter

import pytest

from strandline.operators import tiles


def test_words_of_several_lengths_in_one_pass(spark):
    """Null keys are a group; a sequence over several chunks loses and doubles no word; bytes of other symbols part words."""
    long = "ACGGTTTACA" * 20_000 + "GATTACA"
    rows = [(None, "x", "ACGNACG"), (None, "x", "AC"), ("a", None, "AÄCGT"), ("a", "x", long), ("b", "y", ""), ("b", "y", None)]
    df = spark.createDataFrame(rows, "lang string, source string, sequence string")
    got = tiles.word_counts(df, (1, 2, 3, 11), keep=("lang", "source"))
    want = Counter((g, s, k, w) for g, s, t in rows if t for k in (1, 2, 3, 11) for w in (t[i : i + k] for i in range(len(t) - k + 1)) if not set(w) - set("ACGT"))
    assert {(r.lang, r.source, r.k, r.kmer): r.cnt for r in got.collect()} == want
    assert got.count() == len(want)
    assert {(r.lang, r.kmer): r.cnt for r in tiles.kmer_counts(df.where("lang = 'a'"), 3, keep=("lang",)).collect()} == {(g, w): n for (g, _, k, w), n in _by_lang(want).items() if g == "a" and k == 3}


def _by_lang(want: Counter) -> Counter:
    out = Counter()
    for (g, _, k, w), n in want.items():
        out[g, None, k, w] += n
    return out


def test_counts_make_no_row_a_place(spark):
    plan = tiles.kmer_counts(spark.createDataFrame([("a", "ACGT")], "name string, sequence string"), 3)._jdf.queryExecution().toString()
    assert "posexplode" not in plan and "MapInArrow" in plan


def test_lengths_out_of_range(spark):
    df = spark.createDataFrame([("a", "ACGT" * 5)], "name string, sequence string")
    assert {r.kmer: r.cnt for r in tiles.kmer_counts(df, tiles.LONGEST + 1).where("kmer like 'A%'").collect()} == {"ACGTACGTACGTA": 2}
    with pytest.raises(ValueError):
        tiles.word_counts(df, (0, 2))
