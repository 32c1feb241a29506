"""Whole results of the pipeline's stages and operators, against plain Python."""

import random

import corpus_pipeline
from siltbed.llm import line_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3)


def test_near_copy_stage(spark):
    """Against brute-force Jaccard; one text in two has words replaced, so that fingerprints differ by many bits."""
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(500)}" for _ in range(r.randrange(1, 150))) for _ in range(80)]
    for t in texts[:60]:
        w = t.split()
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(len(w))] = "new"
        texts.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
    rows = list(enumerate([*texts, texts[0], "a b", "A  b"]))

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in range(10):
        root = [min(root[j] for j, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)) for a in sets]
    got = {r.doc_id for r in corpus_pipeline.simhash_stage(spark, corpus(spark, rows), "").collect()}
    assert got == {i for i, k in enumerate(root) if i == k}
    assert corpus_pipeline.simhash_stage(spark, corpus(spark, []), "").count() == 0


def test_line_dedup_repeated_rows(spark):
    """Rows that occur two or three times keep the near links of their lines."""
    line = "one two three four five six seven eight nine ten"
    rows = [(1, line + "\nown words of the first document"), (2, line.replace("four", "4")), (3, line + " more"), (4, "a line that is near to none of them")]
    want = {1: [0, 1], 2: [], 3: [], 4: [0]}
    for times in (2, 3):
        got = line_dedup.dedup_lines(corpus(spark, rows[:1] * times + rows[1:] + rows[1:2])).collect()
        assert len(got) == times + 4 and all(r.kept_lines == want[r.doc_id] for r in got)


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    bench = "what does the old river carry down to the long cold sea at night"
    own = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    rows = [(None, own[0]), (1, own[1]), (1, own[1]), (2, own[2]), (2, own[3]), (None, own[3]), (None, bench), (3, bench + " then"), (3, own[0] + " x " + own[1])]
    d = corpus(spark, rows)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.simhash_stage(spark, d, "").collect()), key=repr)
    assert got == sorted([(None, own[0]), (1, own[1]), (2, own[2]), (2, own[3]), (3, bench + " then"), (3, rows[-1][1])], key=repr)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.decontamination_stage(spark, d, str(tmp_path)).collect()), key=repr)
    assert got == sorted([x for x in rows if bench not in x[1]], key=repr)
