"""Each stage of the pipeline against brute force on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline

from matchlens.llm import mixing
from matchlens.llm.common import stored

from .test_mixing import size
from .test_quality_rules import by_hand as rules_by_hand
from .test_repeats import by_hand as repeats_by_hand
from .test_shingle_sets import kept_by_hand
from .test_tokens import check_packing


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made.append(stored(stage(spark, made[-1], sf), name))
    assert all(df.columns == columns for df in made[:-1])
    given, good, single, cut, mixed, packed = made

    rows, kept = pairs(given), pairs(good)
    assert set(kept) <= set(rows) and not any(rules_by_hand(t)[-1] for _, t in kept)
    sound = [r for r in rows if not rules_by_hand(r[1])[-1]]
    assert 0.8 * len(sound) <= len(kept) <= len(sound)

    # One of each group of documents that share 0.8 or more of their five-word shingles.
    assert sorted(i for i, _ in pairs(single)) == kept_by_hand(kept) and set(pairs(single)) <= set(kept)

    left = {i: (n, gone) for i, n, gone, _, _ in repeats_by_hand(pairs(single))}
    texts = dict(pairs(single))
    assert len(left) == cut.count() and any(gone for _, gone in left.values())
    for i, t in pairs(cut):
        n, gone = left[i]
        # A character that was cut into goes as a whole.
        assert n - gone - 3 * 2 * (gone > 0) * 20 <= len(t.encode()) <= n - gone
        assert gone or t == texts[i]
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    times, at = Counter(i for i, _ in pairs(mixed)), {r.doc_id: r for r in cut.collect()}
    by_source, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, r in at.items():
        by_source[r.source] += size(r.text)
        taken[r.source] += size(r.text) * times[i]
        largest[r.source] = max(largest[r.source], size(r.text))
    assert max(times.values()) <= 2 and all(r.text == at[r.doc_id].text for r in mixed.collect())
    for s, goal in mixing.targets(dict(by_source)).items():
        assert abs(taken[s] - goal) <= largest[s]

    check_packing(pairs(mixed), packed.collect())


def test_run_is_the_stages_in_turn(spark, sf):
    placed = corpus_pipeline.run(spark, sf).collect()
    assert placed and len({(r.sequence_id, r.offset) for r in placed}) == len(placed)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "suffix-array dedup", "mixing sources", "best-fit packing"]
