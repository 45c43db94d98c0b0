"""Large families meet in parts that are written once."""

from __future__ import annotations

import random

from papertally.llm import jaccard


def _groups(n, links):
    group = list(range(n))
    for a, b in links:
        group = [group[b] if g == group[a] else g for g in group]
    return [group.index(g) for g in group]


def test_sets_of_a_large_family_are_written_once(spark, monkeypatch):
    rng = random.Random(5)
    passage = list(range(10_000, 10_030))
    sets = []
    for size in (1, 1, 2, 7, 12):
        for _ in range(4):
            base = rng.sample(range(9_000), rng.randint(1, 120))
            for _ in range(size):
                lost = rng.sample(base, rng.randint(0, len(base) // 9))
                sets.append(sorted({*base, *(passage if size != 7 else [])} - {*lost}))
    every = range(len(sets))
    alike = lambda a, b: 100 * len({*a} & {*b}) >= 85 * len({*a} | {*b})
    wanted = [(a, b) for a in every for b in every if a < b and alike(sets[a], sets[b])]

    paths, real = [], jaccard.shared_path
    monkeypatch.setattr(jaccard, "shared_path", lambda spark: paths.append(real(spark)) or paths[-1])
    table = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "set_id bigint, hashes array<bigint>")
    candidates = spark.createDataFrame([(0, i) for i in every if i], "a bigint, b bigint")
    known = [p for p in wanted if p[0] % 5 == 0]
    labels = [(i, g) for i, g in enumerate(_groups(len(sets), known)) if any(i in p for p in known)]
    labels = spark.createDataFrame(labels, "node bigint, label bigint")
    for block, whole in ((1 << 22, 1 << 18), (150, 1), (1 << 22, 1)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "WHOLE", whole)
        found = [tuple(r) for r in jaccard.links_across(candidates, labels, table, 85).collect()]
        assert set(found) <= set(wanted)
        assert _groups(len(sets), known + found) == _groups(len(sets), wanted)
        there = spark.read.schema("set_id bigint, part int").parquet(paths[-1])
        assert there.count() == there.select("set_id").distinct().count() == (len(sets) if whole == 1 else 0)
        assert block != 150 or there.where("part > 0").count() > 0
