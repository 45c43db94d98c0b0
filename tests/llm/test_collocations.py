"""Phrases against a plain count of every text."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from papertally.llm import collocations as c


def brute(rows, support, best):
    count, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    count.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        kept = []
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        longest = Counter()
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i : i + k]] = max(longest[p[i : i + k]], a)
        for p, a in frequent.items():
            if 100 * longest[p] >= 80 * a:
                continue
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(lang, text, 1) for lang, text in rows], "lang string, text string, key int")
    return sorted(map(tuple, c.collocations(docs.repartition(3), **options).collect()))


def texts(seed: int, n: int):
    pick = random.Random(seed)
    words = ["the", "New", "York", "of", "und", "être", "straße", "a\x00b", "\u00a0", "x-y", "state", "city"] + [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(n):
        text = "".join(
            pick.choice([w, w, w, "new york city hall", "in spite of it"]) + pick.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"])
            for w in pick.choices(words, weights=[9, 5, 5] + [3] * 9 + [1] * 40, k=pick.randint(0, 60))
        )
        rows.append((pick.choice(["en", "de", None, "und"]), text))
    return rows + [("en", None), ("en", ""), (None, "  . ,")] + rows[:20] * 2


def test_phrases_as_counted_plainly(spark):
    rows = texts(1, 400)
    expected = brute(rows, 30, 2000)
    assert len(expected) > 40
    assert mined(spark, rows) == expected
    assert mined(spark, rows, support=8, best=25) == brute(rows, 8, 25)


def test_border_failures_are_closed(spark, monkeypatch):
    # a sample that proposes next to nothing: every phrase comes from a failed border
    monkeypatch.setattr(c, "SAMPLE_SUPPORT", 10**6)
    rows = texts(2, 200)
    assert mined(spark, rows, support=10) == brute(rows, 10, 2000)


def test_blocks_may_cut_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK_TOKENS", 40)
    monkeypatch.setattr(c, "CHUNK_BYTES", 50)
    long = " ".join(["one two three four five six"] * 300)
    rows = [("en", long), ("en", "z" * 5000 + " one two " + "y" * 90), ("de", long[: len(long) // 2])] + texts(3, 60)
    blocks, table = [], c.pa.table({"lang": [r[0] or "und" for r in rows], "text": c.pa.array([(r[1] or "").encode() for r in rows])})
    monkeypatch.setattr(c.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 1})())
    for batch in c._encode(iter(table.to_batches())):
        blocks += batch.to_pylist()
    assert len(blocks) > 40 and len({b["number"] for b in blocks}) == len(blocks)
    total, pairs = Counter(), Counter()
    for b in blocks:
        block = c.Block(*(b[name] for name in c._READ))
        words = [None, None, *block.words]
        total[b["lang"]] += b["n"]
        for i in range(len(block.tokens) - 3):
            window = block.tokens[i : i + 4]
            if (window > 1).all() and i + 4 > block.carried:
                pairs[b["lang"], b" ".join(words[w] for w in window).decode()] += 1
    expected = Counter()
    for lang, text in rows:
        lowered = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(words) - 3):
                expected[lang or "und", " ".join(words[i : i + 4])] += 1
    assert pairs == expected
    assert total["de"] == sum(len(re.findall(r"[^\x20\x09-\x0D.,;:!?]+", t or "")) for lang, t in rows if lang == "de")


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "lang string, text string, k int, key bigint, n bigint, words string")
    assert c.collocations(none).collect() == []
    rows = [("en", "red car. " * 40, i, "x") for i in range(2)]
    docs = spark.createDataFrame(rows, "lang string, text string, key int, tokens string")
    assert [tuple(r) for r in c.collocations(docs).collect()] == [("en", 1, "red car", 80, 80, 80, 160, 1_000_000)]


@pytest.mark.parametrize("n", [1, 5000])
def test_filter_holds_its_keys(spark, n):
    pick = random.Random(n)
    keys = [pick.getrandbits(64) - (1 << 63) for _ in range(n)]
    path = c.write_filter(spark.createDataFrame([(k,) for k in keys], "key bigint"))
    bits = c.BitFilter(c._read_bits(path))
    assert bits.has(c.np.array(keys, c.np.int64).view(c.np.uint64)).all()
    others = c.np.array([pick.getrandbits(64) for _ in range(20000)], c.np.uint64)
    assert bits.has(others).mean() < 0.02
