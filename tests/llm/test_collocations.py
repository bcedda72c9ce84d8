"""Collocations against counting everything in one place."""
import re
from collections import Counter

import pytest

from sigspark.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, a long, best string, phrase string"


def brute(rows, least, inside, first):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + n])] += 1
    out = []
    for lang, found in counts.items():
        ranked = []
        for phrase, a in found.items():
            if len(phrase) < 2 or a < least:
                continue
            if any(len(q) > len(phrase) and any(q[i:i + len(phrase)] == phrase for i in range(len(q))) and b >= least and 100 * b >= inside * a for q, b in found.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (found[phrase[:k]] + found[phrase[k:]]), k, found[phrase[:k]], found[phrase[k:]]) for k in range(1, len(phrase)))
            ranked.append((-score, -a, " ".join(phrase).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:first])]
    return sorted(out)


def got(spark, rows, **how):
    found = c.collocations(spark.createDataFrame(rows, SCHEMA), **how)
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    import random
    draw = random.Random(3)
    words = ["a", "B", "b", "ça", "\x01x", "dog s", "a\x00", "the"]
    texts = ["".join(draw.choice(words) + draw.choice([" ", "  ", "\t", " ", " ", ". ", "\n", ","]) for _ in range(draw.randrange(60))) for _ in range(120)]
    texts += ["", None, " \t.\n", "the the the the the the"] + ["the a b the"] * 40
    return [(k, t, draw.choice(["en", "de", None, "und", "en"]), k, "x", "y") for k, t in enumerate(texts)]


@pytest.mark.parametrize("run_bytes, range_bytes", [(1 << 20, 1 << 20), (200, 1 << 20), (300, 900), (1 << 20, 250)])
def test_all_phrases(spark, rows, run_bytes, range_bytes):
    for least, inside, first in ((3, 80, 2000), (2, 50, 7)):
        assert got(spark, rows, least=least, inside=inside, first=first, run_bytes=run_bytes, range_bytes=range_bytes) == brute(rows, least, inside, first)


def test_long_text_is_divided_at_a_break(spark):
    rows = [(1, "x y z. " * 3000, "en", 0, "", "")]
    assert got(spark, rows, run_bytes=1000, range_bytes=3000) == brute(rows, 30, 80, 2000)


def test_no_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, None, 0, "", ""), (1, "", "en", 0, "", ""), (None, "a b", "en", 0, "", "")]) == []


def test_scores_past_64_bits(spark, monkeypatch):
    big = 6_000_000_000_000
    table = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 3), ("en", "", 0, 3 * big)], "lang string, phrase string, words int, f long")
    monkeypatch.setattr(c, "phrase_counts", lambda *_: table)
    found = c.collocations(table).collect()
    assert [(r.phrase, r.score) for r in found] == [("a b", 2_000_000 * (big - 3) // (2 * big - 1))]


def test_a_merge_holds_few_bytes_for_a_window():
    """Two workers of an executor merge at once; what one holds at most is a small multiple of the 20 bytes of a window's cells."""
    import random
    import tracemalloc
    draw = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    chunks = [x for _ in range(6) for x in c._chunks("en", " ".join(draw.choices(words, k=60_000)).encode(), {})]
    tracemalloc.start()
    _, ranks, counts = c._merged([x[2] for x in chunks], [x[3] for x in chunks])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.sum() == 360_000 and ranks.shape[1] > 350_000
    assert peak < 100 * 360_000
