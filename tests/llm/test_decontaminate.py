"""Windows found by the automaton against a search of every window."""
import random
import re

from sigspark.llm import decontaminate as d


def plain(doc, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), doc or ""))
    hit, found = set(), set()
    for item, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(window, len(w))
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1 if w else 0):
            if tuple(words[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def cases():
    draw = random.Random(5)
    word = lambda k: " ".join(draw.choice(["a", "b", "c", "É", "d1"]) for _ in range(k))
    items = [(i, word(draw.choice([1, 2, 3, 5, 9, 14]))) for i in range(12)] + [(50, None), (51, "  ,; "), (52, "a B-c"), (52, "a b c")]
    docs = [(k, word(draw.randrange(0, 40))) for k in range(40)] + [(90, None), (91, ""), (92, "A,b;C"), (93, "zz " * 2000 + items[5][1]), (93, "zz " * 2000 + items[5][1])]
    return docs, items


def test_windows_equal_brute_force(spark):
    docs, items = cases()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, spans int")
    for window in (3, 4, 13):
        for limit in (1_000_000, 20):                           # one automaton, and several in turn
            got = d.contamination(table, bench, "f", window, limit).collect()
            want = sorted((k, *map(str, plain(t, items, window))) for k, t in docs)
            assert sorted((r.doc_id, str(r.f.n_words), str(sum(s.stop - s.start for s in r.f.spans)), str(sorted(r.f["items"]))) for r in got) == want


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, items string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.asDict() for r in d.decontaminate(docs, none).collect()] == [{"doc_id": 1, "text": "a b c", "items": "x"}]
    assert d.decontaminate(docs.limit(0), none).count() == 0


def test_rule_and_cut(spark):
    item = " ".join(f"t{i}" for i in range(13))
    docs = spark.createDataFrame([(1, "Lead, " + item.upper() + "! tail"), (2, item + " " + "w " * 248), (3, item + " " + "w " * 247), (4, None), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in d.decontaminate(docs, bench).collect()) == [2, 4, 5]        # 13 of 261 words are under one in twenty
    cut = {r.doc_id: r.text for r in d.decontaminate(docs, bench, cut=True).collect()}
    assert cut[1] == "Lead, ! tail" and cut[2].startswith("t0 t1") and cut[3] == " " + "w " * 247 and cut[4] is None
