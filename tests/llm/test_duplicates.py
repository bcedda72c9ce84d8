"""Exact and near duplicates against brute force, on awkward rows."""
import hashlib
import re

import xxhash

from sigspark.llm import block_naming, components, simhash

ROWS = [(1, "a b  c"), (2, "a b c"), (3, None), (4, ""), (5, "\t\n "), (6, " "), (7, "x" * 5000), (8, "x" * 5001), (9, "x" * 5000), (9, "x" * 5000), (None, "a b c"), (10, "ä" * 3000), (11, "ä" * 3000 + "b"),
        (12, "b" + "x" * 4999), (13, "x" * 2048), (14, "x" * 4096), (15, "a b c")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, name string, uid int")


def expected(rows):
    norm = [re.sub(r"[ \t-\r]+", " ", t or "") for _, t in rows]
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(norm[k], []).append((i is None, i or 0, k))
    return {t: (min(g)[1] if not min(g)[0] else None, len(g)) for t, g in groups.items()}, norm


def test_block_names_equal_brute_force(spark):
    want, norm = expected(ROWS)
    for bits in (64, 2):                                        # two bits: keys collide and must be made anew
        got = block_naming.exact_duplicates(frame(spark, ROWS), block_bytes=16 if bits == 2 else 2048, key_bits=bits).collect()
        assert len(got) == len(ROWS)
        by_hash = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
        for r in got:
            assert (r.keep_id, r.group_size) == by_hash[r.text_sha256]
        assert sum(r.kept for r in got) == len(want)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.text_sha256) for r in got) == sorted((-1 if i is None else i, hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(ROWS, norm))


def test_block_names_of_an_empty_table(spark):
    assert block_naming.exact_duplicates(frame(spark, [])).collect() == []


def test_dropping_keeps_columns_and_one_row_each(spark):
    kept = block_naming.drop_exact_duplicates(frame(spark, ROWS))
    assert kept.columns == ["doc_id", "text", "name", "uid"]
    want, _ = expected(ROWS)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(v[0] for v in want.values())


def test_no_python_on_the_main_path(spark):
    plan = block_naming.exact_duplicates(frame(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def plain_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    texts = [None, "", "  \n", "One", "one TWO three", "a b c d e", "É é A a \x0b b\xa0c", "w " * 70_000, "ab\x1ccd e f g h i j"]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(got).collect()}
    assert found == {k: plain_simhash(t) for k, t in enumerate(texts)}


def test_shard_links_and_tiles_equal_all_pairs(spark):
    import random
    draw = random.Random(3)
    values = [draw.getrandbits(64) for _ in range(60)]
    for v in list(values):
        for _ in range(4):
            w = v
            for b in draw.sample(range(64), draw.choice([1, 2, 4, 5, 6])):
                w ^= 1 << b
            values.append(w)
    values = sorted(set(values) | {0, 1, 2**64 - 1})
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    signed = lambda v: v - 2**64 if v >> 63 else v
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    want = {}
    for v in values:
        want.setdefault(label[v], set()).add(signed(v))
    for part in (4096, 2):                                      # two: every shard is dealt into parts
        roots = {r.u: r.root for r in components.components(simhash.links(prints, 4, part)).collect()}
        got = {}
        for v in values:
            got.setdefault(roots.get(signed(v), signed(v)), set()).add(signed(v))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain_a_star_and_nothing(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.u: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_near_duplicates_keep_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (3, base + " more"), (9, "other words than those of the first text"), (9, "other words than those of the first text"), (11, None), (12, "")]
    kept = simhash.drop_near_duplicates(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [3, 9, 11]
    assert simhash.drop_near_duplicates(frame(spark, [])).collect() == []


def test_rejected_rows_of_repeated_and_null_ids_stay_away(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (5, "a b"), (5, "a  b"), (None, "b"), (None, "c"), (None, "c "), (None, "d"), (None, "d"), (3, "c ")]
    kept = sorted((str(r.doc_id), block_normal(r.text)) for r in block_naming.drop_exact_duplicates(frame(spark, rows)).collect())
    assert kept == [("1", "a"), ("2", "b"), ("3", "c "), ("5", "a b"), ("None", "c"), ("None", "d")]
    one, two, three, four = ([f"{w}{k}" for k in range(60)] for w in "abcd")
    texts = {n: " ".join(words) for n, words in zip("abcd", (one, two, three, four))}
    rows = [(1, "a"), (2, "a"), (2, "b"), (2, "b"), (None, "b"), (None, "c"), (None, "c"), (None, "d"), (6, "a")]
    kept = simhash.drop_near_duplicates(frame(spark, [(i, texts[t]) for i, t in rows])).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in kept) == [("1", "a"), ("2", "b"), ("None", "c"), ("None", "d")]
    assert kept[0].asDict().keys() == {"doc_id", "text", "name", "uid"}


def block_normal(text):
    return re.sub(r"[ \t-\r]+", " ", text or "")
