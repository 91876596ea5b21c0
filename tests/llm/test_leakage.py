from conftest import rows
from forgeline.llm.leakage import best_passage, leaks, longest_common

ITEM = "Given a header that feeds 64 branches of unequal bore, state how the loss across each branch compares with the 36 metre run of QUORIDAN pipe"
D, I = "doc_id long, text string, item_id string", "item_id long, text string, suite string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def test_longest_common_against_dynamic_programming():
    import random

    rng = random.Random(5)
    for _ in range(50):
        a, b = [rng.choice("abcde") for _ in range(20)], [rng.choice("abcdef") for _ in range(30)]
        bits = {}
        for i, w in enumerate(a):
            bits[w] = bits.get(w, 0) | 1 << i
        assert longest_common(bits, len(a), b) == lcs(a, b)


def test_cases(spark):
    w = ITEM.split()
    broken = ITEM.replace("branches of", "bran-\n> ches <b>of</b>").replace(" ", "  ").upper()
    docs = [
        (1, "Intro text. " + broken + " And more.", ""), (2, " ".join(w[:17]), ""), (3, " ".join(w[:9]), ""),
        (4, " ".join("xx" if i % 5 == 4 else x for i, x in enumerate(w)), ""), (5, ITEM.replace("64", "12").replace("36", "99").replace("QUORIDAN", "TALLVIK"), ""),
        (6, None, ""), (7, "", ""), (8, "word " * 20_000 + ITEM + " word" * 20_000, ""), (9, " filler ".join(w[i] + " pad pad pad pad pad" for i in range(len(w))), ""), (1, ITEM, ""),
    ]
    items = spark.createDataFrame([(7, ITEM, "s"), (8, "", "s"), (9, None, "s"), (10, "too short", "s")], I)
    got = {(r.doc_id, r.item_id, r.kind) for r in leaks(spark.createDataFrame(docs, D), items).collect()}
    assert got == {(d, 7, "verbatim") for d in (1, 2, 4, 5, 8)}  # 5: three words of twenty-six differ
    assert leaks(spark.createDataFrame([], D), items).count() == 0
    assert leaks(spark.createDataFrame(docs, D), items.limit(0)).count() == 0


def test_exchanged_slots(spark):
    item = "Pump 1 BRAX 20 mm 3 bar valve 4 NORD 5 kg hose 6 TREX 70 cm"
    other = "Pump 8 ZULA 91 cm 7 psi valve 9 PRIM 3 lb hose 2 QUAX 11 mm"
    items = spark.createDataFrame([(1, item, ""), (2, "BRAX ZULA NORD PRIM TREX QUAX stand in a list of names of makers here", "")], I)
    got = rows(leaks(spark.createDataFrame([(1, other, "")], D), items, hits=1).select("doc_id", "item_id", "kind"))
    assert got == [(1, 1, "re-parameterised")]


def test_shuffled_join_gives_the_same(spark):
    docs = spark.createDataFrame([(1, ITEM, ""), (2, "nothing of it", "")], D)
    items = spark.createDataFrame([(7, ITEM, "s")], I)
    assert rows(leaks(docs, items)) == rows(leaks(docs, items, broadcast_bytes=0))


def test_passage_is_local():
    item = [f"w{i}" for i in range(40)]
    spread = [x for w in item for x in (w, *["p"] * 10)]
    assert best_passage(item, spread)[0] < 0.3
    assert best_passage(item, ["p"] * 50 + item)[0] == 1.0


def test_exchanged_words_against_brute_force(spark):
    """Every k-th word exchanged, three of five kept in several patterns, random words exchanged: as many as the definition says."""
    import random

    rng = random.Random(11)
    texts = {k: [f"w{rng.randrange(400)}x" for _ in range(n)] for k, n in ((1, 21), (2, 40), (3, 75), (4, 15))}
    texts = {k: [w.replace("0", "a").replace("1", "b").translate(str.maketrans("23456789", "cdefghij")) for w in v] for k, v in texts.items()}
    docs, n = [], 0
    for k, words in texts.items():
        keep = [lambda i, m=m: i % m != m - 1 for m in (2, 3, 4, 5)] + [lambda i, p=p: p[i % 5] == "x" for p in ("xxxoo", "xxoxo", "xoxxo", "oxoxx", "xoxoo")]
        keep += [lambda i, t=t: random.Random(100 * t + i).random() < 0.58 + 0.02 * t for t in range(10)]
        for f in keep:
            body = [w if f(i) else "zz" for i, w in enumerate(words)]
            docs.append((n, " ".join(["before"] * rng.randrange(120) + body + ["after"] * rng.randrange(30)), ""))
            n += 1
    got = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, D), spark.createDataFrame([(k, " ".join(v), "s") for k, v in texts.items()], I)).where("kind = 'verbatim'").collect()}
    want = {(d, k) for d, t, _ in docs for k, v in texts.items() if best_passage(v, t.split())[0] >= 0.6 - 1e-9}
    assert want and got == want


def test_many_names(spark):
    """Names are known by their form, however many there are."""
    w = ITEM.split()
    many = spark.createDataFrame([(7, ITEM, "s"), (8, " ".join(f"N{chr(65 + i // 676)}{chr(65 + i // 26 % 26)}{chr(65 + i % 26)}" for i in range(1500)), "s")], I)
    other = " ".join({"64": "12", "36": "99", "QUORIDAN": "TALLVIK", "metre": "inch"}.get(x, x) for x in w)
    got = rows(leaks(spark.createDataFrame([(1, other, "")], D), many, least=0.95).select("doc_id", "item_id", "kind"))
    assert got == [(1, 7, "re-parameterised")]


def test_short_items(spark):
    items = ["purge the relief line", "purge the relief line slowly", "drain every sump before noon", "check all nine bolts on this flange", "seal both ends of the long hose now", "name", ""]
    docs = [(i, "some text before " * 3 + x + " and text behind" * 3, "") for i, x in enumerate(items)]
    docs += [(10, "aa bb drain every sump cc dd", ""), (11, "x " * 5 + "seal both ends of the" + " y" * 40, ""), (12, "drain one, then every other", ""), (13, "k " * 19 + "drain k k every k k k k k sump", "")]
    got = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, D), spark.createDataFrame([(i, x, "s") for i, x in enumerate(items)], I)).where("kind = 'verbatim'").collect()}
    assert got == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (10, 2), (11, 4), (13, 2)}
