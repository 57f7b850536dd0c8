from collections import Counter, defaultdict

import numpy as np
from odd import LONG, ROWS, SCHEMA, frame

from boutline.llm import leaked_questions as lq
from boutline.llm.text import PUNCTUATION, words

ITEMS = [(1, "Anna buys 3 kg of apples for 12 dollars and Anna gives 2 kg of them to Ben on the way home."),
         (2, "The quick brown fox jumps over the lazy dog while the small grey cat looks on from the wall."),
         (3, "too short here"), (4, None), (5, ""), (None, "no id at all but many words to look for in here"),
         (6, "The quick brown fox jumps over the lazy dog while the small grey cat looks on from the wall.")]
TEXTS = [
    (1, "We read: well, Carla buys 7 kg of apples for 31 dollars and Carla gives 5 kg of them to Dora on the way home. End."),
    (2, "We read: well, Carla buys 7 kg of apples for 31 dollars and Emil gives 5 kg of them to Fritz on the way home. End."),
    (3, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG WHILE THE SMALL GREY CAT LOOKS ON FROM THE WALL."),
    (4, "the quick brown fox jumps over the lazy dog and then something else entirely happens here"),
    (5, LONG + " The quick brown fox jumps over the lazy dog while the small grey cat looks on from the wall. " + LONG),
    (6, None), (7, ""), (None, ITEMS[1][1]), (8, ITEMS[1][1]), (8, ITEMS[1][1])]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, "en", "k", 0, 0.5, "w", 1) for r in rows], SCHEMA)


def benchmark(spark, rows=ITEMS):
    return spark.createDataFrame([(*r, "clash") for r in rows], "item_id long, text string, h string")


def test_templates(spark):
    found = {(r.doc_id, r.item_id): r for r in lq.leaked_questions(docs(spark), benchmark(spark), agreement=0.95).collect()}
    assert {k for k in found if k[1] == 1} == {(1, 1)}
    assert found[1, 1].n_slots > 0 and found[1, 1].agreement == 1
    assert {k[0] for k in found if k[1] == 2} == {3, 5, 8} == {k[0] for k in found if k[1] == 6}
    loose = {(r.doc_id, r.item_id) for r in lq.leaked_questions(docs(spark), benchmark(spark)).collect()}
    assert (2, 1) in loose


def test_without_leaks(spark):
    df = docs(spark)
    left = lq.without_leaks(df, benchmark(spark), agreement=0.95)
    assert left.columns == df.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 2, 4, 6, 7]


def test_odd_and_empty(spark):
    assert lq.leaked_questions(frame(spark), benchmark(spark)).collect() == []
    assert lq.leaked_questions(spark.createDataFrame([], SCHEMA), benchmark(spark)).collect() == []
    assert lq.without_leaks(frame(spark), benchmark(spark, [])).count() == len(ROWS)


def test_filter_size_does_not_matter(spark):
    want = sorted(map(tuple, lq.leaked_questions(docs(spark), benchmark(spark)).collect()))
    assert sorted(map(tuple, lq.leaked_questions(docs(spark), benchmark(spark), bits=64).collect())) == want


def sequence(text):
    """Template words of one text, as (word, slot)."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    t = lq.template(data, np.array([0, len(data)]), lq._unit_hashes())
    return list(zip(t.word.tolist(), t.slot.tolist()))


def brute(texts, items, size=5, plain=2):
    out = {}

    def cut(text):
        s = sequence(text)
        w = [(i, s[i:i + size]) for i in range(len(s) - size + 1)]
        return [(i, tuple(a for a, _ in x), [b for _, b in x]) for i, x in w if sum(b == 0 for _, b in x) >= plain]

    asked = [(i, cut(t)) for i, t in items if i is not None]
    for d, text in texts:
        if d is None:
            continue
        own = defaultdict(list)
        for at, w, slots in cut(text):
            own[w].append((at, slots))
        for i, ws in asked:
            kinds = {w for _, w, _ in ws}
            met = {w for w in kinds if w in own}
            if not kinds or len(met) < 0.8 * len(kinds) - 1e-9:
                continue
            places = {(q + k, p + k, a, b) for q, w, slots in ws for p, given in own.get(w, []) for k, (a, b) in enumerate(zip(slots, given)) if a}
            pairs = Counter((a, b) for _, _, a, b in places)
            best = Counter()
            for (a, _), n in pairs.items():
                best[a] = max(best[a], n)
            if not pairs or sum(best.values()) >= 0.8 * sum(pairs.values()) - 1e-9:
                out[d, i] = (len(kinds), len(met))
    return out


def test_given_documents(spark):
    folder = "/root/testdata/sf0.01/"
    d, b = (spark.read.parquet(f"{folder}{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): (r.n_windows, r.matched) for r in lq.leaked_questions(d, b).collect()}
    want = brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])
    assert got == want and len(got) > 10


def test_units_and_numbers():
    unit = {int(words(np.frombuffer(u.encode(), np.uint8), np.array([0, len(u)]), PUNCTUATION).hash[0]) for u in lq.UNITS}
    assert unit == set(lq._unit_hashes().tolist())
    assert [w for w, _ in sequence("it costs 1,000.5 dollars")] == [w for w, _ in sequence("it costs 7 kg")]
    assert sequence("it costs 2.5")[-1] != sequence("it costs 25")[-1]
    assert [w for w, _ in sequence("so Mary Ann Lee ran")] == [w for w, _ in sequence("so Bob ran")]


def test_variants_in_one_document(spark):
    """A worksheet holds a question several times; each occurrence counts by itself, and scattered windows are none."""
    def sheet(n):
        return " ".join(f"{a} buys {3 + i} kg of apples for {12 + 5 * i} dollars and {a} gives {2 + 3 * i} kg of them to {b} on the way home."
                        for i, (a, b) in enumerate([("Anna", "Ben"), ("Carla", "Dora"), ("Emil", "Fritz"), ("Gina", "Hugo"), ("Ida", "Jim")][:n]))

    fox = ITEMS[1][1].split()
    scattered = f" {' '.join(f'z{i}' for i in range(80))} ".join(" ".join(fox[i:i + 6]) for i in range(0, len(fox) - 4, 2))
    rows = [(n, "We read: well, " + sheet(n)) for n in range(1, 6)] + [(9, scattered), (10, "It was so. " + ITEMS[1][1] + " " + scattered)]
    found = {(r.doc_id, r.item_id): r for r in lq.leaked_questions(docs(spark, rows), benchmark(spark, ITEMS[:2])).collect()}
    assert set(found) == {(n, 1) for n in range(1, 6)} | {(10, 2)}
    assert all(r.agreement == 1 and r.last - r.first < 30 for r in found.values())


BARE = [(1, "3 + 4 * 12 = 51 and 7 - 2 = 5"), (2, "Paris London Berlin 1987 Rome 42"), (3, "Solve 3.5 by 20"), (4, "no it is"), (5, "1 2 3 4 5 6 7 8 9 10 11 12")]


def test_questions_without_windows(spark):
    """Short and numeric questions are found word for word, other numbers are other questions, a third of all texts hold one of them."""
    rows = [(n, f"Page {n} begins here. {BARE[1][1]}. It goes on with other things.") for n in range(10, 40)]
    rows += [(1, "so: 3 + 4 * 12 = 51 and 7 - 2 = 5, they said"), (2, "so: 3 + 4 * 13 = 55 and 9 - 2 = 7, they said"), (3, "we solve 3.5 BY 20 today"),
             (4, "we solve 35 by 20 today"), (5, "no it is not"), (6, LONG + " 1 2 3 4 5 6 7 8 9 10 11 13 " + LONG), (7, "1 2 3 4 5 and 6 7 8 9 10"), (8, "Paris London Berlin 1988 Rome 42")]
    got = {(r.doc_id, r.item_id): r for r in lq.leaked_questions(docs(spark, rows), benchmark(spark, BARE + [(n + 10, t) for n, t in ITEMS[:2]])).collect()}
    assert set(got) == {(n, 2) for n in range(10, 40)} | {(1, 1), (3, 3), (6, 5)}
    assert all(r.n_slots == 0 for r in got.values()) and got[6, 5].matched == 7 and got[6, 5].n_windows == 8
