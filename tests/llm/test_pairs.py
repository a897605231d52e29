"""Near duplicates and benchmark overlaps against brute force."""

import random
import re

import numpy as np

from martlet.llm import decontaminate, neardup
from tests.llm.conftest import prose


def sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


def brute(rows, k):
    found = [(i, sets(t, k)) for i, t in rows if i is not None]
    parent = {n: n for n in range(len(found))}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(found)):
        for b in range(a):
            x, y = found[a][1], found[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for n, (i, _) in enumerate(found):
        least[root(n)] = min(i, least.get(root(n), i))
    return sorted((i, len(s), least[root(n)]) for n, (i, s) in enumerate(found))


def family(seed, copies, words=80):
    """Copies of one text with a few words changed: similarities on both sides of 0.8."""
    rng = random.Random(seed)
    base = prose(seed, words).split()
    for _ in range(copies):
        own = list(base)
        for at in rng.sample(range(words), rng.randint(0, 5)):
            own[at] = f"x{rng.randint(0, 10**6)}"
        yield " ".join(own)


def test_components_equal_brute_force(docs):
    texts = [prose(1), prose(1), prose(1).upper(), prose(2), None, "", " \t\n", "one two", "One Two", "three", *family(5, 60), *family(6, 40)]
    rows = list(enumerate(texts, 100)) + [(100, prose(1)), (101, prose(9)), (None, prose(1))]
    got = neardup.digest(docs(rows)).collect()
    named = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None)
    assert named == brute(rows, 4)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]


def test_one_of_each_group_stays_with_its_columns(docs):
    rows = [(3, prose(1)), (2, prose(1)), (2, prose(1)), (7, prose(2)), (8, None), (9, ""), (None, prose(1))]
    kept = neardup.keep_one(docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [
        (False, 2), (False, 7), (False, 8), (False, 9), (True, None)]


def test_no_documents(docs):
    assert neardup.digest(docs([])).count() == 0
    assert neardup.keep_one(docs([])).count() == 0


def test_overlaps_tolerate_substitution_and_leave_others(spark, docs):
    item = prose(50, 40)
    words = item.rstrip(".").split()
    swapped = list(words)
    for at in (4, 13, 22, 31):
        swapped[at] = "other"
    rows = [(1, prose(1) + " " + item + " " + prose(2)), (2, prose(1) + " " + " ".join(swapped)), (3, " ".join(words[:12])),
            (4, " ".join(words[5:20]) + " end"), (5, prose(3, 300)), (6, None), (7, ""), (8, item.upper().replace(" ", " !! ")),
            (9, "short one here indeed " + prose(4))]
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "Short one, here")], "item_id bigint, text string")
    # four equal words before a substituted one score nothing, so the stretch of document 2 begins and ends inside
    hits = {(r["doc_id"], r["item_id"]): r["words_equal"] for r in decontaminate.digest(docs(rows), items).collect()}
    assert hits == {(1, 10): 40, (2, 10): 32, (4, 10): 15, (8, 10): 40, (9, 13): 3}
    kept = decontaminate.drop_contaminated(docs(rows), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6, 7] and kept.columns == docs(rows).columns


def test_blocks_and_empty_tables(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    items = spark.createDataFrame([(k, prose(100 + k, 20)) for k in range(9)], "item_id bigint, text string")
    rows = [(k, prose(k) + " " + prose(100 + k, 20)) for k in range(12)]
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.digest(docs(rows), items).collect()) == [(k, k) for k in range(9)]
    assert decontaminate.drop_contaminated(docs(rows), items).count() == 3
    assert decontaminate.digest(docs(rows), items.limit(0)).count() == 0
    assert decontaminate.digest(docs([]), items).count() == 0


def test_four_fifths_equal_count_wherever_the_others_stand(spark, docs):
    """Every 15-word item with one word or two swapped, 20 words with four swapped, every fifth word swapped."""
    def swapped(words, at):
        return " ".join("other" if k in at else w for k, w in enumerate(words))

    fifteen, twenty, hundred = (prose(60 + n, n).rstrip(".").split() for n in (15, 20, 100))
    cases = [(fifteen, {k}) for k in range(15)] + [(fifteen, {3, 11}), (fifteen, {2, 7, 12}), (twenty, {4, 9}), (twenty, {2, 7, 12, 17})]
    cases += [(hundred, set(range(4, 100, 5)))]
    rows = [(k, prose(1) + " " + swapped(words, at) + " " + prose(2)) for k, (words, at) in enumerate(cases)]
    rows += [(500, swapped(twenty, {1, 5, 9, 13, 17})[:60]), (501, prose(3) + " " + swapped(fifteen, {2, 5, 8, 11, 13}))]
    items = spark.createDataFrame([(len(w), " ".join(w)) for w in (fifteen, twenty, hundred)], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"], r["words_equal"] * 5 >= r["words"] * 4 and r["words"] >= 13)
             for r in decontaminate.digest(docs(rows), items).collect()}
    assert found == {(k, len(words), True) for k, (words, _) in enumerate(cases)}
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs(rows), items).collect()) == [500, 501]


def test_longest_stretch_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        equal = np.array([rng.random() < 0.75 for _ in range(rng.randint(1, 30))])
        every = [(b - a, -a) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if 5 * equal[a:b].sum() >= 4 * (b - a)]
        got = decontaminate._longest(equal)
        assert (got is None) == (not every)
        if every:
            size, start = max(every)
            assert got == (int(equal[-start:size - start].sum()), -start, size)
