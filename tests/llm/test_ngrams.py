"""Token alignment, collocations and the n-gram join, held against plain Python."""

import tracemalloc
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from martlet.llm import alignment, blocks, collocations, ngramjoin

from tests.llm.conftest import DOCS, prose


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*(open(f, "rb").read() for f in alignment.FILES))


def aligned_plainly(pair, text):
    """Sizes, groups and links by the lengths of decoded tokens alone."""
    if not text:
        return None
    raw = (" " + text).encode()
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text, return_type=int)
    if b"".join(pair.a_bytes[k] for k in a) != raw or b"".join(pair.b_bytes[k] for k in b) != raw:
        return None
    a_end = np.cumsum([len(pair.a_bytes[k]) for k in a]).tolist()
    b_end = np.cumsum([len(pair.b_bytes[k]) for k in b]).tolist()
    groups, low = [], 0
    for cut in sorted(set(a_end) & set(b_end)):
        groups.append("|".join(",".join(str(k) for k, e in zip(ids, ends) if low < e <= cut) for ids, ends in ((a, a_end), (b, b_end))))
        low = cut
    links = [(i, j) for i, e, s in zip(a, a_end, [0, *a_end]) for j, f, t in zip(b, b_end, [0, *b_end]) if s < f and t < e]
    return len(a), len(b), len(groups), ";".join(groups), links


TEXTS = ["café €5 漢字 x <s> 🙂  two\n\tz", "a", "  x ", " a", "\n", "\nx", "a \nb", "a\n b.c", "🜁🜂 漢x", "<|endoftext|> </s>", "\x00a\x01",
         "é ﬁ Ⅷ ².", "don't 've\nit's a b\x85c d\x1ce f", "_._ a_.b x² . y!?", "Straße,Öl;ñandú:x", "¿Qué?\n\nNo.\r\nSí…", "a" * 300 + " " + "漢" * 200]


def test_alignment_of_texts(pair):
    for text in TEXTS:
        found, wanted = pair.document(text.encode()), aligned_plainly(pair, text)
        assert found[:4] == wanted[:4], text
        assert sorted(found[4].tolist()) == sorted(a << 32 | b for a, b in wanted[4]), text


def test_alignment_takes_only_texts_that_come_back(pair):
    assert aligned_plainly(pair, "a ▁x") is None and pair.document("a ▁x".encode()) is None


def test_alignment_memory_is_bounded(pair, monkeypatch):
    monkeypatch.setattr(alignment._Known, "ENTRIES", 3)
    known = alignment._Known(pair)
    for k in range(20):
        wanted = [f" w{k % 7}", "\nLine", f" and{k % 3}", ".", f" w{k % 7}"]
        assert known.entries(wanted) == [pair.segments([t])[0] for t in wanted]
    assert len(known) <= 3 and len(known.earlier) <= 3


@pytest.mark.parametrize("hot", [1, 1 << 19])
def test_alignment_counts(spark, docs, pair, hot):
    texts = {k: t for k, t in enumerate(TEXTS + ["the cat sat", "the cat sat", "the dog sat on the mat", "", None, "a ▁x"])}
    rows = alignment._written(alignment.encoded(docs(list(texts.items()))), "test")
    plain = {k: aligned_plainly(pair, t) for k, t in texts.items()}
    in_docs = Counter(link for p in plain.values() if p for link in set(p[4]))
    best = defaultdict(int)
    for (a, _), n in in_docs.items():
        best[a] = max(best[a], n)
    found = {r["doc_id"]: r for r in rows.drop("pairs", "times").join(alignment.weighed(rows, hot), "row").collect()}
    assert found.keys() == texts.keys()
    for k, p in plain.items():
        n_a, n_b, n_groups, groups, links = p or (0, 0, 0, "", [])
        r = found[k]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["groups"], r["n_links"]) == (n_a, n_b, n_groups, groups, len(links))
        assert r["n_best"] == sum(in_docs[x] == best[x[0]] for x in links)
        assert r["count_sum"] == sum(in_docs[x] for x in links)


def test_alignment_of_odd_tables(spark, docs):
    assert alignment.digest(docs([])).count() == 0
    odd = spark.createDataFrame([(1, "a b", 3, "x"), (1, "a b", 4, "y"), (None, None, 5, "z")], "doc_id int, text string, row int, pairs string")
    rows = sorted(alignment.digest(odd).collect(), key=str)
    assert [(r["doc_id"], r["n_a"], r["n_best"], r["count_sum"]) for r in rows if r["doc_id"]] == [(1, 2, 2, 4)] * 2
    empty = [r for r in rows if r["doc_id"] is None][0]
    assert (empty["n_a"], empty["n_links"], empty["n_best"], empty["count_sum"], empty["groups_sha256"]) == (0, 0, 0, 0, "")


LONG_WORDS = "red blue green black white grey".split()


def phrase_texts():
    texts = [" ".join(LONG_WORDS[(k * j + k) % (2 + k % 5)] for k in range(40)) + (". " if j % 2 else ",\t") + "New York City; new york" for j in range(30)]
    return [(k, t, ("en", "de", None, "und")[k % 4]) for k, t in enumerate(texts)] + [(98, None, "en"), (99, "", "fr"), (100, "rare words here", "fr")]


def mined_plainly(rows, least):
    import re
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                counts[lang].update(tuple(words[k:k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) == 3 and b >= least and 100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in f.items()) and len(p) == 2:
                continue
            score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:2000], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("shard", [50, 1 << 20])
def test_collocations(spark, docs, monkeypatch, shard):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    rows = phrase_texts()
    for least in (10, 3):
        assert sorted(map(tuple, collocations.collocations(docs(rows), least).collect())) == mined_plainly(rows, least)


def test_many_languages_hold_no_more_words_than_one(monkeypatch):
    assert collocations.SHARD_WORDS <= 1 << 18 and collocations.HELD_KEYS <= 1 << 20  # what an executor's memory allows
    monkeypatch.setattr(collocations, "SHARD_WORDS", 100)
    lines = [(f"l{k % 40}", "some words " * 10) for k in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in lines]), pa.array([t for _, t in lines])], ["lang", "text"])
    given, most = [], []

    class Counted(collocations.Shard):
        made = []

        def __init__(self, lang):
            super().__init__(lang)
            self.made.append(self)

        def add(self, raw):
            super().add(raw)
            most.append(sum(s.size for s in self.made if s not in given))

    monkeypatch.setattr(collocations, "Shard", Counted)
    for shard in collocations._shards(iter([batch])):
        given.append(shard)
    assert max(most) <= 120 and sum(s.size for s in given) == 200 * 20


def test_collocations_of_odd_tables(spark, docs):
    assert collocations.collocations(docs([])).count() == 0
    odd = spark.createDataFrame([("a b", "en", 1, "x")] * 12, "text string, lang string, n int, phrase string")
    assert [tuple(r) for r in collocations.collocations(odd).collect()] == [("en", 1, "a b", 12, 12, 12, 24, 1000000)]
    again = collocations.collocations(docs([(1, "a a a a a " * 20, "en")])).collect()  # overlapping places count
    assert {(r["phrase"], r["a"]) for r in again} == {("a a a", 98)}
    assert collocations.collocations(docs([(1, "x y " * 300_000, None)])).first()["a"] == 299_999


def test_index_counts_every_ngram():
    text = np.array([0, 1, 2, 1, 2, 1, 0, 2, 2, 2, 0])
    ahead, back = collocations.Index(text, 3), collocations.Index(text[::-1], 3)
    owner, left, low, count, before = ahead.extended(ahead.first[1:-1], ahead.first[2:])
    grams = {(int(c), int(o) + 1): int(n) for o, c, n in zip(owner, left, count)}
    assert grams == Counter(p for p in zip(text.tolist(), text[1:].tolist()) if 0 not in p)
    reverse = back.first[owner + 1] + before
    o3, right, _, n3, _ = back.extended(reverse, reverse + count)
    tri = {(int(left[o]), int(owner[o]) + 1, int(r)): int(n) for o, r, n in zip(o3, right, n3)}
    assert tri == Counter(p for p in zip(text.tolist(), text[1:].tolist(), text[2:].tolist()) if 0 not in p)
    # extending to the left once more counts the same trigrams
    o3, first, _, n3, _ = ahead.extended(low, low + count)
    assert {(int(f), int(left[o]), int(owner[o]) + 1): int(n) for o, f, n in zip(o3, first, n3)} == tri


def test_filter_passes_all_heavy_keys(spark):
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    counts = np.arange(5000) % 7 + 1
    halves = [blocks.packed(keys, counts, 10), blocks.packed(keys, counts, 10)]
    rows = [(int(k), bytes(v)) for h in halves for k, v in zip(h.column(0).to_pylist(), h.column(1).to_pylist())]
    found = blocks.heavy(spark.createDataFrame(rows, blocks.SCHEMA), 10, 10)
    passed = found.passes(keys)
    assert passed[2 * counts >= 10].all() and passed[2 * counts < 10].mean() < 0.01 and int(keys[4]) in found


def joined_plainly(rows, size=5, percent=80):
    sets, out = {}, {}
    for k, (doc_id, text) in enumerate(rows):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        sets[k] = {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for a, b in combinations(range(len(rows)), 2):
        if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
            continue
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    low = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[root(k)] = min(doc_id, low.get(root(k), doc_id))
    return sorted(((d, len(sets[k]), low[root(k)] if d is not None else None) for k, (d, _) in enumerate(rows)), key=str)


def near_texts():
    """Copies, chains of near copies, a passage that many share, and sets at the very bound."""
    rng, rows = np.random.default_rng(7), []
    base = [prose(k, 80).split() for k in range(6)]
    for k in range(60):
        words = list(base[k % 6])
        for at in rng.integers(0, len(words), k // 12):
            words[at] = f"x{k}_{at}"
        rows.append(" ".join(words))
    common = prose(50, 40)
    rows += [f"{common} {prose(100 + k, 8 + k % 30)}" for k in range(40)]
    line = [f"v{k}" for k in range(400)]
    rows += [" ".join(line[10 * k:10 * k + 104]) for k in range(20)]  # neighbours share 90 of 100: 82 per cent
    rows += [" ".join(line[:94]), " ".join([*line[:85], "q1", *line[86:94]]), " ".join([*line[:84], "q2", *line[85:94]])]
    rows += ["a b", "A  b", "a b c", "", None, "   ", common]
    return [(k * 3 + 1, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join(spark, docs, monkeypatch, small):
    if small:  # several blocks, slots and rounds
        for name, value in (("BLOCK_ENTRIES", 300), ("STREAM_ENTRIES", 500), ("CELLS", 7), ("BLOCK_ROWS", 2)):
            monkeypatch.setattr(ngramjoin, name, value)
    rows = near_texts()
    assert sorted(map(tuple, ngramjoin.digest(docs(rows)).collect()), key=str) == joined_plainly(rows)


def test_ngram_join_of_odd_tables(spark, docs):
    assert ngramjoin.digest(docs([])).count() == 0
    assert [tuple(r) for r in ngramjoin.digest(docs([(1, None)])).collect()] == [(1, 0, 1)]
    long = prose(3, 60_000)
    rows = [(5, long), (5, long), (4, long + " end"), (None, long), (7, "a b c"), (7, "x y z"), (6, "a b c"), (8, None)]
    assert sorted(map(tuple, ngramjoin.digest(docs(rows)).collect()), key=str) == joined_plainly(rows)
    odd = spark.createDataFrame([(1, "a b", "n", "k", 1)], "doc_id long, text string, node string, keys string, n int")
    assert [tuple(r) for r in ngramjoin.digest(odd).collect()] == [(1, 1, 1)]


def test_digest_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert ngramjoin.digest(empty).dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    assert collocations.collocations(empty).dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), (
        "l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    assert [c for c, _ in alignment.digest(empty).dtypes] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_product_of_near_copies_is_bounded():
    key = np.arange(2000, dtype=np.uint64)
    held = ngramjoin._Held([(b"h%d" % i, None, 2000, key.tobytes()) for i in range(64)])
    stream = [(b"s%d" % i, None, 2000, np.append(key[i:], key[:i] + np.uint64(2000)).tobytes()) for i in range(100)]
    tracemalloc.start()
    found = list(held.links(stream, 80))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(s, h) for s in range(100) for h in range(64)]
    assert peak < 100e6  # 12.8 million matches; all at once take 300 MB


def test_blocks_come_in_batches_of_their_own(spark, docs):
    with ngramjoin.arrow_bytes(spark, ngramjoin.BATCH_BYTES):
        found = spark.range(0, 6, 1, 1).selectExpr("repeat('x', 9000000) AS t").mapInArrow(
            lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
    assert [r["n"] for r in found] == [1] * 6
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b"
