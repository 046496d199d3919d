import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup, graph, near_dedup, run_index, substring_dedup, suffix_dedup
from weftgraph.llm.repeats import Unit
from weftgraph.llm.run_index import RunIndex

SPACES = re.compile(r"[\x20\x09-\x0D]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal(t):
    return SPACES.sub(" ", t or "")


def exact_rows(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[normal(t)].append(i)
    return Counter((i, min(g := groups[normal(t)]), len(g), i == min(g), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in texts)


@pytest.mark.parametrize("max_bits", [1 << 27, 1 << 8])
def test_exact(docs, texts, max_bits):
    got = exact_dedup.decide(docs, max_bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert Counter(map(tuple, got)) == exact_rows(texts)


def test_exact_keeps_rows_whole(docs, texts):
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"], r["maybe"], r["h"]) for r in out.collect())
    first = {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        first.setdefault(normal(t), (i, t, True, "x"))
    assert got == Counter(first.values())


def test_exact_without_ids(no_id, empty):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.decide(no_id).collect()}
    assert got == {(None, 4, 2, False), (4, 4, 2, True), (None, None, 1, True)}
    assert exact_dedup.decide(empty).count() == exact_dedup.deduplicate(empty).count() == 0


def shingles(text, k):
    w = SOLID.findall((text or "").translate(AZ))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_rows(texts, k, percent):
    sets, parent = {i: shingles(t, k) for i, t in texts}, {i: i for i, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), i == find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near(docs, texts, k, percent):
    got = near_dedup.link(docs, k, percent).collect()
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == near_rows(texts, k, percent)


def test_near_drops(docs, texts, empty, no_id):
    out = near_dedup.deduplicate(docs, 3, 85)
    want = near_rows(texts, 3, 85)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(i for i, _ in texts if want[i][2])
    assert near_dedup.link(empty).count() == 0
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.link(no_id).collect())
    assert got == Counter({(None, 4, False): 1, (4, 4, True): 1, (None, None, True): 2})


def test_near_in_a_large_group(spark):
    """Hundreds of near copies of one text, and as many of another that shares half of it."""
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    half, texts = [word() for _ in range(60)], []
    for _ in range(2):
        base = half + [word() for _ in range(60)]
        for _ in range(150):
            w = list(base)
            w[r.randrange(120)] = word()
            texts.append((len(texts), " ".join(w)))
    rows = near_dedup.link(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: x[1] for i, x in near_rows(texts, 3, 85).items()}


@pytest.mark.parametrize("rows", [512, 100])
def test_near_in_a_template_crowd(spark, monkeypatch, rows):
    """Texts of one template, all below the limit of each other, and planted pairs above it."""
    monkeypatch.setattr(near_dedup, "ROWS", rows, raising=False)
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghij", k=8))
    template, texts = [word() for _ in range(144)], []
    for i in range(500):
        common = [word() for _ in range(6)]
        for _ in range(2 if i < 40 else 1):
            texts.append(" ".join(template + common + [word() for _ in range(12)]))
    r.shuffle(texts)
    texts = list(enumerate(texts))
    want = {i: x[1] for i, x in near_rows(texts, 3, 85).items()}
    assert sum(i != x for i, x in want.items()) == 40
    got = near_dedup.link(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("rows, percent", [(2048, 85), (7, 80)])
def test_rare_pairs_lose_none(spark, monkeypatch, rows, percent):
    """Sets of all sizes around a few templates: every pair at the limit is met; those that only share a template aren't."""
    monkeypatch.setattr(near_dedup, "ROWS", rows)
    r = np.random.default_rng(8)
    number = lambda n: r.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    sets = []
    for template in [number(80), number(200), number(7), number(1)]:
        for _ in range(60):
            stay = template[r.random(len(template)) > r.choice([0, 0.03, 0.1])]
            sets.append(np.unique(np.concatenate([stay, number(int(r.integers(0, 2 + len(template) // 4)))])))
    apart = number(100)
    sets += [np.unique(np.concatenate([apart, number(30)])) for _ in range(120)]
    sets = [x for x in sets if len(x)]
    full = spark.createDataFrame([(i, bytearray(x.tobytes()), i // 2) for i, x in enumerate(sets)], "id long, items binary, root long")
    got = {(p["a"], p["b"]) for p in near_dedup.rare_pairs(full.repartition(3), percent).collect()}
    want = set()
    for b, y in enumerate(sets):
        for a, x in enumerate(sets[:b]):
            both = len(np.intersect1d(x, y))
            if a // 2 != b // 2 and 100 * both >= percent * (len(x) + len(y) - both):
                want.add((a, b))
    assert len(want) > 100
    assert want <= got
    assert not [p for p in got if p[0] >= len(sets) - 120]


def test_near_asks_only_crowded_sets(spark, monkeypatch):
    """What the filter of crowded regions lets through by chance costs time: only sets of crowds may be asked, however much passes."""

    class Everything:
        def test(self, column):
            return F.lit(True)

    r = random.Random(4)
    words = lambda n, stem: [f"{stem}{r.randrange(10**9)}" for _ in range(n)]
    template = words(300, "t")
    texts = [(i, " ".join([*template, *words(100, "own")])) for i in range(40)] + [(i, " ".join(words(50, "w"))) for i in range(40, 140)]
    asked, plain = [], near_dedup.rare_pairs
    monkeypatch.setattr(near_dedup, "members", lambda hashed, n: Everything())
    monkeypatch.setattr(near_dedup, "rare_pairs", lambda full, percent: asked.extend(x.id for x in full.select("id").collect()) or plain(full, percent))
    got = near_dedup.link(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {(x.doc_id, x.component_id) for x in got.collect()} == {(i, i) for i, _ in texts}
    assert asked and len(asked) == len(set(asked)) and set(asked) <= set(range(40))


def test_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK", 40)
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(120)] + [(r.randrange(500, 700), r.randrange(500, 700)) for _ in range(90)] + [(900, x) for x in range(901, 930)]
    r.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()))
    assert got == {x: find(x) for x in list(parent) if find(x) != x}


def window_rows(texts, width):
    """doc: (words, removed, hash), by the definition; rows of one id are one document."""
    docs = sorted(dict(texts).items())
    first, out = {}, {}
    words = {i: SOLID.findall(t or "") for i, t in docs}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - width + 1):
            if first.setdefault(tuple(w[j : j + width]), (i, j)) != (i, j):
                gone.update(range(j, j + width))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substrings(docs, texts, batches):
    got = substring_dedup.report(docs, batches=batches).collect()
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == window_rows(texts, 20)


def test_substrings_of_nothing(empty, no_id):
    assert substring_dedup.report(empty).count() == 0
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.report(no_id).collect()) == Counter({(None, 2, 0): 2, (None, 0, 0): 1, (4, 2, 0): 1})


def byte_rows(texts, width):
    seen, out = set(), {}
    for i, t in sorted(dict(texts).items()):
        b, own = (t or "").encode(), set()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - width + 1):
            own.add(b[j : j + width])
            if b[j : j + width] in seen:
                gone[j : j + width] = True
        seen |= own
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("group", [2000, 1])
def test_bytes(docs, texts, group):
    from weftgraph.llm import repeats as R

    rows = R.plain(docs)
    got = R.report(rows, R.BYTES50, suffix_dedup.removed_strings(rows, group=group)).collect()
    assert {r["doc"]: (r["n"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == byte_rows(texts, 50)


@pytest.mark.parametrize("group", [2000, 1])
def test_bytes_repeated_inside_a_document(spark, group):
    """A passage that an earlier document holds stands in a later one twice, with what follows it there."""
    from weftgraph.llm import repeats as R

    r = random.Random(7)
    some = lambda n: "".join(r.choices("abcdefghij ", k=n))
    texts = []
    for i in range(20):
        passage, then = some(r.randint(50, 90)), some(r.randint(50, 90))
        texts.append((2 * i, some(70) + passage + some(70)))
        texts.append((2 * i + 1, "".join(some(60) + passage + then for _ in range(2 + i % 3)) + some(60)))
    rows = R.plain(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    got = R.report(rows, R.BYTES50, suffix_dedup.removed_strings(rows, group=group)).collect()
    assert {r["doc"]: (r["n"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == byte_rows(texts, 50)


def test_bytes_of_nothing(empty, no_id):
    assert suffix_dedup.report(empty).count() == 0
    assert sum(r["n_removed"] for r in suffix_dedup.report(no_id).collect()) == 0


def test_other_widths(spark):
    r = random.Random(4)
    texts = [(i, "".join(r.choices("ab", k=r.randint(0, 60)))) for i in range(40)]
    unit = Unit(False, 9, 3, False)
    got = suffix_dedup.report(spark.createDataFrame(texts, "doc_id long, text string"), unit).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == byte_rows(texts, 9)


def test_run_index_against_search():
    r = random.Random(5)
    for _ in range(20):
        width = r.randint(7, 12)
        texts = [bytes(r.choices(b"ab\x00", k=r.randint(width, 40))) for _ in range(12)]
        value = np.arange(12)
        index = RunIndex(texts, value, width)
        least, first = index.least_values(np.arange(12))
        for i in range(12):
            want = [min(j for j in range(12) if texts[i][k : k + width] in texts[j]) for k in range(len(texts[i]) - width + 1)]
            assert least[first[i] : first[i] + len(want)].tolist() == want


@pytest.mark.parametrize("symbols", [40, 120, 250])
def test_suffixes_of_a_shard_are_sorted_as_single_words(monkeypatch, symbols):
    """A shard's keys fit in one word with their positions, however many symbols there are, and the order is that of the suffixes."""
    r = random.Random(symbols)
    texts = [bytes(r.choices(range(1, symbols), k=80)) for _ in range(60)]
    texts = [x[: r.randint(50, 80)] for _ in range(suffix_dedup.SHARD // 60) for x in texts]
    room, seen, plain = [], [], run_index._sorted
    monkeypatch.setattr(run_index, "_sorted", lambda key, bits: seen.append(bits) or room.append((len(key) - 1).bit_length()) or plain(key, bits))
    index = RunIndex(texts, np.arange(len(texts)), 50)
    assert all(x + y < 64 for x, y in zip(seen, room, strict=True))
    asked = np.arange(0, len(texts), 97)
    least, first = index.least_values(asked)
    holders = {}
    for i, x in enumerate(texts):
        for j in range(len(x) - 49):
            holders.setdefault(x[j : j + 50], i)
    assert least.tolist() == [holders[texts[i][j : j + 50]] for i in asked for j in range(len(texts[i]) - 49)]
    assert first.tolist() == [sum(len(texts[k]) - 49 for k in asked[:i]) for i in range(len(asked))]
