"""Source divergence, SimHash links and the conversation trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from weftgraph.llm import divergence, graph, prefix_trie, sim_hash

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def least_reached(prints):
    """For each index the least index that fingerprints at 2 bits or less lead to."""
    parent = list(range(len(prints)))
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 2).tolist():
            a, b = find(parent, i), find(parent, j)
            parent[max(a, b)] = min(a, b)
    return [find(parent, i) for i in range(len(prints))]


def plain_print(text):
    w = SOLID.findall((text or "").translate(AZ))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, texts):
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"], r["kept"]) for r in sim_hash.link(docs).collect())
    ordered = sorted(texts, key=lambda x: x[0])
    prints = [plain_print(t) for _, t in ordered]
    root = least_reached(np.array(prints, np.uint64))
    assert got == Counter((i, f"{p:016x}", ordered[k][0], i == ordered[k][0]) for (i, _), p, k in zip(ordered, prints, root, strict=True))
    assert len({k for k in root}) < len(set(prints)), "no link between different fingerprints"


def test_simhash_without_ids(no_id, empty):
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in sim_hash.link(no_id).collect()}
    assert got == {(None, 4, False), (4, 4, True), (None, None, True)}
    assert sim_hash.link(empty).count() == 0


def test_simhash_of_a_long_text(spark):
    r = random.Random(2)
    text = " ".join(f"w{r.randint(0, 999)}" for _ in range(sim_hash.PART + 500))
    rows = spark.createDataFrame([(1, text), (2, text.replace(" ", "\n", 40))], "doc_id long, text string")
    assert [tuple(x) for x in sim_hash.link(rows).orderBy("doc_id").select("fingerprint", "component_id").collect()] == [(f"{plain_print(text):016x}", 1)] * 2


@pytest.mark.parametrize("hot", [sim_hash.HOT, 40, 0])
def test_simhash_crowds(spark, monkeypatch, hot):
    """Crowds around a few centres, and even fingerprints: whatever counts as crowded, components are those of all pairs."""
    monkeypatch.setattr(sim_hash, "HOT", hot)
    r = np.random.default_rng(8)
    near = np.repeat(r.integers(0, 1 << 63, 3, dtype=np.int64).astype(np.uint64), 500)
    for _ in range(5):
        near ^= np.uint64(1) << r.integers(0, 64, len(near)).astype(np.uint64)
    prints = np.unique(np.concatenate([near, r.integers(0, 1 << 63, 800, dtype=np.int64).astype(np.uint64), [np.uint64(0), np.uint64(2**64 - 1), np.uint64(3)]]))
    sets = spark.createDataFrame(list(zip(range(len(prints)), prints.view(np.int64).tolist(), strict=True)), "id long, fp long").repartition(3)
    roots = {x["node"]: x["root"] for x in graph.components(sim_hash.linked(sets)).collect()}
    assert [roots.get(i, i) for i in range(len(prints))] == least_reached(prints)


def test_thresholds_cost_least():
    r = np.random.default_rng(4)
    for parts in (2, 3, 4):
        cost = np.concatenate([np.zeros((parts, 1, 50)), r.random((parts, 3, 50)).cumsum(axis=1)], axis=1)
        units, best = sim_hash.allocate(cost)
        assert (units.sum(axis=0) == sim_hash.BITS + 1).all()
        every = [u for u in np.ndindex(*[4] * parts) if sum(u) == 3]
        assert np.allclose(best, np.min([sum(cost[p, u[p]] for p in range(parts)) for u in every], axis=0))
        assert np.allclose(best, cost[np.arange(parts)[:, None], units, np.arange(50)].sum(axis=0))


def test_correlated_bits_share_a_part():
    r = np.random.default_rng(1)
    bits = r.integers(0, 2, (4000, 64))
    for a in range(0, 60, 6):  # ten groups of six equal bits
        bits[:, a : a + 6] = bits[:, a : a + 1] ^ (r.random((4000, 6)) < 0.05)
    groups = sim_hash.correlated_parts((bits.T @ bits).astype(float), 4000, 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and [len(g) for g in groups] == [22, 21, 21]
    home = {b: i for i, g in enumerate(groups) for b in g}
    assert sum(len({home[b] for b in range(a, a + 6)}) == 1 for a in range(0, 60, 6)) >= 7


def plain_audit(rows):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(AZ)), lang or "", source or "") for t, lang, source in rows]
    held, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for w, lang, source in docs:
        held[lang].update(set(w))
        n[lang, source].update(w)
        n[lang, None].update(w)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, k in held[lang].items() if k >= divergence.LEAST]
        p = {s: {t: 1 + 10**9 * (n[lang, s][t] + 5) // (sum(n[lang, s][x] for x in kept) + 5 * len(kept)) for t in kept} for s in [*sources, None]}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - p[None][t], t) for t in kept if n[lang, s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                for i, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.add((lang, s, part, item, value, i + 1))
    return out


@pytest.mark.parametrize("sizes", [(4096, 64, 4, 8), (7, 2, 4, 1), (5, 3, 6, 2)])
def test_divergence(spark, monkeypatch, sizes):
    """Many slices, players and rounds give what one block gives; null and blank fields, ties, an empty language, odd letters."""
    for name, value in zip(("SLICE", "BLOCK", "PLAYERS", "LEG"), sizes, strict=True):
        monkeypatch.setattr(divergence, name, value)
    r = random.Random(6)
    words = ["Été", "naïve", "語文", "x", "Don't", "a_b", *("".join(r.choices("abcdefgh", k=3)) for _ in range(60))]
    rows = []
    for i in range(700):
        source = r.choice(["hot"] * 5 + [f"s{k}" for k in range(9)] + [None, ""])
        rows.append((r.choice([None, "", " ".join(r.choices(words[: 20 + i % 45], k=r.randint(1, 30)))]) if i % 9 == 0 else " ".join(r.choices(words[(i % 5) : 20 + i % 45], k=r.randint(1, 30))), r.choice(["en", "en", "de", None, ""]), source))
    rows += [("rare word", "xx", "a"), (None, "xx", "b"), ("12 !", "xx", "c"), ("only one", "yy", "z"), rows[0]]
    docs = spark.createDataFrame([(*x, 1, "t", 2, 3, 4) for x in rows], "text string, lang string, source string, n long, term string, slice int, player int, v int").repartition(3)
    got = [tuple(x) for x in divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows)


def test_divergence_of_nothing(empty):
    assert divergence.audit(empty).count() == 0


def test_shares_are_exact():
    n = np.array([0, 1, 10**10, 3 * 10**12], np.int64)
    assert divergence.shares(n, 5 * 10**12, 7).tolist() == [1 + 10**9 * (int(x) + 5) // (5 * 10**12 + 35) for x in n]


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = b"abc defghijklmnop q rs  tuv" * 5
    assert [t for part in divergence._pieces(text) for t in part] == text.split()


@pytest.mark.parametrize("players", [2, 4, 6, 10])
def test_every_two_players_meet_once(spark, players):
    rows = spark.createDataFrame([("l", 0, x, players, str(x), 0, 0, b"") for x in range(players)], "lang string, slice int, player int, players int, source string, total long, v long, vec binary")
    met = [frozenset((r["player"], int(r["source"]))) for r in divergence._visitors(rows, 0, players - 1).collect()]
    assert len(met) == len(set(met)) == players * (players - 1) // 2 and all(len(m) == 2 for m in met)
    for rnd in range(players - 1):
        assert sorted(divergence.partner(players, x, rnd) for x in range(players)) == list(range(players))


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, md5(md5(role or "") + md5(text or "")), (role or "", text or "")))
    convs = {c: [x[3] for x in sorted(turns)] for c, turns in convs.items()}
    nodes, kids, ends = defaultdict(list), Counter(), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built = tuple(convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:])
        ends[built].append(c)
        for d in range(len(built) + 1):
            nodes[built[:d]].append(c)
    leaves, saved = Counter(), Counter()
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] += not kids[k]
        saved[k] += (len(nodes[k]) - 1) * len(SOLID.findall(k[-1][1])) if k else 0
        if k:
            kids[k[:-1]] += 1
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in nodes.items())


TURNS = "conv_id long, turn long, role string, text string, rank long, digest string, up string, n long"


def test_trie(spark, monkeypatch):
    """Shared first turns, a conversation of a third of all rows, nulls, ties, repeated rows, absent first conversations."""
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    r = random.Random(3)
    rows = []
    for c in [*range(60), 200, 199, -3, -25, 107]:
        for t in range(r.choice([1, 2, 3, 5, 9])):
            rows.append((c, r.choice([t, t, None, 1]), r.choice(["user", "assistant", None, ""]), r.choice(["a b", "a  b c", None, "", "hello\tx y", " "])))
    rows += [(41, t, "user", f"w{t % 7} q") for t in range(120)] + [(41, 5, "user", "same row")] * 40
    rows += [(c, 1, "user", "one text") for c in range(300, 420)]  # one node where many end
    rows += [(None, 1, "user", "lost")] * 3 + rows[:4]
    frame = spark.createDataFrame([(*x, 9, "d", "u", 1) for x in rows], TURNS).repartition(5)
    assert sorted(tuple(x) for x in prefix_trie.trie(frame).collect()) == plain_trie(rows)


def test_trie_of_one_long_conversation(spark):
    """A chain of turns over all tasks: digests meet over the borders, and sums climb in few rounds."""
    rows = [(20, t, "user", f"{t} {t % 3}") for t in range(700)] + [(21, t, "user", f"{t} {t % 3}") for t in range(690)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    assert sorted(tuple(x) for x in prefix_trie.trie(frame).collect()) == plain_trie(rows)


def test_trie_of_nothing(spark):
    frame = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(frame).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x", 1, "", "", 1)], TURNS)).count() == 0
