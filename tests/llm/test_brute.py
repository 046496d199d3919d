"""Operators that SQL can't express against plain loops, and texts longer than a kernel's block."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from weftgraph.llm import decontaminate, exact_dedup, language, licenses, near_dedup, packing, quality, repeats, substring_dedup, suffix_dedup, tokens
from weftgraph.llm import kernels as K

SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(n, x="a", y="b"):
    return "".join(x if bin(i).count("1") % 2 == 0 else y for i in range(n))


def test_words_of_any_form_have_different_hashes():
    for n in (512, 1024, 2048, 4096, 8192):
        block = next(K.blocks([f"{thue_morse(n)} {thue_morse(n, 'b', 'a')} {thue_morse(n)}".encode()]))
        h = K.words(block, K.SOLID, K.CODES).hash
        assert h[0] != h[1] and h[0] == h[2]


def test_word_hashes_do_not_depend_on_parts():
    long = "x" * (3 * K.BLOCK) + "y"
    alone = K.words(next(K.blocks([long.encode()])), K.SOLID, K.CODES).hash
    later = K.words(next(K.blocks([("a b " * K.BLOCK + long + " c").encode()])), K.SOLID, K.CODES).hash
    assert alone[0] == later[-2]


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_token_ids_of_periodic_words(n):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"{thue_morse(n)} {thue_morse(n, 'b', 'a')}", thue_morse(n, "b", "a"), "é" * 300_000 + " x"]
    ids, sizes = tokens.tokenizer().encode(texts, added=True)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_periodic_words_stay_apart(spark):
    """Words that powers of a base would take for each other, in the operators that compare words by hash."""
    one, two = thue_morse(1024), thue_morse(1024, "b", "a")
    fill = [f"w{i}" for i in range(30)]
    texts = [(0, " ".join([one, *fill])), (1, " ".join([two, *fill[:19], "z"])), (2, " ".join([two, *fill[:9]])), (3, one), (4, two)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    near = {r["doc_id"]: r["component_id"] for r in near_dedup.link(docs, 3, 85).collect()}
    assert near == {i: i for i in range(5)}
    cut = {r["doc_id"]: r["n_removed"] for r in substring_dedup.report(docs).collect()}
    assert cut == dict.fromkeys(range(5), 0)
    items = spark.createDataFrame([("i", " ".join([one, *fill[:9]]))], "item_id string, text string")
    hit = {r["doc_id"]: r["n_hit"] for r in decontaminate.report(docs, items).collect()}
    assert hit == {0: 10, 1: 0, 2: 0, 3: 0, 4: 0}


def bucket(gram):
    """The bucket of one n-gram, by whole numbers."""
    m = (1 << 64) - 1

    def mix(x):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & m
        x ^= x >> 32
        x = x * 0xA0761D6478BD642F & m
        return x ^ x >> 29

    h = 0
    for c in gram:
        h = (h * int(K.BASE) + mix(int.from_bytes(c.encode(), "big") + 0x51ED27)) & m
    return mix((h + len(gram)) & m) >> 49


def plain_grams(text):
    t = " " + re.sub(r"[\x20\x09-\x0D]", " ", text).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) + " "
    return Counter(bucket(t[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(t) - n + 1))


def test_language_against_plain_counts(spark):
    r = random.Random(12)
    words = {"aa": ["kal", "Mor", "tín", "भाषा"], "bb": ["sch", "ung", "öl", "語文"], "cc": ["kal", "ung", "語", "भा"]}
    rows = [(i, " \t".join(r.choices(words[x], k=r.randint(1, 8))), x) for i in range(120) for x in [r.choice(["aa", "bb", "bb", "cc"])]]
    rows += [(500, "kal ung 語 " * 40_000, None), (501, "", "aa"), (502, "१२", "aa")]
    got = {g["doc_id"]: g for g in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    counts, number = defaultdict(Counter), Counter()
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 5:
            counts[lang] += plain_grams(t)
            number[lang] += 1
    names = sorted(counts)
    size = {x: sum(counts[x].values()) + 0.5 * language.BUCKETS for x in names}
    for i, t, _ in rows:
        g = plain_grams(t)
        n, prior = sum(g.values()), [math.log(number[x] / sum(number.values())) for x in names]
        sums = [sum(k * math.log((counts[x][b] + 0.5) / size[x]) for b, k in g.items()) for x in names]
        full = [s + p for s, p in zip(sums, prior, strict=True)]
        best = full.index(max(full))
        mean = [s / n * min(n, 256) + p for s, p in zip(sums, prior, strict=True)]
        p = [math.exp(x - max(mean)) for x in mean]
        if i in (501, 502):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
        else:
            assert got[i]["lang_pred"] == names[best]
            assert got[i]["score"] == pytest.approx(p[best] / sum(p), abs=2e-3)


def plain_logit(net, text):
    step, answers = quality.CHUNK - quality.OVERLAP, []
    for i in range(max(1, -(-(len(text) - quality.OVERLAP) // step))):
        chunk = (text[i * step : i * step + quality.CHUNK]).ljust(quality.CHUNK, b"\0")
        row = []
        for f in range(quality.FILTERS):
            best = max(sum(float(net.vectors[chunk[at + w]] @ net.filters[w * quality.DIMS : (w + 1) * quality.DIMS, f]) for w in range(quality.WIDTH)) for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE))
            row.append(max(best + float(net.bias[f]), 0.0))
        answers.append(row)
    a = np.array(answers)
    return float(np.concatenate([a.mean(axis=0), a.max(axis=0)]) @ net.head + net.offset[0])


def test_quality_network_against_plain_loops(monkeypatch):
    monkeypatch.setattr(quality, "FILTERS", 5)
    r = random.Random(8)
    net = quality.fresh()
    net.bias[:] = np.linspace(-1, 1, 5)
    texts = [bytes(r.choices(range(256), k=n)) for n in (0, 1, 512, 513, 1300)]
    block = next(K.blocks(texts))
    got = quality.logits(net, block.data, block.begin, block.end)
    assert np.allclose(got, [plain_logit(net, t) for t in texts], atol=1e-3)


def test_quality_gradients_against_differences(monkeypatch):
    monkeypatch.setattr(quality, "FILTERS", 4)
    r = np.random.default_rng(3)
    net = quality.Network(*(p.astype(np.float64) for p in quality.fresh().parts()))
    chunks, owner, label = r.integers(0, 40, (5, quality.CHUNK)).astype(np.uint8), np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        top, _ = quality.pooled(net, chunks)
        first = np.searchsorted(owner, np.arange(3))
        x = np.hstack([np.add.reduceat(top, first, axis=0) / np.diff(np.append(first, 5))[:, None], np.maximum.reduceat(top, first, axis=0)])
        p = 1 / (1 + np.exp(-(x @ net.head + net.offset)))
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p)) + 0.5e-4 * (net.head**2).sum()

    found = quality._gradients(net, chunks, owner, 3, label)
    for part, g in zip(net.parts(), found, strict=True):
        flat = part.reshape(-1)
        for k in r.choice(len(flat), min(12, len(flat)), replace=False):
            keep = flat[k]
            flat[k] = keep + 1e-6
            up = loss()
            flat[k] = keep - 1e-6
            down = loss()
            flat[k] = keep
            assert np.reshape(g, -1)[k] == pytest.approx((up - down) / 2e-6, abs=2e-5)


@pytest.fixture(scope="module")
def long_texts():
    """Texts several blocks long that share passages with each other and with short ones."""
    r = random.Random(21)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(4000)] + ["naïve", "語文"]
    base = r.choices(vocabulary, k=110_000)
    changed = list(base)
    for at in range(500, 110_000, 9000):
        changed[at] = "new"
    return [(0, " ".join(base)), (1, " ".join(base[70_000:70_060])), (2, " ".join(changed)), (3, " ".join(base).replace(" ", " \n", 50)), (4, "x" * 700_000), (5, " ".join(r.choices(vocabulary, k=60) + base[109_000:]))]


@pytest.fixture(scope="module")
def long_docs(spark, long_texts):
    assert len(long_texts[0][1]) > 2 * K.BLOCK
    return spark.createDataFrame(long_texts, "doc_id long, text string").repartition(2).cache()


def test_long_texts_in_dedup(long_docs, long_texts):
    exact = {r["doc_id"]: r["keep_id"] for r in exact_dedup.decide(long_docs).collect()}
    assert exact == {0: 0, 1: 1, 2: 2, 3: 0, 4: 4, 5: 5}
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.link(long_docs, 3, 85).collect()}
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} or {tuple(w)} for i, t in long_texts for w in [SOLID.findall(t)]}
    assert near == {i: (len(x), {2: 0, 3: 0}.get(i, i)) for i, x in sets.items()}


def removed(symbols, width, later):
    first, out = {}, {}
    for i, w in symbols:
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - width + 1):
            if later(first.setdefault(tuple(w[j : j + width]) if isinstance(w, list) else w[j : j + width], (i, j)), (i, j)):
                gone[j : j + width] = True
        out[i] = int(gone.sum())
    return out


def test_long_texts_in_substring_operators(long_docs, long_texts):
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.report(long_docs).collect()}
    assert got == removed([(i, SOLID.findall(t)) for i, t in long_texts], 20, lambda a, b: a < b)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.report(long_docs).collect()}
    assert got == removed([(i, t.encode()) for i, t in long_texts], 50, lambda a, b: a[0] < b[0])


def test_long_texts_in_scans(spark, long_docs, long_texts):
    item = " ".join(SOLID.findall(long_texts[0][1])[90_000:90_012])
    hits = {r["doc_id"]: r["n_hit"] for r in decontaminate.report(long_docs, spark.createDataFrame([("i", item)], "item_id string, text string")).collect()}
    assert hits == {0: 12, 1: 0, 2: 12, 3: 12, 4: 0, 5: 0}
    assert {r["doc_id"]: r["n_words"] for r in licenses.scan(long_docs).collect()} == {i: len(SOLID.findall(t)) for i, t in long_texts}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in packing.pack(long_docs, with_ids=True).collect():
        pieces[r["doc_id"]].append((r["start"], r["ids"]))
    for i, t in long_texts:
        assert [x for _, ids in sorted(pieces[i]) for x in ids] == [*library.encode(t, add_special_tokens=False).ids, 1]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    assert quality.report(long_docs, labels).count() == 6


@pytest.mark.parametrize("unit", [repeats.WORDS20, repeats.BYTES50])
def test_requested_windows_come_a_block_at_a_time(unit):
    """Each requested window with the hash that it has alone, those beyond a text's end left out; short and empty texts between."""
    r = random.Random(11)
    texts = [" ".join(r.choices(["a", "bc", "déf"], k=r.choice([0, 3, 19, 20, 21, 90]))) for _ in range(40)]
    asked = [[(at, r.randint(1, 4)) for at in sorted(r.sample(range(120), 3))] if i % 3 else [] for i, _ in enumerate(texts)]
    lists = [pa.array([[x[k] for x in a] for a in asked], t) for k, t in ((0, pa.list_(pa.int64())), (1, pa.list_(pa.int32())))]
    fresh = pa.array([[x[0] % 2 == 0 for x in a] for a in asked], pa.list_(pa.bool_()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100, 140)), pa.array(texts), *lists, fresh], ["doc", "text", "start", "c", "fresh"])
    out = list(repeats._windows(unit)([batch]))
    assert len(out) == 1
    want = []
    for i, (text, a) in enumerate(zip(texts, asked, strict=True)):
        h = unit.symbols(next(K.blocks([text.encode()])))[0][: None if unit.words else len(text.encode())]
        alone = repeats.window_hashes(unit, h).view(np.int64).tolist()
        want += [(alone[j], 100 + i, j, at % 2 == 0) for at, c in a for j in range(at, at + c) if j < len(alone)]
    assert want and [(x["w"], x["doc"], x["start"], x["fresh"]) for x in out[0].to_pylist()] == want


def test_words_without_hashes_stand_where_those_with_them_do():
    block = next(K.blocks(["one  two\tthree".encode(), b"", b" x "]))
    with_, without = K.words(block, K.SOLID, K.CODES), K.words(block, K.SOLID)
    assert all(np.array_equal(getattr(with_, x), getattr(without, x)) for x in ("begin", "end", "doc", "bounds"))


def test_runs_are_joined_and_compacted(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [r.choices(vocabulary, k=45) for _ in range(4)]
    texts = [(i, " ".join(r.choices(vocabulary, k=30) + passages[i % 4][: r.randint(20, 45)] + r.choices(vocabulary, k=20))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumnRenamed("doc_id", "doc")
    index = substring_dedup.FingerprintIndex(spark, buckets=4, fan=2)
    sizes, spans = [], []
    for low in range(0, 60, 12):
        batch = docs.filter(f"doc >= {low} AND doc < {low + 12}")
        spans += index.ingest(batch, docs.filter(f"doc < {low + 12}")).collect()
        sizes.append(len(index.runs))
    assert sizes == [1, 2, 1, 2, 1] and index.compactions == 2
    index.drop()
    got = defaultdict(set)
    for x in spans:
        got[x["doc"]] |= set(range(x["start"], x["start"] + x["c"] + 19))
    assert {i: len(got[i]) for i, _ in texts} == removed([(i, SOLID.findall(t)) for i, t in texts], 20, lambda a, b: a < b)


def test_common_line_in_many_texts(spark):
    """Every step of refinement: a line that stands in many texts, with other bytes around it each time."""
    r = random.Random(14)
    some = lambda n: "".join(r.choices("abcdefghij ", k=n))
    line = some(64)
    texts = [(i, some(r.randint(0, 80)) + line[r.randint(0, 9) :] + some(r.randint(0, 80))) for i in range(150)]
    texts += [(200 + i, texts[i][1][: r.randint(60, 120)]) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3).withColumnRenamed("doc_id", "doc")
    got = defaultdict(set)
    for x in suffix_dedup.removed_strings(docs, group=5).collect():
        got[x["doc"]] |= set(range(x["start"], x["start"] + x["c"] + 49))
    assert {i: len(got[i]) for i, _ in texts} == removed([(i, t.encode()) for i, t in texts], 50, lambda a, b: a[0] < b[0])
