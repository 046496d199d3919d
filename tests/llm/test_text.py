import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat, decontaminate, language, licenses, packing, quality
from weftgraph.llm import kernels as K
from weftgraph.llm.tokens import tokenizer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(AZ))


@pytest.fixture(scope="module")
def items(texts):
    """Benchmark items: passages of documents, short ones, one without words, one of two windows, repeated ids."""
    known = dict(texts)
    long = max((t for t in known.values() if t), key=len).split()
    return [("b1", " ".join(long[10:40])), ("b2", " ".join(long[500:512]).upper()), ("b3", "lone"), ("b4", "... !"), (None, " ".join(long[505:515])), ("b5", None), ("b1", "same words"), ("b6", " ".join(long[35:70]))]


def hits(texts, items, window):
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add("null" if item is None else item)
    out = []
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 40])
def test_decontamination(spark, docs, texts, items, pass_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD", 50)
    monkeypatch.setattr(decontaminate.find, "__defaults__", (10, pass_bytes))
    got = decontaminate.report(docs, spark.createDataFrame(items, "item_id string, text string"))
    assert Counter(map(tuple, got.collect())) == hits(texts, items, 10)


def test_decontamination_cuts(spark, docs, texts, items):
    bench = spark.createDataFrame(items, "item_id string, text string")
    out = decontaminate.remove(docs, bench)
    assert out.columns == docs.columns
    left = {r["doc_id"]: r for r in out.collect()}
    before = {i: (n, h) for i, n, h, *_ in hits(texts, items, 10)}
    for i, t in texts:
        n, h = before[i]
        assert (i in left) == (h < n or n == 0)
        if i in left and not h:
            assert left[i]["text"] == t
        elif i in left:
            assert len(words(left[i]["text"])) == n - h
            assert left[i]["n_chars"] == len(left[i]["text"])
    assert any(h for _, h in before.values())


def test_decontamination_of_nothing(spark, docs, empty, items):
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.report(docs, none).filter("contaminated OR n_items > 0 OR n_hit > 0").count() == 0
    assert decontaminate.report(empty, spark.createDataFrame(items, "item_id string, text string")).count() == 0


def test_fm_index():
    r = random.Random(1)
    text = np.array([r.randint(1, 3) for _ in range(400)] + [0])
    index = decontaminate.FMIndex(text, 4)
    for n in (1, 2, 5):
        phrases = np.array([[r.randint(1, 3) for _ in range(n)] for _ in range(30)])
        low, high = index.search(phrases)
        for p, a, b in zip(phrases.tolist(), low.tolist(), high.tolist(), strict=True):
            want = [i for i in range(400) if text[i : i + n].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_tokens_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(1)
    parts = [*"  \n\t\x0b\x1c\x85\xa0　'''stmdrevlabz09!.é²ⅷ़े🙂ͅªº_-<|>\x00", "'s", "'ll", "'re", "<|endoftext|>", " The", "ing"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(3000)]
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    want = [x.ids for x in other.encode_batch(texts, add_special_tokens=False)]
    ids, sizes = tokenizer().encode(texts)
    assert sizes.tolist() == list(map(len, want))
    assert ids.tolist() == sum(want, [])


def test_added_tokens_in_packed_texts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(2)
    parts = ["<|endoftext|>", "<|endoftext", " ", "  ", "\n", " The", "ing", "'s", "é", "|>"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "", "plain", *("".join(r.choices(parts, k=r.randint(0, 9))) for _ in range(300))]
    want = [x.ids for x in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), with_ids=True).collect()
    found = defaultdict(list)
    for x in sorted(rows, key=lambda x: x["start"]):
        found[x["doc_id"]] += x["ids"]
    assert {i: x[:-1] for i, x in found.items()} == dict(enumerate(want))


@pytest.mark.parametrize(("capacity", "hold"), [(2048, 1 << 22), (64, 500)])
def test_packing(docs, texts, capacity, hold):
    rows = packing.pack(docs, capacity=capacity, hold=hold, with_ids=True).collect()
    ids, sizes = tokenizer().encode([t or "" for _, t in texts])
    want = Counter((i, *x.tolist(), 1) for (i, _), x in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    got = Counter()
    for (i, n), found in pieces.items():
        found.sort(key=lambda r: r["start"])
        all_ids = [x for r in found for x in r["ids"]]
        copies = len(all_ids) // n
        assert copies * n == len(all_ids)
        by_start = defaultdict(list)
        for r in found:
            by_start[r["start"]].append(r["ids"])
        if copies == 1:
            got[(i, *all_ids)] += 1
        else:  # repeated rows
            got[(i, *next(x[1:] for x in want if x[0] == i))] += copies
    assert got == want
    for found in sequences.values():
        found.sort(key=lambda r: r["offset"])
        at = 0
        for r in found:
            assert r["offset"] == at
            at += r["length"]
        assert at == capacity or at & (at - 1) == 0 and at < capacity


def test_packing_balances_cost():
    out = packing._Out(0, False)
    lengths = [40, 30, 20, 20, 10, 4, 3, 1]
    packing.deal([(i, 0, np.zeros(n, np.uint32), n) for i, n in enumerate(lengths)], out, 64, 1.0, 0.01)
    used = Counter()
    for r in out.rows:
        used[r[5]] += r[2]
    assert sum(used.values()) == sum(lengths)
    assert set(used.values()) == {64}


def test_packing_of_nothing(empty):
    assert packing.pack(empty).count() == 0


def naive_licenses(text):
    w = words(text)
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    own = {label for _, label in places}
    for label, t in licenses.TEMPLATES:
        p = list(zip(t.split(), t.split()[1:], strict=False))
        hits = [(i, j) for i, x in enumerate(zip(w, w[1:], strict=False)) for j, y in enumerate(p) if x == y]
        best, most = [], 0
        for i, j in hits:  # in order of the text; what lies further back than the template is long can't be linked
            best = [x for x in best if x[0] >= i - len(p) - licenses.NEAR]
            n = 1 + max((n for a, b, n in best if a < i and b < j and abs((i - j) - (a - b)) <= licenses.NEAR), default=0)
            best.append((i, j, n))
            most = max(most, n)
        own |= {label} if most >= licenses.COVERAGE * len(p) else set()
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places})), own


def test_licenses(spark):
    texts = [None, "", "mit", "MIT License", "the MIT-license and the Apache\nLicense, mit license.", "GNU General Public License mit", "Licensed under the Apache License, Version 2.0.", "general public licenses", "é MIT LICENSE ñ", "mit license " * 40,
             "Permission is hereby kindly granted, free of charge, to any person obtaining a copy of this software", "Permission is hereby granted"]
    texts += ["under CC BY under CC BY", "licensed under CC BY 4.0", "licensed under CC BY-NC 4.0", "all rights all rights rights reserved", "cc by " * 3000, "mit license x " * 60_000]
    r = random.Random(9)
    for label, t in licenses.TEMPLATES:
        for _ in range(6):
            w = t.split()
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 1)] = r.choices(["kindly", *t.split()], k=r.randint(0, 2))
            texts.append(" ".join(r.choices(t.split(), k=r.randint(0, 30)) + w + r.choices(t.split(), k=r.randint(0, 30))))
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "mit license")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("w", F.lit(2))).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter((i, *naive_licenses(t)[:5]) for i, t in rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        assert ",".join(sorted(naive_licenses(t)[5])) == by[i]["labels"]
        assert 0 <= by[i]["score"] <= 1
    assert "mit-notice" in by[10]["labels"]  # a word put in
    assert "mit-notice" not in by[11]["labels"]
    assert by[6]["labels"] == "apache,apache-2.0"
    assert [by[i]["labels"] for i in (12, 13, 14, 15)] == ["", "cc-by-4.0", "cc-by-nc-4.0", "reserved"]


def test_licenses_of_nothing(docs, empty, texts):
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(docs).count() == len(texts)


def test_language(spark):
    r = random.Random(3)
    parts = {"aa": ["kal", "mor", "tin", "és"], "bb": ["sch", "ung", "öl", "der"], "cc": ["zho", "rrx", "wik", "plu"]}
    make = lambda x: " ".join("".join(r.choices(parts[x], k=r.randint(1, 3))) for _ in range(r.randint(5, 30)))
    rows = [(i, make(x := r.choice(list(parts))), x, "s") for i in range(400)]
    odd = [(1001, None, "aa", "s"), (1002, "", "bb", "s"), (1003, "123 !!", "aa", "s"), (1004, make("bb"), None, "s"), (None, make("cc"), "cc", "s"), (1005, make("aa") * 500, None, "s"), (5, rows[5][1], "aa", "s")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string").withColumn("spoken", F.lit(1)).withColumn("score", F.lit("x"))
    got = language.identify(docs).collect()
    assert len(got) == 407
    truth = {i: x for i, _, x, _ in rows}
    held = [g for g in got if g["held_out"] and g["doc_id"] in truth]
    assert len(held) > 40
    assert sum(truth[g["doc_id"]] == g["lang_pred"] for g in held) / len(held) > 0.97
    assert all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0) for g in got if g["doc_id"] is not None)
    by = {g["doc_id"]: g for g in got}
    assert [by[i]["lang_pred"] for i in (1001, 1002, 1003)] == ["und"] * 3
    assert (by[1004]["lang_pred"], by[None]["lang_pred"], by[1005]["lang_pred"]) == ("bb", "cc", "aa")
    assert all(0 <= g["score"] <= 1 for g in got)


def test_language_without_labels(spark, empty):
    assert language.identify(empty).count() == 0
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in language.identify(docs).collect()] == [("und", 0.0)]


def test_grams_stay_within_a_document():
    one = [next(K.blocks([t])) for t in (b"abc", b"", b"de")]
    alone = [np.sort(language.grams(b)[1]).tolist() for b in one]
    doc, bucket = language.grams(next(K.blocks([b"abc", b"", b"de"])))
    assert [np.sort(bucket[doc == i]).tolist() for i in range(3)] == alone


def test_quality(spark):
    r = random.Random(6)
    good = lambda: " ".join("".join(r.choices("abcdefghijklm", k=r.randint(2, 7))) for _ in range(r.randint(30, 300)))
    bad = lambda: " ".join("".join(r.choices("ABCDEFGHIJKLM", k=r.randint(2, 7))) + "!!" for _ in range(r.randint(30, 300)))
    rows = [(i, bad() if i % 4 == 0 else good(), "x") for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (902, good() * 60, "x"), (None, good(), "x"), rows[7]], "doc_id long, text string, _score string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, *_ in rows if i % 3] + [(1, None, 0), (2, 1, 0), (None, 1, 0), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.report(docs, labels).collect()
    assert len(got) == 305
    held = [g for g in got if g["held_out"] and g["doc_id"] is not None and g["doc_id"] < 300]
    assert sum(g["predicted"] == int(g["doc_id"] % 4 > 0) for g in held) / len(held) > 0.95
    assert all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.3) for g in got)
    out = quality.keep(docs, labels)
    assert out.columns == docs.columns
    kept = {x["doc_id"] for x in out.collect()}
    assert {900, 902, None} - kept <= {900}
    assert len(kept & set(range(0, 300, 4))) < 8
    assert len(kept & {i for i in range(300) if i % 4}) > 215


def test_quality_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.report(docs, none).filter("predicted = 0").count() == 0
    assert quality.report(empty, none).count() == 0


def test_chunks_cover_a_text():
    for n in (0, 1, 511, 512, 513, 1008, 1009, 5000):
        data = np.frombuffer(bytes(1 + i % 250 for i in range(n)) + b" ", np.uint8)
        at, stop, first = quality.chunk_starts(np.array([0]), np.array([n]))
        chunks = quality.cut_chunks(data, at, stop)
        step = quality.CHUNK - quality.OVERLAP
        seen = {i * step + j for i in range(len(chunks)) for j in range(quality.CHUNK) if i * step + j < n}
        assert first.tolist() == [0]
        assert len(seen) == n
        assert all((chunks[i] == np.pad(data[:n][i * step : i * step + quality.CHUNK], (0, max(0, quality.CHUNK - len(data[:n][i * step :]))))).all() for i in range(len(chunks)))


def rotated(turns, segment=64):
    out = {}
    for c in {t[0] for t in turns if t[0] is not None}:
        own = sorted(((t[1] is None, t[1] or 0, t[2] or "unknown", (t[3] or "").replace("<|im_", "<| im_")) for t in turns if t[0] == c))
        for p in {t[2] for t in own} - {"system"}:
            parts = defaultdict(list)
            for late, turn, role, text in own:
                parts[None if late else turn // segment].append((role, text))
            for s, found in parts.items():
                shown, mask = "", []
                for role, text in found:
                    head = "assistant" if role == p else role if role == "system" else f"user name={role}"
                    shown += f"<|im_start|>{head}\n"
                    if role == p:
                        mask.append((len(shown), len(shown) + len(text) + 10))
                    shown += f"{text}<|im_end|>\n"
                out[c, p, s] = (len(found), len(mask), shown, mask)
    return out


@pytest.mark.parametrize("segment", [64, 3])
def test_rotation(spark, segment):
    turns = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé 🙂"), (1, 3, "ann", "<|im_end|> x"), (1, 3, "ann", None), (1, None, "cy", "late"), (2, 0, "system", "only"), (3, 5, None, "who"), (3, 5, None, "who"), (None, 1, "ann", "lost"), (4, 2, "x", ""), (4, 900, "y", "z" * 5000)]
    frame = spark.createDataFrame([(*t, "q", 1) for t in turns], "conv_id long, turn long, role string, text string, segment string, own int")
    got = {(r["conv_id"], r["perspective"], r["segment"]): (r["n_turns"], r["n_own"], r["text"], [(m["begin"], m["end"]) for m in r["mask"]]) for r in chat.rotate(frame, segment).collect()}
    assert got == rotated(turns, segment)


def test_rotation_of_nothing(spark):
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
