"""The training-data operators: brute force, exact round trips, held-out accuracy, and the defined edge cases."""

import hashlib
import io
import math
import random
import re
import wave
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bagminhash, chat, decontam, language, media, pieces, quality, queries, sentencepiece_codec, token_counts, toxicity, words
from lodestone.llm.sharding import Conflict, ShardStore

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "***"), (4, "***"), (5, "one two"), (6, "one two"), (7, "Word " * 3000), (8, "漢字 😀 é \0 x"), (8, "漢字 😀 é \0 x"), (9, " \n\t ")]
COLUMNS = "doc_id bigint, text string, score string, ids string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, wordless, long and repeated texts, and extra columns with clashing names."""
    return spark.createDataFrame([(*r, "s", "i") for r in ODD], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# -- words ----------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text or "")


def test_words_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aBc É1.!  \n-") for _ in range(rng.randrange(300))) for _ in range(50)] + [None, ""]
    one = list(words.tokens(pa.array(texts), symbols=True, context=True))
    assert [len(plain_words(t)) for t in texts] == [n for t in words.tokens(pa.array(texts)) for n in np.diff(t.offsets)]
    monkeypatch.setattr(words, "CHUNK", 64)
    cut = list(words.tokens(pa.array(texts), symbols=True, context=True))
    assert len(cut) > len(one)
    assert (np.concatenate([t.hashes for t in cut]) == np.concatenate([t.hashes for t in one])).all()
    assert words.word_hash("ÉTÉ") == words.word_hash("été") != words.word_hash("ete")


# -- pieces ---------------------------------------------------------------------------------------

ALPHABET = "  \n\tabcdeé漢▁\0😀ist ing the  Ü"


def random_texts(n):
    rng = random.Random(3)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_pieces_equal_the_library():
    """Ids, counts and scores over all texts of sf0.01 and odd ones, by both readings of the public vocabulary."""
    import pyarrow.parquet as pq
    import sentencepiece

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist() + random_texts(500)
    figures = []
    for data in (pieces.model_bytes(), pieces.model_bytes(pieces.DEFAULT_MODEL)):
        lib, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Segmenter(pieces.Model(data))
        assert all(own.text[i] == lib.id_to_piece(i) and own.score[i] == lib.get_score(i) for i in range(0, 32000, 7))
        total = 0
        for t, want in zip(texts, lib.encode(texts), strict=True):
            ids = own.encode(t)
            assert ids == want
            n, score = own.count(t)
            assert n == len(ids) and score == sum(own.score[i] for i in ids if i not in own.byte_of) + own.unknown_score * unknowns(own, t)
            assert own.decode(ids) == t.replace("▁", " ")
            total += n
        assert own.decode(ids) == lib.decode(ids)
        figures.append(total)
    print("pieces, unigram and BPE:", figures, "bytes:", sum(len(t.encode()) for t in texts))


def unknowns(own, text):
    return sum(c not in own.single for c in text.replace(" ", "▁"))


def test_viterbi_equals_the_library_on_a_unigram_model():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto.FromString(pieces.model_bytes(pieces.DEFAULT_MODEL))
    m.trainer_spec.model_type = 1
    for i, p in enumerate(m.pieces):
        if p.type == 1:  # scores that float32 adds exactly, with ties
            p.score = -round(math.log(2 + i - 259) * 4) / 4
    data = m.SerializeToString()
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Segmenter(pieces.Model(data))
    for t in random_texts(800):
        assert own.encode(t) == lib.encode(t)
        n, score = own.count(t)
        assert n == len(lib.encode(t))


def test_codec_and_counts_on_odd_rows(odd):
    enc = sentencepiece_codec.encode(odd)
    assert enc.columns == ["doc_id", "text", "score", "ids", "n_pieces", "n_bytes", "roundtrip"]
    rows = enc.collect()
    assert len(rows) == len(ODD) and all(r.roundtrip for r in rows)
    assert {r.doc_id: r.n_pieces for r in rows if r.doc_id < 3} == {1: 0, 2: 0}
    back = {(r.doc_id, r.text) for r in sentencepiece_codec.decode(enc).collect()}
    assert back == {(i, t or "") for i, t in ODD}
    counts = token_counts.count_tokens(odd, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in counts) == sorted((r.doc_id, r.n_pieces) for r in rows)
    assert sentencepiece_codec.encode(odd.limit(0)).count() == token_counts.count_tokens(odd.limit(0)).count() == 0


# -- near duplicates ------------------------------------------------------------------------------


def bag(text):
    w = [x.lower() for x in plain_words(text)]
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def brute_classes(rows):
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [(i, bag(t)) for i, t in rows]
    for k, (i, a) in enumerate(bags):
        for j, b in bags[:k]:
            if similarity(a, b) >= 0.8:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i, _ in rows}


def test_near_copies_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in bagminhash.classes(docs).collect()}
    assert got == brute_classes(rows)
    assert len(set(got.values())) < len(got)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    """A chain of edits around one text: most pairs aren't linked, some only through others."""
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(bagminhash, "BLOCK", 8)
    got = {r.doc_id: r.class_id for r in bagminhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_classes(rows)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    agree = want = 0.0
    for _ in range(30):
        a, b = rng.integers(0, 9, 40), rng.integers(0, 9, 40)
        el = words.mix(rng.integers(1, 1 << 40, 40).astype(np.uint64))
        s = [bagminhash.sign(np.zeros((c > 0).sum(), np.int64), el[c > 0], c[c > 0], 1)[0] for c in (a, b)]
        agree += (s[0] == s[1]).mean() / 30
        want += np.minimum(a, b).sum() / np.maximum(a, b).sum() / 30
    assert agree == pytest.approx(want, abs=0.03)


def test_near_copies_on_odd_rows(odd, spark):
    got = Counter((r.doc_id, r.class_id) for r in bagminhash.classes(odd).collect())
    assert got == Counter([(1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7), (8, 8), (8, 8), (9, 9)])
    kept = bagminhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 7, 8, 9]
    assert bagminhash.classes(odd.limit(0)).count() == 0


def test_rows_that_share_a_doc_id(spark):
    """Rows (3, B), (5, A), (5, B), each text with near copies of its own; a copy goes, a text that nothing copies stays."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "ABCD"}
    near = text["A"] + " more"
    rows = [(3, text["B"], "x"), (5, text["A"], "y"), (5, text["B"], "z"), (9, near, "x"), (5, text["C"], "x"), (5, text["C"], "w"), (5, None, "x"), (None, text["B"], "n"), (4, "", "e"), (8, text["D"], "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, k1 string").repartition(3)
    got = Counter((r.doc_id, r.class_id) for r in bagminhash.classes(docs).collect())
    assert got == Counter([(3, 3), (5, 5), (5, 3), (9, 5), (5, 5), (5, 5), (5, 5), (4, 4), (8, 8)])
    kept = sorted((r.doc_id or 0, r.text or "") for r in bagminhash.keep_one(docs).collect())
    assert kept == sorted([(3, text["B"]), (5, text["A"]), (5, text["C"]), (5, ""), (0, text["B"]), (4, ""), (8, text["D"])])
    again = bagminhash.keep_one(docs.repartition(7)).where("text like 'C%'").collect()
    assert again == bagminhash.keep_one(docs).where("text like 'C%'").collect() and len(again) == 1


def test_hot_keys_take_the_other_join(spark, monkeypatch):
    """Many copies and a star of near copies, with the bound of hot keys at two rows."""
    from lodestone.llm import common

    monkeypatch.setattr(common, "HOT", 2)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base)) for i in range(40)] + [(100 + i, " ".join([*base[:99], f"x{i}"])) for i in range(40)] + [(200 + i, f"alone {i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in bagminhash.classes(docs).collect()}
    assert got == {i: 0 if i < 200 else i for i, _ in rows}
    assert sorted(r.doc_id for r in bagminhash.keep_one(docs).collect()) == [0, *range(200, 209)]


def test_components_of_paths_stars_and_random_links(spark, monkeypatch):
    from lodestone.llm import common

    monkeypatch.setattr(common, "HOT", 3)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    rng = random.Random(12)
    links = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(40)] + [(250 - i, 251 - i) for i in range(40)] + [(300 + rng.randrange(60), 300 + rng.randrange(60)) for _ in range(45)]
    order = rng.sample(range(400, 460), 60)
    links += list(zip(order, order[1:], strict=False)) + [(5, 5)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    want = {x: top(x) for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.label for r in bagminhash.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == want
    assert bagminhash.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_recall_of_all_similar_pairs(spark):
    """Every pair of sf0.01 at 0.8 or more, found by an exact join on shared shingles, is in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    bags, holders = {i: bag(t) for i, t in rows}, {}
    for i, b in bags.items():
        for x in b:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in holders.values() for k, b in enumerate(ids) for a in ids[:k]}
    similar = [(a, b) for a, b in pairs if similarity(bags[a], bags[b]) >= 0.8]
    label = {r.doc_id: r.class_id for r in bagminhash.classes(docs).collect()}
    found = sum(label[a] == label[b] for a, b in similar)
    print(f"pairs at 0.8 or more: {len(similar)}, in one class: {found}")
    assert len(similar) > 100 and found / len(similar) >= 0.999


# -- decontamination ------------------------------------------------------------------------------

ITEM = "Early on Monday the farmer Jones sold 12 kg of apples and then walked 12 km back to his barn with 30 dollars in hand"


def test_decontamination(spark, docs):
    found = decontam.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in r.text}
    assert exact and {(r.doc_id, r.item_id) for r in found} == exact
    bench = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, None), (4, ""), (5, "red green blue yellow black"), (6, "too short")], "item_id bigint, text string")
    again = ITEM.replace("12", "57").replace("Jones", "Smith").replace("30 dollars", "9 euros")
    texts = [(1, f"Before. {ITEM} After."), (2, f"some words here {again} and more"), (3, ITEM.replace("12 km", "13 km")), (4, None), (5, ""), (6, "now red green blue yellow black end"), (7, "too short"), (1, f"Before. {ITEM} After.")]
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontam.contamination(spark.createDataFrame(texts, "doc_id bigint, text string"), bench).collect()}
    assert got == {(1, 1): False, (1, 2): False, (2, 1): True, (2, 2): True, (6, 5): False}  # 3: one value of the item has two in the text
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in decontam.drop_contaminated(table, bench).collect()) == [3, 4, 5, 7]
    assert decontam.contamination(table, bench.limit(0)).count() == decontam.contamination(table.limit(0), bench).count() == 0


def _leaks(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r.reparameterised for r in decontam.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), bench).collect()}


def test_decontamination_of_passages_and_edited_copies(spark):
    words59, words15, other = ([f"{p}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n)] for p, n in (("w", 59), ("v", 15), ("u", 40)))
    cut = lambda a, b: " ".join(other[:9] + words59[a:b] + other[9:])
    edited = lambda at, *new: " ".join(other[:9] + words15[:at] + [*new] + words15[at + 1 :] + other[9:])
    texts = [cut(10, 48), cut(20, 33), cut(20, 32), edited(7, "changed"), edited(7), edited(7, words15[7], "more"), edited(4, "changed"), " ".join(other[:9] + words15[:7] + other)]
    assert _leaks(spark, [" ".join(words59), " ".join(words15)], texts) == {(0, 0): False, (1, 0): False, (3, 1): False, (4, 1): False, (5, 1): False, (6, 1): False}
    numbers = " ".join(["Put these in order please", *map(str, range(10, 24)), *words59])
    table = " ".join(map(str, range(50, 90)))
    assert _leaks(spark, [numbers], [table, " ".join(map(str, range(10, 24)))]) == {(1, 0): False}  # other values alone are no passage


def test_decontamination_of_copies_in_other_case(spark):
    short, nine = "What is the capital of France?", "What did the old king of Spain say then?"
    long = "Every day the careful gardener Miller carries water from the well behind the house to the roses at the gate"
    price = "The new machine of the mill cost 1,250,000 dollars and cut 3.5 tons of wood in a day"
    texts = [f'he asked "{short}"', f"then ({nine})", long.lower(), long.upper(), long.title(), price.replace("1,250,000", "900").replace("3.5", "12"), 'he asked "What is the capital of Spain?"', "she did the old thing"]
    got = _leaks(spark, [short, nine, long, price], texts)
    assert got == {(0, 0): False, (1, 1): False, (2, 2): False, (3, 2): False, (4, 2): False, (5, 3): True, (6, 0): True}
    for a, n in (("1,000 and 3.5.", 3), ("1, 2", 2), (",1", 1), ("a.b 1.", 3)):
        assert [len(t.hashes) for t in words.tokens(pa.array([a]), numbers=True)] == [n], a
    assert [list(np.diff(t.offsets)) for t in words.tokens(pa.array(["1", ",2", "3,", "4"]), numbers=True)] == [[1, 1, 1, 1]]
    assert [list(t.opens) for t in words.tokens(pa.array(["It is 3.5 Or so. Yes"]), context=True, numbers=True)] == [[True, False, False, False, False, True]]


def test_decontamination_needs_the_values_of_slots_without_words(spark):
    items = ["1 2 3 4 5 6 7 8", "What is 3 4 5 6 7 8 9 10 11 12 13 14 15"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = ["rows 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 end", "the table has 1 2 3 4 5 6 7 8 there", "20 21 22 23 24 25 26 27"]
    texts += ["he asked what is 3 4 5 6 7 8 9 10 11 12 13 14 15 again"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contamination(docs, bench).collect()} == {(1, 0), (3, 1)}


def test_decontamination_keeps_rows_and_names_apart(spark):
    twelve = "The careful gardener Jones sold 12 kg of ripe apples and 30 boxes of pears to the old mill of the town"
    bench = spark.createDataFrame([(0, twelve)], "item_id bigint, text string")
    rows = [(1, twelve), (1, twelve.replace("12", "57")), (2, twelve.replace("12", "3.5").replace("30", "1,250")), (3, twelve.replace("Jones", "Mary Ann Jones")), (4, twelve.replace("12", "-3")), (4, "nothing of it")]
    got = {r.doc_id: r.reparameterised for r in decontam.contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True}
    opening = "Jones sold the ripe apples of his garden and Jones bought 9 pears"
    other = "Mary Smith sold the ripe apples of his garden and Mary Smith bought 9 pears"
    assert _leaks(spark, [opening], [f"It rained. {other}.", other.replace("bought", "gave us")])[0, 0] is True
    # one value of the item may not have two in the text, wherever the windows lie
    long = " ".join(f"a{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30)).split()
    item = " ".join([*long[:10], "12", *long[10:20], "12", *long[20:]])
    cut = " ".join([*long[:10], "7", *long[10:15], "so", "it", "went", *long[15:20], "8", *long[20:]])
    kept = " ".join([*long[:10], "7", *long[10:15], "so", "it", "went", *long[15:20], "7", *long[20:]])
    got = {d: r for (d, _), r in _leaks(spark, [item], [cut, kept]).items()}
    assert got.get(1) is True
    hits = lambda d, at, values: [(32, 8, a, a + d, False, ["x"], [values]) for a in at]
    assert decontam.evidence(hits(0, range(5), "p") + hits(3, range(8, 13), "q") + hits(6, range(16, 21), "p")) is None  # 15 of 25 windows, 5 contradict
    assert decontam.evidence(hits(0, range(5), "p") + hits(3, range(8, 13), "p") + hits(6, range(16, 21), "p")) == (0.6, True)


def reparameterised_items(n):
    """Items with numbers, units and names, each with a text that has other values, and one that has the words of another item."""
    rng, vocabulary = random.Random(17), [a + b + c for a in ("ta", "mo", "ri", "se", "lu") for b in ("ber", "non", "vik", "dal") for c in ("ed", "is", "or")]
    names = ["Jones", "Mary Ann", "Smith", "Lopez", "Carla Ruiz", "Olaf", "Ingrid Berg"]
    out = []
    for _ in range(n):
        frame = [rng.choice(vocabulary) for _ in range(rng.randrange(14, 40))]
        slots = rng.sample(range(2, len(frame)), 3)
        old, new = rng.sample(names, 2)
        a, b = str(rng.randrange(2, 99)), rng.choice(["3.5", "1,250", "0.75", "640", "12,000.50"])
        fill = lambda name, number: " ".join(name if k == slots[0] else f"{number} kg" if k == slots[1] else number if k == slots[2] else w for k, w in enumerate(frame))  # noqa: E731, B023
        shuffled = frame[:]
        rng.shuffle(shuffled)
        out.append((fill(old, a), f"they asked us this. so {fill(new, b)} and that was all", " ".join(shuffled)))
    return out


def test_decontamination_finds_constructed_questions(spark):
    made = reparameterised_items(240)
    got = _leaks(spark, [m[0] for m in made], [m[1] for m in made] + [m[2] for m in made])
    found = sum(got.get((k, k)) is True for k in range(240))
    wrong = [x for x in got if x[0] != x[1]]
    print(f"re-parameterised items found: {found} of 240; other pairs reported: {len(wrong)} of {480 * 240 - 240}")
    assert found >= 228 and len(wrong) <= 2


# -- learned models -------------------------------------------------------------------------------


def test_toxicity(docs, labels, odd):
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.cuts) >= 0).all()
    rows = toxicity.score(docs, model, ["doc_id"]).withColumnRenamed("toxic", "said").join(labels, "doc_id").collect()
    assert sum(r.said == (r["toxic"] == 1) for r in rows) / len(rows) > 0.9
    assert all(0 <= r.severity <= 3 for r in rows)
    assert toxicity.score(odd, model).count() == len(ODD)
    none = toxicity.fit(odd, labels.limit(0))
    assert not any(r.toxic for r in toxicity.score(odd, none, ["doc_id"]).collect())


def test_ordinal_gradient_orders_grades():
    rng = np.random.default_rng(0)
    count = rng.integers(0, 9, 400)
    grade = np.digitize(count, [1, 4, 7])
    m = toxicity.fit_ordinal(np.arange(401), np.zeros(400, np.int64), np.log1p(count), grade, 4, 1)
    p = toxicity.sigmoid(np.log1p(np.arange(9))[:, None] * m.weights[0] - m.cuts).sum(axis=1)
    assert (np.diff(p) > 0).all() and p[0] < 0.5 and p[8] > 2.5


def test_quality(spark, odd, labels):
    sf = SF.replace("0.001", "0.01")
    scored = queries.op1_quality(spark, sf)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(held) > 30 and sum(r.predicted == r.quality for r in held) / len(held) > 0.9
    none = quality.score(odd, quality.fit(odd, labels.limit(0)), ["doc_id"]).collect()
    assert len(none) == len(ODD) and {r.score for r in none} == {0.5}


def test_language(spark, docs, odd):
    model = language.fit(docs)
    assert model.names == ["de", "en", "es", "fr"]
    got = language.identify(docs, model, F.col("text"), host=F.col("source")).collect()
    assert sum(r.language == r.lang for r in got) / len(got) > 0.97
    rows = {r.doc_id: (r.language, r.rejected) for r in language.identify(odd, model, F.col("text")).collect()}
    assert rows[1] == rows[2] == rows[3] == rows[9] == ("und", True) and rows[7] == ("en", False)
    pages = spark.createDataFrame(
        [(1, "http://x.example.com/fr/1", '<html lang="fr"></html>'), (2, "https://Shop.Example.DE/", "<p></p>"), (3, None, None), (4, "http://a.com/", "<html lang=xx><script>das ist nicht</script>")],
        "page_id bigint, url string, html string",
    )
    rows = {r.page_id: (r.language, r.rejected) for r in language.identify(pages, model, **language.page_parts(F.col("url"), F.col("html"))).collect()}
    assert rows[1] == ("fr", False) and rows[2][0] == "de" and rows[3] == rows[4] == ("und", True)
    nothing = language.fit(docs.limit(0))
    assert nothing.names == [] and language.identify(odd, nothing, F.col("text")).where("rejected").count() == len(ODD)


def test_pooling_and_word_vectors_against_a_dictionary(spark):
    texts = ["The cat sat. The CAT sat sat!", "a b a b", "", None, "x " * 300, "one"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    plus, minus = quality._index_vectors()
    lists = [w[offsets[i] : offsets[i + 1]].tolist() for offsets, w in quality._words(pa.array(texts, pa.string())) for i in range(len(offsets) - 1)]
    sums = {}
    for words_ in lists:
        for i, x in enumerate(words_):
            v = sums.setdefault(x, np.zeros(quality.DIM))
            for j in range(max(0, i - quality.REACH), min(len(words_), i + quality.REACH + 1)):
                if j != i:
                    v[plus[words_[j]]] += 1
                    v[minus[words_[j]]] -= 1
    got = quality.word_vectors(docs)
    for b in range(0, quality.BUCKETS, 97):
        sums.setdefault(b, np.zeros(quality.DIM))
    for b, v in sums.items():
        v = v / max(np.linalg.norm(v), 1e-9)
        v[plus[b]] += 1
        v[minus[b]] -= 1
        assert got[b] == pytest.approx(v, abs=1e-5)
    for own, row in zip(lists, quality.pool(pa.array(texts, pa.string()), got), strict=True):
        mean = np.mean([got[x] for x in own], axis=0, dtype=float) if own else np.zeros(quality.DIM)
        assert row == pytest.approx([*mean, np.linalg.norm(mean), math.log1p(len(own))], abs=1e-9)


def test_ordinal_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(4)
    offsets = np.concatenate([[0], np.cumsum(rng.integers(0, 5, 30))])
    index, value, grade = rng.integers(0, 6, offsets[-1]), rng.random(offsets[-1]), rng.integers(0, 4, 30)
    w, free = rng.normal(size=6), rng.normal(size=3) / 2
    _, gw, gf = toxicity.ordinal_loss(offsets, index, value, grade, w, free)
    loss = lambda w, free: toxicity.ordinal_loss(offsets, index, value, grade, w, free)[0]
    for x, g, at in ((w, gw, 0), (free, gf, 1)):
        for k in range(len(x)):
            step = np.eye(len(x))[k] * 1e-6
            near = [loss(x + s, free) if at == 0 else loss(w, x + s) for s in (step, -step)]
            assert (near[0] - near[1]) / 2e-6 == pytest.approx(g[k], abs=1e-6)


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.expr("crc32(cast(doc_id as string)) % 3 = 0")
    model = toxicity.fit(docs, labels, train=~held)
    rows = toxicity.score(docs, model, ["doc_id"]).withColumnRenamed("toxic", "said").join(labels.where(held), "doc_id").collect()
    toxic, fine = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    print(f"held-out toxic rows found {sum(r.said for r in toxic)} of {len(toxic)}, others rejected {sum(r.said for r in fine)} of {len(fine)}")
    assert len(toxic) > 100 and sum(r.said for r in toxic) >= 0.8 * len(toxic) and sum(r.said for r in fine) <= 0.005 * len(fine)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    got = language.identify(docs.where("doc_id % 2 = 1"), model, F.col("text"), host=F.col("source")).collect()
    assert sum(r.language == r.lang for r in got) / len(got) > 0.97


def test_host_priors_against_a_dictionary(spark):
    names, n = ["a", "b", "c"], 3
    rows = [("d1", "h1", [0.0, -1.0, -2.0], 5)] * 7 + [("d1", "h2", [-1.0, 0.0, -2.0], 2)] * 3 + [("d2", "h1", [-3.0, -2.0, 0.0], 9)] + [("", "", [0.0, 0.0, 0.0], 0)] * 4
    model = language.Languages(names, np.zeros((1, n), np.float32))
    got = {(r.domain, r.host): (r.rows, r.prior) for r in language.host_priors(spark.createDataFrame(rows, "domain string, host string, ll array<double>, n bigint"), model).collect()}
    counts, domains, total, sizes = {}, {}, [0.0] * n, Counter()
    for d, h, ll, k in rows:
        sizes[d, h] += 1
        for table in (counts.setdefault((d, h), [0.0] * n), domains.setdefault(d, [0.0] * n), total):
            if k:
                table[ll.index(max(ll))] += 1
    share = lambda c, p: [(x + language.STRENGTH * q) / (sum(c) + language.STRENGTH) for x, q in zip(c, p, strict=True)]
    top = [(x + 1) / (sum(total) + n) for x in total]
    assert set(got) == set(counts)
    for (d, h), c in counts.items():
        assert got[d, h][0] == sizes[d, h] and got[d, h][1] == pytest.approx(share(c, share(domains[d], top)))


def test_repeated_rows_do_not_reach_the_driver(spark, docs, labels, monkeypatch):
    """One labelled doc_id on 20,000 rows, with as many labels: fits gather one row of it, and learn what they learned."""
    one = labels.where("toxic = 0").orderBy("doc_id").limit(1)
    many = docs.union(docs.join(one.select("doc_id"), "doc_id").select(*docs.columns).crossJoin(spark.range(20_000)).select(*docs.columns))
    gathered = []
    frame = type(docs)
    for name in ("toPandas", "toArrow"):
        monkeypatch.setattr(frame, name, lambda self, old=getattr(frame, name): (got := old(self), gathered.append(len(got)))[0])
    more = labels.union(one.crossJoin(spark.range(20_000)).select(*labels.columns))
    assert (toxicity.fit(many, more).weights == toxicity.fit(docs, labels).weights).all()
    assert max(gathered) <= labels.count()
    gathered.clear()
    a = quality.fit(many, more)
    assert gathered and gathered[-1] <= labels.count() and len(a.network.b1) == quality.HIDDEN
    lang = [language.fit(x) for x in (many, docs)]
    assert lang[0].names == lang[1].names and (lang[0].table == lang[1].table).all()


def test_rare_languages_are_learned(spark, docs):
    rare = spark.createDataFrame([(10**6 + i, "zumtaz gobbel wuxi flarn quib " * 5, "xx", "s", 1) for i in range(3)], docs.schema)
    model = language.fit(docs.union(rare))
    assert model.names == ["de", "en", "es", "fr", "xx"]
    got = language.identify(rare, model, F.col("text")).collect()
    assert {r.language for r in got} == {"xx"}


INNER = "text doc_id k0 k1 k2 i0 c0 c1 n ll domain host markup address prior e w known top rows __text __id __y __toxic __host d0 label node t score severity p_toxic grade toxic language confidence rejected ids n_pieces n_bytes roundtrip n_tokens feature fingerprints media row lang source n_chars"


@pytest.fixture(scope="module")
def clashing(spark, docs):
    """Documents with all names that operators use inside or give to results."""
    extra = [c for c in dict.fromkeys(INNER.split()) if c not in docs.columns]
    return docs.select("*", *(F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in extra)).where("doc_id < 40")


def same(rows, columns):
    return all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in columns)


def test_no_name_clashes(spark, docs, labels, clashing, tmp_path):
    own = [c for c in clashing.columns if c not in docs.columns]
    n = clashing.count()
    toxic, good, lang = toxicity.fit(clashing, labels), quality.fit(clashing, labels), language.fit(clashing)
    for run, new in (
        (lambda d, keep=None: toxicity.score(d, toxic, keep), toxicity.NEW), (lambda d, keep=None: quality.score(d, good, keep), "score double"),
        (lambda d, keep=None: language.identify(d, lang, F.col("text"), host=F.col("source"), keep=keep), language.NEW), (lambda d, keep=None: media.media_columns(d, keep), "feature string, fingerprints array<bigint>, media binary, n_bytes bigint"),
        (lambda d, keep=None: sentencepiece_codec.encode(d, keep), sentencepiece_codec.NEW), (lambda d, keep=None: token_counts.count_tokens(d, keep), token_counts.NEW),
    ):
        out = {x.split()[0] for x in new.split(", ")}
        rows = run(clashing).collect()
        assert len(rows) == n and same(rows, [c for c in own if c not in out])
        plain = {r.doc_id: r for r in run(docs.where("doc_id < 40"), ["doc_id"]).collect()}
        assert all(r[c] == plain[r.doc_id][c] for r in rows for c in out)
        assert run(clashing.limit(0)).collect() == []
    assert sorted(map(tuple, bagminhash.classes(clashing).collect())) == sorted(map(tuple, bagminhash.classes(docs.where("doc_id < 40")).collect()))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").withColumn("hash", F.lit("x")).withColumn("slots", F.lit(1))
    for kept in (bagminhash.keep_one(clashing), decontam.drop_contaminated(clashing, bench)):
        rows = kept.collect()
        assert kept.columns == clashing.columns and 0 < len(rows) <= n and same(rows, own)
    store = ShardStore(spark, f"file://{tmp_path}/s", clashing.withColumn("arrival", F.lit(1)).withColumn("a.b", F.lit(2)).schema)
    store.append(clashing.withColumn("arrival", F.lit(1)).withColumn("a.b", F.lit(2)), arrival=F.expr("doc_id % 2"))
    assert same(store.read().collect(), own) and store.read().count() == n


def test_long_texts(spark):
    """Texts of more than a megabyte, one of them without a space, through every operator."""
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(250_000))
    rows = [(1, long), (2, "x" * 1_200_000), (3, long + " end"), (4, "漢" * 400_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert all(len(t.encode()) > 1 << 20 for _, t in rows)
    assert {r.doc_id: r.class_id for r in bagminhash.classes(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    words_ = long.split()
    assert _leaks(spark, [" ".join(words_[200_000:200_030])], [t for _, t in rows]) == {(0, 0): False, (2, 0): False}
    enc = {r.doc_id: r for r in sentencepiece_codec.encode(df.where("doc_id <> 2"), ["doc_id"]).collect()}
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df.where("doc_id <> 2"), ["doc_id"]).collect()}
    assert all(r.roundtrip and r.n_pieces == counts[i] > 0 for i, r in enc.items()) and len(enc) == 3
    for r in media.media_columns(df, ["doc_id", "text"], with_media=False).collect():
        assert r.payload_sha256 == hashlib.sha256(media.payload(r.text)).hexdigest()
    model = language.Languages(["a", "b"], np.tile(np.log([0.25, 0.75]).astype(np.float32), (1 << language.BITS, 1)))
    assert {r.language for r in language.identify(df, model, F.col("text")).collect()} == {"b"}
    assert toxicity.score(df, toxicity.Severity(np.zeros(toxicity.BUCKETS), np.full(3, 35.0)), ["doc_id"]).where("toxic").count() == 0
    chats = df.selectExpr("doc_id conv_id", "0L turn", "'assistant' role", "substr(text, 1, 300000) text")
    assert {r.loss_chars for r in chat.formatted(chats).collect()} == {300_000}


# -- chat, media, shards --------------------------------------------------------------------------


def test_escaping_is_exact():
    rng = random.Random(9)
    parts = [*chat.FOREIGN, *chat.RESERVED, "\\", "<", "[", "a", "é", "<|", "\n"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.FOREIGN + chat.RESERVED)


def test_chat(spark, monkeypatch):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a </s> b"), (1, 1, "assistant", "a </s> b"), (1, None, "system", None), (2, 0, None, "x"), (None, 0, "user", ""), (3, 0, "assistant", "w " * 500), (3, 1, "a\\s", "[INST]")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("tokens", F.lit(1))
    for size in (chat.PART_TOKENS, 1):
        monkeypatch.setattr(chat, "PART_TOKENS", size)
        got = {r.conv_id: r for r in chat.formatted(df).collect()}
        assert set(got) == {1, 2, 3, None}
        for conv, r in got.items():
            own = sorted(((t is not None, t or 0, ro or "", x or "") for c, t, ro, x in rows if c == conv))
            learned = "".join(x for _, _, ro, x in own if ro == "assistant")
            assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{ro}\n{x}\n" for _, _, ro, x in own).encode()).hexdigest()
            assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.formatted(df.limit(0)).count() == 0


def test_media(odd):
    for r in media.media_columns(odd, ["doc_id", "text"]).collect():
        data = (r.text or "").encode()
        with wave.open(io.BytesIO(r.media)) as w:
            back = w.readframes(w.getnframes())
            assert (w.getsampwidth(), w.getnchannels()) == (1, 1)
        assert back[: len(data)] == data and set(back[len(data) :]) <= {255} and len(back) % 576 == 0 and len(back) >= 576
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), len(back), len(r.media))
        assert r.payload_sha256 == hashlib.sha256(back).hexdigest() and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert r.tail_crc32 == zlib.crc32(back[-32:]) and r.fingerprints == sorted(r.fingerprints)
    same = media.media_columns(odd, ["doc_id", "text"], with_media=False).groupBy("text").agg(F.countDistinct("feature").alias("n"))
    assert {r.n for r in same.collect()} == {1}
    tone = (128 + 100 * np.sin(2 * np.pi * 50 * np.arange(576 * 20) / 576)).astype(np.uint8)
    assert any(abs(m.argmax() - 50) <= 1 for block in media.spectra(tone) for m in block)


def brute_fingerprints(data):
    """Peaks of each band over time, and pairs of each with the next three, frame by frame."""
    x = np.frombuffer(data, np.uint8).astype(float) - 128
    n, hop = media.FRAME, media.HOP
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    frames = [np.abs(np.fft.rfft(x[a : a + n] * window)) for a in range(0, len(x) - n + 1, hop)]
    tops = [[max(range(a, b), key=lambda k: (m[k], -k)) for a, b in zip(media.BANDS, media.BANDS[1:])] for m in frames]
    power = lambda t, band: frames[t][tops[t][band]] if 0 <= t < len(frames) else 0.0
    peaks = [(t, tops[t][band]) for t in range(len(frames)) for band in range(len(media.BANDS) - 1) if power(t, band) > power(t - 1, band) and power(t, band) >= power(t + 1, band)]
    pairs = [(p, q) for i, p in enumerate(peaks) for q in peaks[i + 1 : i + 1 + media.PARTNERS] if q[0] - p[0] <= media.REACH]
    return sorted(p[0] << 32 | p[1] << 20 | q[1] << 8 | q[0] - p[0] for p, q in pairs)


def test_media_fingerprints_against_brute_force(spark):
    sf = spark.read.parquet(f"{SF}/documents.parquet").limit(25)
    for r in media.media_columns(sf, ["text"], with_media=False).collect():
        assert r.fingerprints == brute_fingerprints(media.payload(r.text))
        frames, pairs, digest = r.feature.split(":")[1:]
        assert (int(frames), int(pairs)) == (1 + (r.payload_bytes - 576) // 288, len(r.fingerprints))
        assert digest == hashlib.sha256(np.array(r.fingerprints, "<i8").tobytes()).hexdigest()[:32]


def test_op8_on_all_conversations_and_its_own(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    control = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", control), (-7, 1, "assistant", control)]
    got = {r.conv_id: r for r in queries.op8_chat(spark, SF).collect()}
    by = {}
    for c, t, ro, x in rows:
        by.setdefault(c, []).append((t, ro or "", x or ""))
    assert set(got) == set(by) and got[-7].n_turns == 2 and got[-7].loss_chars == len(control)
    for c, turns in by.items():
        learned = "".join(x for _, ro, x in sorted(turns) if ro == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{ro}\n{x}\n" for _, ro, x in sorted(turns)).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert got[c].formatted_chars >= sum(len(ro) + len(x) for _, ro, x in turns) + 3 * len(turns)


def test_shards(spark, docs, tmp_path, odd):
    store = ShardStore(spark, f"file://{tmp_path}/s", docs.schema, target_bytes=100_000)
    assert store.read().count() == 0
    store.append(docs.repartition(12), arrival=F.expr("pmod(doc_id, 3)"))
    first = store.manifest()
    assert first["version"] == 3 and len(first["shards"]) == 36
    last = store.compact()
    assert 3 <= len(last["shards"]) < 12 and max(x["bytes"] for x in last["shards"]) < 150_000
    assert store.read(3).exceptAll(docs).isEmpty() and store.read().exceptAll(docs).isEmpty() and docs.exceptAll(store.read()).isEmpty()
    with pytest.raises(Conflict):
        store.commit(first, [], [])
    assert store.vacuum() >= len({x["file"] for x in first["shards"]} - {x["file"] for x in last["shards"]}) and store.versions() == [last["version"]]
    assert len(list((tmp_path / "s" / "data").rglob("part-*.parquet"))) == len(last["shards"])
    assert store.read().count() == docs.count()
    other = ShardStore(spark, f"file://{tmp_path}/o", odd.schema)
    other.append(odd)
    other.append(odd.limit(0))
    other.compact()
    assert sorted((r.doc_id, r.text or "") for r in other.read().collect()) == sorted((i, t or "") for i, t in ODD)


def test_shards_of_any_number_take_few_jobs(spark, tmp_path):
    """2,000 small shards: the number of jobs is that of tiers climbed; versions before the last list are followed."""
    store = ShardStore(spark, f"file://{tmp_path}/s", spark.range(0).schema, target_bytes=1 << 20)
    store.append(spark.range(20_000).repartition(2000))
    for k in range(20):
        store.append(spark.range(20_000 + k, 20_001 + k).coalesce(1))
    assert store.manifest()["version"] == 21 and store._numbers("w") == [16] and len(store.manifest(15)["shards"]) == 2014
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    last = store.compact()
    assert last["version"] - 21 <= 3 and len(last["shards"]) < store.fanout and spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert store.read().distinct().count() == store.read().count() == store.read(21).count() == 20_020
    assert store.vacuum() >= 2020 and store.versions() == [last["version"]] and store.read().count() == 20_020
    store.append(spark.range(5))
    assert store.read().count() == 20_025 and store.vacuum(2) == 0 and len(store.versions()) == 2


def test_shards_where_packing_cannot_be_set(spark, docs, tmp_path, monkeypatch):
    """The session keeps its small scan partitions: compaction still ends, with files near the target."""
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    monkeypatch.setattr(type(spark.conf), "set", lambda *_: None)
    try:
        store = ShardStore(spark, f"file://{tmp_path}/s", docs.schema, target_bytes=200_000, fanout=2)
        store.append(docs.repartition(30))
        last = store.compact()
    finally:
        monkeypatch.undo()
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    total = sum(x["bytes"] for x in last["shards"])
    assert last["version"] <= 8 and len(last["shards"]) <= 2 + 1.5 * total / 200_000 and docs.exceptAll(store.read()).isEmpty() and store.read().count() == docs.count()


# -- pipeline -------------------------------------------------------------------------------------


def brute_pipeline(spark, docs, labels):
    """The rows that are left, by plain Python from each operator's decisions on single texts and brute-force classes."""
    model = toxicity.fit(docs, labels)
    kept = {r.doc_id for r in toxicity.score(docs, model, ["doc_id"]).where("p_toxic < 0.5").collect()}
    rows = [r for r in docs.collect() if r.doc_id in kept]
    now = spark.createDataFrame(rows, docs.schema)
    fine = {r.doc_id for r in language.identify(now, language.fit(now), F.col("text"), host=F.col("source")).where("confidence >= 0.5").collect()}
    rows = [(r.doc_id, r.text) for r in rows if r.doc_id in fine]
    label = brute_classes(rows)
    rows = [(i, t) for i, t in rows if label[i] == i]
    bench = [plain_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    spans = {tuple(w.lower() for w in b[k : k + 13]) for b in bench for k in range(len(b) - 12)}
    return {i for i, t in rows if not any(tuple(x.lower() for x in w[k : k + 13]) in spans for w in [plain_words(t)] for k in range(len(w) - 12))}


def test_pipeline_against_brute_force(spark, docs, labels):
    import corpus_pipeline

    from lodestone import scratch

    before = scratch.made()
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.select("doc_id").collect()} == brute_pipeline(spark, docs, labels)
    assert scratch.made() - before < 20
    release = scratch.release
    release(spark)
    assert got.count() > 0


def test_stages_leave_columns_alone(spark, docs, labels, clashing):
    import corpus_pipeline

    own = [c for c in clashing.columns if c not in docs.columns]
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (None, "word " * 9, "en", "s", 1), (3, "other words here", "en", None, 1)], docs.schema)
    rows = clashing.unionByName(odd, allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SF)
        got = out.where("doc_id < 40").collect()
        assert out.columns[: len(rows.columns)] == rows.columns and 0 < len(got) <= rows.count(), name
        assert same([r for r in got if r.feature is not None], own), name
        assert (out.columns == rows.columns) == (name != "sentencepiece")
        assert stage(spark, rows.limit(0), SF).count() == 0
    assert out.columns[len(rows.columns) :] == ["ids_", "n_pieces_", "n_bytes_", "roundtrip_"]


def test_pipeline(spark, docs, labels):
    import corpus_pipeline

    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, SF).persist()
        assert set(before.columns) <= set(now.columns), name
        assert now.count() <= before.count(), name
    rows = now.collect()
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert all(r.roundtrip for r in rows) and not any(b in r.text for r in rows for b in bench)
    kept = [(r.doc_id, r.text) for r in rows]
    assert len(set(brute_classes(kept).values())) == len(kept)
    assert len(rows) > 0.6 * docs.count()
