"""Collocations, hard negatives and decontamination against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomwork.llm import collocations, common, decontamination, hard_negatives, mixing, passage_dedup, simhash

DOCS = "doc_id long, text string, lang string, `__rid` int, words string, number int, `window` string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- collocations


def plain_collocations(rows, least, top, covered=80):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    part = p[i : i + size]
                    if 100 * a >= covered * counts[part]:
                        gone.add(part)
        found = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, lv, r, n[lang], -s) for i, (s, a, p, lv, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts_with_phrases(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "naïve x", "a-b", "\x00", "Und", " "]
    rows = [(None, "en"), ("", "en"), (" \t.,\n", None), ("one", "xx"), ("Of THE of the OF THE", "en"), ("of the " * 400, "en"), ("a b c d e " * 60, "und"), ("a b c d e " * 30, None)]
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randint(1, 60))
        rows.append(("".join(w + rng.choice([" ", " ", " ", " \t ", ". ", ",", "\r\n", ";"]) for w in words), ["en", "fr", None, "und"][i % 4]))
    return rows + rows[20:30] * 3


@pytest.mark.parametrize(("least", "top"), [(5, 2000), (12, 7), (30, 2000)])
def test_collocations(spark, least, top):
    rows = texts_with_phrases()
    docs = spark.createDataFrame([(i, t, lang, i, "x", 3, "y") for i, (t, lang) in enumerate(rows)], DOCS).repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least, top).collect())
    want = plain_collocations(rows, least, top)
    assert want and got == want
    assert collocations.collocations(docs, 10**6).count() == 0 == collocations.collocations(docs.limit(0), least).count()


@pytest.mark.parametrize(("share", "words"), [(20, 64), (60, 256), (4096, 1 << 20)])
def test_hot_words_are_split_without_loss(spark, monkeypatch, share, words):
    """Pairs and triples that lead many suffixes are counted in several tasks; small chunks make most of them hot."""
    rng = random.Random(7)
    rows = [(" ".join(rng.choices(["of", "the", "and", "x", "y", "z", "q"], [9, 9, 3, 1, 1, 1, 1], k=rng.randint(5, 80))), "en") for _ in range(80)]
    texts = spark.createDataFrame(rows, "text string, lang string").repartition(3).select("lang", "text")
    numbers, chunks = collocations.word_counts(texts, 0)
    total = numbers.agg({"n": "sum"}).first()[0]
    pairs, triples = _hot(monkeypatch, chunks, total, share)
    assert len(pairs) > 1 and (share < 60 or len(triples) > 1)
    each = collocations.Chunks(0)
    found = Counter()
    bits = np.full(common.FILTER_BITS // 8, 255, np.uint8)
    by_part = defaultdict(lambda: defaultdict(list))
    for i in range(0, len(rows), max(1, words // 40)):
        some = np.concatenate([each.of("en", [*collocations.tokens_of(t), b"."]) for t, _ in rows[i : i + max(1, words // 40)]])
        columns, n, lead, route = collocations.suffixes(some, bits, pairs, triples)
        for part in range(4):
            for k in (2, 3, 4):
                at = (route % np.uint64(4) == part) & (lead == k)
                by_part[part][k].append([c[at] for c in columns] + [n[at]])
    for leads in by_part.values():
        for lead, blocks in leads.items():
            *keys, n = (np.concatenate(x) for x in zip(*blocks))
            for at, size, count in collocations.frequent_phrases(keys, n, 12, lead):
                found[tuple(int(k[at]) for k in keys[:size])] += count
    names = {r.id % (1 << 64): r.word for r in numbers.collect()}
    got = {tuple(names[w] for w in p): c for p, c in found.items() if c >= 12}
    want = Counter()
    for t, _ in rows:
        w = t.split()
        for size in (2, 3, 4):
            want.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    assert got == {p: c for p, c in want.items() if c >= 12}


def _hot(monkeypatch, chunks, total, share):
    monkeypatch.setattr(collocations, "HOT_SHARE", share)
    return collocations.hot_leads(chunks, total)


def test_words_that_share_a_number_get_another_seed(spark, monkeypatch):
    seeds, real = [], collocations.word_counts

    def clashing(texts, seed):
        seeds.append(seed)
        words, chunks = real(texts, seed)
        return (words.withColumn("id", words["id"] * 0 + 5), chunks) if seed == 0 else (words, chunks)

    monkeypatch.setattr(collocations, "word_counts", clashing)
    docs = spark.createDataFrame([("a b " * 40, "en")], "text string, lang string")
    assert [r.phrase for r in collocations.collocations(docs).orderBy("rank").collect()][:1] == ["a b a b"] or seeds == [0, 1]
    assert seeds == [0, 1]


# --- hard negatives


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 5), (65, 64, 130), (40, 33, 71), (17, 1, 90), (100, 100, 100)])
@pytest.mark.parametrize("leaf", [1, 8, 16])
def test_strassen_is_exact(shape, leaf):
    m, k, n = shape
    if leaf == 1 and m * k * n > 20_000:
        pytest.skip("slow")
    rng = np.random.default_rng(m + n)
    a, b = rng.integers(-(1 << 24), 1 << 24, (m, k)), rng.integers(-(1 << 24), 1 << 24, (k, n))
    assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()


def plain_negatives(rows, k=5):
    import math

    e = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in dict.fromkeys((i, label, tuple(v)) for i, label, v in e if i is not None and i % 10 == 0):
        last = lambda p: (-p[0], p[1] is None, p[1] or 0)
        positives = sorted(((dot(v, w), j) for j, other, w in e if other == label and j != i), key=last)[:k]
        negatives = sorted(((dot(v, w), j) for j, other, w in e if other != label), key=last)
        for s, p in positives:
            fit = [(t, j) for t, j in negatives if 80 * s <= 100 * t <= 100 * s][:k]
            out += [(i, p, r + 1, j, s, t) for r, (t, j) in enumerate(fit)]
    return sorted(out, key=repr)


def test_hard_negatives(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(150)]
    rows += [(200 + i, i % 3, rows[10][2]) for i in range(9)]  # ties
    rows += [rows[20], rows[20], rows[31], (30, 9, rows[30][2])]  # repeated rows, an id with two labels
    rows += [(None, 1, rows[10][2]), (400, None, [1.0] * 6), (410, 1, None), (420, 1, [float("nan")] * 6), (430, 1, [None, 1.0]), (440, 2, [1.0, 2.0]), (450, 2, []), (460, 1, [0.0] * 6), (470, 1, [float("inf")])]
    df = spark.createDataFrame([(i, v, label, "a", 1, 2) for i, label, v in rows], "vec_id long, embedding array<float>, label int, id string, tile int, score int").repartition(3)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_ROWS", 40)
    got = sorted((tuple(r) for r in hard_negatives.hard_negatives(df, "vec_id % 10 = 0").collect()), key=repr)
    want = plain_negatives(rows)
    assert len(want) > 50 and got == want
    assert hard_negatives.hard_negatives(df.limit(0), "vec_id % 10 = 0").count() == 0
    assert hard_negatives.hard_negatives(df, "vec_id = 400").count() == 0


def test_products_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(i, [1e30, 1.0], i % 2) for i in range(20)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="too large"):
        hard_negatives.hard_negatives(df, "vec_id % 10 = 0").collect()


# --- decontamination


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def plain_contamination(docs, items):
    wanted = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wanted[tuple(w[i : i + k])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for k in {len(x) for x in wanted}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wanted:
                    hit.update(range(i, i + k))
                    found |= wanted[tuple(w[i : i + k])] - {None}
        ids = sorted(map(str, found))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(3)
    prose = lambda n, letters="abcdefgh": " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(n))
    items = [(i, prose(rng.randint(10, 60))) for i in range(25)]
    items += [(30, prose(9)), (31, "Two Words"), (32, "solo9é"), (33, None), (34, " .,"), (None, prose(20)), (35, items[3][1]), (35, items[4][1]), (36, items[5][1][:60]), (37, "same " * 40), (38, "x y " * 12)]
    docs = [(i, prose(rng.randint(0, 120))) for i in range(60)]
    for i in range(60):
        text = rng.choice(items)[1] or ""
        w = text.split()
        a = rng.randint(0, max(0, len(w) - 12))
        cut = " ".join(w[a : a + rng.choice([8, 9, 10, 11, 15, 60])])
        docs.append((100 + i, f"{prose(rng.randint(0, 30))} {cut.upper() if i % 2 else cut.replace(' ', ', ')} {prose(rng.randint(0, 30))}"))
    docs += [(None, items[0][1]), (200, None), (201, ""), (202, items[1][1]), (202, items[1][1]), (203, "two words; and SOLO9é"), (204, "same " * 500), (205, "y x " * 30), (206, prose(30_000) + " " + items[7][1])]
    return docs, items


def test_decontamination(spark, leaks):
    docs, items = leaks
    df = spark.createDataFrame([(i, t, "en", 1, "w", 2, "v") for i, t in docs], DOCS).repartition(4)
    bench = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id long, text string, doc_id string").repartition(2)
    got = sorted((tuple(r) for r in decontamination.contamination(df, bench).collect()), key=repr)
    want = plain_contamination(docs, items)
    assert sum(r[2] > 0 for r in want) > 30 and got == want
    none = decontamination.contamination(df, bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated or r.n_items for r in none)
    assert decontamination.contamination(df.limit(0), bench).count() == 0
    bad = {r[0] for r in want if r[5]}
    kept = decontamination.clean_documents(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in bad)


def test_a_full_filter_only_costs_time(spark, leaks, monkeypatch):
    docs, items = leaks
    real = common.filter_bits
    monkeypatch.setattr(decontamination, "filter_bits", lambda *a: spark.sparkContext.broadcast(np.full_like(real(*a).value, 255)))
    df = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    got = decontamination.contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_contamination(docs, items)


@pytest.mark.parametrize("n", [0, 3, 9, 10, 11, 40])
def test_every_window_keeps_the_same_gram_wherever_it_stands(n):
    rng = np.random.default_rng(n)
    span = rng.integers(1, 5, n).astype(np.uint64)
    whole = np.concatenate([rng.integers(1, 5, 20).astype(np.uint64), span, rng.integers(1, 5, 20).astype(np.uint64)])
    own, at = decontamination.winnow(span)
    least, place = decontamination.winnow(whole)
    assert (least[20 : 20 + len(own)] == own).all() and (place[20 : 20 + len(own)] == at).all() and len(own) == max(0, n - 9)


# --- stages


def test_reruns_of_the_mix_agree_over_partitionings(spark):
    rng = random.Random(5)
    rows = [(1, " ".join(rng.choice("abcdef") for _ in range(20)), "en", "s", i % 3) for i in range(61)] + [(2, "p q r s t", "en", "s", 0)] * 30 + [(3, "x " * 40, "en", None, 1)]
    outs = []
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
        outs.append(Counter(tuple(r) for r in mixing.mixed_documents(docs, weights=(1, 1)).collect()))
    assert outs[0] == outs[1] == outs[2]
    taken = sum(len(r[1].split()) * n for r, n in outs[0].items() if r[3] == "s")
    source = sum(len(r[1].split()) for r in rows if r[3] == "s")
    target = min(3 * source, source + 40 - min(3 * 40, (source + 40) // 2))
    assert abs(taken - target) <= 1


def test_stages_take_columns_of_any_name(spark):
    fields = "doc_id long, text string, `__id` int, `__row` int, `__spans` string, `__id_of` string, `__text` string, content string, `alike` int, source string"
    line = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{line}\nown {i} " + " ".join(f"v{i}x{k}" for k in range(30)), 1, 2, "s", "t", "u", "c", 3, "q") for i in range(6)], fields)
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and 1 <= one.count() <= 6
    cut = passage_dedup.without_passages(docs, passage_dedup.repeated_passages(docs))
    assert cut.columns == docs.columns and sum("w3 w4" in r.text for r in cut.collect()) == 1
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_passages_keep_ids_of_any_type(spark):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    line, run = prose(40), prose(60)
    rows = [(i, f"{prose(30)}\n{line if i % 2 else prose(20)}\n{prose(9)} {run if i % 3 == 0 else ''} {prose(9)}") for i in range(12)] + [(None, line)]
    by_number = passage_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    named = spark.createDataFrame([(None if i is None else f"doc-{i:02d}", t) for i, t in rows], "doc_id string, text string")
    by_name = passage_dedup.repeated_passages(named)
    shape = lambda df, of: sorted((of(r[0]), r[1], r[2], r[3], r[5]) for r in df.collect())
    want = shape(by_number, lambda i: f"doc-{i:02d}")
    assert want and shape(by_name, str) == want and by_name.columns == by_number.columns
    cut = passage_dedup.without_passages(named, by_name)
    assert sum(run in r.text for r in cut.collect()) == 1 and cut.count() == len(rows)
