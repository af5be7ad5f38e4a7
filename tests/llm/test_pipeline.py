"""The stages one by one against brute force, on the smallest tables and on odd ones, and the whole of them."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from loomwork.llm import quality_rules, secret_scan
from loomwork.session import table, written

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `__ledger` string, id string, size int, position int, `__row_of` int"


def odd_rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, prose(rng.randint(5, 200)), "en", ["a", "b", None][i % 3], i) for i in range(60)]
    rows += [(None, prose(40), "en", "a", None), (None, prose(50), None, None, 1), (None, None, "en", "a", 0), (3, "", "en", "b", 0), (3, " \n", "en", "b", 2)]
    rows += [rows[1], rows[1], (1, prose(80), "en", "b", 0), (100, rows[5][1], "en", "b", 3), (101, rows[6][1] + " x", "en", "a", 4)]
    rows += [(200, prose(8000), "en", "a", 7), (201, 'password = "Xk9vQ2mT7pLw" ' + prose(60), "en", "c", 9)]
    return [(*r, "l", "i", 1, 2, 3) for r in rows]


@pytest.fixture(scope="module", params=["small", "odd", "empty"])
def frames(request, spark):
    if request.param == "small":
        docs = table(spark, DATA, "documents")
    else:
        docs = spark.createDataFrame(odd_rows() if request.param == "odd" else [], SCHEMA).repartition(3)
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DATA), re.sub(r"\W", "-", name)))
    return out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain(df, change=None):
    return Counter(tuple(r.asDict().items()) for r in df.collect())


def test_all_but_the_last_keep_the_columns(frames):
    assert all(f.columns == frames[0].columns and f.dtypes == frames[0].dtypes for f in frames[:-1])


def test_quality_keeps_what_no_rule_rejects(frames):
    def keeps(t):
        measured = dict(zip(quality_rules.MEASURES, quality_rules.measurements(t or "")))
        return not any(eval(rule, {}, measured) for rule in quality_rules.RULES.values())

    assert plain(frames[1]) == Counter({k: n for k, n in plain(frames[0]).items() if keeps(dict(k)["text"])})


def test_one_row_of_each_component_stays(frames):
    def fingerprint(t):
        own = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        hashes = [xxhash.xxh64_intdigest(" ".join(own[k : k + 3]).encode(), 42) for k in range(max(1, len(own) - 2))] if own else []
        bits = [sum(h >> b & 1 for h in hashes) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * bits[b] > len(hashes))

    before, kept = frames[1].collect(), frames[2].collect()
    prints = sorted({fingerprint(r.text) for r in before})
    component = {p: p for p in prints}

    def root(p):
        while component[p] != p:
            p = component[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 2:
                component[root(p)] = root(q)
    of = Counter(root(fingerprint(r.text)) for r in kept)
    assert set(of) == {root(p) for p in prints} and set(of.values()) <= {1}
    assert not plain(frames[2]) - plain(frames[1])
    least = {}
    for r in before:
        c = root(fingerprint(r.text))
        least[c] = min(least.get(c, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert all((r.doc_id is None, r.doc_id or 0) == least[root(fingerprint(r.text))] for r in kept)


def test_secrets_are_redacted(frames):
    def clean(key):
        row = dict(key)
        row["text"] = None if row["text"] is None else secret_scan.redact(row["text"])
        row["n_chars"] = None if row["text"] is None else len(row["text"])
        return tuple(row.items())

    want = Counter()
    for k, n in plain(frames[2]).items():
        want[clean(k)] += n
    assert plain(frames[3]) == want


def test_sources_meet_their_targets(frames):
    sizes, got = Counter(), Counter()
    for r in frames[3].collect():
        sizes[r.source] += len(words(r.text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, full = {s: i % 3 + 1 for i, s in enumerate(names)}, set()
    while names:
        rest, open_weight = sum(sizes.values()) - sum(3 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        new = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not new:
            break
        full |= new
    own = defaultdict(list)
    for r in frames[3].collect():
        own[r.doc_id, r.source].append(" ".join(words(r.text)))
    for r in frames[4].collect():
        got[r.source] += len(words(r.text))
        assert any(" ".join(words(r.text)) in t for t in own[r.doc_id, r.source])
    assert all(abs(got[s] - target[s]) <= 200 for s in names)


def test_sequences_hold_all_tokens(frames):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = frames[5].collect()
    want = Counter()
    for r in frames[4].collect():
        want[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    by_sequence = defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.length
        assert len(r.ids) == r.length and np.array(r.ids).max(initial=0) < 1 << 17
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    held = frames[5].selectExpr("input_file_name() as f", "sequence_id").distinct().groupBy("sequence_id").count().where("count > 1")
    assert held.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0 and corpus_pipeline.ORACLE_SQL is None
