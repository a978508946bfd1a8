"""Operators on texts against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ssaflow.llm import media, mixing, packing, pii, simhash, substrings, tokens, toxicity

from .cases import documents, empty

WORDS = "[^\x20\x09-\x0d]+"
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = st.lists(st.sampled_from(list(" \n\t\x0b\x1c\x85\xa0　aéE1'sß中́😀.<|>Σİ") + ["<|endoftext|>", "'ll", "  ", "ab"]), max_size=12).map("".join)


def words(text):
    return re.findall(WORDS, text or "")


# ---- 1 -------------------------------------------------------------------------------------------------------------------


def test_a_cover_aligns_any_two_windows():
    for shift in range(substrings.PERIOD):
        assert any((a + shift) % substrings.PERIOD in substrings.COVER for a in substrings.COVER)
    assert substrings.ANCHOR + substrings.PERIOD - 1 <= substrings.WINDOW


def removed(rows):
    last = substrings.LAST_ID
    texts = [(last if r[0] is None else r[0], words(r[1]), r[0]) for r in rows]
    least = {}
    for d, w, _ in texts:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, w, doc in texts:
        gone = {i + j for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < d for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("batch_words", [1 << 20, 300])
def test_substrings(spark, monkeypatch, batch_words):
    monkeypatch.setattr(substrings, "BATCH_WORDS", batch_words)
    rows, df = documents(spark)
    want = removed(rows)
    assert sum(k[2] for k in want) > 100
    assert Counter(tuple(r) for r in substrings.remove_repeats(df).collect()) == want
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_buckets_follow_the_texts_counted(spark):
    from ssaflow.llm.common import bucket_count

    rows, df = documents(spark)
    joined = df.join(df.select("doc_id").withColumnRenamed("doc_id", "other"), F.col("doc_id") == F.col("other")).drop("other")
    made = spark.createDataFrame(joined.rdd, df.schema)
    assert bucket_count(df) == bucket_count(joined) == bucket_count(made) == 16
    plain = [r for r in rows if r[0] is not None and r[0] != 2]
    same = joined.where("doc_id <> 2").dropDuplicates(["doc_id"])
    assert Counter(tuple(r) for r in substrings.remove_repeats(same).collect()) == removed(plain)


# ---- 3 -------------------------------------------------------------------------------------------------------------------


def test_packing(spark):
    rows, df = documents(spark)
    library = Tokenizer.from_file(WORD_BPE)
    pieces = packing.pack_documents(df, WORD_BPE, 1, window=256, open_windows=4).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    for doc, held in texts.items():
        if len(held) > 1:
            continue
        ids = library.encode(held[0] or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    total = sum(p.length for p in pieces)
    assert total == sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert 1 - total / (256 * len(by_sequence)) < 0.1
    assert packing.pack_documents(empty(spark), WORD_BPE, 1).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        packing.chunk_ids(BYTE_BPE)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_chunk_ids_are_the_library_s(text):
    ids = packing.chunk_ids(WORD_BPE)
    assert ids.of_text(text) == ids.encode(text)


# ---- 4 -------------------------------------------------------------------------------------------------------------------


def test_media(spark):
    rows, df = documents(spark)
    out = media.media_columns(df).collect()
    assert len(out) == len(rows)
    found = defaultdict(set)
    payloads = Counter()
    for r in rows:
        data = (r[1] or "").encode()
        payloads[(r[0], len(data), hashlib.sha256(media.padded(data)).hexdigest(), zlib.crc32(media.padded(data)[-16:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in out) == payloads
    for r in out:
        assert r.payload_bytes % 192 == 0 and r.width * r.height == r.payload_bytes
        found[r.payload_sha256].add((r.media_sha256, r.feature, r.shard, r.media_offset))
    assert all(len(v) == 1 for v in found.values())
    assert media.media_columns(empty(spark)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=2000))
def test_images_are_lossless(data):
    payload = media.padded(data)
    made = media.encode_image(payload)
    assert media.decode_image(made) == payload and payload.startswith(data)
    assert media.read_header(made[: media.HEADER_BYTES]) == (192, len(payload) // 192, 8)
    with pytest.raises(ValueError):
        media.decode_image(made[:20] + bytes([made[20] ^ 1]) + made[21:])


# ---- 5 -------------------------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_token_counts_are_the_library_s(text):
    library = test_token_counts_are_the_library_s.__dict__.setdefault("library", Tokenizer.from_file(BYTE_BPE))
    assert tokens.counter(BYTE_BPE).count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts(spark):
    rows, df = documents(spark)
    library = Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for r in rows:
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        want[(r[0], len((r[1] or "").encode()), n, n > 100)] += 1
    assert Counter(tuple(r) for r in tokens.token_counts(df, BYTE_BPE, 100).collect()) == want
    assert tokens.token_counts(empty(spark), BYTE_BPE, 100).count() == 0
    assert tokens.counter(BYTE_BPE).count("ab" * 20_000) == len(library.encode("ab" * 20_000).ids)


# ---- 7 -------------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8))
def test_targets(sizes):
    weights = [(3.0, 1.0, 2.0)[k % 3] for k in range(len(sizes))]
    total = 1.5 * sum(sizes)
    targets = mixing.share_out(sizes, weights, total, 2.0)
    assert all(t <= 2 * s + 1e-9 for t, s in zip(targets, sizes, strict=True))
    assert abs(sum(targets) - total) < 1e-6 * (1 + total)
    free = [t / w for t, s, w in zip(targets, sizes, weights, strict=True) if t < 2 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * (1 + max(free))


def test_targets_of_many_sources():
    sizes = [1 + (k * 7919) % 10_007 for k in range(20_000)]
    weights = [(3.0, 1.0, 2.0)[k % 3] for k in range(len(sizes))]
    targets = mixing.share_out(sizes, weights, 1.9 * sum(sizes), 2.0)
    assert abs(sum(targets) - 1.9 * sum(sizes)) < 1e-6 * sum(sizes)
    assert all(t <= 2 * s + 1e-9 for t, s in zip(targets, sizes, strict=True))


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    df = spark.createDataFrame([(k, f"s{k}", "a b c") for k in range(3)], "doc_id bigint, source string, text string")
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(df)


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_DOCS", 4)
    rows, df = documents(spark, rows=120)
    out = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(5)).collect()
    assert Counter(tuple(r) for r in out) == Counter(tuple(r) for r in again)
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((r[0], len(words(r[1]))) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.share_out([sizes[s] for s in order], [(3.0, 1.0, 2.0)[k % 3] for k in range(len(order))], 1.5 * sum(sizes.values()), 2.0), strict=True))
    taken = Counter()
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[(r.source_size, r.target)] += r.taken
    for s in order:
        assert abs(taken[(sizes[s], targets[s])] - targets[s]) <= 1
    assert mixing.mix(empty(spark)).count() == 0


def test_mixed_documents(spark):
    rows, df = documents(spark)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    took = Counter()
    for r in mixing.mix(df).collect():
        took[r.doc_id] += r.taken
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
    assert got == +took


# ---- 8 -------------------------------------------------------------------------------------------------------------------


def unit(counts, idf):
    import numpy as np

    terms = np.array(sorted(counts), np.int64)
    raw = np.array([(1 + math.log(counts[t])) * idf[t] for t in terms.tolist()])
    return terms, raw / math.sqrt((raw * raw).sum()) if len(raw) else raw


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 9), st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=200), st.dictionaries(st.integers(0, 9), st.integers(1, 4), max_size=5))
def test_nearest_are_exact(vectors, query):
    idf = [1.0 + t / 7 for t in range(10)]
    made = [unit(v, idf) for v in vectors]
    index = toxicity.BlockMaxIndex.build(made, [0] * len(made), range(len(made)), 10)
    terms, weights = unit(query, idf)
    of = lambda v: sum(w * dict(zip(*map(list, v), strict=True)).get(t, 0.0) for t, w in zip(terms.tolist(), weights.tolist(), strict=True))
    near = index.nearest(terms, weights, 5)
    cosines = sorted(map(of, made), reverse=True)
    assert [round(c, 9) for c, _ in near] == [round(c, 9) for c in cosines if c > 0][:5]
    for c, at in near:
        assert abs(of(made[index.ids[at]]) - c) < 1e-9
    assert [c for c, _ in index.nearest(terms, weights, 5, below=1 - 1e-9)] == [c for c, _ in index.nearest(terms, weights, 500) if c < 1 - 1e-9][:5]


def toxic_terms(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        out.update([w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) >= n)])
    return out


@pytest.mark.parametrize("chars", [1 << 22, 50])
def test_terms_are_counted_whole(monkeypatch, chars):
    monkeypatch.setattr(toxicity, "COUNT_CHARS", chars)
    texts = [None, "", "Lorem ipsum_dolor 12 lorem " * 30, "É" * 100, "\u2028IDIOT,idiots", " " * 200, "... 12 _ !"]
    vocabulary = {t: k for k, t in enumerate(sorted({t for x in texts for t in toxic_terms(x)}))}
    bounds, terms, n = toxicity.TermCounter(vocabulary).counts(texts)
    for k, text in enumerate(texts):
        got = dict(zip(terms[bounds[k] : bounds[k + 1]].tolist(), n[bounds[k] : bounds[k + 1]].tolist(), strict=True))
        assert got == {vocabulary[t]: c for t, c in toxic_terms(text).items()}


def test_scores_are_those_of_brute_force(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("lmnop") for _ in range(rng.randint(2, 4)))
    rows = [(k, " ".join([word() for _ in range(12)] + [rng.choice(["awful", "nasty", "vile"])] * (k % 3 == 0))) for k in range(300)] + [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = {k: int(k % 3 == 0) for k in range(0, 300, 2) if zlib.crc32(str(k).encode()) % 5}
    model = toxicity.fit(df, spark.createDataFrame([(k, y) for k, y in labels.items()], "doc_id bigint, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    counts = {k: toxic_terms(t) for k, t in rows}
    df_of = Counter(t for c in counts.values() for t in c)
    # distinct texts with the term, by label
    texts = {(dict(rows)[k], y): counts[k] for k, y in labels.items()}
    n = Counter(y for _, y in texts)
    seen = {y: Counter(t for (_, label), c in texts.items() if label == y for t in c) for y in (0, 1)}
    total = n[0] + n[1]

    def weight(t):
        both = seen[0][t] + seen[1][t]
        off = max(0, abs(seen[1][t] * n[0] - seen[0][t] * n[1]) - total / 2)
        phi = off / math.sqrt(both * (total - both) * n[0] * n[1]) if 0 < both < total else 0.0
        return (math.log((1 + len(rows)) / (1 + df_of[t])) + 1) * (0.01 + phi)

    vocabulary = {t for k in labels for t in counts[k]}

    def vector(k):
        raw = {t: (1 + math.log(c)) * weight(t) for t, c in counts[k].items() if t in vocabulary}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    vectors = {k: vector(k) for k in counts}
    for k, _ in rows:
        cosines = {e: round(sum(w * vectors[e].get(t, 0.0) for t, w in vectors[k].items()), 9) for e in labels}
        near = sorted((c for c in cosines.values() if c > 0), reverse=True)[:15]
        assert [cosines[e] for e in got[k].evidence] == pytest.approx(near, abs=2e-9)
        if not near:
            assert got[k].score == model.without
        elif len({c for c in cosines.values()} & {near[-1]}) and sum(c >= near[-1] for c in cosines.values()) == len(near):
            votes = [1 / (1.05 - cosines[e]) for e in got[k].evidence]
            raw = sum(w * labels[e] for w, e in zip(votes, got[k].evidence, strict=True)) / sum(votes)
            assert any(got[k].score == pytest.approx(model.calibrated(raw + d)) for d in (0, 1e-7, -1e-7))


def test_isotonic_rises():
    xs, ys = toxicity.isotonic([0.1, 0.2, 0.3, 0.4] * 30, [0, 1, 0, 1] * 30)
    assert xs == [0.1, 0.2, 0.4] and ys == [0, 0.5, 1]
    assert toxicity.isotonic([0.1, 0.1], [0, 1], [3.0, 1.0]) == ([0.1], [0.25])


def test_toxicity(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("lmnopqrst") for _ in range(5))
    rows = []
    for k in range(600):
        bad = k % 5 == 0
        text = " ".join([word() for _ in range(20)] + [rng.choice(["awful", "nasty", "grimly", "grimmer"]) for _ in range(2 * bad)])
        rows.append((k, text, "l", "s", "y", True))
    rows += [(600, None, None, None, None, None), (601, "", "l", "s", "y", True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, y string, example boolean")
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(600)] + [(3, 1, 0), (7, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(df, labels)
    out = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())
    held = [r for d, r in out.items() if r.held_out and d < 600]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.95
    assert out[600].score == out[601].score < 0.5 and out[600].predicted == 0
    assert any(r.evidence for r in out.values())
    kept = toxicity.reject(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, r in out.items() if not r.predicted}
    alone = toxicity.fit(df, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score(df, alone).collect()} == {0.0}
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), labels.limit(0))).count() == 0


# ---- 9 -------------------------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def luhn(digits):
        return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0

    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()  # noqa: B023
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark):
    import random

    rng = random.Random(2)
    parts = list("0123456789") * 2 + list(" -.+()@a_é😀%") + ["4539578763621486", "192.168.1.2", "a.b@c.d", "+1 (555) 123-4567", " (at) "]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for k in range(800)]
    rows += [(800, None), (801, ""), (802, "x@y.z " * 700), (803, "9" * 20_000), (804, "é" * 50_000 + " a@b.c"), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = pii.fit(spark)
    out = defaultdict(list)
    for r in pii.summary(pii.find(df, model)).collect():
        out[r.doc_id].append(r)
    for doc, text in rows:
        base = base_spans(text or "")
        for r in out[doc]:
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in base) for k in BASE)
            assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert set(base) <= set(filter(None, r.spans.split(",")))
    assert pii.summary(pii.find(empty(spark), model)).count() == 0
    plan = pii.summary(pii.find(df, model))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def all_matches(text, pattern, start):
    first, later, at = re.compile(pattern), re.compile(start + "(?:" + pattern + ")"), 0
    while m := first.match(text, at) or later.search(text, at):
        yield m
        at = m.end()


def numbers(kind, found, before, after):
    """The features of a candidate, by other means than the operator's."""
    digits, low = re.sub("[^0-9]", "", found), before.lower()
    total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits or "1")))
    return {
        **{f"is_{k}": int(k == kind) for k in pii.KINDS}, "chars": len(found), "digits": len(digits), "luhn": int(total % 10 == 0),
        "separators": sum(not c.isascii() or not c.isalnum() for c in found), "brackets": sum(c in "[]()" for c in found), "colons": found.count(":"),
        "groups": len(re.split("[^0-9]+", found)), "glued_before": int(bool(before) and bool(regex.search(r"[\p{L}\p{N}_./-]\Z", before))),
        "glued_after": int(bool(regex.match(r"[\p{L}\p{N}_/-]", after))), **{n: int(bool(re.search(p, low))) for n, p in pii.CONTEXT.items()},
    }


def all_spans(text, model):
    base = {k: [tuple(map(int, s.split(":")[1:])) for s in base_spans(text) if s.startswith(k)] for k in pii.KINDS}
    out = []
    for kind in pii.KINDS:
        spans = set(base[kind])
        tried = [(m, m.end()) for m in all_matches(text, pii.BASE[kind], pii.STARTS[kind])] + [(m, m.end()) for m in all_matches(text, pii.MORE[kind], pii.MORE_STARTS[kind])]
        for m, end in tried:
            start = m.start()
            if (start, end) in base[kind] or any(a < end and start < b for a, b in base[kind]):
                continue
            # context ends at the last match before, of the same expression
            x = numbers(kind, m.group(), text[max(0, start - pii.CONTEXT_CHARS) : start], text[end : end + 1])
            if sum(t.value(x) for t in model.trees) >= model.thresholds[kind]:
                spans.add((start, end))
        out += [f"{kind}:{a}:{b}" for a, b in sorted(spans)]
    return ",".join(out)


def test_all_spans_are_those_of_brute_force(spark):
    import random

    rng = random.Random(11)
    model = pii.fit(spark)
    # apart by over the context's length, as a candidate's context ends at the match before it
    far = "".join(rng.choice("bcdfg ") for _ in range(60))
    texts = [t for _, t, _, _ in pii.made_up(5, 400)] + [f" {far} ".join(t for _, t, _, _ in pii.made_up(seed, 6)) for seed in range(20, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.spans for r in pii.summary(pii.find(df, model)).collect()}
    assert sum(bool(v) for v in got.values()) > 100
    wrong = [(t, got[k], all_spans(t, model)) for k, t in enumerate(texts) if got[k] != all_spans(t, model)]
    assert not wrong, (len(wrong), wrong[:3])


def test_added_spans_held_out(spark):
    made = pii.made_up(77, 1500)
    df = spark.createDataFrame([(k, t) for k, t, _, _ in made], "doc_id int, text string")
    got = {r.doc_id: {tuple(s.split(":")) for s in r.spans.split(",") if s} for r in pii.summary(pii.find(df, pii.fit(spark))).collect()}
    for kind in pii.KINDS:
        found = right = wanted = 0
        for k, text, y, value in made:
            mine = {text[int(a) : int(b)] for what, a, b in got[k] if what == kind}
            if base_spans(text):
                continue
            found, right, wanted = found + len(mine), right + (y == kind and value in mine), wanted + (y == kind)
        assert right / max(1, found) >= 0.9 and right / wanted >= 0.9, (kind, found, right, wanted)


def test_many_matches_in_one_text(spark):
    import random

    rng = random.Random(12)
    model, parts = pii.fit(spark), []
    for k in range(3_000):
        parts.append(rng.choice(["a@b.cc", "é😀", "1.2.3.4", "+1 555 123-4567", "300.1.2.3", "word " * 40, "(at) x"]))
    text = " ".join(parts) + " " + "ß" * 9_000 + " z@y.xx"
    r = pii.summary(pii.find(spark.createDataFrame([(1, text)], "doc_id int, text string"), model)).first()
    base = base_spans(text)
    assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in r.spans.split(",")))
    want, at = "", 0
    for a, b, kind in spans:
        if a >= at:
            want += text[at:a] + f"<{kind}>"
        at = max(at, b)
    assert pii.redact(spark.createDataFrame([(1, text)], "doc_id int, text string"), model).first().text == want + text[at:]


def test_candidates_beyond_the_base_rules(spark):
    texts = ["please call me at (555) 123-4567 soon", "write to jo.do (at) example (dot) com now", "amex 378282246310005 ok", "555-4208 4539578763621486", "order 123-456-7890 shipped", "version 300.1.2.3 of it", "login from 10[.]20[.]30[.]40 today", "at 12:30:45 or 01:02:03:04:05:06 it", "host 2001:db8:85a3:1:2:8a2e:370:7334 is up"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.spans for r in pii.summary(pii.find(df, pii.fit(spark))).collect()}
    assert got[0].startswith("phone:") and got[1].startswith("email:") and "card:" in got[2] and "card:9:25" in got[3]
    assert got[4] == "" and got[5] == "" and got[7] == ""
    assert got[6].startswith("ip:") and got[8].startswith("ip:")


def test_redaction(spark):
    rows, df = documents(spark)
    model = pii.fit(spark)
    out = pii.redact(df, model)
    assert out.columns == df.columns and out.count() == len(rows)
    for r in out.where("text like '%nïc%'").collect():
        assert "<email>" in r.text and "<phone>" in r.text and "@" not in r.text
    plain = {r[0]: r[1] for r in rows if r[1] and not base_spans(r[1])}
    for r in out.collect():
        if r.doc_id in plain and r.doc_id != 2:
            assert r.text == plain[r.doc_id]


# ---- 10 ------------------------------------------------------------------------------------------------------------------


def fingerprint(text, width=3):
    w = re.findall(WORDS, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(prints, radius):
    ids = sorted(prints)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_simhash(spark, radius):
    rows, df = documents(spark, rows=48)
    rows = [r for r in rows if r[0] is not None and r[0] != 2]
    df = df.where("doc_id is not null and doc_id <> 2")
    prints = {r[0]: fingerprint(r[1]) for r in rows}
    want = groups(prints, radius)
    out = simhash.near_duplicates(df, radius=radius).collect()
    assert {r.doc_id: r.fingerprint for r in out} == {d: f"{f:016x}" for d, f in prints.items()}
    assert {r.doc_id: r.component_id for r in out} == want
    kept = simhash.keep_one(df, radius=radius)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_chains_of_fingerprints(spark):
    # each two bits from the next: one component, found in several rounds
    value, chain = 0, []
    for k in range(30):
        chain.append((value,))
        value ^= 3 << (2 * k)
    df = spark.createDataFrame(chain, "fp bigint")
    linked = simhash.components(simhash.links(df, 2))
    assert linked.select("component").distinct().count() == 1 and linked.count() == 30


def test_simhash_nulls_and_repeats(spark):
    rows, df = documents(spark)
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = [r.doc_id for r in simhash.keep_one(df).collect()]
    assert kept.count(2) <= 1 and None in kept


def test_similar_texts(spark):
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(40):
        base = [word() for _ in range(300)]
        rows.append((10 * k, " ".join(base)))
        near = list(base)
        for _ in range(2):
            near[rng.randrange(300)] = word()
        rows.append((10 * k + 1, " ".join(near)))
        far = list(base)
        far[::4] = [word() for _ in far[::4]]
        rows.append((10 * k + 2, " ".join(far)))
    rows += [(1000, rows[0][1]), (1001, ""), (1002, None), (None, "no id"), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id bigint, text string, node int, a string").repartition(4)
    kept = simhash.keep_one(df, similarity=0.8)
    assert kept.columns == df.columns
    got = [r.doc_id for r in kept.collect()]
    assert {d for d in got if d is not None and d % 10 == 2 and d < 1000} == {10 * k + 2 for k in range(40)}
    assert {d for d in got if d is not None and d % 10 == 0 and d < 1000} == {10 * k for k in range(40)}
    assert not any(d is not None and d % 10 == 1 and d < 1000 for d in got)
    assert 1000 not in got and got.count(None) == 2 and (1001 in got) != (1002 in got)
    assert simhash.keep_one(empty(spark), similarity=0.8).count() == 0


def shingle_set(text, width=5):
    w = words(text)
    return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} or ({" ".join(w)} if w else set())


def similar_groups(texts, similarity=0.8):
    """Components of ids whose shingle sets are as similar, by brute force; alone ones left out."""
    sets = {d: shingle_set(t) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    named = {d: find(d) for d in ids}
    sizes = Counter(named.values())
    return {d: c for d, c in named.items() if sizes[c] > 1}


def linked_groups(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    return {r.node: r.component for r in simhash.components(simhash.similar_links(df, 0.8)).collect()}


def test_texts_that_share_a_passage_are_not_linked(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(258)]
    texts = {k: " ".join(passage + [word() for _ in range(42)]) for k in range(100)}
    assert similar_groups(texts) == {} and linked_groups(spark, texts) == {}


def test_similar_pairs_near_the_threshold(spark):
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = {}
    for k in range(60):
        base = [word() for _ in range(404)]
        new = 30 + k % 20
        texts[2 * k] = " ".join(base)
        texts[2 * k + 1] = " ".join(base[:-new] + [word() for _ in range(new)])
    want = similar_groups(texts)
    assert 40 < len(want) < 120
    assert linked_groups(spark, texts) == want


def test_all_that_share_shingles_are_compared(spark, monkeypatch):
    import random

    # no shingle is known as frequent: those of the templates are in the prefixes of many that aren't similar
    monkeypatch.setattr(simhash, "ORDER_DOCS", 0)
    monkeypatch.setattr(simhash, "ROUND_PAIRS", 1)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    templates = [[word() for _ in range(24)] for _ in range(4)]
    tails = [word() for _ in range(3)]
    texts = {}
    for k in range(300):
        base = list(rng.choice(templates))
        for _ in range(rng.randrange(3)):
            base[rng.randrange(24)] = rng.choice(tails)
        texts[k] = " ".join(base + [rng.choice(tails) for _ in range(rng.randrange(5))])
    assert linked_groups(spark, texts) == similar_groups(texts)


def test_hubs_and_chains(spark):
    from ssaflow.llm.components import components

    links = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000 + k, 900) for k in range(50)] + [(7, 7), (12, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint").repartition(3)).collect()}
    assert got == {k: 0 for k in range(300)} | {k: 1000 for k in range(1000, 1041)} | {5000 + k: 900 for k in range(50)} | {900: 900}


def test_rare_toxic_words_are_learnt(spark):
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("lmnopqrst") for _ in range(5))
    toxic = lambda k: k % 2 == 0
    rows = [(k, " ".join([word() for _ in range(12)] + ["vile" if k % 40 == 0 else "awful"] * toxic(k))) for k in range(2400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(toxic(k))) for k, _ in rows], "doc_id bigint, toxic int")
    out = {r.doc_id: r for r in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    assert all(out[k].predicted == 1 for k in range(0, 2400, 40))
    assert sum(r.predicted for d, r in out.items() if not toxic(d)) <= 12
