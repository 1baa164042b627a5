"""Packing, mixing, language, quality and the language model against plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import frame, of, plain_bytes, rows, words
from tickloom.llm import language, language_model, mixing, packing, quality

WORD = packing.tokenizer_path("word_bpe_49k.json")


def check_places(pieces, capacity):
    sequences = {}
    for sequence, offset, length in pieces:
        sequences.setdefault(sequence, []).append((offset, length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def plain_best_fit(lengths, capacity):
    """Number of sequences when every piece, longest first, goes where least room is left."""
    room = []
    for length in sorted(lengths, reverse=True):
        fitting = [at for at, left in enumerate(room) if left >= length]
        if fitting:
            room[min(fitting, key=lambda at: room[at])] -= length
        else:
            room.append(capacity - length)
    return len(room)


@settings(max_examples=150)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_best_fit(lengths):
    steps = packing.plan(Counter(lengths), 20)
    placed, ranks = [], Counter()
    for length, first, end, each, sequence, offset in steps:
        assert first == ranks[length]
        ranks[length] = end
        placed += [(sequence + at // each, offset + at % each * length, length) for at in range(end - first)]
    assert Counter(length for _, _, length in placed) == Counter(lengths)
    assert check_places(placed, 20) == plain_best_fit(lengths, 20)


def test_packing(spark):
    tokenizer, wanted = Tokenizer.from_file(WORD), []
    for doc_id, text, *_ in rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], dtype="<u4").tobytes()
            wanted.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)))
    found = of(packing.pack_documents(frame(spark)))
    assert sorted((row[:5] for row in found), key=repr) == sorted(wanted, key=repr)
    assert max(row[1] for row in found) >= 2
    assert check_places([(row[5], row[6], row[3]) for row in found], 4096) == plain_best_fit([row[3] for row in found], 4096)
    assert of(packing.pack_documents(frame(spark, []))) == []


def test_ids_and_round_trip(spark):
    tokenizer = Tokenizer.from_file(WORD)
    texts = ["İstanbul Straße don't 'S can'T.. a.b,, É x́.  z ﬁ", "<|endoftext|>a <|startoftext|>.", "<|ENDOFTEXT|> <|EndOfText|>B <|StartOfText|> A<|endoftext|>B <|x", "12,3. ΑΣ. ſ  K", "l'été. a,"]
    given = [(at, text, None, None, None) for at, text in enumerate(texts)]
    found = packing.tokenize(frame(spark, given), "word_bpe_49k.json", 5, with_ids=True).collect()
    for at, text in enumerate(texts):
        parts = b"".join(bytes(row["ids"]) for row in sorted(found, key=lambda row: row["piece"]) if row["doc_id"] == at)
        assert np.frombuffer(parts, dtype="<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def plain_targets(sizes, weights, epochs):
    """Clamp, share the excess by weight among the rest, and again until none is above."""
    names = sorted(sizes, key=lambda name: (name is None, name))
    weight = {name: weights[at % len(weights)] for at, name in enumerate(names)}
    clamped = {name for name in names if sizes[name] == 0}
    total = sum(sizes.values())
    while True:
        left = total - sum(epochs * sizes[name] for name in clamped)
        free = [name for name in names if name not in clamped]
        target = {name: left * weight[name] / sum(weight[n] for n in free) for name in free}
        above = {name for name in free if target[name] > epochs * sizes[name] * (1 + 1e-12)}
        if not above:
            return {**target, **{name: epochs * sizes[name] for name in clamped}}
        clamped |= above


def test_mixing(spark):
    docs = [(at, words(at, 3 + at % 17), None, f"s{at % 3}", None) for at in range(120)]
    docs += [(500, words(1, 9), None, "a", None), (501, None, None, "z", None), (502, "", None, None, None), (503, "x y", None, None, None), docs[4]]
    found = mixing.plan_mix(frame(spark, docs)).collect()
    again = mixing.plan_mix(frame(spark, docs[::-1])).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again)) and len(found) == len(docs)
    sizes = Counter()
    for _, text, _, source, _ in docs:
        sizes[source] += len(plain_bytes(text).split())
    wanted = plain_targets(sizes, (1, 2, 3), 3)
    taken = Counter()
    for row in found:
        assert row["source_size"] == sizes[row["source"]] and math.isclose(row["target"], wanted[row["source"]])
        assert 0 <= row["repeats"] <= 3
        taken[row["source"]] += row["size"] * row["repeats"]
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 3 or target == 3 * sizes[source] == taken[source]
    assert of(mixing.plan_mix(frame(spark, []))) == []
    assert {row["repeats"] for row in mixing.plan_mix(frame(spark, [(1, None, None, "a", None)])).collect()} <= {0, 1}


def test_language(spark):
    known = spark.createDataFrame(
        [(words(at, 60, 90), "aa") for at in range(6)] + [(words(at, 60, 90).replace("w", "zq"), "bb") for at in range(6)]
        + [(None, "aa"), ("text", None)], "text string, lang string",
    )
    page = '<html lang="{}"><script>zq1 zq2 zq3</script><p>{}</p></html>'
    pages = [(at, f"http://h{at % 3}.x.example/p", page.format("aa", words(50 + at, 40, 90))) for at in range(9)]
    pages += [(20 + at, "http://b.example.org", page.format("bb", words(60 + at, 40, 90).replace("w", "zq"))) for at in range(6)]
    pages += [(30, "http://b.example.org", '<html lang="bb"></html>'), (31, None, None), (32, "http://h1.x.example", ""), (33, "nonsense", "𐍈" * 500)]
    pages += [pages[0], (None, "http://h1.x.example", page.format("aa", words(70, 40, 90)))]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'clash' as host", "'clash' as row_id")
    found = {row["page_id"]: row for row in language.identify_pages(table, known).collect()}
    assert all(found[at]["lang"] == "aa" and found[at]["text_lang"] == "aa" for at in [*range(9), None])
    assert all(found[20 + at]["lang"] == "bb" for at in range(6))
    assert found[30]["lang"] == "bb" and found[30]["text_lang"] == "und"  # declaration and host alone
    assert found[33]["text_lang"] == "und" and not found[33]["accepted"]
    assert set(found) == {*range(9), *range(20, 26), 30, 31, 32, 33, None}
    assert language.identify_pages(table.where("false"), known).count() == 0
    assert {row["lang"] for row in language.identify_pages(table, known.where("false")).collect()} == {"und"}


def test_languages_of_many_labels(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    marks = ["w", "zq", "ß", "xv", "kj"]
    told = [(words(at, 60, 90).replace("w", mark), f"l{n}") for n, mark in enumerate(marks) for at in range(6 - n)]
    known = spark.createDataFrame(told, "text string, lang string")
    pages = [(n, f"http://h{n}.example/p", words(80 + n, 60, 90).replace("w", mark)) for n, mark in enumerate(marks)]
    table = spark.createDataFrame([*pages, pages[0]], "page_id long, url string, html string")
    found = sorted((row["page_id"], row["text_lang"], row["lang"]) for row in language.identify_pages(table, known).collect())
    assert found == sorted((n, f"l{n}", f"l{n}") for n in [*range(5), 0])
    docs = [(at, text, lang, "s", None) for at, (text, lang) in enumerate(told)]
    judged = language.decide_documents(*[frame(spark, [*docs, docs[0]])] * 2).collect()
    assert sorted(row["lang_found"] for row in judged) == sorted(lang for _, lang in told)


def test_quality(spark):
    good = [(at, words(at, 40 + at, 500), None, None, None) for at in range(60)]
    bad = [(100 + at, words(at, 20, 500) + " spam!!" * (30 + at) + " " + words(at + 1, 90, 500), None, None, None) for at in range(60)]
    docs = frame(spark, [*good, *bad, (300, None, None, None, None), (301, "", None, None, None), (None, "a", None, None, None), good[0]])
    labels = [(at, int(at < 100), 0) for at in [*range(0, 60, 2), *range(100, 160, 2)]] + [(None, 1, 0), (1, None, 0), (0, 1, 0), (999, 0, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'clash' as text")
    model = quality.train(docs, labels)
    again = quality.train(docs, labels)
    assert all(np.array_equal(model.layers[name], again.layers[name]) for name in model.layers)
    found = quality.score(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= row["score"] <= 1 for row in found)
    held_out = [(row["doc_id"], row["score"]) for row in found if row["doc_id"] is not None and row["doc_id"] < 200 and row["doc_id"] % 2]
    assert np.mean([(score >= 0.5) == (doc_id < 100) for doc_id, score in held_out]) >= 0.95
    assert quality.train(docs, labels.where("quality = 1")) == 1.0 and quality.train(docs, labels.where("false")) == 0.5
    assert [row["score"] for row in quality.score(docs.limit(1), 0.5).collect()] == [0.5]
    assert quality.score(docs.where("false"), model).count() == 0


def test_quality_sample_takes_texts_whole(spark, monkeypatch):
    """Bad texts are told by one passage far inside a long text; texts beyond the bound are left out of the fit."""
    monkeypatch.setattr(quality, "SAMPLE_PASSAGES", 1300)
    good = [words(at, 64 * 40, 900) for at in range(40)]
    bad = [f"{words(at, 64 * 20, 900)} {'$$ ## !! ' * 40} {words(at + 1, 64 * 20, 900)}" for at in range(100, 140)]
    docs = frame(spark, [(at, text, None, None, None) for at, text in enumerate(good + bad)] + [(99, words(9, 64 * 1400), None, None, None)])
    labels = spark.createDataFrame([(at, int(at < 40)) for at in range(80)] + [(99, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scores = {row.doc_id: row.score for row in quality.score(docs, model).collect()}
    right = [(scores[at] >= 0.5) == (at < 40) for at in range(80)]
    assert sum(right) >= 76
    monkeypatch.setattr(quality, "SAMPLE_PASSAGES", 3)
    assert quality.train(docs, labels) == 41 / 81


def plain_score(model, passages):
    """One text, a passage and a number at a time."""
    w = {name: value.tolist() for name, value in model.layers.items()}
    codes, raws = [], []
    for passage in passages:
        x = [min(8, max(-8, (value - mean) / spread)) for value, mean, spread in zip(passage, model.mean, model.deviation)]
        code = [math.tanh(sum(a * row[k] for a, row in zip(x, w["code"])) + w["code_bias"][k]) for k in range(len(w["code_bias"]))]
        value = [math.tanh(sum(a * row[k] for a, row in zip(code, w["value"]))) for k in range(len(w["gate_bias"]))]
        gate = [1 / (1 + math.exp(-sum(a * row[k] for a, row in zip(code, w["gate"])) - w["gate_bias"][k])) for k in range(len(w["gate_bias"]))]
        codes.append(code)
        raws.append(sum(a * b * c for a, b, c in zip(value, gate, w["weight"])))
    shares = [math.exp(raw - max(raws)) for raw in raws]
    whole = [sum(share * code[k] for share, code in zip(shares, codes)) / sum(shares) for k in range(len(w["out"]))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(whole, w["out"])) - w["bias"][0]))


def test_scores_like_one_text_at_a_time(spark):
    texts = [words(1, 300), words(2, 64), "", None, "A b! " * 70, words(3, 65) + " ü|"]
    bags = [quality.encode([plain_bytes(text)])[0].astype(float) for text in [words(at, 30 + 9 * at) for at in range(30)]]
    model = quality.Attention(quality.NUMBERS).fit(bags, np.arange(30) % 2 * 1.0, np.ones(30))
    found = quality.score(frame(spark, [(at, text, None, None, None) for at, text in enumerate(texts)]), model).collect()
    for row in found:
        passages = quality.encode([plain_bytes(texts[row["doc_id"]])])[0].tolist()
        assert row["score"] == pytest.approx(plain_score(model, passages), abs=1e-6)


def test_fused_evidence_like_one_row_at_a_time(spark):
    """The posterior of every row from counts over the other rows, in plain Python; text likelihoods as they are read."""
    german = str.maketrans("w", "ß")
    told = [(words(at, 80, 300), "en") for at in range(8)] + [(words(at, 80, 300).translate(german), "de") for at in range(8)]
    source, given = np.random.default_rng(3), []
    for at in range(40):
        text = None if at % 9 == 0 else words(50 + at, 3 + at % 20, 300).translate(german if at % 3 else {})
        pick = lambda *some: some[source.integers(len(some))]
        given.append((f"r{at}", text, pick("en", "de", None), pick("com", "de", None), pick("a.x", "b.x", "c.y", None), pick("x", "y", None)))
    rows = spark.createDataFrame(given, "row_id string, text string, declared string, suffix string, host string, domain string")
    labelled = spark.createDataFrame(told, "text string, lang string")
    found = {row["row_id"]: row for row in language.identify(rows, labelled).collect()}
    ((names, shares, last),) = language.likelihoods(labelled)
    evidence = {row["row_id"]: list(row["evidence"]) for row in language.text_evidence(rows, shares, False, last).collect()}
    names, texts = [*names, language.NONE], {}
    for row_id, own in evidence.items():
        texts[row_id] = None if not any(own) else names[own.index(max(own))]
    sure = [(row, texts[row[0]]) for row in given if texts[row[0]]]
    for row in given:
        others = [(other, lang) for other, lang in sure if other[0] != row[0]]

        def counted(keys, lang=None):
            return sum(all(other[key] == row[key] for key in keys) and lang in (None, own) for other, own in others)

        scores = []
        for place, lang in enumerate(names):
            share = (counted([], lang) + language.PSEUDO / len(names)) / (counted([]) + language.PSEUDO)
            for keys in ([5], [4, 5]):
                share = (counted(keys, lang) + language.PSEUDO * share) / (counted(keys) + language.PSEUDO)
            score = evidence[row[0]][place] + math.log(share)
            for key in (2, 3):
                if row[key] is not None:
                    score += math.log((counted([key], lang) + 0.5) / (counted([], lang) + 0.5 * language.PSEUDO))
            scores.append(score)
        posterior = 1 / sum(math.exp(score - max(scores)) for score in scores)
        best = max(zip(scores, names))[1]
        accepted = best != language.NONE and posterior > language.LEAST_POSTERIOR
        one = found[row[0]]
        assert one["posterior"] == pytest.approx(posterior, rel=1e-9) and one["accepted"] == accepted
        assert one["lang"] == (best if accepted else language.NONE)


def test_quality_gradients():
    random = np.random.default_rng(0)
    model = quality.Attention(6)
    numbers, each = random.normal(size=(9, 6)), np.array([2, 4, 3])
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        logit = model.forward(numbers, each)[-1]
        fit = (weight * (np.logaddexp(0, logit) - label * logit)).sum() / weight.sum()
        return fit + quality.PENALTY / 2 * sum((v * v).sum() for n, v in model.layers.items() if "bias" not in n)

    slopes = model.gradients(numbers, each, label, weight)
    for name, value in model.layers.items():
        at = tuple(0 for _ in value.shape)
        kept, value[at] = value[at], value[at] + 1e-6
        high = loss()
        value[at] = kept - 1e-6
        low = loss()
        value[at] = kept
        assert math.isclose(slopes[name][at], (high - low) / 2e-6, rel_tol=1e-4, abs_tol=1e-7), name


def plain_model(texts):
    read = [[*plain_bytes(text).lower().split(), None] for text in texts]
    count = Counter(word for text in read for word in text)
    pairs = Counter(pair for text in read for pair in zip(["start", *text], text, strict=False))
    follows = Counter(word for _, word in pairs)

    def taken(counts):
        return [0, *language_model.discounts([sum(n == k for n in counts.values()) for k in (1, 2, 3, 4)])]

    d_pair, d_word = taken(pairs), taken(follows)
    rest = sum(d_word[min(3, n)] for n in follows.values()) / len(pairs)
    total, left = Counter(), Counter()
    for (before, _), n in pairs.items():
        total[before] += n
        left[before] += d_pair[min(3, n)]

    def chance(before, word):
        n = follows[word]
        plain = max(n - d_word[min(3, n)], 0) / len(pairs) + rest / (len(count) + 1)
        if before not in total:
            return plain
        n = pairs[before, word]
        return max(n - d_pair[min(3, n)], 0) / total[before] + left[before] / total[before] * plain

    return count, chance


@pytest.mark.parametrize("frequent", [1000, 3])
def test_language_model(spark, monkeypatch, frequent):
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 3000)
    monkeypatch.setattr(language_model, "COMBINED_TOKENS", 2000)
    docs = [*rows(), *((1000 + at, words(at, 90, 60), None, None, None) for at in range(40)), (2000, words(99, 50, 70), None, None, None)]
    table = frame(spark, docs)
    learned = [row[1] for row in docs if row[0] != 2000]
    count, chance = plain_model(learned)
    model = language_model.train(table.where("doc_id is null or doc_id != 2000"))
    assert (model.total, model.words) == (sum(count.values()), len(count))
    found = sorted(language_model.score(table, model).collect(), key=repr)
    wanted = []
    for doc_id, text, *_ in docs:
        read = [*plain_bytes(text).lower().split(), None]
        base = sum(math.log10((count[word] + 1) / (model.total + model.words + 1)) for word in read)
        logs = sum(math.log10(chance(before, word)) for before, word in zip(["start", *read], read, strict=False))
        wanted.append((doc_id, len(read), sum(count[word] > 0 for word in read), base, logs))
    for got, row in zip(sorted(map(tuple, found), key=lambda r: repr(r[:3])), sorted(wanted, key=lambda r: repr(r[:3])), strict=True):
        assert got[:3] == row[:3]
    by = lambda r: (repr(r[:3]), round(r[4], 6))
    assert np.allclose([r[3:] for r in sorted(map(tuple, found), key=by)], [r[3:] for r in sorted(wanted, key=by)])
    assert math.isclose(sum(chance("start", word) for word in count) + chance("start", "never seen"), 1)
    language_model.forget(model)


def test_language_model_without_texts(spark):
    model = language_model.train(frame(spark, []))
    found = language_model.score(frame(spark, [(1, "a b", None, None, None), (2, None, None, None, None)]), model).orderBy("doc_id").collect()
    assert [tuple(row) for row in found] == [(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    assert language_model.score(frame(spark, []), model).count() == 0


def test_counts_beyond_four_bytes(tmp_path):
    model = language_model.Model(str(tmp_path), 1, 0, 0, 0, (0, 0, 0), 1.0, (0, 0, 0), np.zeros(0, np.uint64), np.zeros((0, 4)))
    keys = np.arange(3, dtype="<u8")
    for name, counts in (("small", np.array([[1, 2], [3, 4], [5, 2**32 - 1]])), ("large", np.array([[1, 2], [3, 4], [2**32, 2**40]]))):
        language_model.store(str(tmp_path), f"{name}-keys-0", keys)
        language_model.store(str(tmp_path), f"{name}-counts-0", language_model.narrowest(counts))
        found = language_model.Reader(model).look_up(keys, np.zeros(3, np.int64), (f"{name}-keys", f"{name}-counts"), None, 2)
        assert np.array_equal(found, counts)


def test_packed_arrays():
    found = np.array([0, 1, 2**48 - 1, 12345678901234], dtype=np.uint64)
    assert language_model.wide(language_model.narrow(found)).tolist() == found.tolist()
    keys, counts = language_model.summed(np.array([3, 1, 3], dtype=np.uint64), np.array([1, 5, 2]))
    assert keys.tolist() == [1, 3] and counts.tolist() == [5, 3]
