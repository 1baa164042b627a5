"""Token alignment against a token-by-token version."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.cases import frame, words
from tickloom.llm import alignment
from tickloom.llm.alignment import align_tokens, byte_of_letter, groups_of, words_of

NAMES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def plain(texts):
    a = Tokenizer.from_file(public_tokenizers.path(NAMES[0]))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(NAMES[1]))
    letters = byte_of_letter()
    found, links = [], []
    for text in texts:
        if not text:
            found.append(([], [], []))
            links.append([])
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[letter] for letter in a.id_to_token(number)) for number in ids_a]
        pieces = [b.id_to_piece(number) for number in ids_b]
        bytes_b = [bytes([int(x[3:-1], 16)]) if b.is_byte(n) else x.replace("▁", " ").encode() for x, n in zip(pieces, ids_b)]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append(([], [], []))
            links.append([])
            continue
        at_a, at_b = [dict(zip(np.cumsum([len(x) for x in own]).tolist(), ids)) for own, ids in ((bytes_a, ids_a), (bytes_b, ids_b))]
        groups, one, two, linked = [], [], [], []
        for offset in sorted({*at_a, *at_b}):
            one += [at_a[offset]] if offset in at_a else []
            two += [at_b[offset]] if offset in at_b else []
            if offset in at_a and offset in at_b:
                linked.append((at_a[offset], at_b[offset]))
                groups.append(f"{','.join(map(str, one))}|{','.join(map(str, two))}")
                one, two = [], []
        found.append((ids_a, ids_b, groups))
        links.append(linked)
    counts = Counter(pair for own in links for pair in own)
    best = defaultdict(int)
    for (_, number), count in counts.items():
        best[number] = max(best[number], count)
    return [
        (len(one), len(two), len(groups), len(own), sum(counts[pair] == best[pair[1]] for pair in own), sum(counts[pair] for pair in own),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if one else "")
        for (one, two, groups), own in zip(found, links)
    ]


def texts():
    source = random.Random(5)
    pool = "abcdeABC12  \n\t'sé漢字🙂́　\x1c▁"
    odd = ["".join(source.choice(pool) for _ in range(source.randrange(1, 40))) for _ in range(150)]
    return [
        None, "", " ", "  two  spaces  ", "plain words of a text", "plain words of a text", "<|endoftext|> and <s> </s> <unk> <0x41>", "it's we'll THEY'RE",
        "a▁b underscore", "line one\n\nline two \n three", "tab\tand\r\nreturn", " leading", "trailing ", "\x00 null byte \x00", "𝒳 math 𝒴", "x" * 3000,
        words(1, 30000, 3000), "naïve café Straße", " nbsp  here", *odd,
    ]


def test_alignment_like_token_by_token(spark):
    given = texts()
    rows = [(2**60 + at, text, "en", "s", None) for at, text in enumerate(given)] + [(None, "plain words of a text", "en", "s", None)]
    wanted = plain([row[1] for row in rows])
    assert sum(row[0] > 0 for row in wanted) > 80 and sum(row[0] == 0 for row in wanted) > 5
    for size in (200, 1 << 20):
        found = align_tokens(frame(spark, rows).repartition(3), *NAMES, block_characters=size).collect()
        assert sorted(map(tuple, found), key=repr) == sorted(((row[0], *one) for row, one in zip(rows, wanted)), key=repr)


def test_a_worker_that_starts_anew(spark, monkeypatch):
    monkeypatch.setattr(alignment, "WORDS_KEPT", 3)
    lexicon, by_word = alignment.lexicon_of(*NAMES)
    assert by_word
    lexicon.clear()
    for number in range(2):
        block = alignment.Block(lexicon, by_word)
        block.add(number, "some words again")
        docs, whole = block.rows(number)
        assert docs["n_groups"][0] > 2 and whole["counts"][0].sum() == docs["n_links"][0]
        lexicon.clear()


def test_no_documents(spark):
    assert align_tokens(frame(spark, []), *NAMES).count() == 0
    nothing = align_tokens(frame(spark, [(1, None, "en", "s", None)]), *NAMES).collect()
    assert [tuple(row) for row in nothing] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_pointers_reach_the_last_token_of_a_group():
    source = random.Random(3)
    for _ in range(200):
        total = source.randrange(1, 60)
        ends = [np.array(sorted({*source.sample(range(1, total + 1), source.randrange(1, total + 1)), total})) for _ in range(2)]
        both = np.intersect1d(*ends)
        group_a, group_b, last_b = groups_of(*ends)
        assert np.array_equal(group_a, np.searchsorted(both, ends[0])) and np.array_equal(group_b, np.searchsorted(both, ends[1]))
        assert np.array_equal(ends[1][last_b], both)


def test_very_long_white_space():
    tokenizer = alignment.ByteTokenizer(public_tokenizers.path(NAMES[0]))
    whole = Tokenizer.from_file(public_tokenizers.path(NAMES[0]))
    for text in (" " * 1_000_000, " " * 300_000 + "x", "a b" + "\n" * 400_000):
        assert tokenizer.encode([text]) == [whole.encode(text, add_special_tokens=False).ids]


def test_words_join_to_the_text():
    for text in texts():
        if text:
            assert " ".join(words_of(text)) == text
