"""Token alignment against the libraries on whole texts and a plain two-pointer walk."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from loomwork.llm import alignment, text

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "   ", "a", " lead", "trail  ", "a  b\n\nc\t d ", "▁x", "x▁ y", "ﬁ ½ é é 　x", "\x00a\x01b\r\n", "<s> </s> <unk> <0x41> <|endoftext|>x", "中文 \U0001f600\U0001f600 ok", "it's 'll THE the", "1234567 89", "� ﻿​"]


def texts(n=60, seed=5):
    rng = random.Random(seed)
    alphabet = "abcdefghijk thtion  \n\té中\U0001f600<>|.,'0123XYZ"
    out = [*ODD, *["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(n)], " ".join(rng.choice(["the", "nation", "of", "Überraschung", "élan"]) for _ in range(9000))]
    return [*out, out[20]]


def plain(rows):
    """One dictionary a text, in the order of rows."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.no_truncation()
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    from loomwork.llm.bpe import byte_letters

    letters, names = byte_letters(), {i: s for s, i in t.get_vocab().items()}
    b_bytes = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    out, count = [], Counter()
    for x in rows:
        want = (" " + x).encode() if x else b""
        a = t.encode(" " + x, add_special_tokens=False).ids if x else []
        b = sp.encode(x) if x else []
        pa_, pb = [bytes(letters[c] for c in names[i]) for i in a], [b_bytes(i) for i in b]
        if b"".join(pa_) != want or b"".join(pb) != want:
            a, b, pa_, pb = [], [], [], []
        spans = lambda ps: [(sum(map(len, ps[:0])) + s, s + n) for s, n in zip(np.cumsum([0, *map(len, ps)])[:-1].tolist(), map(len, ps), strict=True)]
        sa, sb, links, i, j = spans(pa_), spans(pb), [], 0, 0
        groups, ga, gb = [], [], []
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            end_a, end_b = sa[i][1], sb[j][1]
            if not ga or ga[-1] != i:
                ga.append(i)
            if not gb or gb[-1] != j:
                gb.append(j)
            if end_a == end_b:
                groups.append(",".join(str(a[k]) for k in ga) + "|" + ",".join(str(b[k]) for k in gb))
                ga, gb = [], []
            i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        count.update(links)
        out.append({"n_a": len(a), "n_b": len(b), "n_groups": len(groups), "n_links": len(links), "groups": ";".join(groups), "links": links})
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    for r in out:
        links = r.pop("links")
        r["n_best"] = sum(count[x] == best[x[1]] for x in links)
        r["count_sum"] = sum(count[x] for x in links)
    return out


@pytest.mark.parametrize("at_once", [4_000_000, 200])
def test_alignment(spark, monkeypatch, at_once):
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", at_once)  # few: several rounds
    rows = texts()
    ids = [None if i == 3 else i for i in range(len(rows))]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in zip(ids, rows, strict=True)], "doc_id long, text string, lw_pairs string, n_a int, groups int").repartition(3)
    got = alignment.align(df, A, B, ("groups", "groups_sha256")).collect()
    want = sorted(((i is None, i or 0), sorted(w.items())) for i, w in zip(ids, plain(rows), strict=True))
    seen = sorted(((r.doc_id is None, r.doc_id or 0), sorted((k, v) for k, v in r.asDict().items() if k not in ("doc_id", "groups_sha256"))) for r in got)
    assert seen == want
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got)
    assert any(w["n_a"] == 0 for w in plain(["x▁y"]))


def test_alignment_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, A, B).count() == 0
    with pytest.raises(ValueError, match="n_a"):
        alignment.align(spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, n_a int"), A, B, keep=("doc_id", "n_a"))


def test_colliding_words_are_encoded_whole(monkeypatch):
    from loomwork.llm import bpe

    one, two = alignment.ByteWords(bpe.load_spec(A, special=False), open(A, "rb").read()), alignment.PieceWords(open(B, "rb").read())
    monkeypatch.setattr(text, "range_hashes", lambda buf, starts, ends: (ends - starts).astype(np.uint64))  # words of one length collide
    buf, off = text.utf8(pa.array([" the cat", " dog sat", " a"]))
    for words in (one, two):
        ids, rows, ok = alignment.encoded(words, buf, off)
        assert ok.all() and words.vocabulary.spell(ids).tobytes() == buf.tobytes()


def test_intervals():
    a, b, closes = alignment.intervals(np.array([2, 5, 6]), np.array([1, 5, 6]))
    assert a.tolist() == [0, 0, 1, 2] and b.tolist() == [0, 1, 1, 2] and closes.tolist() == [False, False, True, True]
