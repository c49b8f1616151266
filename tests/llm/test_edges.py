"""Rows that share an id or have none, hashes that must not collide, hot groups and the queries' own columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwork.llm import bpe, fingerprints, jaccard, language, mixing, registry, sharding, substrings, suffixes, text, topk, toxicity


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def run_of(prefix, n, first=0):
    return " ".join(f"{prefix}{k}" for k in range(first, first + n))


def thue_morse(n, flip):
    return "".join("ab"[(bin(k).count("1") + flip) & 1] for k in range(n))


def test_words_of_polynomial_collisions_differ():
    pair = [thue_morse(2048, 0), thue_morse(2048, 1)]
    buf, off = text.utf8(pa.array(pair, pa.string()))
    a, b = text.range_hashes(buf, off[:-1], off[1:])
    assert a != b
    rng = random.Random(8)
    many = list({"".join(rng.choice("ab\0é") for _ in range(rng.randint(0, 20))) for _ in range(20_000)})
    buf, off = text.utf8(pa.array(many, pa.string()))
    assert len(set(text.range_hashes(buf, off[:-1], off[1:]).tolist())) == len(many)


def test_long_words_are_told_apart(spark):
    a, b = thue_morse(2048, 0), thue_morse(2048, 1)
    docs = spark.createDataFrame([(1, a), (2, b), (3, run_of("k", 19) + " " + a), (4, run_of("k", 19) + " " + b)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.similarity_components(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 3 if 14 * 4 >= 3 * 16 else 4}
    assert [r.lw_n_removed for r in substrings.remove_repeats(docs).collect()] == [0, 0, 0, 0]


def shared_id_rows():
    rows = [(None, run_of("a", 30)), (None, run_of("x", 5) + " " + run_of("a", 30)), (None, run_of("q", 60))]
    rows += [(7, run_of("a", 30)), (7, run_of("y", 3) + " " + run_of("a", 30, 2)), (7, run_of("z", 60)), (7, run_of("z", 60)), (9, run_of("z", 50, 5) + " end")]
    return [*rows, (None, None), (8, ""), (8, None)]


@pytest.mark.parametrize("window", [20, 7])
def test_spans_belong_to_rows(spark, window):
    rows = shared_id_rows()
    seen = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            seen.setdefault(tuple(w[p : p + window]), set()).add((-1 if i is None else i, p))
    want = Counter()
    for i, t in rows:
        w, j = words(t), -1 if i is None else i
        gone = {k for p in range(len(w) - window + 1) if min(seen[tuple(w[p : p + window])]) < (j, p) for k in range(p, p + window)}
        want[i, t, len(gone), None if t is None else " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text, r.lw_n_removed, r.lw_kept) for r in substrings.remove_repeats(docs, window).collect())
    assert got == want and next(n for i, t, n, _ in got if t == run_of("q", 60)) == 0


def test_small_buckets_and_pieces(spark, monkeypatch):
    """Many buckets and pieces for a few rows give what one gives."""
    rows = [(i, t) for i, (_, t) in enumerate(shared_id_rows() * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    take = lambda: (sorted((r.doc_id, r.lw_n_removed) for r in substrings.remove_repeats(docs).collect()), sorted((r.doc_id, r.n_removed) for r in suffixes.remove_shared(docs, ("kept_sha256",)).collect()), sorted((r.doc_id, r.component_id) for r in jaccard.similarity_components(docs).collect()))
    one = take()
    monkeypatch.setattr("loomwork.llm.exchange.BUCKET_TEXT", 40)
    assert take() == one


def test_texts_of_one_id_are_one_document(spark):
    t = [run_of(c, 12) for c in "abcde"]
    rows = [(1, t[0]), (2, t[1]), (3, t[0]), (3, t[1]), (4, t[2]), (None, t[2]), (None, t[3]), (None, t[4]), (None, t[4]), (None, None), (6, "")]
    got = Counter((r.doc_id, r.component_id) for r in jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, 1), (2, 1), (3, 1), (3, 1), (4, 4), (None, 4), (None, None), (None, None), (None, None), (None, None), (6, 6)])


def test_shared_masks_are_exact(monkeypatch):
    reach, rng = suffixes.REACH, random.Random(1)
    for chunk in (suffixes.CHUNK, 200):
        monkeypatch.setattr(suffixes, "CHUNK", chunk)
        for _ in range(20):
            m = rng.randint(1, 100)
            base = [bytes(rng.choice(b"ab") for _ in range(reach)) for _ in range(3)]

            def side():
                x = bytearray(rng.choice(base))
                for _ in range(rng.randint(0, 2)):
                    x[rng.randrange(reach)] = rng.choice(b"abc\0")
                return bytes(x)[: rng.choice([reach, reach, rng.randint(0, reach)])]

            left, right = [side() for _ in range(m)], [side() for _ in range(m)]
            group, doc = [rng.randint(0, 4) for _ in range(m)], [rng.randint(0, 9) for _ in range(m)]
            low = {}
            strings = [[(group[k], o, left[k][:o], right[k][: reach - o]) for o in range(reach + 1) if len(left[k]) >= o and len(right[k]) >= reach - o] for k in range(m)]
            for k in range(m):
                for s in strings[k]:
                    low[s] = min(low.get(s, 99), doc[k])
            want = [sum(1 << s[1] for s in strings[k] if low[s] < doc[k]) for k in range(m)]
            pad = lambda xs: np.frombuffer(b"".join(x.ljust(reach, b"\0") for x in xs), np.uint8).reshape(-1, reach)
            size = lambda xs: np.array([len(x) for x in xs])
            assert suffixes.shared_masks(np.array(group, np.uint64), np.array(doc), pad(left), size(left), pad(right), size(right)).tolist() == want


def test_rows_without_ids_are_mixed_each(spark):
    df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("s").alias("source"))
    got = mixing.poisson_mix(df).collect()
    assert len({r.lw_key for r in got}) == len(got) and len(got) == pytest.approx(2000, rel=0.1)
    assert set(Counter(r.text for r in got).values()) > {1, 2, 3}


def test_topk_of_repeated_ids_and_huge_components(spark):
    rng = np.random.default_rng(5)
    v = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)] + [(50, [1.0, 0.5, 0.25, 0.0]), (50, [-1.0, 0.5, 0.25, 2.0]), (60, [1e200, 0.0, 0.0, 0.0]), (61, [1e6, 0.0, 0.0, 0.0])]
    got = Counter(tuple(r) for r in topk.exact_topk(spark.createDataFrame(v, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    ints = [(i, np.floor(256 * np.array(x)).astype(np.int64)) for i, x in v if i != 60]
    want = Counter()
    for n, (i, q) in enumerate(ints):
        if i % 50 == 0:
            want.update((i, k, j, s) for k, (s, j) in enumerate(((-s, j) for s, j in sorted((-int(q @ c), j) for m, (j, c) in enumerate(ints) if m != n)[:5]), 1))
    assert got == want


def test_groups_of_equal_texts_stay_whole(spark):
    rows = [(i, "some often repeated text" if i % 10 == 0 else "half " * 3 if i % 10 == 1 else None if i % 50 == 2 else f"text {i} " * (i % 9)) for i in range(6000)]
    got = sharding.vector_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    where = {}
    for r in got:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
        assert r["size"] == len(texts[r.doc_id] or "") + 1
    assert len(got) == 6000 and max(map(len, where.values())) == 1
    for measure in ("size", "n"):
        load = Counter()
        for r in got:
            load[r.shard] += r["size"] if measure == "size" else 1
        assert len(load) == 8 and max(load.values()) < (1.03 if measure == "size" else 1.6) * min(load.values())
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def plain_fingerprint(spark, t):
    """Bins of the hashes of a text's shingles, filled and cut to two hex digits, one bin after another."""
    w = words("".join(c.lower() for c in t))
    if not w:
        return ""
    hashes = lambda xs: [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x array<string>").select(F.transform("x", lambda w: F.xxhash64(w))).collect()]
    h = hashes([w])[0]
    parts = [h[k : k + 5] for k in range(len(h) - 4)] if len(h) >= 5 else None
    if parts is None:
        shingles = [spark.createDataFrame([(h,)], "h array<long>").select(F.xxhash64("h")).first()[0]]
    else:
        shingles = [r[0] for r in spark.createDataFrame([tuple(p) for p in parts], "a long, b long, c long, d long, e long").select(F.xxhash64("a", "b", "c", "d", "e")).collect()]
    bins = {}
    for s in shingles:
        b = s >> 56
        bins[b] = min(bins.get(b, s), s)
    draws = {(r.i, r.b): r.d for r in spark.createDataFrame([(i, b) for i in range(256) for b in bins], "i int, b long").select("i", "b", F.xxhash64("i", "b").alias("d")).collect()}
    out = []
    for i in range(256):
        value = bins.get(i - 128)
        for attempt in fingerprints._TRIES:
            value = bins.get(attempt[i] - 128) if value is None else value
        if value is None:
            value = bins[min(bins, key=lambda b: (draws[i, b], bins[b]))]
        out.append(f"{value & 255:02x}")
    return "".join(out)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    same = sum(a[k : k + 2] == b[k : k + 2] for k in range(0, 512, 2))
    return max(0.0, (same / 256 - 1 / 256) / (1 - 1 / 256))


def some_tables(spark, folder):
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(80)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    texts = [say(rng.randint(0, 90)) for _ in range(30)]
    texts += [texts[3], texts[4] + " more", None, "", "é中\U0001f600 ABC", say(3000)]
    ids = [3 * k for k in range(len(texts) - 1)] + [1 << 60]
    docs = spark.createDataFrame([(i, t, ("en", "fr", None)[k % 3], "s", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(k, [float(rng.random()) for _ in range(4)]) for k in range(120)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return dict(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    return folder, some_tables(spark, folder)


CONTRACT = {
    "op1": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op4": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op6": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op8": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op9": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op10": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
}


@pytest.mark.parametrize("op", list(CONTRACT))
def test_query_columns(spark, tables, op):
    import zlib

    folder, texts = tables
    df = next(f for name, f in registry.queries().items() if name.startswith(op + "_"))(spark, folder)
    assert dict(df.dtypes[: len(CONTRACT[op])]) == CONTRACT[op]
    rows = df.collect()
    if op != "op5":
        assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        if op in ("op1", "op6"):
            mod, rest = (4, 2) if op == "op1" else (3, 1)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1
        if op == "op6":
            assert r.predicted == (r.score >= 0.7)
        if op == "op9":
            assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None


def test_fingerprint_query_against_plain_python(spark, tables):
    folder, texts = tables
    got = {r.doc_id: r for r in fingerprints.op10_one_permutation_minhash(spark, folder).collect()}
    order = sorted(texts, reverse=True)
    known = {}

    def of(t):
        if t not in known:
            known[t] = plain_fingerprint(spark, t)
        return known[t]

    for i, j in list(zip(order, order[1:] + order[:1], strict=True))[:14]:
        t, u = texts[i] or "", texts[j] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == of(t) and r.edited_fingerprint == of(edited)
        assert r.near_edited == pytest.approx(plain_likeness(of(t), of(edited))) and r.near_next == pytest.approx(plain_likeness(of(t), of(u)))


def test_next_of_repeated_and_missing_keys(spark):
    rows = [(5, "a", 1), (5, "b", 2), (None, "c", 3), (None, "d", 4), (1 << 60, "e", 5), (1, "f", 6), (1, "f", 6)]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string, cell long"), ["text"]).collect()
    assert len(got) == len(rows) and Counter(r.text for r in got) == Counter(t for _, t, _ in rows) == Counter(r.next_text for r in got)
    follows = {(r.doc_id, r.text): r.next_text for r in got}
    assert follows[1 << 60, "e"] in "ab" and {follows[None, "c"], follows[None, "d"]} & {"e"}


def test_clashing_names_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1, 2)], "doc_id long, text string, source string, lw_rate int, lw_kept int")
    with pytest.raises(ValueError, match="lw_rate"):
        mixing.poisson_mix(docs)
    with pytest.raises(ValueError, match="lw_kept"):
        substrings.remove_repeats(docs)
    with pytest.raises(ValueError, match="lang_pred"):
        language.identify(docs.withColumn("lang", F.lit("en")).withColumn("lang_pred", F.lit("x")), keep=("doc_id", "lang_pred"))
    with pytest.raises(ValueError, match="ids"):
        bpe.encode_decode(docs.withColumn("ids", F.lit(1)), bpe.default_tokenizer(), ("ids",), keep=("doc_id", "ids"))


@pytest.mark.parametrize("most", [50_000, 1])
def test_next_of_very_many_equal_rows(spark, monkeypatch, most):
    monkeypatch.setattr(fingerprints, "MOST_REPEATED", most)
    equal = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("hot").alias("text"))
    rest = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "z")], "doc_id long, text string")
    got = fingerprints.with_next(equal.unionByName(rest).repartition(4), ["text"])
    pairs = Counter((r.doc_id, r.text, r.next_text) for r in got.collect())
    assert sum(pairs.values()) == 20_004 and pairs[None, "hot", "hot"] == 19_999 and pairs[2, "b", "b"] == 1 and pairs[2, "b", "a"] == 1
    assert Counter(k[2] for k in pairs.elements()) == Counter({"hot": 20_000, "b": 2, "a": 1, "z": 1})
    spread = got.groupBy(F.spark_partition_id()).count().orderBy(F.desc("count")).collect()
    assert len(spread) > 2 and spread[0]["count"] < 15_000
    with pytest.raises(ValueError, match="next_text"):
        fingerprints.with_next(rest.withColumn("next_text", F.lit("x")), ["text"])


def test_language_learns_from_the_end_of_long_texts(spark):
    """The languages differ only beyond the first 8000 characters, so only stretches from there can tell them apart."""
    rng = random.Random(4)
    same = " ".join(rng.choice(["ka", "lo", "mi"]) for _ in range(3000))
    tail = {"aa": "thing", "bb": "oiseau"}
    rows = [(i, lang, " ".join([same, *[f"{tail[lang]}{rng.choice('xyz')}" for _ in range(3000)]])) for i in range(60) for lang in tail]
    docs = spark.createDataFrame([(2 * i + (lang == "bb"), t, lang) for i, lang, t in rows], "doc_id long, text string, lang string")
    short = spark.createDataFrame([(-1, "thingx thingy thingz", None), (-2, "oiseaux oiseauy oiseauz", None)], docs.schema)
    got = {r.doc_id: r.lang_pred for r in language.identify(docs.unionByName(short)).collect()}
    assert got[-1] == "aa" and got[-2] == "bb"


def test_code_switched_words(spark):
    """Words of a text that changes its language halfway are labelled each with its own."""
    rng = random.Random(2)
    kinds = {"en": "the ing tion and er ed".split(), "fr": "eau oir que les ai ent".split()}
    make = lambda x, k: ["".join(rng.choice(kinds[x]) for _ in range(rng.randint(1, 3))) for _ in range(k)]
    model = language.train([" ".join(make(x, 40)) for x in ["en", "fr"] * 150], ["en", "fr"] * 150)
    assert (np.diag(model.transitions) > model.transitions.mean()).all()
    mixed = " ".join(make("en", 15) + make("fr", 15))
    buf, off = text.utf8(pa.array([mixed], pa.string()))
    e, rows = model.emissions(buf, off)
    total = language.forward_backward(e, rows, model.transitions)[0]
    assert total[0] == pytest.approx(15, abs=2) and total[1] == pytest.approx(15, abs=2)


def test_dense_features_by_hand():
    keys = toxicity._key_of(["grubling"])
    t = "You GRUBLING! gr0bl1ng? fine text"
    buf, off = text.utf8(pa.array([t, ""], pa.string()))
    x = dict(zip(toxicity.FEATURES, toxicity.dense_features(buf, off, keys, np.array([2.0]))[0], strict=True))
    assert x["words"] == pytest.approx(np.log(6)) and x["word_density"] == pytest.approx(2 / 5) and x["second_person"] == pytest.approx(1 / 5)
    assert x["capitals"] == pytest.approx(9 / len(t)) and x["shouted"] == pytest.approx(1 / 5) and x["exclamation"] == pytest.approx(1 / len(t))
    assert x["question"] == pytest.approx(1 / len(t)) and x["obfuscated"] == pytest.approx(1 / 5) and x["punctuation"] == pytest.approx(2 / len(t))
    assert toxicity.dense_features(buf, off, keys, np.array([2.0]))[1].tolist() == [0.0] * len(toxicity.FEATURES)
