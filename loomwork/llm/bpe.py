"""BPE encoding and decoding: distinct words share the encodings of their common prefixes.

The encoding of a prefix is fixed by its last token: it is the encoding of the prefix without that token, followed by the
token. So each node of a trie of words needs one number, its last token, and a depth-first walk computes each
shared prefix once.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import text as T

#: Distinct words that a worker remembers between batches; beyond that it starts anew, with equal results.
REMEMBERED = 150_000
#: Pairs of tokens of which a worker knows whether they stay apart.
PAIRS_KNOWN = 500_000
LETTER, NUMBER, BLANK, OTHER, EDGE = 1, 2, 3, 0, 9


def byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in a byte-level vocabulary: printable Latin-1 stays, the rest moves up from 256."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def code_point_classes() -> np.ndarray:
    """Letter, number, white space or other for each code point.

    Libraries differ in their Unicode version: where two of them disagree, the tokenizers library is asked how it splits.
    """
    import unicodedata

    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    points = np.array([c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF], dtype=np.uint32)
    every, out = points.tobytes().decode("utf-32-le"), np.zeros(0x110000, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    pieces = lambda c, before: len(ask.pre_tokenize_str(before + chr(c)))
    ask = ByteLevel(add_prefix_space=False)
    for c in np.flatnonzero(out).tolist():
        if unicodedata.category(chr(c)) == "Cn":
            out[c] = LETTER if pieces(c, "a") == 1 else NUMBER if pieces(c, "1") == 1 else OTHER
    return out


def load_spec(path: str, *, special: bool = True) -> bytes:
    """What workers need of a tokenizer file, read where the path is valid (the driver): about a megabyte.

    Without ``special``, the strings of special tokens are text like any other.
    """
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    if t["model"]["type"] != "BPE" or (t["pre_tokenizer"] or {}).get("type") != "ByteLevel" or t["pre_tokenizer"]["add_prefix_space"] or not t["pre_tokenizer"].get("use_regex", True) or t["normalizer"]:
        raise ValueError("a byte-level BPE file without a normalizer or a prefix space is needed")
    if any(a.get(k) for a in t["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on what stands around them aren't supported")
    if any(t["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        raise ValueError("merges with dropout, subword prefixes or suffixes, or exceptions aren't supported")
    merges = [m if isinstance(m, str) else " ".join(m) for m in t["model"]["merges"]]
    spec = {"vocab": t["model"]["vocab"], "merges": merges, "special": {a["content"]: a["id"] for a in t["added_tokens"] if special}}
    return zlib.compress(json.dumps(spec).encode()) + b"|classes|" + zlib.compress(code_point_classes().tobytes())


class Codec:
    """Encodes words and decodes ids; one is kept by each worker process."""

    def __init__(self, spec: bytes) -> None:
        model, classes = spec.split(b"|classes|", 1)
        t, letters = json.loads(zlib.decompress(model)), byte_letters()
        self.classes = np.frombuffer(zlib.decompress(classes), dtype=np.uint8)
        self.special = {k.encode(): v for k, v in t["special"].items()}
        # the first one counts, and of those at one place the longest
        self.any_special = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or b"(?!)")
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.bytes_of = {i: to_bytes(s) for s, i in t["vocab"].items()} | {v: k for k, v in self.special.items()}
        self.rank: dict[int, int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank of the merge that makes it, left part, right part
        for r, m in enumerate(t["merges"]):
            a, b = m.split(" ")
            ia, ib, ic = t["vocab"][a], t["vocab"][b], t["vocab"][a + b]
            self.rank.setdefault(ia << 20 | ib, r)
            self.made.setdefault(ic, (r, ia, ib))
        self.tokens: dict[bytes, int] = {}
        for i in sorted(t["vocab"].values(), key=lambda i: self.made.get(i, (-1,))[0]):
            w = self.bytes_of[i]
            if len(w) == 1 or i in self.made and self._joins(i):
                self.tokens[w] = i
        self.longest = max(map(len, self.tokens))
        self.stable_pairs: dict[int, bool] = {}
        self.table: dict[bytes, int] = {}
        self.ids: list[tuple[int, ...]] = []
        self.id_text: list[bytes] = []
        self.decoded: list[bytes] = []

    def _undisturbed(self, a: int, b: int, bound: int) -> bool:
        """No merge across the border of a and b comes before `bound` or before either was made.

        Goes back in time: the later made of the two is taken apart, which leaves its part at the border.
        """
        while True:
            ra, rb = self.made.get(a, (-1,))[0], self.made.get(b, (-1,))[0]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                bound, a = ra, self.made[a][2]
            else:
                bound, b = rb + 1, self.made[b][1]
            if self.rank.get(a << 20 | b, bound) < bound:
                return False

    def _joins(self, token: int) -> bool:
        """Encoding the token's own bytes gives the token."""
        r, a, b = self.made[token]
        return self.bytes_of[a] in self.tokens and self.bytes_of[b] in self.tokens and self._undisturbed(a, b, r)

    def stable(self, a: int, b: int) -> bool:
        """Encoding the bytes of a and b together gives a and b."""
        key = a << 20 | b
        known = self.stable_pairs.get(key)
        if known is None:
            known = key not in self.rank and self._undisturbed(a, b, 1 << 60)
            if len(self.stable_pairs) > PAIRS_KNOWN:
                self.stable_pairs.clear()
            self.stable_pairs[key] = known
        return known

    def learn(self, new: list[bytes]) -> None:
        """Encode words that the table lacks, in the depth-first order of their trie (the sorted order).

        ``last`` holds the last token of every prefix on the path from the root to the present node.
        """
        tokens, known, stable, longest = self.tokens, self.stable_pairs, self.stable, self.longest
        last: list[int] = [0] * (max(map(len, new), default=0) + 1)
        size: list[int] = last.copy()
        before = b""
        for w in sorted(new):
            n, keep = len(w), 0
            most = min(n, len(before))
            if w[:most] == before[:most]:
                keep = most
            else:
                while w[keep] == before[keep]:
                    keep += 1
            for i in range(keep + 1, n + 1):
                for at in range(max(0, i - longest), i):
                    t = tokens.get(w[at:i])
                    if t is None:
                        continue
                    if at == 0:
                        break
                    p = last[at]
                    ok = known.get(p << 20 | t)
                    if ok or ok is None and stable(p, t):
                        break
                last[i], size[i] = t, i - at
            ids, i = [], n
            while i:
                ids.append(last[i])
                i -= size[i]
            self.put(w, tuple(reversed(ids)))
            before = w

    def put(self, w: bytes, ids: tuple[int, ...]) -> None:
        self.table[w] = len(self.ids)
        self.ids.append(ids)
        self.id_text.append((",".join(map(str, ids)) + ",").encode())
        back = b"".join([self.bytes_of[i] for i in ids])
        self.decoded.append(w if back == w else back)

    def forget(self) -> None:
        """Drop the words; what is encoded later learns them again, with equal results."""
        self.table.clear()
        self.ids, self.id_text, self.decoded = [], [], []

    def split(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the words of all rows (bytes, then the end), and the row offsets into them.

        Words are: a contraction after an apostrophe; a run of letters, of numbers or of other marks, with one space
        before it; white space, whose last character stands alone or goes to the next word. A special token is a word.
        """
        if not len(buf):
            return np.zeros(1, np.int64), np.zeros(len(off), np.int64)
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        points = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(points)
        kind = self.classes[points]
        edge = np.zeros(n + 1, dtype=bool)  # before this character a row or a stretch between special tokens starts
        rows = np.searchsorted(lead, off)
        edge[rows] = True
        edge[n] = True
        whole = []
        raw = buf.tobytes() if self.special else b""
        found = self.any_special.search(raw)
        while found:
            at, to = found.span()
            row = int(np.searchsorted(off, at, side="right")) - 1
            if to <= off[row + 1]:
                a, b = np.searchsorted(lead, [at, to])
                edge[a] = edge[b] = True
                whole.append((a, b))
            else:  # it goes on in the next row
                to = at + 1
            found = self.any_special.search(raw, to)
        before = np.where(edge[:-1], EDGE, np.concatenate([[EDGE], kind[:-1]]))
        after = np.where(edge[1:], EDGE, np.concatenate([kind[1:], [EDGE]]))
        blank = kind == BLANK
        after_space = np.zeros(n, dtype=bool)
        after_space[1:] = points[:-1] == 32
        after_space &= before != EDGE
        start = np.where(blank, (before != BLANK) | (after != BLANK) & (after != EDGE), (before != kind) & ~after_space)
        marks = np.flatnonzero((points == 39) & (before != OTHER) & ~after_space)
        if len(marks):
            padded = np.concatenate([points, [0, 0, 0]])
            one, two = padded[marks + 1], padded[marks + 2]
            fits1 = ~edge[marks + 1]
            fits2 = fits1 & ~edge[np.minimum(marks + 2, n)]
            short = fits1 & np.isin(one, [ord(c) for c in "stmd"])
            long = fits2 & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
            start[marks[short | long] + 1] = False
            ends = np.concatenate([marks[short] + 2, marks[long] + 3])
            start[marks[long] + 2] = False
            start[ends[ends < n]] = True
        for a, b in whole:
            start[a] = True
            start[a + 1 : b] = False
        starts = np.flatnonzero(start)
        return np.concatenate([lead[starts], [len(buf)]]), np.searchsorted(starts, rows)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The place in the table of every word of all rows, and the row offsets into them."""
        place, which, rows = self.distinct(buf, off)
        return place[which].tolist(), rows

    def distinct(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place in the table of every distinct word, which of them each word of all rows is, and the row offsets into the words."""
        bounds, rows = self.split(buf, off)
        if len(bounds) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), rows
        h = T.range_hashes(buf, bounds[:-1], bounds[1:])
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        raw = buf.tobytes()
        distinct = [raw[a:b] for a, b in zip(bounds[first].tolist(), bounds[first + 1].tolist(), strict=True)]
        if len(self.table) > REMEMBERED:
            self.forget()
        new = [w for w in distinct if w not in self.table]
        for w in new:
            if w in self.special:
                self.put(w, (self.special[w],))
        self.learn([w for w in new if w not in self.special])
        return np.array([self.table[w] for w in distinct], dtype=np.int64), which, rows

    def encode_one(self, text: bytes) -> list[int]:
        """The ids of one text, word by word; for texts where two words share a hash."""
        buf, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        bounds, _ = self.split(buf, off)
        ids: list[int] = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            w = text[a:b]
            if w not in self.table:
                self.put(w, (self.special[w],)) if w in self.special else self.learn([w])
            ids += self.ids[self.table[w]]
        return ids


_CODECS: dict[bytes, Codec] = {}


def codec(spec: bytes) -> Codec:
    key = hashlib.sha256(spec).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


_KINDS = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "ids_sha256": ("string", pa.string()), "decoded": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def encode_decode(docs: DataFrame, tokenizer: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Encode each whole text with the byte-level BPE file at ``tokenizer`` and decode its ids again.

    Returns the columns in ``keep``, then ``outputs``, which picks among n_tokens, ids, decoded and the SHA-256 of the last two (ids in decimal, joined by commas;
    decoded text in UTF-8). Nothing is added to a text; special tokens written in it get their ids. Null and empty
    texts have no token. Rows aren't moved or joined: repeated rows and null ids give rows like any other, an
    empty table an empty table. The file is read by the driver only and sent to the workers (about 1 MB). A column to keep that has
    the name of an output raises ValueError; others aren't read.
    """
    if clash := {*keep} & {*outputs}:
        raise ValueError(f"columns to keep have names of outputs: {sorted(clash)}")
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(tokenizer))
    ask = tuple(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for batch in batches:
            buf, off = T.utf8(batch.column(len(keep)))
            for at, to, part, part_off in T.pieces(buf, off):
                places, rows = c.encode(part, part_off)
                raw, got = part.tobytes(), {k: [] for k in ask}
                texts, backs = c.id_text, c.decoded
                for d in range(to - at):
                    mine = places[rows[d] : rows[d + 1]]
                    text = raw[part_off[d] : part_off[d + 1]]
                    back = b"".join([backs[p] for p in mine])
                    if back == text:
                        line = b"".join([texts[p] for p in mine])[:-1]
                    else:  # two words of the piece share a hash, or the vocabulary lacks a byte
                        flat = c.encode_one(text)
                        line, back = ",".join(map(str, flat)).encode(), b"".join([c.bytes_of[i] for i in flat])
                        texts, backs = c.id_text, c.decoded
                    if "n_tokens" in got:
                        got["n_tokens"].append(line.count(b",") + 1 if line else 0)
                    if "ids" in got:
                        got["ids"].append(np.array(line.split(b","), dtype=np.int32) if line else [])
                    if "ids_sha256" in got:
                        got["ids_sha256"].append(hashlib.sha256(line).hexdigest())
                    if "decoded" in got or "decoded_sha256" in got:
                        shown = back.decode("utf-8", "replace")
                        if "decoded" in got:
                            got["decoded"].append(shown)
                        if "decoded_sha256" in got:
                            got["decoded_sha256"].append(hashlib.sha256(shown.encode()).hexdigest())
                own = [c.slice(at, to - at) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(got[k], _KINDS[k][1]) for k in ask]], [*keep, *ask])
        c.forget()  # the worker process outlives the task and serves other steps next
        T.give_back()

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, F.col(text_col).alias("__lw_text")).mapInArrow(run, ", ".join([*fields, *[f"{k} {_KINDS[k][0]}" for k in ask]]))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, default_tokenizer(), ("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op4_bpe_round_trip": op4_bpe_round_trip}
