"""BPE encoding and decoding with a contiguous rank array.

A word is a row of parts; beside it stands the rank of each adjacent pair.  The
smallest rank (leftmost first) is found by a scan, its boundary deleted and the
two neighbouring ranks refreshed.  Words beyond ``SHORT`` parts do the same with a
heap over linked parts, as repeated scans would take quadratic time.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

SHORT = 96
NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else U+0100 and on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class BPE:
    """Reads a tokenizer file (byte-level BPE with an optional word-end suffix) and encodes on its own."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.specials = spec["model"], {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + suffix] for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        kinds = [s["type"] for s in steps]
        split = next(s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        if kinds != ["NFC", "Replace", "Lowercase"] or not (split["invert"] and split["behavior"] == "Removed"):
            raise ValueError("only NFC, white-space folding, lower case and a matching split are implemented")
        self.words_in = regex.compile(split["pattern"]["Regex"]).findall
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.words: dict[str, list[int]] = {}
        self.of_symbol = dict(zip(symbols, range(256), strict=True))
        self.beyond_latin = regex.compile(r"[^\x00-\u024F]").search
        library = Tokenizer.from_file(path)
        self.library_words = lambda text: library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))

    def merge(self, parts: list[int]) -> list[int]:
        """Contiguous parts and ranks; ``parts`` is used up."""
        if len(parts) > SHORT:
            return self._merge_long(parts)
        get, none = self.merges.get, (NEVER, -1)
        found = [get(pair, none) for pair in zip(parts, parts[1:])]
        ranks = [f[0] for f in found]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [get((parts[i], parts[i + 1]))[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)[0]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)[0]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = get((a, b))[1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := get((parts[i], parts[after[i]])):
                    heapq.heappush(heap, (m[0], i, parts[i], parts[after[i]]))
            if before[i] >= 0 and (m := get((parts[before[i]], parts[i]))):
                heapq.heappush(heap, (m[0], before[i], parts[before[i]], parts[i]))
        return [p for p in parts if p >= 0]

    def word(self, word: str, data: bytes = b"") -> list[int]:
        if (ids := self.words.get(word)) is None:
            data = data or word.encode()
            ids = self.merge([*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]])
            if len(self.words) >= 150_000:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _plain(self, text: str) -> list[int]:
        if self.beyond_latin(text):
            # Releases of Unicode differ here in letters and numbers, so the split (not the merging) is the library's own.
            spelt = [(w, bytes(map(self.of_symbol.__getitem__, w))) for w, _ in self.library_words(text)]
            return [i for _, data in spelt for i in self.word(data.decode("utf-8", "replace"), data)]
        return [i for w in self.words_in(text.lower()) for i in self.word(w)]  # composed already, and white space parts words whatever it is

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text; special strings inside it give their own ids."""
        if "<" not in text or not self.at_special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.specials[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, as such vocabularies without a decoder are read; unknown ids are left out."""
        return " ".join(t for i in ids if (t := self.token.get(i)) is not None)


_LOADED: dict = {}


def load(path: str) -> BPE:
    if path not in _LOADED:
        _LOADED[path] = BPE(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array of int), decoded text.  Null text is empty; no row is dropped; extra columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))

    def encode(batches):
        bpe = load(tokenizer_path)
        for b in common.rows_of(batches):
            ids = [bpe.encode(x or "") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(encode, "doc_id long, ids array<int>, decoded string")


class RunDigests:
    """Runs between ASCII white space -> (count, decimal ids, decoded tokens); no token crosses that white space."""

    def __init__(self, path: str, limit: int = 400_000):
        self.bpe, self.limit = load(path), limit
        self.known: dict[bytes, tuple[int, bytes, bytes]] = {b"": (0, b"", b"")}

    def _of(self, run: bytes) -> tuple[int, bytes, bytes]:
        if (x := self.known.get(run)) is None:
            ids = self.bpe.encode(run.decode("utf-8", "replace"))
            x = self.known[run] = len(ids), " ".join(map(str, ids)).encode(), self.bpe.decode(ids).encode()
        return x

    def __call__(self, runs: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        if len(self.known) > self.limit:
            self.known = {b"": (0, b"", b"")}
        out = []
        for base, tail in map(common.base_and_tail, runs):
            x = self._of(base)
            if tail:
                y = self._of(tail)
                x = x[0] + y[0], x[1] + b" " + y[1], x[2] + b" " + y[2]
            out.append(x)
        return out


_DIGESTS: dict = {}


def run_digests(path: str) -> RunDigests:
    if path not in _DIGESTS:
        _DIGESTS[path] = RunDigests(path)
    return _DIGESTS[path]


def digest_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, but per row only the count and SHA-256 of ids and decoded text, so ids need not leave the worker."""
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))

    def encode(batches):
        digests = run_digests(tokenizer_path)
        for b in common.rows_of(batches, 1024):
            runs, numbers, begins = common.runs_of(b.column(1))
            of = digests(runs)
            n = np.array([x[0] for x in of], dtype=np.int64)
            id_part, decoded_part = [x[1] for x in of], [x[2] for x in of]
            numbers, begins = numbers[n[numbers] > 0], np.concatenate(([0], np.cumsum(n[numbers] > 0)))[begins]
            totals = np.concatenate(([0], np.cumsum(n[numbers])))
            counts = totals[begins[1:]] - totals[begins[:-1]]
            ids, decoded = [], []
            at = begins.tolist()
            for first, end in zip(at, at[1:]):
                own = numbers[first:end].tolist()
                ids.append(hashlib.sha256(b" ".join(map(id_part.__getitem__, own))).hexdigest())
                decoded.append(hashlib.sha256(b" ".join(map(decoded_part.__getitem__, own))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
