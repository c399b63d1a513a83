"""Operator 9: BPE encoding and decoding by a tokenization automaton.

The merges are compiled one after another into a deterministic automaton over tokens. It starts as one state with an arc for every base symbol, and
each merge (a, b) -> c adds a gadget: wherever an ``a`` arc is followed by a ``b`` arc an arc ``c`` bypasses both, and the ``b`` arc after ``a`` goes. What may
follow ``c`` is what may follow ``b`` at that moment; ``c`` may follow whatever ``a`` may follow. So a state's arcs are kept as "those of my
right part when I was made", and an arc is gone if one of the gadgets on the two chains removed it. A text has exactly one path, and so has each of its
prefixes: encoding goes through a word once, by table look-ups, for all words of a batch at the same time. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents
from .words import SPACES, Table, block_at, blocks, find_words, hash_words, slices

#: Fixed values of the byte-level alphabet: bytes that stand for themselves; the others get code points from 256 on, in order.
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
#: White space as the tokenizer files' ``\s`` has it (Unicode's White_Space).
BLANKS = "\t-\r \x85\xa0  -     　"
#: Words kept with their tokens between batches, in each Python worker.
KEPT_WORDS = 400_000
#: Pieces of up to so many symbols go through the automaton together; longer ones alone.
TOGETHER = 48


def byte_symbols() -> list[str]:
    """The character of each byte in the byte-level alphabet."""
    out, n = {b: chr(b) for b in PRINTABLE}, 0
    for b in range(256):
        if b not in out:
            out[b], n = chr(256 + n), n + 1
    return [out[b] for b in range(256)]


class Automaton:
    """The compiled merges of a ``tokenizers`` BPE file with byte-level symbols and an end-of-word mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern.replace(r"\s", BLANKS))
        n = max([*vocab.values(), *self.specials.values()]) + 1
        self.labels = [""] * n
        for t, i in [*vocab.items(), *self.specials.items()]:
            self.labels[i] = t
        symbols = byte_symbols()
        self.base = np.array([vocab[s] for s in symbols] + [vocab[s + suffix] for s in symbols], np.int64)  # by byte, then by byte at a word's end
        self.suffix, self.n = suffix, n
        self._compile([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], vocab)

    def _compile(self, merges: list[tuple[str, str]], vocab: dict) -> None:
        right, left, born = np.full(self.n, -1), np.full(self.n, -1), np.full(self.n, len(merges) + 1)
        keys, ranks = [], []
        for r, (a, b) in enumerate(merges):  # the gadget of each merge
            c = vocab[a + b]
            if born[c] > len(merges):
                left[c], right[c], born[c] = vocab[a], vocab[b], r
            keys.append(vocab[a] * self.n + vocab[b])
            ranks.append(r)
        self.removed = Table(np.array(keys, np.uint64), np.array(ranks, np.int64), 1 << 40)
        # The chains: token, right part, right part of that ...; with the merge before which a gadget must have come to count.
        self.right, self.left = self._chains(right, born), self._chains(left, born)
        # Labels as a trie over base symbols: (node, symbol) -> node, and each node's token.
        spelled: list[tuple[int, ...] | None] = [None] * self.n
        for k, t in enumerate(self.base):
            spelled[t] = (k,)
        for c in np.argsort(born, kind="stable"):
            if left[c] >= 0:
                spelled[c] = spelled[left[c]] + spelled[right[c]]
        nodes, token = {}, [-1]
        for t, word in enumerate(spelled):
            at = 0
            for k in word or ():
                at = nodes.setdefault((at, k), len(token))
                if at == len(token):
                    token.append(-1)
            if word:
                token[at] = t
        self.trie = Table(np.array([a * 512 + k for a, k in nodes], np.uint64), np.array(list(nodes.values()), np.int64), -1)
        self.token = np.array([*token, -1], np.int64)  # the last is for node -1

    @staticmethod
    def _chains(part: np.ndarray, born: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at, bound = [], np.arange(len(part)), np.full(len(part), 1 << 39)
        while (at >= 0).any():
            out.append((at, bound))
            bound, at = np.where(at >= 0, born[at], -1), np.where(at >= 0, part[at], -1)
        return out

    def arc(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether the state after token u has an arc v."""
        ok, live = np.ones(len(u), bool), np.arange(len(u))
        for chain, before in self.right:
            live = live[ok[live]]
            live = live[chain[u[live]] >= 0]
            if not len(live):
                break
            a, a_bound, rows = chain[u[live]], before[u[live]], live
            for other, other_before in self.left:
                w = v[rows]
                keep = (other[w] >= 0) & ok[rows]
                if not keep.any():
                    break
                rows, a, a_bound, w = rows[keep], a[keep], a_bound[keep], w[keep]
                r = self.removed((a * self.n + other[w]).astype(np.uint64))
                ok[rows[(r < a_bound) & (r <= other_before[w])]] = False
        return ok

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, number of ids of each). Pieces aren't empty."""
        counts, found = np.zeros(len(pieces), np.int64), [None] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        short = np.flatnonzero(lengths <= TOGETHER)
        order = short[np.argsort(-lengths[short], kind="stable")]
        for k in range(0, len(order), 20_000):
            self._paths(pieces, order[k : k + 20_000], lengths, found)
        for i in np.flatnonzero(lengths > TOGETHER):
            found[i] = self._long(pieces[i])
        counts[:] = [len(f) for f in found]
        return (np.concatenate(found) if found else np.zeros(0, np.int64)), counts

    def _paths(self, pieces: list[bytes], rows: np.ndarray, lengths: np.ndarray, found: list) -> None:
        """Pieces sorted by falling length, all at once: after each symbol, the last token of every prefix's only path."""
        n, most = len(rows), int(lengths[rows[0]])
        size = lengths[rows]
        data = np.frombuffer(b"".join(pieces[i].ljust(most, b"\0") for i in rows), np.uint8).reshape(n, most).astype(np.int64)
        data[np.arange(n), size - 1] += 256
        node = np.zeros((n, most), np.int64)  # of the trie, for the label that starts at each place
        last, came = np.full((n, most + 1), -1, np.int64), np.zeros((n, most + 1), np.int64)
        for t in range(most):
            m = int(np.searchsorted(-size, -(t + 1), "right"))  # pieces of more than t symbols
            r, j = np.nonzero(node[:m, : t + 1] >= 0)
            to = self.trie((node[r, j] * 512 + data[r, t]).astype(np.uint64))
            node[r, j] = to
            token = self.token[to]
            ends = data[r, t] >= 256
            token[ends & (size[r] != t + 1)] = -1
            hit = (token >= 0) & ((j == 0) | (last[r, j] >= 0))
            r, j, token = r[hit], j[hit], token[hit]
            ok = j == 0
            rest = np.flatnonzero(~ok)
            ok[rest] = self.arc(last[r[rest], j[rest]], token[rest])
            last[r[ok], t + 1], came[r[ok], t + 1] = token[ok], j[ok]
        at, out = size.copy(), []
        while (at > 0).any():
            live = at > 0
            out.append(np.where(live, last[np.arange(n), at], -1))
            at = np.where(live, came[np.arange(n), at], 0)
        ids = np.stack(out[::-1], 1)
        for i, row in zip(rows, ids, strict=True):
            found[i] = row[row >= 0]

    def _long(self, piece: bytes) -> np.ndarray:
        """One piece of any length: the same walk, with the labels that may still go on."""
        last, came = np.full(len(piece) + 1, -1, np.int64), np.zeros(len(piece) + 1, np.int64)
        start, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for t, b in enumerate(piece):
            start, node = np.append(start, t), np.append(node, 0)
            node = self.trie((node * 512 + b + 256 * (t + 1 == len(piece))).astype(np.uint64))
            start, node = start[node >= 0], node[node >= 0]
            token = self.token[node]
            hit = np.flatnonzero((token >= 0) & ((start == 0) | (last[start] >= 0)))
            ok = start[hit] == 0
            rest = np.flatnonzero(~ok)
            ok[rest] = self.arc(last[start[hit[rest]]], token[hit[rest]])
            if ok.any():
                k = hit[ok][0]
                last[t + 1], came[t + 1] = token[k], start[k]
        out, at = [], len(piece)
        while at > 0:
            out.append(last[at])
            at = came[at]
        return np.array(out[::-1], np.int64)

    def pieces(self, word: str) -> list:
        """The pieces of a word without ASCII white space: UTF-8 bytes to encode, or the id of a special token."""
        if self.special and "<|" in word and len(parts := self.special.split(word)) > 1:
            return [x for p in parts if p for x in ([self.specials[p]] if p in self.specials else self._plain(p))]
        return self._plain(word)

    def _plain(self, word: str) -> list[bytes]:
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
        # Each character is lowered alone; str.lower() differs from that for one letter only.
        word = "".join(c.lower() for c in word) if "Σ" in word else word.lower()
        return [m.encode() for m in self.pattern.findall(word)]

    def decode(self, ids) -> str:
        return " ".join(self.labels[i] for i in ids)


class WordCoder:
    """Tokens of whole texts, word by word; words seen before aren't encoded again."""

    def __init__(self, path: str):
        self.automaton = Automaton(path)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.other: dict[bytes, int] = {}  # words whose hash is another word's
        self.raw, self.at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.starts, self.sizes, self.ids, self.texts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), []

    def _learn(self, words: list[bytes]) -> None:
        a = self.automaton
        parts = [a.pieces(w.decode()) for w in words]
        fresh = list(dict.fromkeys(p for x in parts for p in x if isinstance(p, bytes)))
        ids, counts = a.encode(fresh)
        ends = np.cumsum(counts)
        coded = {p: ids[e - c : e] for p, e, c in zip(fresh, ends.tolist(), counts.tolist(), strict=True)}
        one = lambda p: coded[p] if isinstance(p, bytes) else np.array([p])
        rows = [one(x[0]) if len(x) == 1 else np.concatenate([one(p) for p in x]) if x else np.zeros(0, np.int64) for x in parts]
        sizes = np.array([len(r) for r in rows], np.int64)
        begin = len(self.ids) + np.cumsum(sizes) - sizes
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(words), np.uint8)])
        self.at = np.append(self.at, self.at[-1] + np.cumsum([len(w) for w in words]))
        self.starts, self.sizes = np.append(self.starts, begin), np.append(self.sizes, sizes)
        self.ids = np.append(self.ids, np.concatenate(rows).astype(np.uint32) if rows else np.zeros(0, np.uint32))
        self.texts += [a.decode(r.tolist()).encode() for r in rows]

    def _differ(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """The words of a slice whose bytes aren't those of the entry that their hash led to."""
        wide, known, n = blocks(data), blocks(self.raw), ends - starts
        own = self.at[entry]
        bad, live, k = n != self.at[entry + 1] - own, np.arange(len(n)), 0
        live = live[~bad]
        while len(live):
            rest = n[live] - k
            bad[live] |= block_at(wide, starts[live] + k, rest) != block_at(known, own[live] + k, rest)
            k += 8
            live = live[n[live] > k]
        return np.flatnonzero(bad)

    def encode(self, column):
        """(number of ids, their bytes, the decoded text's bytes) of each text. Every word is compared with the one that its hash found."""
        import pandas as pd

        for _, _, data, offsets in slices(column):
            starts, ends, first = find_words(data, offsets, SPACES)
            codes, keys = pd.factorize(hash_words(data, starts, ends))
            if len(self.place) + len(keys) > KEPT_WORDS and len(self.place):
                unknown = sum(k not in self.place for k in keys.tolist())
                if len(self.place) + unknown > KEPT_WORDS:
                    self._clear()
            keys = keys.tolist()
            new = [i for i, k in enumerate(keys) if k not in self.place]
            word = lambda i: data[starts[i] : ends[i]].tobytes()
            if new:
                at = np.zeros(len(keys), np.int64)
                at[codes[::-1]] = np.arange(len(codes))[::-1]
                self.place.update((keys[i], len(self.texts) + n) for n, i in enumerate(new))
                self._learn([word(i) for i in at[new].tolist()])
            entry = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))[codes] if len(codes) else np.zeros(0, np.int64)
            if len(bad := self._differ(data, starts, ends, entry)):
                words = [word(i) for i in bad.tolist()]
                fresh = list(dict.fromkeys(w for w in words if w not in self.other))
                self.other.update((w, len(self.texts) + n) for n, w in enumerate(fresh))
                if fresh:
                    self._learn(fresh)
                entry[bad] = [self.other[w] for w in words]
            sizes = self.sizes[entry]
            total = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.repeat(self.starts[entry] - total[:-1], sizes) + np.arange(total[-1])
            ids = self.ids[flat].astype("<u4").tobytes()
            texts = self.texts
            for i in range(len(offsets) - 1):
                lo, hi = first[i], first[i + 1]
                a, b = int(total[lo]), int(total[hi])
                own = entry[lo:hi]
                own = own[sizes[lo:hi] > 0]
                yield b - a, ids[4 * a : 4 * b], b" ".join([texts[k] for k in own.tolist()])


_coders: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    """One coder for a Python worker."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def encode(docs: DataFrame, path: str, text: str = "text", digests: bool = True) -> DataFrame:
    """``docs`` without ``text`` but with n_tokens, and ids_sha256 and decoded_sha256; or, without ``digests``, ids (array<long>) and decoded.

    Nulls are empty texts (no tokens); other columns pass through, but for those named like the result's, which it replaces; repeated rows are coded alike, order and ties
    don't matter, long texts are coded whole, and an empty table gives an empty result. ``path`` is a tokenizer file that every executor can read.
    """
    kept = docs.drop(text)
    result = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<bigint>, decoded string"
    names = [f.strip().split()[0] for f in f"n_tokens bigint, {result}".split(",")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name not in names), f"n_tokens bigint, {result}"])

    def run(batches):
        c = coder(path)
        for batch in batches:
            rows = list(c.encode(batch.column(batch.schema.get_field_index(text))))
            n = pa.array([r[0] for r in rows], pa.int64())
            if digests:
                own = [n, pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())]
            else:
                own = [n, pa.array([np.frombuffer(r[1], "<u4").astype(np.int64) for r in rows], pa.list_(pa.int64())), pa.array([r[2].decode() for r in rows], pa.string())]
            keep = [i for i, f in enumerate(batch.schema.names) if f != text and f not in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *own], [*(batch.schema.names[i] for i in keep), *names])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text that the arcs of ``ids`` spell; nulls decode to an empty text."""

    @F.pandas_udf("string")
    def spell(column):
        a = coder(path).automaton
        return column.map(lambda x: a.decode(x if x is not None else []))

    return rows.withColumn(into, spell(ids))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
