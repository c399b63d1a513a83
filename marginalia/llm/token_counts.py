"""Operator 13: token counts with a shortcut for whole tokens.

For each string of the vocabulary it is proved once, before any text is read, whether the merges turn it alone into that one token. A piece of text (pre-token) that is such a
string counts one without being merged; only the rest goes through the merges, and is remembered. A piece's tokens don't depend on what stands around it, so the counts are exact.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .base import documents
from .bpe import BLANKS, byte_symbols
from .words import Table

#: Fixed value: how byte-level tokenizer files of this kind cut texts into pieces (white space is Unicode's White_Space).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"[^\s", f"[^{BLANKS}").replace(r"\S", f"[^{BLANKS}]").replace(r"\s", f"[{BLANKS}]")
#: Fixed value: the over_limit column says whether a text has more tokens than this.
LIMIT = 512
#: Merged pieces that a Python worker remembers, about; characters of texts that are worked on together; bytes of a piece that is merged side by side with others.
KEPT, TEXTS_CHARS, TOGETHER = 300_000, 1 << 21, 40
#: No merge: a number behind that of every merge.
NONE = 1 << 40


class Vocabulary:
    """The tables of a ``tokenizers`` byte-level BPE file. Files with other steps (normalizers, unknown tokens, dropout, stripping special tokens) are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += ["normalizer"] if spec.get("normalizer") else []
        odd += [f"added token {t['content']!r}" for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        if odd or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError(f"not a plain byte-level BPE file: {', '.join(odd) or cut}")
        vocab, self.symbols = model["vocab"], byte_symbols()
        self.base = [vocab[s] for s in self.symbols]
        self.merges = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.whole = self._whole(vocab)
        # The same tables for whole arrays.
        pairs = np.array(list(self.merges), np.uint64)
        ranks, self._made = np.array([r for r, _ in self.merges.values()], np.int64), np.zeros(len(model["merges"]), np.int64)
        self._made[ranks] = [new for _, new in self.merges.values()]
        self._ranks = Table((pairs[:, 0] << np.uint64(32)) | pairs[:, 1], ranks, NONE)
        self._base = np.array(self.base, np.int64)
        self._first = self._ranks(((self._base[:, None].astype(np.uint64) << np.uint64(32)) | self._base.astype(np.uint64)).ravel()).reshape(256, 256)

    def _whole(self, vocab: dict) -> frozenset[str]:
        """The strings of the vocabulary that the merges turn into themselves as one token. Strings that aren't whole UTF-8 characters are never a piece of a text."""
        byte_of = {s: b for b, s in enumerate(self.symbols)}
        proved = set()
        for token, id in vocab.items():
            try:
                data = bytes(byte_of[s] for s in token)
                if self.merged(data) == [id]:
                    proved.add(data.decode())
            except (KeyError, UnicodeDecodeError):
                pass
        return frozenset(proved)

    def merged(self, data: bytes) -> list[int]:
        """The tokens of a piece: of all neighbours that a merge joins, those of the earliest merge first, from the left. A heap keeps long pieces at n log n."""
        ids, merges = [self.base[b] for b in data], self.merges
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*merges[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            _, new, i = heapq.heappop(heap)
            j = after[i]
            # A pair that has changed since is no longer this merge.
            if ids[i] < 0 or j >= n or merges.get((ids[i], ids[j]), (0, -1))[1] != new:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (p := (new, ids[after[j]])) in merges:
                    heapq.heappush(heap, (*merges[p], i))
            if before[i] >= 0 and (p := (ids[before[i]], new)) in merges:
                heapq.heappush(heap, (*merges[p], before[i]))
        return [t for t in ids if t >= 0]

    def sizes(self, pieces: list[bytes]) -> list[int]:
        """The number of tokens of each piece: long ones one by one, all others side by side, one merge of each at a time."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(lengths, kind="stable")
        out = np.zeros(len(pieces), np.int64)
        short = int(np.searchsorted(lengths[order], TOGETHER, "right"))
        for k in range(0, short, 8192):
            rows = order[k : min(k + 8192, short)]
            out[rows] = self._side_by_side([pieces[i] for i in rows.tolist()], lengths[rows])
        for i in order[short:].tolist():
            out[i] = len(self.merged(pieces[i]))
        return out.tolist()

    def _side_by_side(self, pieces: list[bytes], size: np.ndarray) -> np.ndarray:
        most = int(size.max())
        raw = np.frombuffer(b"".join(p.ljust(most, b"\0") for p in pieces), np.uint8).reshape(len(pieces), most)
        ids = np.pad(self._base[raw], ((0, 0), (1, 2)))  # room for the neighbours of the ends
        at = self._first[raw[:, :-1], raw[:, 1:]]  # the number of the merge of each pair; NONE where there is none
        at[np.arange(most - 1) >= size[:, None] - 1] = NONE
        at = np.pad(at, ((0, 0), (1, 3)), constant_values=NONE)  # pair k is tokens k and k + 1, as in ids
        out, live, columns = size.copy(), np.arange(len(pieces)), np.arange(most + 3)
        while len(live):
            place = at.argmin(1)
            rank = at[np.arange(len(live)), place]
            go = rank < NONE
            live, ids, at, place, rank = live[go], ids[go], at[go], place[go], rank[go]
            if not len(live):
                break
            out[live] -= 1
            row, moved = np.arange(len(live)), np.minimum(columns + (columns > place[:, None]), most + 2)
            ids, at = np.take_along_axis(ids, moved, 1), np.take_along_axis(at, moved, 1)
            ids[row, place] = self._made[rank]
            for side in (place - 1, place):
                fresh = self._ranks((ids[row, side].astype(np.uint64) << np.uint64(32)) | ids[row, side + 1].astype(np.uint64))
                at[row, side] = np.where((side >= 1) & (side < out[live]), fresh, NONE)
        return out


class TokenCounter:
    """Counts the tokens of texts, as the library does without adding special tokens; special strings inside a text are one token each."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.whole, self.known = vocabulary, vocabulary.whole, {}
        self.pieces = regex.compile(PIECES).findall
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.specials))) if vocabulary.specials else None

    def __call__(self, texts: list[str]) -> list[int]:
        out, whole = [], self.whole
        for i, j in runs(texts):
            rest = []  # of each text, the pieces that aren't whole tokens
            for text in texts[i:j]:
                parts = self.special.split(text) if self.special else [text]
                n = len(parts) - 1
                merge = []
                for part in parts:
                    pieces = self.pieces(part)
                    n += len(pieces)
                    merge += [p for p in pieces if p not in whole]
                out.append(n - len(merge))
                rest.append(merge)
            if len(self.known) > KEPT:
                self.known.clear()
            new = list(set().union(*rest).difference(self.known))
            self.known.update(zip(new, self.vocabulary.sizes([p.encode() for p in new]), strict=True))
            for k, merge in enumerate(rest, i):
                out[k] += sum(map(self.known.__getitem__, merge))
        return out


def runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts with about ``TEXTS_CHARS`` characters; a longer text is a run of its own."""
    i = size = 0
    for j, text in enumerate(texts):
        if j > i and size + len(text) > TEXTS_CHARS:
            yield i, j
            i, size = j, 0
        size += len(text)
    if texts:
        yield i, len(texts)


_counters: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` without ``text`` but with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens), which replace columns of these names.

    Nulls are empty texts (0 bytes, 0 tokens); other columns pass through; repeated rows count alike and stay, order and ties don't matter; long texts, and long runs without
    a break, count whole; an empty table gives an empty result. ``path`` is read on the driver only: tasks get the tables, whose size is the vocabulary's, by broadcast.
    """
    known, own_key = docs.sparkSession.sparkContext.broadcast(Vocabulary(path)), uuid.uuid4().hex
    names = ["n_bytes", "n_tokens", "over_limit"]
    kept = [f for f in docs.drop(text).schema if f.name not in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_bytes bigint, n_tokens bigint, over_limit boolean"])

    def run(batches):
        if own_key not in _counters:  # one a Python worker
            _counters.clear()
            _counters[own_key] = TokenCounter(known.value)
        c = _counters[own_key]
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            n = c(texts)
            own = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())]
            keep = [i for i, f in enumerate(batch.schema.names) if f != text and f not in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *own], [*(batch.schema.names[i] for i in keep), *names])

    return docs.mapInArrow(run, schema)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
