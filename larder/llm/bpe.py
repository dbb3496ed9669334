"""BPE encoding and decoding with a tokenization automaton."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from larder.llm.common import read, spread

NEVER = np.int64(1) << 40
#: Words above this many bytes are encoded one at a time.
LONG_WORD = 192
#: Chunks whose ids a worker keeps; the table is emptied when it is full.
CACHED_CHUNKS = 500_000


class _Hash:
    """Open-addressing table from int64 keys (>= 0) to int32 values, looked up in bulk."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] < 0
            trying = left[free]
            self.keys[slot[trying]] = keys[trying]  # of several for one slot the last one wins
            self.values[slot[trying]] = values[trying]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            same = found == keys[todo]
            out[todo[same]] = self.values[slot[todo[same]]]
            todo = todo[~same & (found >= 0)]
        return out


class MergeAutomaton:
    """Deterministic automaton over tokens that accepts exactly the token sequences BPE yields.

    It starts with one state and a loop for each base symbol. The gadget of merge (u, v) -> w splits off the state
    entered by u, removes its arc v and gives every state with an arc u an arc w into the state that u v led to. So the
    state after a token is that of its last part until a later merge splits it, and an arc is missing iff some gadget
    removed it while its two boundary parts were current. ``born``, ``left``, ``right`` and the pair table hold the
    gadgets in order; an arc's row is compiled from them when it is first used and kept in a table.

    A word is encoded by running the automaton over the trie of arc labels: after each prefix exactly one token can be
    the last, and it is reached by a single arc. Decoding emits the arc labels.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], byte_symbols: list[str], end: str):
        size = max(vocab.values()) + 1
        self.labels = [""] * size
        for text, i in vocab.items():
            self.labels[i] = text
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.born = np.full(size, -1, np.int64)
        base = {i: (i,) for b in byte_symbols for i in (vocab[b], vocab[b + end])}
        spelled = dict(base)
        ranks: dict[int, int] = {}
        for rank, (u, v) in enumerate(merges):
            u, v, w = vocab[u], vocab[v], vocab[u + v]
            if w in spelled:
                raise ValueError(f"token {self.labels[w]!r} comes from two merges; the gadgets need one each")
            ranks[u * size + v] = rank
            self.left[w], self.right[w], self.born[w] = u, v, rank
            spelled[w] = spelled[u] + spelled[v]
        self.size, self.ranks = size, ranks
        keys = np.fromiter(ranks, np.int64, len(ranks))
        self.pairs = _Hash(keys, np.fromiter(ranks.values(), np.int32, len(ranks)))
        # a merge whose parts an earlier gadget keeps apart makes no arc
        made = np.flatnonzero(self.born >= 0)
        self.alive = np.ones(size, bool)
        self.alive[made] = self._compiled(self.left[made], self.right[made], self.born[made])
        for w in made[np.argsort(self.born[made])]:
            self.alive[w] &= self.alive[self.left[w]] & self.alive[self.right[w]]
        # trie of the labels of arcs, over base symbols
        trie: dict[int, int] = {}
        token_of = [-1]
        for w, symbols in spelled.items():
            if not self.alive[w]:
                continue
            node = 0
            for s in symbols:
                key = node * size + s
                node = trie.setdefault(key, len(token_of))
                if node == len(token_of):
                    token_of.append(-1)
            token_of[node] = w
        self.trie_dict, self.token_of = trie, np.array(token_of, np.int64)
        self.trie = _Hash(np.fromiter(trie, np.int64, len(trie)), np.fromiter(trie.values(), np.int32, len(trie)))
        self.inner = np.array([vocab[b] for b in byte_symbols], np.int64)
        self.final = np.array([vocab[b + end] for b in byte_symbols], np.int64)
        self.arc_keys = np.full(1 << 21, -1, np.int64)
        self.arc_open = np.zeros(1 << 21, bool)
        self.one_arc: dict[int, bool] = {}

    def _compiled(self, before: np.ndarray, after: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: is there an arc ``after`` from the state that ``before`` enters?

        Walks back in time over the parts at the boundary. A gadget (a, b) cut the arc if it came while a and b were
        current: before a became part of a longer left token, and not after b did (a gadget works from the left, so at
        the same rank the left token takes its part first). ``until``: gadgets from that rank on do not count.
        """
        open_ = np.ones(len(before), bool)
        at = np.arange(len(before))
        a, b = before.copy(), after.copy()
        a_until = np.full(len(a), NEVER) if until is None else until.copy()
        b_until = np.full(len(a), NEVER) if until is None else until - 1
        while len(at):
            rank = self.pairs.get(a * self.size + b).astype(np.int64)
            cut = (rank >= 0) & (rank < a_until) & (rank <= b_until)
            open_[at[cut]] = False
            undo_a = self.born[a] > self.born[b]
            go = ~cut & ((self.born[a] >= 0) | (self.born[b] >= 0))
            a_until = np.where(undo_a, self.born[a], a_until)
            b_until = np.where(undo_a, b_until, self.born[b])
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            at, a, b, a_until, b_until = at[go], a[go], b[go], a_until[go], b_until[go]
        return open_

    def arcs(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Rows of the transition table; -1 as ``before`` is the start state."""
        key = (before + 1) * self.size + after
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        known = self.arc_keys[slot] == key
        out = self.arc_open[slot]
        new = np.flatnonzero(~known)
        if len(new):
            started = before[new] < 0
            made = np.ones(len(new), bool)
            made[~started] = self._compiled(before[new][~started], after[new][~started])
            out[new] = made
            self.arc_keys[slot[new]] = key[new]
            # two keys for one slot: keep what belongs to the key that stayed
            stayed = self.arc_keys[slot[new]] == key[new]
            self.arc_open[slot[new[stayed]]] = made[stayed]
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each non-empty word."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        start = 0
        while start < len(order):
            top = len(words[order[start]])
            if top > LONG_WORD:
                for i in order[start:]:
                    out[i] = self.encode_long(words[i])
                break
            group = [i for i in order[start : start + 8192] if len(words[i]) <= max(top + 2, top * 5 // 4)]
            start += len(group)
            for i, ids in zip(group, self._encode_group([words[i] for i in group]), strict=True):
                out[i] = ids
        return out

    def _encode_group(self, words: list[bytes]) -> list[bytes]:
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        most = int(lengths.max())
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = np.full((n, most), -1, np.int64)
        inside = np.arange(most) < lengths[:, None]
        symbols[inside] = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbols[np.arange(n), lengths - 1] = self.final[flat[ends]]
        last = np.full((n, most + 1), -2, np.int64)
        came = np.zeros((n, most + 1), np.int64)
        last[:, 0] = -1
        for s in range(most):
            row = np.flatnonzero((last[:, s] > -2) & (lengths > s))
            node = np.zeros(len(row), np.int64)
            e = s
            while len(row):
                node = self.trie.get(node * self.size + symbols[row, e]).astype(np.int64)
                e += 1
                going = node >= 0
                row, node = row[going], node[going]
                token = self.token_of[node]
                at = np.flatnonzero(token >= 0)
                if len(at):
                    fits = at[self.arcs(last[row[at], s], token[at])]
                    last[row[fits], e] = token[fits]
                    came[row[fits], e] = s
                going = lengths[row] > e
                row, node = row[going], node[going]
        at, all_rows = lengths.copy(), np.arange(n)
        back = []
        while (at > 0).any():
            token = np.where(at > 0, last[all_rows, at], -1)
            if (token == -2).any():
                raise ValueError("the automaton has no path for a word")
            back.append(token)
            at = came[all_rows, at]
        table = np.array(back[::-1]).T
        counts = (table >= 0).sum(axis=1)
        data = table[table >= 0].astype("<u4").tobytes()
        stops = (np.cumsum(counts) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def encode_long(self, word: bytes) -> bytes:
        n = len(word)
        symbols = self.inner[np.frombuffer(word, np.uint8)].tolist()
        symbols[-1] = int(self.final[word[-1]])
        last, came = [-2] * (n + 1), [0] * (n + 1)
        last[0] = -1
        for s in range(n):
            before = last[s]
            if before == -2:
                continue
            node, e = 0, s
            while e < n and (node := self.trie_dict.get(node * self.size + symbols[e], -1)) >= 0:
                e += 1
                token = int(self.token_of[node])
                if token >= 0 and last[e] == -2:
                    key = (before + 1) * self.size + token
                    if (fits := self.one_arc.get(key)) is None:
                        if len(self.one_arc) > CACHED_CHUNKS:
                            self.one_arc.clear()
                        fits = before < 0 or bool(self._compiled(np.array([before]), np.array([token]))[0])
                        self.one_arc[key] = fits
                    if fits:
                        last[e], came[e] = token, s
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = came[at]
        return np.array(ids[::-1], "<u4").tobytes()


#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on.
def byte_symbols() -> list[str]:
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: White space as Unicode has it; str.split() also splits at \x1c-\x1f.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
#: The vocabulary's pattern for words, numbers and signs.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordEndBpe:
    """A word-end BPE vocabulary file (JSON): NFC, lower case, words by pattern, bytes, merges with an end-of-word mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, byte_symbols(), model["end_of_word_suffix"])
        self.labels = [x.encode() for x in self.automaton.labels]
        for text, i in self.special.items():
            self.labels += [b""] * (i + 1 - len(self.labels))
            self.labels[i] = text.encode()
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.chunks: dict[str, bytes] = {}
        self.splitter = Tokenizer.from_file(path)
        self.byte_of = {s: b for b, s in enumerate(byte_symbols())}

    def _words(self, chunk: str) -> list[bytes]:
        """Pre-split words of a chunk. Beyond Latin, Unicode tables differ by version; the vocabulary's own library splits there."""
        if chunk.isascii():
            return [w.encode() for w in WORDS.findall(chunk.lower())]
        if max(chunk) < "\u0250":
            return [w.encode() for w in WORDS.findall(unicodedata.normalize("NFC", chunk).lower())]
        parts = self.splitter.pre_tokenizer.pre_tokenize_str(self.splitter.normalizer.normalize_str(chunk))
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in parts]

    @staticmethod
    def _split(text: str) -> list[str]:
        return [x for x in SPACE.split(text) if x] if SEPARATORS.search(text) else text.split()

    def _learn(self, missing: set[str]) -> None:
        if len(self.chunks) + len(missing) > CACHED_CHUNKS:
            self.chunks.clear()
        chunks = list(missing)
        words = [self._words(c) for c in chunks]
        known = {w: i for i, w in enumerate({w for ws in words for w in ws})}
        ids = self.automaton.encode_words(list(known))
        for c, ws in zip(chunks, words, strict=True):
            self.chunks[c] = b"".join([ids[known[w]] for w in ws])

    def encode(self, texts: list[str], together: int = 256) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        out = []
        for at in range(0, len(texts), together):
            parts = [self.marks.split(t) if "<|" in t else [t] for t in texts[at : at + together]]
            split = [[[p] if i % 2 else self._split(p) for i, p in enumerate(ps)] for ps in parts]
            missing: set[str] = set()
            for text in split:
                for chunks in text[::2]:
                    missing.update(chunks)
            missing.difference_update(self.chunks)
            if missing:
                if len(self.chunks) + len(missing) > CACHED_CHUNKS:
                    missing = {c for text in split for chunks in text[::2] for c in chunks}
                self._learn(missing)
            ids = self.chunks
            for text in split:
                out.append(b"".join([self.special[x[0]].to_bytes(4, "little") if i % 2 else b"".join([ids[c] for c in x]) for i, x in enumerate(text)]))
        return out

    def decode(self, ids: bytes) -> bytes:
        """Labels of the arcs taken, joined by a space, special tokens included."""
        return b" ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def word_end_bpe(path: str) -> WordEndBpe:
    return WordEndBpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary, decoded string) of every row, whole texts.

    ``path`` is a vocabulary file that every executor has. Null text counts as empty: no ids, empty decoding. Ids may be
    null or repeat; other columns are ignored; an empty table gives no rows. A worker compiles the automaton once.
    """
    return _encoded(docs, path, id_col, text_col, digest=False)


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    def run(stream):
        bpe = word_end_bpe(path)
        for batch in stream:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = bpe.encode([t or "" for t in part.column(text_col).to_pylist()])
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                doc = part.column(id_col).cast(pa.int64())
                if digest:
                    one = pa.array([hashlib.sha256(x).hexdigest() for x in ids])
                    two = pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids])
                    yield pa.RecordBatch.from_arrays([doc, counts, one, two], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    two = pa.array([bpe.decode(x) for x in ids], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([doc, counts, pa.array(ids, pa.binary()), two], [id_col, "n_tokens", "ids", "decoded"])

    rest = "ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded string"
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n_tokens long, {rest}")


def op9_bpe(spark, sf_dir):
    import public_tokenizers

    return _encoded(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("word_bpe_49k.json"), "doc_id", "text", digest=True)
