"""Exact BPE encoding and decoding by dynamic programming over prefixes.

A word's BPE encoding has the prefix property: for each prefix exactly one
token can end it, whatever follows.  An automaton over the vocabulary yields,
for each position, the tokens that are suffixes of the prefix ending there.
Of these the one is kept whose left neighbour - the last token already stored
for the shorter prefix - stays apart from it under the merge rules (the pair
test).  Back-pointers from a word's end then give its ids.

The work is a map over documents: no shuffle, nothing but the vocabulary file
is held besides a batch, and a task that is lost is simply run again.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame

from sceneline.llm.common import map_texts

#: Words kept encoded between batches of a task; the table is emptied when it is full, so memory is bounded.
MAX_CACHED_WORDS = 400_000
#: Longer words are encoded without being kept.
MAX_CACHED_LENGTH = 64
#: Code points encoded at once; a longer text is still encoded whole, word list by word list.
SLICE_WORDS = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder of one vocabulary file whose tokens mark word ends by a suffix."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        named = vocab | self.specials
        self.tokens = [""] * (max(named.values()) + 1)
        for token, i in named.items():
            self.tokens[i] = token
        splits = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(splits).findall
        self.pattern = splits
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

        size = max(vocab.values()) + 1
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.merge: dict[int, int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            t = vocab[a + b]
            self.rank[t], self.left[t], self.right[t] = r, vocab[a], vocab[b]
            self.merge[vocab[a] << 20 | vocab[b]] = r

        # Words are strings of stand-ins; the last byte of a word is a symbol of its own (private use area).
        self.to_symbol = byte_symbols()
        byte_of = {s: b for b, s in enumerate(self.to_symbol)}
        self.automaton = ahocorasick.Automaton()
        self.length = [0] * size
        for s, t in vocab.items():
            ends = s.endswith(self.suffix) and len(s) > len(self.suffix)
            body = s[: -len(self.suffix)] if ends else s
            if not all(c in byte_of for c in body):
                continue
            text = body[:-1] + chr(0xE000 + byte_of[body[-1]]) if ends else body
            self.length[t] = len(text)
            self.automaton.add_word(text, t)
        self.automaton.make_automaton()
        self.whole = [self.rank[t] < 0 or self.apart(self.left[t], self.right[t], self.rank[t]) for t in range(size)]
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.odd_space = regex.compile("[\x1c-\x1f\x85]").search  # white space to one of the two sides only

    def apart(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """True if the adjacent tokens ``a`` and ``b`` are never joined across their border.

        Undo the later of the two tokens step by step; the pieces at the border at any time
        must not have a merge of a smaller rank than the step that made them vanish (of the
        same rank, the leftmost goes first).
        """
        rank, merge = self.rank, self.merge
        while True:
            m = merge.get(a << 20 | b)
            if m is not None and m < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.right[a]
            else:
                limit, b = rb + 1, self.left[b]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        sym = self.to_symbol
        table = {i: s for i, s in enumerate(sym)}
        parts = []
        for w in words:
            raw = w.encode("utf-8")
            parts.append(raw[:-1].decode("latin-1").translate(table) + chr(0xE000 + raw[-1]))
        text = "\0" + "\0".join(parts)
        last = [-2] * len(text)  # -2: none yet, -1: a word begins after this place
        last[0] = -1
        at = 0
        for p in parts:
            at += len(p) + 1
            if at < len(text):
                last[at] = -1
        length, whole, pairs = self.length, self.whole, self.pairs
        if len(pairs) > 2_000_000:
            pairs.clear()
        for end, t in self.automaton.iter(text):
            if last[end] != -2:
                continue
            before = last[end - length[t]]
            if before == -1:
                if whole[t]:
                    last[end] = t
            elif before >= 0:
                key = before << 20 | t
                ok = pairs.get(key)
                if ok is None:
                    ok = pairs[key] = whole[t] and self.apart(before, t)
                if ok:
                    last[end] = t
        out, end = [], 0
        for p in parts:
            end += len(p)
            ids, i = [], end
            while (t := last[i]) != -1:
                ids.append(t)
                i -= length[t]
            ids.reverse()
            out.append(array("I", ids).tobytes())
            end += 1
        return out

    def _words_ids(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each distinct word, by the table of words where it has them."""
        table = self.cache
        new = list(set(words).difference(table))
        if len(table) + len(new) > MAX_CACHED_WORDS:
            table.clear()
            new = list(set(words))
        found = dict(zip(new, self.encode_words(new), strict=True)) if new else {}
        table.update((w, ids) for w, ids in found.items() if len(w) <= MAX_CACHED_LENGTH)
        for w in words:
            if w not in found:
                found[w] = table[w]
        return found

    def _ids(self, text: str) -> bytes:
        """Ids of normalised text: no word crosses white space, so each run between spaces is kept encoded."""
        out, table = [], self.runs
        runs = text.split()
        for k in range(0, len(runs), SLICE_WORDS):
            part = runs[k : k + SLICE_WORDS]
            new = list(set(part).difference(table))
            if len(table) + len(new) > MAX_CACHED_WORDS:
                table.clear()
                new = list(set(part))
            if new:
                cut = [self.words(run) for run in new]
                ids = self._words_ids([w for ws in cut for w in ws])
                table.update((run, b"".join([ids[w] for w in ws])) for run, ws in zip(new, cut, strict=True))
            out.append(b"".join(map(table.__getitem__, part)))
            if any(len(run) > MAX_CACHED_LENGTH for run in new):
                for run in new:
                    if len(run) > MAX_CACHED_LENGTH:
                        del table[run]
        return b"".join(out)

    def forget(self) -> None:
        """Empty the tables of words and pairs: a worker goes on to other tasks, which need the memory."""
        for table in (self.cache, self.runs, self.pairs):
            table.clear()

    def encode_piece(self, piece: str) -> bytes:
        """Ids of a piece of text without special tokens."""
        if piece.isascii() or max(piece, default="") < "\u0530":
            # Lower case goes character by character: no final sigma.
            text = piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
            if not self.odd_space(text):
                return self._ids(text)
            words = self.words(text)
        else:
            # Which characters are letters depends on the Unicode version, so rarer scripts
            # are normalised and cut by the tokenizer library's own steps.
            from tokenizers import Regex, normalizers, pre_tokenizers

            steps = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
            cut = pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
            words = [w for w, _ in cut.pre_tokenize_str(steps.normalize_str(piece))]
        out = []
        for k in range(0, len(words), SLICE_WORDS):
            ids = self._words_ids(words[k : k + SLICE_WORDS])
            out.append(b"".join(map(ids.__getitem__, words[k : k + SLICE_WORDS])))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        marks = list(self.special.finditer(text)) if self.special and "<|" in text else []
        for m in marks:
            out += [self.encode_piece(text[at : m.start()]), array("I", [self.specials[m.group()]]).tobytes()]
            at = m.end()
        out.append(self.encode_piece(text[at:] if at else text))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Without a decoder in the file, the tokens themselves, joined by spaces."""
        a = array("I")
        a.frombytes(ids)
        return " ".join([*map(self.tokens.__getitem__, a)])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One encoder for each worker process and file."""
    return WordBpe(path)


class Encode:
    """For :func:`map_texts`: ids and decoded text, or their digests."""

    def __init__(self, path: str, digest: bool):
        self.path, self.digest = path, digest

    def __call__(self, texts: list[str | None]):
        bpe = load(self.path)
        ids = [bpe.encode(t) if t is not None else b"" for t in texts]
        decoded = [bpe.decode(x) for x in ids]
        if not self.digest:
            return ids, decoded
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [len(x) // 4 for x in ids], [sha(x) for x in ids], [sha(x.encode("utf-8")) for x in decoded]

    def done(self) -> None:
        load(self.path).forget()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian uint32) and decoded text of every row of ``docs``.

    A null or empty text has no ids and decodes to the empty string; repeated rows give
    repeated results, null ids stay null; other columns are ignored, so their names cannot
    clash; an empty table gives an empty result.
    """
    return map_texts(docs, Encode(path or default_path(), False), {"ids": "binary", "decoded": "string"}, step=32)


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As :func:`encode`, with counts and SHA-256 digests in place of the ids and the text."""
    fields = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return map_texts(docs, Encode(path or default_path(), True), fields, step=32)
