"""Packing: vector bin packing of token sequences by the dot-product heuristic, cut so that no sequence is padded."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import HEAD, batches_of, mix, release

#: Limits of a sequence: tokens, segments, loss-bearing tokens.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 64, 2048
END_ID = 1
#: Tokens that are gathered before they are packed, which bounds a task's memory; what is left over stays for the next round.
POOL_TOKENS, POOL_ITEMS = 1 << 20, 4096
#: Words that a worker keeps the ids of, then it starts afresh; and from one task to the next, the first of them.
CACHE_WORDS, KEPT_WORDS = 500_000, 100_000
#: Characters of text split at a time.
SLICE = 1 << 18


#: In texts of these characters alone the tokenizer's words are runs of letters, runs of signs and single digits, each by itself.
_PLAIN = re.compile(r"[\x09-\x0d\x20-&(-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_RUNS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: By byte of lower-case plain text in UTF-8: white space, letters (all bytes of those beyond ASCII), digits, signs.
_DIGIT = 2
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = _DIGIT
_LETTERS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")


# The normaliser and the pre-tokenizer of a file whose words Words can take apart by itself.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Whole:
    """Ids of texts by any tokenizer file, as it encodes them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, np.uint32)

    def all_ids(self, texts: list[str]) -> list[np.ndarray]:
        return [self.ids(t) for t in texts]

    def shrink(self) -> None:
        """Nothing is kept."""


class Words:
    """Ids of texts by their words, each of which is encoded once. Only for files with the normaliser and pre-tokenizer above.

    No token spans ASCII white space, so a text's ids are those of its words. Plain texts are taken
    apart further, which leaves fewer words: letter runs in lower case without the signs around them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        #: Words of up to 16 bytes by hash, with their bytes: hash, number of the word, size, first and second eight bytes.
        self.known = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        self.flat, self.start, self.size, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def shrink(self) -> None:
        """Let go of all but the first words, which are the frequent ones."""
        if len(self.index) > KEPT_WORDS:
            self.index = dict(islice(self.index.items(), KEPT_WORDS))
            self.start, self.size = self.start[:KEPT_WORDS].copy(), self.size[:KEPT_WORDS].copy()
            self.used = int(self.start[-1] + self.size[-1])
            self.flat = self.flat[: self.used].copy()
            kept = self.known[1] < KEPT_WORDS
            self.known = [x[kept] for x in self.known]

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if _LETTERS.fullmatch(w)]
        for at in range(0, len(plain), 256):
            some = plain[at : at + 256]
            got = self.bare.encode_batch([" ".join(some)], add_special_tokens=False)[0]
            self._keep(some, got.ids, np.array(got.word_ids, np.int64))
        odd = [w for w in words if not _LETTERS.fullmatch(w)]
        for at in range(0, len(odd), 256):
            some = odd[at : at + 256]
            got = self.encoder.encode_batch([" ".join(some)], add_special_tokens=False)[0]
            begin = np.cumsum([0, *[len(w) + 1 for w in some]])
            self._keep(some, got.ids, np.searchsorted(begin, [a for a, _ in got.offsets], side="right") - 1)

    def _keep(self, some: list[str], ids: list[int], owner: np.ndarray) -> None:
        first, n = len(self.index), self.used + len(ids)
        while n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(some) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : n] = ids
        size = np.bincount(owner, minlength=len(some))
        self.start[first : first + len(some)] = self.used + np.cumsum(size) - size
        self.size[first : first + len(some)] = size
        self.used = n
        self.index.update(zip(some, range(first, first + len(some)), strict=True))

    def all_ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Plain ones are taken many at a time."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        plain, held = [], 0
        for k, t in enumerate(texts):
            if len(t) > SLICE or "<|" in t or not _PLAIN.fullmatch(t):
                out[k] = self.ids(t)
                continue
            plain.append(k)
            held += len(t)
            if held > SLICE or len(plain) == len(texts):
                self._plain([texts[k] for k in plain], plain, out)
                plain, held = [], 0
        if plain:
            self._plain([texts[k] for k in plain], plain, out)
        return out

    def _plain(self, texts: list[str], places: list[int], out: list[np.ndarray]) -> None:
        raw = [t.lower().encode() for t in texts]
        data = np.frombuffer(b" ".join(raw) + b" " * 16, np.uint8)
        kind = _KIND[data]
        change = kind[1:] != kind[:-1]
        single = kind == _DIGIT
        start = np.flatnonzero((kind != 0) & (np.concatenate([[True], change]) | single))
        end = np.flatnonzero((kind != 0) & (np.concatenate([change, [True]]) | single)) + 1
        if len(self.index) > CACHE_WORDS:
            self.reset()
        word = self._numbers(data, start, end)
        size = self.size[word]
        heads = np.cumsum(size) - size
        ids = self.flat[np.repeat(self.start[word] - heads, size) + np.arange(size.sum())]
        bound = np.cumsum([0, *[len(r) + 1 for r in raw]])
        edge = np.append(heads, len(ids))[np.searchsorted(start, bound)].tolist()
        for k, a, b in zip(places, edge[:-1], edge[1:], strict=True):
            out[k] = ids[a:b]

    def _numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each run's word. Runs are looked up by hash and compared by their bytes; those of over 16 bytes by themselves."""
        size = end - start
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        one, two = eight[start] & HEAD[np.minimum(size, 8)], eight[start + 8] & HEAD[np.clip(size - 8, 0, 8)]
        short = size <= 16
        h = mix(mix(one ^ size.astype(np.uint64)) * np.uint64(5) ^ two)
        out = np.full(len(start), -1)

        def found(some: np.ndarray) -> None:
            if len(self.known[0]) and len(some):
                hashes, number, n, first, second = self.known
                at = np.minimum(np.searchsorted(hashes, h[some]), len(hashes) - 1)
                same = (hashes[at] == h[some]) & (n[at] == size[some]) & (first[at] == one[some]) & (second[at] == two[some])
                out[some[same]] = number[at[same]]

        found(np.flatnonzero(short))
        missing = np.flatnonzero(short & (out < 0))
        if len(missing):
            new = missing[np.unique(h[missing], return_index=True)[1]]
            words = [data[a:b].tobytes().decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            self.learn([w for w in words if w not in self.index])
            both = [np.concatenate([x, y]) for x, y in zip(self.known, (h[new], np.array([self.index[w] for w in words]), size[new], one[new], two[new]), strict=True)]
            order = np.argsort(both[0], kind="stable")
            self.known = [x[order] for x in both]
            found(missing)
        for k in np.flatnonzero(out < 0).tolist():  # long runs, and hashes that two words share
            w = data[start[k] : end[k]].tobytes().decode()
            if w not in self.index:
                self.learn([w])
            out[k] = self.index[w]
        return out

    def ids(self, text: str) -> np.ndarray:
        out = []
        for piece in _slices(text):
            # special tokens' strings are looked for before anything else, so they are left whole
            words = _RUNS.findall(piece.lower()) if "<|" not in piece and _PLAIN.fullmatch(piece) else _SPACES.split(piece)
            if len(self.index) > CACHE_WORDS:
                self.reset()
            found = list(map(self.index.get, words))
            if None in found:
                missing = [k for k, i in enumerate(found) if i is None]
                self.learn(list(dict.fromkeys(words[k] for k in missing)))
                for k in missing:
                    found[k] = self.index[words[k]]
            at = np.array(found, np.int64)
            size = self.size[at]
            heads = np.cumsum(size) - size
            out.append(self.flat[np.repeat(self.start[at] - heads, size) + np.arange(size.sum())])
        return np.concatenate(out)


_SPACES = re.compile(r"[\x09-\x0d\x20]+")


def _slices(text: str) -> list[str]:
    """The text in slices of about SLICE characters that end at white space."""
    out = []
    while len(text) > SLICE:
        cut = max(text.rfind(c, 0, SLICE) for c in " \n") + 1
        if not cut:
            ends = [p for c in " \n" if (p := text.find(c, SLICE)) >= 0]
            cut = min(ends) + 1 if ends else len(text)
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


def encoder_of(path: str) -> Words | Whole:
    """The faster encoder where the file's normaliser and pre-tokenizer are those that it knows, else the tokenizer itself."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    known = told.get("normalizer") == WORD_NORMALIZER and told.get("pre_tokenizer") == WORD_SPLIT and not told.get("truncation") and not told.get("padding")
    return Words(path) if known and all(t["content"].startswith("<|") for t in told.get("added_tokens", [])) else Whole(path)


_workers: dict[str, Words | Whole] = {}


def word_encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Texts to ids, with a cache of words that the worker keeps."""
    if path not in _workers:
        _workers[path] = encoder_of(path)
    return _workers[path].all_ids


def shrink_cache(path: str) -> None:
    """Let go of most of the worker's cache of words."""
    if path in _workers:
        _workers[path].shrink()
    release()


class Packer:
    """Fills sequences from pieces. ``add`` gives the pieces of those that are full, ``close`` of the rest.

    A piece is (item, start, length, sequence, offset). A document of max_tokens or more fills whole
    sequences by itself as far as its loss-bearing tokens allow, or else begins them. What remains is
    packed by vector: the next item of a sequence is the one that fits with the largest dot product of its
    demand and the room left, both as shares of the limits; when none fits, the one that can give most is
    cut to fill the sequence. The last ones, and those that their
    segments or their loss-bearing tokens fill first, are cut to a power of two.
    """

    def __init__(self, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS):
        self.limit = np.array([tokens, segments, loss], float)
        self.tokens, self.segments, self.loss = tokens, segments, loss
        #: What waits, by slot: item, start, length, prompt, and of the length what bears loss. A slot of length 0 is used up.
        self.item, self.start, self.length, self.prompt, self.need = (np.zeros(0, np.int64) for _ in range(5))
        self.left = 0  # tokens that wait
        self.sequence = 0

    def add(self, items: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """items: (item, tokens, of these the leading ones without loss)."""
        out, rest = [], []
        for item, n, prompt in items:
            start = 0
            while n - start >= self.tokens and min(self.tokens, max(0, prompt - start) + self.loss) == self.tokens:
                out.append((item, start, self.tokens, self.sequence, 0))
                self.sequence += 1
                start += self.tokens
            if start < n:
                rest.append((item, start, n - start, prompt, n - max(start, min(prompt, n))))
        kept = self.length > 0
        for name, x in zip(("item", "start", "length", "prompt", "need"), np.array(rest, np.int64).reshape(-1, 5).T, strict=True):
            setattr(self, name, np.concatenate([getattr(self, name)[kept], x]))
        self.left = int(self.length.sum())
        while self.left >= 10 * self.tokens:
            out += self._fill(last=False)
        return out

    def _move(self, at: int, by: int) -> None:
        """Take the first ``by`` tokens of a slot, or give back so many if it is negative."""
        self.start[at] += by
        self.length[at] -= by
        self.left -= by
        start, length = int(self.start[at]), int(self.length[at])
        self.need[at] = start + length - max(start, min(int(self.prompt[at]), start + length))

    def _fill(self, last: bool) -> list[tuple[int, int, int, int, int]]:
        tokens, segments, loss = self.tokens, self.segments, self.loss
        if last and self.left < tokens:
            tokens = 1 << (self.left.bit_length() - 1)
        pieces, used = [], 0  # pieces: slot, start, length
        length, need = self.length, self.need
        while tokens and segments and self.left:
            fits = (length > 0) & (length <= tokens) & (need <= loss)
            if segments == 1:  # the last segment has to fill what is left, if any can
                fits &= length == tokens
            room = np.array([tokens, segments, loss]) / self.limit / self.limit
            score = np.where(fits, length * room[0] + need * room[2] + room[1], -1.0)
            at = int(score.argmax())
            take = int(length[at])
            if score[at] < 0 or (not pieces and length.max() >= tokens):
                most = np.minimum(np.minimum(length, tokens), np.maximum(self.prompt - self.start, 0) + loss)
                at = int(most.argmax())
                take = int(most[at])
                if take <= 0:
                    break
            before = int(need[at])
            pieces.append([at, int(self.start[at]), take])
            self._move(at, take)
            tokens, segments, used = tokens - take, segments - 1, used + take
            loss -= before - int(need[at])
        keep = 1 << (used.bit_length() - 1)  # cut to a power of two; MAX_TOKENS is one
        while used > keep:
            at, start, take = pieces.pop()
            cut = min(take, used - keep)
            self._move(at, -cut)
            used -= cut
            if take > cut:
                pieces.append([at, start, take - cut])
        out, offset = [], 0
        for at, start, take in pieces:
            out.append((int(self.item[at]), start, take, self.sequence, offset))
            offset += take
        self.sequence += 1
        return out

    def close(self) -> list[tuple[int, int, int, int, int]]:
        out = []
        while self.left:
            out += self._fill(last=True)
        return out


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, end_id: int = END_ID, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS
) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is the ids of its prompt and text, by any tokenizer file, and then ``end_id``; a null prompt
    or text is empty, so that each row has at least one id. Tokens of the prompt bear no loss, all others
    do. Every id lies in one piece. A sequence holds at most max_tokens tokens (a
    power of two), max_segments pieces and max_loss tokens after prompts; all sequences are full or a
    power of two long. Tasks pack what they read, without a shuffle, and hold POOL_TOKENS ids and one
    document at a time. Rows may repeat, and ids may be null; other columns are not looked at. An empty
    table gives no rows.
    """
    if max_tokens & (max_tokens - 1) or min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("max_tokens must be a power of two, and the limits positive")
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        base = TaskContext.get().partitionId() << 40
        packer = Packer(max_tokens, max_segments, max_loss)
        held: dict[int, tuple] = {}  # documents with ids that aren't in a sequence yet: id, ids, ids left
        n = 0

        def rows(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(pieces), 2000):
                some = pieces[at : at + 2000]
                cols = [
                    pa.array([held[p[0]][0] for p in some], kind), pa.array([p[1] for p in some], pa.int64()), pa.array([p[2] for p in some], pa.int64()),
                    pa.array([held[p[0]][1][p[1] : p[1] + p[2]].tobytes() for p in some], pa.binary()), pa.array([len(held[p[0]][1]) for p in some], pa.int64()),
                    pa.array([base + p[3] for p in some], pa.int64()), pa.array([p[4] for p in some], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            for p in pieces:
                doc = held[p[0]]
                doc[2][0] -= p[2]
                if not doc[2][0]:
                    del held[p[0]]

        kind, waiting, tokens = pa.int64(), [], 0
        for b in batches_of(batches, 1):
            kind = b.schema.field(0).type
            keys, bodies, leads = b.column(0).to_pylist(), *(encode([t or "" for t in b.column(k).to_pylist()]) for k in (1, 2))
            for key, body, lead in zip(keys, bodies, leads, strict=True):
                ids = np.concatenate([lead, body, np.array([end_id], np.uint32)]).astype("<u4")
                held[n] = (key, ids, [len(ids)])
                waiting.append((n, len(ids), len(lead)))
                n, tokens = n + 1, tokens + len(ids)
                if tokens >= POOL_TOKENS or len(waiting) >= POOL_ITEMS:
                    yield from rows(packer.add(waiting))
                    waiting, tokens = [], 0
        yield from rows(packer.add(waiting))
        yield from rows(packer.close())
        shrink_cache(tokenizer)

    prompt = F.col(prompt_col).cast("string") if prompt_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), prompt.alias("prompt"))
    out = rows.mapInArrow(run, f"id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
