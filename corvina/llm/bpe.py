"""BPE with word ends over a public vocabulary file: encoding by batched numpy merge rounds, and decoding.

Texts are cut into chunks, which no word crosses: at ASCII white space, between plain ASCII letters and signs, and at each
digit.  The distinct chunks of many texts are found at once (Arrow dictionary).  Chunks not seen before are cut into words as the file asks (NFC, lower case, then the split
pattern), and words not seen before are encoded together: their symbols lie in one flat array; each round looks up the
adjacent pairs that are new in the sorted pair keys by binary search, takes the pairs of lowest rank within each word,
merges them from the left without overlap and closes the gaps, until no pair is left that the file merges.

Nulls and empty texts have no ids.  The file's added tokens are cut out of the raw text first.  Rows are independent, so
ties, repeats and extra columns have no effect.  A text of any length is encoded whole.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import sys
import types
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STORE, saved, trim

#: Words, and half as many chunks, kept with their ids in a worker (about 200 bytes each); beyond it only those met again and again stay.
WORDS = 100_000

#: Bytes of text that are encoded together (some 10 MB of a worker beside its stores); a longer text is a run of its own.
RUN = 1 << 19

#: Characters whose Unicode classes differ between versions of the pattern libraries; chunks with them are cut by the tokenizers library.
RARE = "[^\\x00-\\x1b\\x20-\\u024f\\u2000-\\u206e]"


# Classes of bytes: 1 letters, 2 digits, 3 signs, 4 white space; 0 is what may belong to words, contractions or added tokens with its neighbours.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]], _CLASS[48:58], _CLASS[[32, *range(9, 14)]] = 1, 2, 4
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = 3
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[_CLASS == 4] = 32
_LOWER = _PLAIN.copy()
_LOWER[65:91] += 32
#: By the classes of two neighbours whether a chunk begins between them; white space belongs to what follows.
_CUT = np.array([(b == 4 and a != 4) or (a in (1, 2, 3) and b in (1, 2, 3) and (a != b or a == 2)) for a in range(5) for b in range(5)])


def chunked(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts one after the other, lower-cased where no added token can be meant, and how many each text has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    kind = _CLASS[raw]
    cut = np.zeros(len(raw), bool)
    cut[1:] = _CUT[kind[:-1] * np.uint8(5) + kind[1:]]
    cut[off[:-1][off[:-1] < len(raw)]] = True
    starts = np.flatnonzero(cut)
    low = (_PLAIN if b"<|" in raw.tobytes() else _LOWER)[raw]
    edge = pa.py_buffer(np.append(starts, len(raw)).astype(np.int64))
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, edge, pa.py_buffer(low)]), np.diff(np.searchsorted(starts, off))


def byte_symbols() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Runs:
    """Strings with their runs of ids; of a full store what was met in several calls stays."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.flat, self.start, self.size, self.hits = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def places(self, keys: list[str]) -> np.ndarray:
        """Where each key is, or -1."""
        return np.fromiter(map(self.at.get, keys, repeat(-1)), np.int64, len(keys))

    def add(self, keys: list[str], flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        places = np.arange(len(self.at), len(self.at) + len(keys))
        self.at.update(zip(keys, places.tolist(), strict=True))
        self.start = np.append(self.start, len(self.flat) + np.cumsum(sizes) - sizes)
        self.size, self.hits = np.append(self.size, sizes), np.append(self.hits, np.zeros(len(keys), np.int32))
        self.flat = np.append(self.flat, flat.astype(np.int32))
        return places

    def known(self, keys: list[str], learn) -> np.ndarray:
        """Places of distinct keys; ``learn`` gives flat ids and sizes of those not in store yet."""
        place = self.places(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = [keys[k] for k in new.tolist()]
            place[new] = self.add(fresh, *learn(fresh))
        self.hits[place] += 1
        return place

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.flat, self.start, self.size, places)

    def trim(self, limit: int) -> None:
        if len(self.at) <= limit:
            return
        often = self.hits > 1
        if often.sum() > limit // 2:
            often[:] = False
        old, kept = list(self.at), np.flatnonzero(often)
        self.flat, _ = self.take(kept)
        self.size = self.size[kept]
        self.start, self.hits = np.cumsum(self.size) - self.size, np.zeros(len(kept), np.int32)
        self.at = {old[k]: i for i, k in enumerate(kept.tolist())}


class WordBpe:
    """A byte-level BPE whose symbols at the end of a word bear a suffix."""

    def __init__(self, spec: str):
        import regex
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.limit = WORDS
        data = json.loads(spec)
        model = data["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # ranks of pairs of single bytes, by place among the 512 byte symbols: the first round needs no search
        self.base = np.zeros(max(vocab.values()) + 1, np.int32)
        single = np.append(self.inner, self.final)
        self.base[single] = np.arange(len(single))
        is_single = np.zeros(len(self.base), bool)
        is_single[single] = True
        self.byte_ranks = np.full((len(single), len(single)), len(pairs), np.int64)
        low = is_single[left] & is_single[right]
        self.byte_ranks[self.base[left[low]], self.base[right[low]]] = np.flatnonzero(low)
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings = [""] * (1 + max(max(vocab.values()), *self.added.values(), 0))
        for t, i in (vocab | self.added).items():
            self.strings[i] = t
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in self.added) + ")") if self.added else None
        bare = data | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}  # its normaliser is all that is needed
        self.normal = Tokenizer.from_str(json.dumps(bare)).normalizer
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(f"\\n|{pattern}").findall  # a line end parts the chunks that are cut together
        self.split_rare = Split(Regex(pattern), behavior="removed", invert=True).pre_tokenize_str
        self.rare, self.rare_ascii = regex.compile(RARE).search, re.compile("[\x1c-\x1f]").search
        self.stored_chunks, self.stored_words = Runs(), Runs()

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where each word's begin; merged together in rounds."""
        none = len(self.merged)  # the rank of pairs that the file doesn't merge
        size = np.fromiter(map(len, map(str.encode, words)), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode(), np.uint8)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        last = np.cumsum(size) - 1
        ids = self.inner[flat]
        ids[last] = self.final[flat[last]]

        def ranked(at: np.ndarray) -> np.ndarray:
            """Ranks of the pairs that begin at places ``at``; pairs across a word's end have none."""
            after = np.minimum(at + 1, len(ids) - 1)
            pair = ids[at] << 32 | ids[after]
            place = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            return np.where((self.keys[place] == pair) & (word[after] == word[at]) & (after > at), self.ranks[place], none)

        after = np.append(ids[1:], 0)
        rank = np.where(np.append(word[1:] == word[:-1], False), self.byte_ranks[self.base[ids], self.base[after]], none)
        out_ids, out_words = [], []
        while len(ids):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, heads)
            count = np.diff(np.append(heads, len(ids)))
            open_ = least < none
            if not open_.all():  # finished words leave the array
                keep = np.repeat(open_, count)
                out_ids.append(ids[~keep])
                out_words.append(word[~keep])
                if not open_.any():
                    break
                rank, ids, word = rank[keep], ids[keep], word[keep]
                least, count = least[open_], count[open_]
            # of a run of overlapping hits (equal symbols) every second one counts, from the left
            place = np.flatnonzero(rank == np.repeat(least, count))
            near = np.diff(place) == 1
            if near.any():
                run = np.flatnonzero(np.append(True, ~near))
                start = np.repeat(place[run], np.diff(np.append(run, len(place))))
                place = place[((place - start) % 2 == 0) | (ids[place + 1] != ids[place])]
            ids[place] = self.merged[rank[place]]
            stay = np.ones(len(ids), bool)
            stay[place + 1] = False
            ids, word, rank = ids[stay], word[stay], rank[stay]
            at = place - np.arange(len(place))  # where the merged symbols are now; their pairs and those before are new
            at = np.concatenate([at, at[at > 0] - 1])
            rank[at] = ranked(at)
        every, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_ids, out_words))
        order = np.argsort(owner, kind="stable")
        return every[order], np.append(0, np.cumsum(np.bincount(owner, minlength=len(words))))

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk that holds rare characters or added tokens; an added token is one with a tab before it."""
        out = []
        for part in self.split_added.split(chunk) if self.split_added else (chunk,):
            if part in self.added:
                out.append("\t" + part)
            elif part:
                out += [x for x, _ in self.split_rare(self.normal.normalize_str(part))]
        return out

    def _odd(self, text: str) -> bool:
        return bool((self.rare_ascii if text.isascii() else self.rare)(text)) or (bool(self.added) and "<|" in text)

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = np.array([w[0] == "\t" for w in words], bool)
        plain = [w for w in words if w[0] != "\t"]
        ids, edge = self.merge(plain) if plain else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        sizes = np.ones(len(words), np.int64)
        sizes[~special] = np.diff(edge)
        flat, at = np.zeros(int(sizes.sum()), np.int64), np.repeat(special, sizes)
        flat[~at], flat[at] = ids, [self.added[w[1:]] for w in words if w[0] == "\t"]
        return flat, sizes

    def _cut(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of all chunks one after the other, and how many each has."""
        odd = [k for k, c in enumerate(chunks) if self._odd(c)] if self._odd("\n".join(chunks)) else []
        plain = chunks
        if odd:
            plain = list(chunks)
            for k in odd:
                plain[k] = ""
        # chunks hold no line end, as their white space is spaces; among common characters NFC changes none, and each is lower-cased by itself
        every = self.find("\n".join(plain).lower())
        ends = np.flatnonzero(np.fromiter(map("\n".__eq__, every), bool, len(every)))
        count = np.diff(np.append(ends, len(every)), prepend=-1) - 1
        words = [w for w in every if w != "\n"]
        if odd:
            edge, out, last = np.append(0, np.cumsum(count)), [], 0
            for k in odd:
                found = self.words(chunks[k])
                out += words[last : edge[k]] + found
                last, count[k] = edge[k], len(found)
            words = out + words[last:]
        return words, count

    def _chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        every, count = self._cut(chunks)
        distinct = dict.fromkeys(every)
        place = dict(zip(distinct, self.stored_words.known(list(distinct), self._word_ids).tolist(), strict=True))
        flat, sizes = self.stored_words.take(np.fromiter(map(place.__getitem__, every), np.int64, len(every)))
        return flat, np.bincount(np.repeat(np.arange(len(chunks)), count), weights=sizes, minlength=len(chunks)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and how many each text has."""
        gc.disable()  # no cycles arise here, and passes over the store would cost more than the work
        try:
            self.stored_chunks.trim(self.limit // 2)
            self.stored_words.trim(self.limit)
            chunks, count = chunked(texts)
            coded = chunks.dictionary_encode()
            del chunks
            index = self.stored_chunks.known(coded.dictionary.to_pylist(), self._chunk_ids)[coded.indices.to_numpy()]
            flat, sizes = self.stored_chunks.take(index)
            return flat, np.bincount(np.repeat(np.arange(len(texts)), count), weights=sizes, minlength=len(texts)).astype(np.int64)
        finally:
            gc.enable()


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``index`` of ``flat`` one after the other, and their lengths."""
    sizes = size[index]
    ends = np.cumsum(sizes)
    at = np.repeat(start[index] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    return flat[at], sizes


def worker_bpe(spec: str, kind: type = WordBpe, limit: int = 0) -> WordBpe:
    """One encoder of each kind and vocabulary in a worker process, kept for its later tasks (until another operator's ``release``)."""
    trim()
    store = sys.modules.setdefault(STORE, types.ModuleType(STORE)).__dict__
    key = f"{kind.__name__} {hashlib.sha256(spec.encode()).hexdigest()}"
    if key not in store:
        store[key] = kind(spec)
    store[key].limit = limit or WORDS
    return store[key]


def text_runs(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = RUN) -> Iterator[tuple[pa.Table, pa.Array]]:
    """(rows, their texts) a few MB at a time, over the edges of batches; a longer text is a run of its own."""
    held, size = [], 0

    def run() -> tuple[pa.Table, pa.Array]:
        rows = pa.Table.from_batches(held)
        texts = rows.column(column).cast(pa.large_string())
        held.clear()
        return rows, texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)

    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(length)
        a = 0
        while a < len(length):
            b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit - size, "right"))
            if b > a:
                held.append(batch.slice(a, b - a))
                size += int(ends[b - 1] - (ends[a - 1] if a else 0))
                a = b
            elif held:
                yield run()
                size = 0
            else:
                held.append(batch.slice(a, 1))
                yield run()
                a += 1
    if held:
        yield run()


def _digests(spec: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(spec)
        number = list(map(str, range(len(bpe.strings)))).__getitem__
        string = bpe.strings.__getitem__
        for rows, texts in text_runs(batches):
            flat, n = bpe.encode(texts)
            at, enc, dec = 0, [], []
            for k in n.tolist():
                part = flat[at : at + k].tolist()
                at += k
                enc.append(hashlib.sha256(" ".join(map(number, part)).encode()).hexdigest())
                dec.append(hashlib.sha256(" ".join(map(string, part)).encode()).hexdigest())
            yield from pa.table([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).to_batches()

    return run


def _encoded(spec: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(spec)
        for rows, texts in text_runs(batches):
            flat, n = bpe.encode(texts)
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat, pa.int32()))
            yield from rows.append_column("ids", ids).to_batches()

    return run


def _decoded(spec: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(spec)
        for batch in batches:
            text = [" ".join(bpe.strings[i] for i in ids.as_py() or ()) for ids in batch.column(batch.schema.get_field_index("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "decoded"])

    return run


def vocabulary(path: str) -> str:
    """The vocabulary file, read once on the driver (under 2 MB) and shipped with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids``, the token ids of ``text``; a column of that name is replaced."""
    docs = docs.drop("ids")
    return docs.mapInArrow(_encoded(vocabulary(path)), docs.select("*", F.lit(None).cast("array<int>").alias("ids")).schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``decoded``, the text that ``ids`` stand for; a column of that name is replaced."""
    rows = rows.drop("decoded")
    return rows.mapInArrow(_decoded(vocabulary(path)), rows.select("*", F.lit(None).cast("string").alias("decoded")).schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, without materialising ids per row."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digests(vocabulary(path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return saved(rows, "digests")
