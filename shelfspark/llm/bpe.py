"""Byte-level BPE encoding and decoding with a pair occurrence index.

Each task gathers the distinct pretokens of an Arrow batch that it has not met before and
encodes them together: all their symbols lie in one linked list, an index maps every pair
to all its positions, and the pairs with a merge rank are taken from a heap in ascending
rank.  Applying a pair rewrites its positions and updates the lists of the neighbouring
pairs only.  Pretokens never share a pair, so the batch's result is each pretoken's own.

The vocabulary file is a parameter and is read on each executor from its own installation.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, free, utf8

#: The pretokenizer pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pretokens a task remembers; beyond it the memory is emptied, results stay the same.
REMEMBER = 700_000
#: Pretokens longer than this many characters are encoded but not remembered.
LONG = 256
#: Bits of a symbol in a pair's key; the mark after a pretoken; a symbol merged away.
SHIFT, END, GONE = 17, 256, -2


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others take the code points from 256 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    letters.update({chr(256 + i): b for i, b in enumerate(others)})
    return letters


class Vocabulary:
    """Ids, merge ranks and token bytes of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, letters = data["model"], byte_letters()
        ids = model["vocab"]
        #: Of each rank: left and right symbol and the symbol they make; of each pair: its rank.
        self.left, self.right, self.made, self.rank = [], [], [], {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.left.append(ids[a])
            self.right.append(ids[b])
            self.made.append(ids[a + b])
            self.rank.setdefault(ids[a] << SHIFT | ids[b], rank)
        #: By byte, with END after a pretoken: symbols, and the rank of each pair of bytes.
        self.single = np.full(257, -1, np.int64)
        for letter, byte in letters.items():
            self.single[byte] = ids[letter]
        self.first = np.full((257, 257), -1, np.int64)
        for x in range(256):
            for y in range(256):
                self.first[x, y] = self.rank.get(int(self.single[x]) << SHIFT | int(self.single[y]), -1)
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        self.bytes_of.update({i: t.encode() for t, i in self.special.items()})
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.words = regex.compile(PATTERN)
        self.memory: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each pretoken, all merged together through one pair occurrence index."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1  # with the end mark
        ends = np.cumsum(size)
        letters = np.full(int(ends[-1]), END, np.int64)
        mask = np.ones(len(letters), bool)
        mask[ends - 1] = False
        letters[mask] = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.single[letters].tolist()
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        # the index: positions of each pair, under the pair's rank
        ranks = self.first[letters[:-1], letters[1:]]
        places = np.flatnonzero(ranks >= 0)
        places = places[np.argsort(ranks[places], kind="stable")]
        heap, begin = np.unique(ranks[places], return_index=True)
        bounds = [*begin.tolist(), len(places)]
        order, heap = places.tolist(), heap.tolist()
        where = {r: order[a:b] for r, a, b in zip(heap, bounds, bounds[1:])}
        rank_of, push, pop = self.rank.get, heapq.heappush, heapq.heappop
        while heap:
            rank = pop(heap)
            left, right, new = self.left[rank], self.right[rank], self.made[rank]
            for i in sorted(where.pop(rank)):  # left to right, as overlapping runs need
                j = after[i]
                if sym[i] != left or sym[j] != right:
                    continue  # an earlier merge took one of the two
                sym[i], sym[j] = new, GONE
                after[i] = k = after[j]
                before[k] = i
                if (other := sym[k]) >= 0 and (r := rank_of(new << SHIFT | other)) is not None:
                    if r in where:
                        where[r].append(i)
                    else:
                        where[r] = [i]
                        push(heap, r)
                h = before[i]
                if (other := sym[h]) >= 0 and (r := rank_of(other << SHIFT | new)) is not None:
                    if r in where:
                        where[r].append(h)
                    else:
                        where[r] = [h]
                        push(heap, r)
        done = np.array(sym, np.int64)
        live = done >= 0
        packed = done[live].astype("<u4").tobytes()
        cut = [0, *(np.cumsum(live)[ends - 1] * 4).tolist()]
        return [packed[a:b] for a, b in zip(cut, cut[1:])]

    def pieces(self, text: str) -> list[str]:
        """Pretokens in order; special tokens stand alone as written."""
        if self.split is None or not self.split.search(text):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.words.findall(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.words.findall(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        memory, pieces = self.memory, [self.pieces(t) for t in texts]
        new = [w for w in set().union(*pieces) if w not in memory]
        if len(memory) + len(new) > REMEMBER:
            memory.clear()
            new = list(set().union(*pieces))
        for word in [w for w in new if w in self.special]:
            memory[word] = np.array([self.special[word]], "<u4").tobytes()
        new = [w for w in new if w not in self.special]
        if new:
            memory.update(zip(new, self.encode_words(new)))
        out = [b"".join(map(memory.__getitem__, p)) for p in pieces]
        for word in new:
            if len(word) > LONG:
                del memory[word]
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 bytes of the decoded text; what is not UTF-8 becomes U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _portions(column, most: int = 4 << 20):
    """Texts of an Arrow column in portions of about `most` bytes, so that memory is bounded."""
    part, size = [], 0
    for value in column:
        raw = value.as_buffer().to_pybytes()
        part.append(raw.decode("utf-8", "replace"))
        size += len(raw)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """docs with a binary column of the text's token ids (little-endian unsigned 32-bit).

    A null text encodes as empty.  All other columns pass through, so names may clash with
    nothing but `ids`, which is replaced.  Null and repeated ids stay.  Empty table: empty.
    """
    return _mapped(docs.drop(ids), text, ids, lambda v, texts: v.encode(texts), path)


def _mapped(docs: DataFrame, text: str, out: str, work, path: str | None) -> DataFrame:
    schema = added(docs, f"`{out}` binary")
    [temp] = free(docs, "llm_text")

    def run(batches):
        vocab = vocabulary(path or default_path())
        for batch in batches:
            got = []
            for part in _portions(batch.columns[-1]):
                got += work(vocab, part)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.binary())], names=[*batch.schema.names[:-1], out])

    return docs.withColumn(temp, utf8(text)).mapInArrow(run, schema)


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with the text that its ids decode to (null ids: empty text); a column named as `text`
    is replaced, all others pass through.  Empty table: empty."""
    schema = added(docs.drop(text), f"`{text}` string")

    def run(batches):
        vocab = vocabulary(path or default_path())
        for batch in batches:
            got = [vocab.decode(x.as_py() or b"").decode() for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*batch.schema.names, text])

    return docs.drop(text).mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256.

    Encodes and decodes in one pass and hashes both in the task, so neither ids nor texts
    are shuffled or returned.  Null text: empty.  Null and repeated ids stay.  Empty table:
    no rows.
    """
    kinds = dict(docs.dtypes)

    def run(batches):
        vocab = vocabulary(path or default_path())
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for part in _portions(batch.column("text")):
                for ids in vocab.encode(part):
                    n.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(vocab.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"`{id_col}` {kinds[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col), utf8(text).alias("text")).mapInArrow(run, schema)
