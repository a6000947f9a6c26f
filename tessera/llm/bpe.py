"""Byte-level BPE encoding and decoding with a minimal acyclic lexicon.

A first pass counts all words of the corpus; the most frequent ones are compiled, with their
ids, into a shared-suffix automaton that every worker memory-maps. The second pass encodes: words
known to the worker come from its table, new ones from the automaton, and unseen ones are merged
exactly, many words at once, by the vocabulary's merge ranks. Special strings in a text become
their special id, as in the library.

Defined results: null counts as the empty text; an empty text has no ids and decodes to itself;
words of any length are merged exactly (past 256 bytes by a heap, in n log n), and a text may hold
any number of special strings; repeated rows are answered once each; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import vec
from tessera.llm.lexicon import Lexicon, build
from tessera.llm.pretoken import WordTable, class_table, decode, split_bytes
from tessera.llm.shared import drop_path, keep, table

#: Words in the lexicon, and bytes of the longest one; both bound what is broadcast.
LEXICON_WORDS = 1 << 16
LEXICON_BYTES = 64
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(plain)))
    return [out[b] for b in range(256)]


class Merges:
    """A byte-level BPE vocabulary as arrays; small enough to broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.spelled = [t.encode() if t in self.special else bytes(of_letter[c] for c in t) for t in (names.get(i, "") for i in range(max(names) + 1))]
        self.of_byte = np.array([vocab[c] for c in letters], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids, NONE where there is none (ids under 0: none)."""
        key = a.astype(np.int64) << 20 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (a >= 0) & (b >= 0), self.rank[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids per word, all ids): exact merging, words of like length together."""
        size = np.array([len(w) for w in words], np.int64)
        lens, out = np.zeros(len(words), np.int64), [None] * len(words)
        for low, high in ((0, 8), (8, 16), (16, 32), (32, 64), (64, 256)):
            rows = np.flatnonzero((size > low) & (size <= high))
            if len(rows):
                for r, ids in zip(rows.tolist(), self._grid([words[r] for r in rows.tolist()], size[rows]), strict=True):
                    out[r], lens[r] = ids, len(ids)
        for r in np.flatnonzero(size > 256).tolist():
            out[r] = self.merge_long(words[r])
            lens[r] = len(out[r])
        return lens, np.concatenate([x for x in out if x is not None] or [np.zeros(0, np.int32)]).astype(np.int32)

    def _grid(self, words: list[bytes], size: np.ndarray) -> list[np.ndarray]:
        n, width = len(words), int(size.max())
        inside = np.arange(width) < size[:, None]
        ids = np.full((n, width + 1), -1, np.int32)
        ids[:, :-1][inside] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        live = np.arange(n)
        cols = np.arange(width)
        while len(live):
            j = rank[live].argmin(axis=1)
            best = rank[live, j]
            go = best < NONE
            live, j, best = live[go], j[go], best[go]
            if not len(live):
                break
            move = np.minimum(cols + (cols > j[:, None]), width - 1)
            rest = np.take_along_axis(ids[live, :-1], move, axis=1)
            rest[:, -1] = -1
            rest[np.arange(len(live)), j] = self.made[best]
            moved = np.take_along_axis(rank[live], move, axis=1)
            moved[:, -1] = NONE
            ids[live, :-1], rank[live] = rest, moved
            rank[live, j] = self.ranks(ids[live, j], ids[live, j + 1])
            left = j > 0
            rank[live[left], j[left] - 1] = self.ranks(ids[live[left], j[left] - 1], ids[live[left], j[left]])
        return [row[row >= 0] for row in ids]

    def merge_long(self, word: bytes) -> np.ndarray:
        """Exact merging of a long word with a heap of candidate merges over a linked list."""
        import heapq

        ids = self.of_byte[np.frombuffer(word, np.uint8)]
        rank = self.ranks(ids[:-1], ids[1:])
        heap = [(int(r), i, int(ids[i]), int(ids[i + 1])) for i, r in enumerate(rank.tolist()) if r < NONE]
        heapq.heapify(heap)
        ids = ids.tolist()
        nxt, prv = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]

        def offer(i: int) -> None:
            if i >= 0 and nxt[i] >= 0:
                a, b = ids[i], ids[nxt[i]]
                if (r := int(self.ranks(np.array([a]), np.array([b]))[0])) < NONE:
                    heapq.heappush(heap, (r, i, a, b))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            k = nxt[i] if ids[i] == a else -1
            if k < 0 or ids[k] != b:
                continue
            ids[i], ids[k], nxt[i] = int(self.made[r]), -1, nxt[k]
            if nxt[k] >= 0:
                prv[nxt[k]] = i
            offer(prv[i])
            offer(i)
        return np.array([x for x in ids if x >= 0], np.int32)


def words_in(data: np.ndarray, offs: np.ndarray, classes: np.ndarray):
    """(starts, ends) in bytes, both hashes, words before each text."""
    points, at_text, at = decode(data, offs)
    s, e = split_bytes(points, at_text, classes)
    first = np.searchsorted(s, at_text)
    s, e = at[s], at[e]
    return s, e, vec.hasher(1)(data, s, e), vec.hasher(2)(data, s, e), first


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = memoryview(data)
    return [bytes(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def texts_with(col: pa.Array, special: dict[str, int]) -> pa.Array:
    """Which texts hold a special string."""
    mask = pa.array(np.zeros(len(col), bool))
    for t in special:
        mask = pc.or_(mask, pc.fill_null(pc.match_substring(col, t), False))
    return mask


class Codec:
    """Encoder and decoder of one worker; its word table lasts across batches."""

    def __init__(self, merges: Merges, classes: np.ndarray, lexicon: Lexicon | None):
        self.merges, self.classes, self.lexicon = merges, classes, lexicon
        self.words = WordTable()
        #: The longest special string at the first place, as in the library; one that never matches if there is none.
        self.special = re.compile("|".join(re.escape(t) for t in sorted(merges.special, key=len, reverse=True)) or r"(?!)")
        self.spelled = pa.array(merges.spelled, pa.binary())
        self.decimal = pa.array([str(i) for i in range(len(merges.spelled))])

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.lexicon is None:
            return self.merges.merge(words)
        number = self.lexicon.find(words)
        known, unseen = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        lens = np.zeros(len(words), np.int64)
        lens[known], known_ids = self.lexicon.output(number[known])
        lens[unseen], unseen_ids = self.merges.merge([words[i] for i in unseen.tolist()])
        flat = np.empty(int(lens.sum()), np.int32)
        which = np.repeat(number >= 0, lens)
        flat[which], flat[~which] = known_ids, unseen_ids
        return lens, flat

    def _plain(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, e, h, c, first = words_in(data, offs, self.classes)
        ids, size = self.words.encode(h, c, lambda rows: self.ids_of(spelled(data, s[rows], e[rows])))
        return ids, np.concatenate([[0], np.cumsum(size)])[first]

    def _with_special(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_plain``, for texts that hold special strings: the pieces between them are encoded
        together, and each special string's id follows the piece before it."""
        pieces, after, count = [], [], []
        for t in texts:
            at = 0
            for m in self.special.finditer(t):
                pieces.append(t[at : m.start()])
                after.append(self.merges.special[m[0]])
                at = m.end()
            pieces.append(t[at:])
            after.append(-1)
            count.append(len(pieces))
        ids, ends = self._plain(*vec.text_buffer(pa.array(pieces, pa.large_string())))
        after = np.array(after, np.int32)
        marks = after >= 0
        ids = np.insert(ids, ends[1:][marks], after[marks])
        ends = ends + np.concatenate([[0], np.cumsum(marks)])
        return ids, ends[np.array([0, *count])]

    def encode(self, col: pa.Array):
        """Lists of ids of the texts of ``col``, part by part."""
        odd = texts_with(col, self.merges.special).to_numpy(zero_copy_only=False)
        data, offs = vec.text_buffer(col)
        for i, j in vec.chunks(offs):
            if odd[i:j].any():
                ids, ends = self._with_special([t or "" for t in col.slice(i, j - i).to_pylist()])
            else:
                ids, ends = self._plain(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids, as UTF-8 with replacement characters where bytes are not."""
        raw = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.spelled.take(ids.values)), pa.scalar(b"", pa.binary()))
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())

    def joined(self, ids: pa.ListArray) -> pa.Array:
        """Decimal ids joined by commas."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.decimal.take(ids.values)), ",")


def shas(col: pa.Array) -> pa.Array:
    data, offs = vec.text_buffer(col)
    raw, o = memoryview(data.tobytes()), offs.tolist()
    return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(o[:-1], o[1:], strict=True)], pa.string())


_CODECS: dict[int, Codec] = vec.cache()


def codec_of(shared) -> Codec:
    """This worker's codec for a broadcast (merges, classes, lexicon file)."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else id(shared)
    if key not in _CODECS:
        merges, classes, flat = shared.value
        _CODECS.clear()
        _CODECS[key] = Codec(merges, classes, Lexicon(flat) if flat else None)
    return _CODECS[key]


def _count(shared):
    def emit(words: list[bytes], n: np.ndarray):
        for i in range(0, len(words), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 20_000], pa.binary()), pa.array(n[i : i + 20_000])], names=["word", "n"])

    def run(batches):
        classes, seen, names, n = shared.value, WordTable(), [], np.zeros(0, np.int64)

        def fresh(words):
            names.extend(words)
            return np.zeros(len(words), np.int64), np.zeros(0, np.int32)

        for rb in batches:
            data, offs = vec.text_buffer(rb.column(0))
            for i, j in vec.chunks(offs):
                d = data[offs[i] : offs[j]]
                s, e, h, c, _ = words_in(d, offs[i : j + 1] - offs[i], classes)
                number = seen.numbers(h, c, lambda rows, d=d, s=s, e=e: fresh(spelled(d, s[rows], e[rows])))
                got = np.bincount(number, minlength=len(names))
                got[: len(n)] += n
                n = got
                if len(names) > seen.limit:
                    yield from emit(names, n)
                    seen.clear()
                    names, n = [], np.zeros(0, np.int64)
        yield from emit(names, n)

    return vec.tidy(run)


def word_counts(docs: DataFrame, classes, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts."""
    part = docs.select(F.col(text_col).cast("string")).mapInArrow(_count(classes), "word binary, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, words: int) -> list:
    """The words of the highest counts, ``words`` at most: all those above a cut that a histogram
    of the counts' logarithms (a few hundred rows) gives, so no task sends more than those."""
    counts, path = keep(counts, "word-counts")
    step = F.floor(F.log("n") * 24).cast("int")
    room, cut = words, None
    for level, n in counts.groupBy(step.alias("level")).count().orderBy(F.desc("level")).collect():
        if n > room:
            break
        room, cut = room - n, level
    top = counts.where(step >= cut).select("word").collect() if cut is not None else []
    drop_path(counts.sparkSession, path)
    return top


def prepare(docs: DataFrame, tokenizer: str, text_col: str = "text", words: int = LEXICON_WORDS):
    """Broadcast of (merges, classes, lexicon file) for these texts."""
    sc = docs.sparkSession.sparkContext
    merges, classes = Merges(tokenizer), class_table()
    counts = word_counts(docs, sc.broadcast(classes), text_col)
    top = most_frequent(counts.where(F.octet_length("word") <= LEXICON_BYTES), words)
    frequent = [bytes(r[0]) for r in top]
    lens, flat = merges.merge(frequent)
    return sc.broadcast((merges, classes, build(frequent, np.split(flat, np.cumsum(lens)[:-1]) if frequent else [])))


def _columns(shared, make, names):
    def run(batches):
        codec = codec_of(shared)
        for rb in batches:
            at = 0
            for ids in codec.encode(rb.column(rb.num_columns - 1)):
                head = [rb.column(k).slice(at, len(ids)) for k in range(rb.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*head, *make(codec, ids)], names=names)
                at += len(ids)

    return vec.tidy(run, keeps=True)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text."""
    shared = prepare(docs, tokenizer, text_col)
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(_columns(shared, lambda _, ids: [ids], [id_col, "ids"]), f"`{id_col}` bigint, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of lists of ids."""
    shared = encoded.sparkSession.sparkContext.broadcast((Merges(tokenizer), None, None))

    def run(batches):
        codec = codec_of(shared)
        for rb in batches:
            ids = pc.fill_null(rb.column(1), []) if rb.column(1).null_count else rb.column(1)
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())]).astype(np.int32)), ids.flatten())
            yield pa.RecordBatch.from_arrays([rb.column(0), codec.decode(flat)], names=[id_col, "text"])

    return encoded.select(F.col(id_col).cast("bigint"), F.col(ids_col).cast("array<int>")).mapInArrow(run, f"`{id_col}` bigint, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ids counted and hashed, and the hash of what they decode to."""
    shared = prepare(docs, tokenizer, text_col)

    def make(codec, ids):
        return [pc.list_value_length(ids).cast(pa.int64()), shas(codec.joined(ids)), shas(codec.decode(ids))]

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(_columns(shared, make, names), f"`{id_col}` bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
