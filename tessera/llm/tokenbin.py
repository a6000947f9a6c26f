"""Token-id files coded with a static range asymmetric numeral system.

One frequency table over the whole corpus codes independent blocks. A block holds whole texts; its
ids are dealt over interleaved lanes, so one array operation codes a step of all lanes, and every
``CHECKPOINT`` steps the lanes' states and the place in the stream are kept. A reader starts at any
checkpoint: ``read_tokens`` makes each stretch between checkpoints a row of its own, with its part of
the stream alone, and can deal those rows over as many tasks as it is told.

A folder of token files holds ``blocks`` (Parquet, one row a block, in ascending doc_id order by part
and block), ``frequencies`` (id, freq) and ``header`` (one row: coding parameters, number of blocks
and ids, checksum of the frequencies). Nothing else is needed to read it: another program in another
session decodes from the path. Each stretch of a stream has a checksum, and so has all the rest of a
block; the header tells lost blocks.

Key ranges of documents go to parts, cut so that each holds about ``PART_BYTES`` of text (more past
``MAX_PARTS`` parts, 1 TB of text; a task sorts its part with spilling and codes it block by block, so
its memory does not grow with the part). A doc_id that holds many rows is cut by the hash of its ids.

Words are encoded by the tokenizers library once per worker and word: texts are normalised and
split exactly as its file says, by array operations where normalisation is letter by letter (the
basic plane without combining marks and jamo), and by the library itself for any other text.

Defined results: null counts as empty; an empty text has the end id alone; rows of equal doc_id
follow each other in the order of their ids' hash (rows equal in that too have equal ids); rows
without doc_id come first; an empty table gives none.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import vec
from tessera.llm.bpe import texts_with, tokenizer_path
from tessera.llm.pretoken import WordTable, class_table, decode, split_words
from tessera.llm.shared import drop_path, keep, new_path, table

U64 = np.uint64
LANES = 1024
BLOCK_IDS = 1 << 19
CHECKPOINT = 128
#: Frequencies sum to 2**SCALE; states stay in [2**31, 2**63) and shed 32 bits at a time.
SCALE = 20
LOW = 1 << 31
PART_BYTES = 16 << 20
MAX_PARTS = 1 << 16
#: Code points that arrays normalise, where they can: the basic plane.
PLAIN = 0x10000


# --- coding --------------------------------------------------------------------------------------


class Frequencies:
    """Static symbol frequencies that sum to 2**SCALE; every symbol that occurs has one."""

    def __init__(self, counts: np.ndarray):
        total = int(counts.sum())
        f = np.where(counts > 0, np.maximum(1, (counts * (1 << SCALE)) // max(total, 1)), 0).astype(np.int64)
        while (over := int(f.sum()) - (1 << SCALE)) > 0:  # takes from the largest what the small ones were given
            big = np.flatnonzero(f > 1)
            share = np.minimum(f[big] - 1, np.maximum(1, f[big] * over // int(f[big].sum())))
            share = np.where(np.cumsum(share) - share < over, share, 0)
            f[big] -= share
        if over < 0:
            f[int(f.argmax())] -= over
        self.freq = f.astype(np.uint64)
        self.start = (np.cumsum(f) - f).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(f), dtype=np.uint32), f)
        self.crc = zlib.crc32(f.astype("<u4").tobytes())


def encode_block(ids: np.ndarray, fr: Frequencies) -> dict:
    """Stream and checkpoints of a block of ids; the first checkpoint is its beginning."""
    n = len(ids)
    steps = -(-n // LANES)
    f, c = fr.freq[ids], fr.start[ids]
    limit = f << U64(63 - SCALE)
    x = np.full(LANES, LOW, np.uint64)
    words, marks, shed = [], [], 0
    for t in range(steps - 1, -1, -1):
        a, b = t * LANES, min(n, (t + 1) * LANES)
        y, ft = x[: b - a], f[a:b]
        big = y >= limit[a:b]
        out = y[big]
        words.append((out & U64(0xFFFFFFFF)).astype("<u4"))
        shed += len(out)
        y = np.where(big, y >> U64(32), y)
        q = y // ft
        x[: b - a] = (q << U64(SCALE)) + (y - q * ft) + c[a:b]
        if t % CHECKPOINT == 0:
            marks.append((t, shed, x.astype("<u8")))
    marks = marks[::-1]
    stream = (np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")).tobytes()
    places = [shed - s for _, s, _ in marks] + [shed]
    return {"stream": stream, "steps": [t for t, *_ in marks], "places": places, "states": b"".join(s.tobytes() for *_, s in marks), "crcs": [zlib.crc32(stream[4 * i : 4 * j]) for i, j in zip(places, places[1:], strict=False)]}


def decode_stretch(block: dict, mark: int, stop: int, end: int, fr: Frequencies, base: int = 0) -> np.ndarray:
    """The ids of a block from checkpoint ``mark`` to position ``end``, which lies before checkpoint ``stop``;
    ``stream`` begins at checkpoint ``base``."""
    skip = block["places"][base]
    for k in range(mark, stop):
        if zlib.crc32(block["stream"][4 * (block["places"][k] - skip) : 4 * (block["places"][k + 1] - skip)]) != block["crcs"][k]:
            raise ValueError("token block: stream checksum does not match")
    stream, at = np.frombuffer(block["stream"], "<u4"), block["places"][mark] - skip
    x = np.frombuffer(block["states"], "<u8").reshape(-1, LANES)[mark].astype(np.uint64)
    first = block["steps"][mark] * LANES
    out = np.empty(end - first, np.uint32)
    for a in range(first, end, LANES):
        b = min(end, a + LANES)
        y = x[: b - a]
        slot = y & U64((1 << SCALE) - 1)
        s = fr.symbol[slot]
        out[a - first : b - first] = s
        y = fr.freq[s] * (y >> U64(SCALE)) + slot - fr.start[s]
        low = np.flatnonzero(y < U64(LOW))
        y[low] = (y[low] << U64(32)) | stream[at : at + len(low)]
        at += len(low)
        x[: b - a] = y
    return out


def head_crc(b: dict) -> int:
    """Checksum of all of a block but its stream."""
    crc = zlib.crc32(b["states"])
    numbers = [b["part"], b["block"], b["first"], b["n_ids"], len(b["doc_ids"]), *(-1 if d is None else d for d in b["doc_ids"]), *(d is None for d in b["doc_ids"])]
    for part in (numbers, b["n_tokens"], b["steps"], b["places"], b["stops"], b["crcs"], [b["freq_crc"]]):
        crc = zlib.crc32(np.array(part, "<i8").tobytes(), crc)
    return crc


def stretches(steps: list[int], n_ids: int, sizes: list[int]) -> list[int]:
    """For each checkpoint the one before which the texts that begin after it end (itself: no text begins there)."""
    end = np.cumsum(np.array(sizes, np.int64))
    begin = end - np.array(sizes, np.int64)
    edge = np.array([t * LANES for t in steps] + [n_ids], np.int64)
    first = np.searchsorted(begin, edge)
    last = end[np.maximum(first[1:] - 1, 0)]
    return np.where(first[1:] > first[:-1], np.searchsorted(edge, last), np.arange(len(steps))).tolist()


# --- tokenizing ----------------------------------------------------------------------------------


#: Masks of the first 0 to 4 letters of four packed ones.
FIRST = np.array([(1 << 16 * k) - 1 for k in range(5)], np.uint64)


def outline(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first and last four letters of plain words, packed: a second identity beside the hash."""
    packed = np.zeros(len(points) + 4, "<u2")
    packed[: len(points)] = points
    four = np.ndarray((len(points) + 1,), "<u8", packed, strides=(2,))
    mask = FIRST[np.minimum(ends - starts, 4)]
    return (four[starts] & mask) + vec.mix(four[np.maximum(ends - 4, starts)] & mask)


def letter_by_letter(tok) -> tuple[np.ndarray, np.ndarray]:
    """(what the tokenizer's normaliser makes of each code point, whether it does so whatever stands beside it).

    Composition joins only marks and jamo to what stands before them; a sigma's small form may depend on its place."""
    low, plain = np.arange(PLAIN, dtype=np.uint32), np.zeros(PLAIN + 1, bool)
    for c in range(PLAIN):
        if not (0xD800 <= c < 0xE000 or 0x1100 <= c < 0x1200 or c == 0x3A3 or unicodedata.category(chr(c))[0] == "M"):
            to = tok.normalizer.normalize_str(chr(c))
            if len(to) == 1 and ord(to) < PLAIN:
                low[c], plain[c] = ord(to), True
    return low, plain


class Tokens:
    """One worker's tokenizer, by its library, with a table of the words it has met."""

    def __init__(self, spec: str, classes: np.ndarray):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        parts = json.loads(spec)
        # for words that are normalised and split already: the same model behind a plain split at spaces
        plain = [{"type": "WhitespaceSplit"}, *(p for p in parts["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel")]
        self.model = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": plain}}))
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.classes, self.words = classes, WordTable(limit=1_500_000)
        vocab, suffix = self.tok.get_vocab(with_added_tokens=True), parts["model"]["end_of_word_suffix"] or "\0"
        self.closes = np.zeros(max(vocab.values()) + 1, bool)  # the ids that end a word
        self.closes[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.low, self.plain = letter_by_letter(self.tok)

    def ids_of(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids per word, all ids) of words given as ranges of code points, many in a call."""
        lens, flat = [], []
        for i in range(0, len(starts), 1024):
            s, e = starts[i : i + 1024], ends[i : i + 1024]
            stop = np.cumsum(e - s + 1)
            line = np.full(int(stop[-1]), 32, np.uint32)  # a space after each word
            line[vec.gather(stop - (e - s + 1), stop - 1)] = points[vec.gather(s, e)]
            got = self.model.encode_batch_fast([line.astype("<u4").tobytes().decode("utf-32-le")], add_special_tokens=False)[0]
            ids = np.array(got.ids, np.int32)
            last = np.flatnonzero(self.closes[ids])
            if len(last) == len(s):
                lens.append(np.diff(last, prepend=-1))
                flat.append(ids)
            else:  # a word that the splitter cuts anew
                words = [points[a:b].astype("<u4").tobytes().decode("utf-32-le") for a, b in zip(s.tolist(), e.tolist(), strict=True)]
                each = [x.ids for x in self.tok.encode_batch_fast(words, add_special_tokens=False)]
                lens.append(np.array([len(x) for x in each]))
                flat.append(np.array([y for x in each for y in x], np.int32))
        return np.concatenate(lens), np.concatenate(flat)

    def _plain(self, points: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, e = split_words(points, offs, self.classes)
        h, c = vec.hasher(1, PLAIN)(points, s, e), outline(points, s, e)
        ids, size = self.words.encode(h, c, lambda rows: self.ids_of(points, s[rows], e[rows]))
        return ids, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(s, offs)]

    def encode(self, col: pa.Array):
        """(ids of all texts, their ends) of a column, part by part."""
        odd = texts_with(col, self.special).to_numpy(zero_copy_only=False)
        data, offs = vec.text_buffer(col)
        for i, j in vec.chunks(offs):
            points, at, _ = decode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            strange = np.flatnonzero(~self.plain[np.minimum(points, PLAIN)])
            direct = odd[i:j].copy()
            direct[np.searchsorted(at, strange, "right") - 1] = True
            if not direct.any():
                yield self._plain(self.low[points], at)
                continue
            keep_points = np.repeat(~direct, np.diff(at))
            size = np.where(direct, 0, np.diff(at))
            ids, ends = self._plain(self.low[points[keep_points]], np.concatenate([[0], np.cumsum(size)]))
            lists = np.split(ids, ends[1:-1])
            for k in np.flatnonzero(direct).tolist():
                lists[k] = np.array(self.tok.encode(col[i + k].as_py() or "", add_special_tokens=False).ids, np.int32)
            yield np.concatenate(lists).astype(np.int32), np.cumsum([0] + [len(x) for x in lists])


_TOKENS: dict[str, Tokens] = vec.cache()


TOKEN_SCHEMA = "doc_id bigint, tie bigint, part int, width int, ids binary, counts binary"


def parts_of(cuts: np.ndarray, doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The part of each row: by its doc_id, and by its tie (63 bits) where cuts repeat that doc_id."""
    low, high = np.searchsorted(cuts, doc), np.searchsorted(cuts, doc, "right")
    return (low + (((tie >> 31) * (high - low + 1)) >> 32)).astype(np.int32)


def _tokenize(shared, end_id: int, vocab: int):
    """Rows of packed ids; then one row with how often each id occurred in the task."""

    def batch(doc, tie, part, width, ids, counts):
        return pa.RecordBatch.from_arrays([doc, pa.array(tie, pa.int64()), pa.array(part, pa.int32()), pa.array(width, pa.int32()), ids, counts], names=["doc_id", "tie", "part", "width", "ids", "counts"])

    def run(batches):
        spec, classes, cuts = shared.value
        counts = np.zeros(vocab, np.int64)
        if spec not in _TOKENS:
            _TOKENS[spec] = Tokens(spec, classes)
        tok = _TOKENS[spec]
        for rb in batches:
            doc, done = rb.column(0), 0
            for ids, ends in tok.encode(rb.column(1)):
                n = len(ends) - 1
                counts += np.bincount(ids, minlength=vocab)
                counts[end_id] += n
                closed = np.insert(ids, ends[1:], end_id).astype("<u2" if vocab <= 1 << 16 else "<u4")
                off = (ends + np.arange(n + 1)) * closed.itemsize
                part = doc.slice(done, n)
                packed = closed.tobytes()
                view = memoryview(packed)
                tie = np.array([xxhash.xxh64_intdigest(view[a:b]) >> 1 for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.int64)
                where = parts_of(cuts, part.fill_null(np.iinfo(np.int64).min).to_numpy(), tie)
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(packed)])
                yield batch(part, tie, where, np.full(n, closed.itemsize), raw, pa.nulls(n, pa.binary()))
                done += n
        yield batch(pa.nulls(1, pa.int64()), [0], [-1], [0], pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary()))

    return vec.tidy(run, keeps=True)


def token_rows(col_width: pa.Array, col_ids: pa.Array):
    """Arrays of ids of rows of (width, packed ids)."""
    data, offs = vec.text_buffer(col_ids)
    for w, a, b in zip(col_width.to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        yield np.frombuffer(data[a:b].tobytes(), "<u2" if w == 2 else "<u4")


def _histogram(batches):
    total = 0
    for rb in batches:
        for blob in rb.column(0).to_pylist():
            total = total + np.frombuffer(blob, np.int64)
    if isinstance(total, np.ndarray):
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])


BLOCK_SCHEMA = "part int, block int, first bigint, n_ids bigint, doc_ids array<bigint>, n_tokens array<int>, stream binary, steps array<int>, places array<int>, states binary, crcs array<bigint>, stops array<int>, freq_crc bigint, head_crc bigint"
BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64()]


def block_row(fr: Frequencies, part: int, block: int, first: int, docs: list, sizes: list[int], ids: np.ndarray) -> dict:
    b = {"part": part, "block": block, "first": first, "n_ids": len(ids), "doc_ids": docs, "n_tokens": sizes, **encode_block(ids, fr)}
    b |= {"stops": stretches(b["steps"], len(ids), sizes), "freq_crc": fr.crc}
    return b | {"head_crc": head_crc(b)}


def _write_blocks(shared):
    """Rows of one part in doc_id order -> its blocks."""

    def row(*args):
        b = block_row(*args)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(b.values(), BLOCK_TYPES, strict=True)], names=list(b))

    def run(batches):
        fr, part, k, first, docs, sizes, arrays, held = shared.value, None, 0, 0, [], [], [], 0
        for rb in batches:
            for doc, p, ids in zip(rb.column("doc_id").to_pylist(), rb.column("part").to_pylist(), token_rows(rb.column("width"), rb.column("ids")), strict=True):
                if docs and (p != part or held >= BLOCK_IDS):
                    yield row(fr, part, k, first, docs, sizes, np.concatenate(arrays).astype(np.int64))
                    k, first, docs, sizes, arrays, held = k + 1, first + held, [], [], [], 0
                if p != part:
                    part, k, first = p, 0, 0
                docs.append(doc)
                sizes.append(len(ids))
                arrays.append(ids)
                held += len(ids)
        if docs:
            yield row(fr, part, k, first, docs, sizes, np.concatenate(arrays).astype(np.int64))

    return vec.tidy(run, keeps=True)


def part_cuts(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Ids that divide the documents into parts of about PART_BYTES of text; a frequent id comes more than once."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = min(MAX_PARTS, max(1, total // PART_BYTES))
    if parts < 2:
        return np.zeros(0, np.int64)
    doc = F.coalesce(F.col(id_col), F.lit(np.iinfo(np.int64).min))
    cuts = docs.agg(F.percentile_approx(doc, [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
    return np.array(cuts or [], np.int64)


HEADER_SCHEMA = "scale int, lanes int, checkpoint int, vocab int, end_id int, freq_crc bigint, n_blocks bigint, n_ids bigint"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Write the token files of all texts; returns their path."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True)
    cuts = part_cuts(rows, "doc_id", "text")
    kept, kept_path = keep(rows.mapInArrow(_tokenize(sc.broadcast((spec, class_table(), cuts)), end_id, vocab), TOKEN_SCHEMA), "token-ids")
    ids = kept.where("part >= 0").drop("counts")
    counts = np.zeros(vocab, np.int64)
    for i, n in kept.select("counts").where("counts IS NOT NULL").mapInArrow(_histogram, "id int, n bigint").groupBy("id").agg(F.sum("n")).collect():
        counts[i] = n
    fr = Frequencies(counts)
    path = path or new_path(spark, "token-files")
    used = np.flatnonzero(fr.freq)
    spark.createDataFrame(pa.table([pa.array(used.astype(np.int32)), pa.array(fr.freq[used].astype(np.int32))], names=["id", "freq"])).coalesce(1).write.parquet(f"{path}/frequencies")
    ordered = ids.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "tie")
    ordered.mapInArrow(_write_blocks(sc.broadcast(fr)), BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    drop_path(spark, kept_path)
    size = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").agg(F.count("*"), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    spark.createDataFrame([(SCALE, LANES, CHECKPOINT, vocab, end_id, fr.crc, *size)], HEADER_SCHEMA).coalesce(1).write.parquet(f"{path}/header")
    return path


def _read_stretches(shared, digest: bool):
    def run(batches):
        fr = shared.value
        for rb in batches:
            for b in rb.to_pylist():
                if b["freq_crc"] != fr.crc:
                    raise ValueError("token block: coded with other frequencies")
                if head_crc(b) != b["head_crc"]:
                    raise ValueError("token block: checksum does not match")
                k, stop = b["stretch"], b["stop"]
                size = np.array(b["n_tokens"], np.int64)
                end = np.cumsum(size)
                edge = [t * LANES for t in b["steps"]] + [b["n_ids"]]
                i, j = np.searchsorted(end - size, (edge[k], edge[k + 1])).tolist()
                ids = decode_stretch(b, k, stop, int(end[j - 1]), fr, base=k)
                s, e = (end - size)[i:j] - edge[k], end[i:j] - edge[k]
                cols = [pa.array([b["part"]] * (j - i), pa.int32()), pa.array(b["doc_ids"][i:j], pa.int64()), pa.array(b["first"] + edge[k] + s), pa.array(size[i:j])]
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    cols.append(pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(s.tolist(), e.tolist(), strict=True)], pa.int64()))
                else:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(s, e[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["part", "doc_id", "at", "n_tokens", "ids_crc32" if digest else "ids"])

    return vec.tidy(run, keeps=True)


def read_tokens(spark: SparkSession, path: str, digest: bool = False, id_col: str = "doc_id", tasks: int | None = None) -> DataFrame:
    """(id, start, n_tokens, ids or their crc32) of every text, from the files at ``path`` alone; each stretch between
    checkpoints is decoded by itself, in ``tasks`` tasks if given."""
    header = spark.read.schema(HEADER_SCHEMA).parquet(f"{path}/header").first()
    if (header.scale, header.lanes, header.checkpoint) != (SCALE, LANES, CHECKPOINT):
        raise ValueError("token files: coded with other parameters")
    counts = np.zeros(header.vocab, np.int64)
    for i, n in spark.read.schema("id int, freq int").parquet(f"{path}/frequencies").collect():  # as long as the vocabulary
        counts[i] = n
    fr = Frequencies(counts)  # sums to 2**SCALE, so stays as it is
    if fr.crc != header.freq_crc:
        raise ValueError("token files: checksum of the frequencies does not match")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    base, at, found = {}, 0, 0
    for part, n, k in blocks.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("k")).orderBy("part").collect():  # one row a part
        base[part], at, found = at, at + n, found + k
    if (found, at) != (header.n_blocks, header.n_ids):
        raise ValueError("token files: blocks are missing")
    bases = spark.createDataFrame([(k, v) for k, v in base.items()] or [(0, 0)], "part int, base bigint")
    what = "ids_crc32 bigint" if digest else "ids array<int>"
    each = blocks.select("*", F.posexplode("stops").alias("stretch", "stop")).where("stop > stretch")
    each = each.withColumn("stream", F.expr("substring(stream, places[stretch] * 4 + 1, (places[stop] - places[stretch]) * 4)"))
    each = each.repartition(tasks, "part", "block", "stretch") if tasks else each
    got = each.mapInArrow(_read_stretches(spark.sparkContext.broadcast(fr), digest), f"part int, doc_id bigint, at bigint, n_tokens bigint, {what}")
    return got.join(F.broadcast(bases), "part").select(F.col("doc_id").alias(id_col), (F.col("base") + F.col("at")).alias("start"), "n_tokens", what.split()[0])


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path, digest=True)
