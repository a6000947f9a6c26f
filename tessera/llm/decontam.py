"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores the corpus as index segments in the shared folder: per segment a sorted term
table (two 64-bit hashes per term, a 128-bit identity), and each term's word positions. Segments are
partitioned by document, so neither building nor searching shuffles, a frequent word is just a long
list in every segment, and a lost executor costs only its own segments. ``search`` reads the index
once: each segment meets the benchmark's blocks, of bounded size, one after the other; each phrase's
posting lists are taken from the rarest term on, shifted by the term's offset in the phrase and
intersected. A worker holds one segment and one block at a time. The same lists, from the rarest on,
give the proximity matches: the smallest intervals of a document that hold all words of a window, in
any order, and are no more than ``SLOP`` words longer than it.

Defined results: null or wordless text has no words and no hits; an empty corpus gives no rows; an
empty benchmark leaves every document clean; repeated rows are answered once each; null item ids
take part in hits but are not listed; columns besides the id and text are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import vec
from tessera.llm.shared import keep, row_key, table, without

#: Bytes of text in an index segment, and of benchmark text shipped to the segments at a time.
SEGMENT_BYTES = 4 << 20
BLOCK_BYTES = 2 << 20
WINDOW = 10
#: Words besides those of the window that a proximity match may hold.
SLOP = 2

SEGMENT_SCHEMA = "ids array<bigint>, first array<int>, terms binary, checks binary, counts binary, gaps binary"
HIT_SCHEMA = "doc_id bigint, n_words bigint, starts array<int>, ends array<int>, items array<bigint>, near array<struct<item:bigint,start:int,end:int>>"


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first hash, second hash, words before each text) of the words of lower-cased texts."""
    one, two, first = [], [], [np.zeros(1, np.int64)]
    seen = 0
    for i, j in vec.chunks(offs):
        d, o = vec.LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
        s, e = vec.spans(vec.ALNUM[d], o)
        one.append(vec.hasher(1)(d, s, e))
        two.append(vec.hasher(2)(d, s, e))
        first.append(np.searchsorted(s, o[1:]) + seen)
        seen += len(s)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return cat(one), cat(two), np.concatenate(first)


def invert(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, checks, counts, positions by term) of a sequence of hashed words."""
    n = len(h1)
    if not n:
        z = np.zeros(0, np.uint64)
        return z, z, np.zeros(0, np.int32), np.zeros(0, np.int32)
    low = vec.U64((1 << max(1, n.bit_length())) - 1)
    key = (h1 & ~low) | np.arange(n, dtype=np.uint64)  # sorts by leading hash bits, then position
    key.sort()
    pos = (key & low).astype(np.int64)
    top = key & ~low
    a, b = h1[pos], h2[pos]
    new = a[1:] != a[:-1]
    if not (np.array_equal(new, top[1:] != top[:-1]) and np.array_equal(new, b[1:] != b[:-1])):
        pos = np.lexsort((np.arange(n), h2, h1))  # hashes that share their leading bits
        a, b = h1[pos], h2[pos]
        new = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.concatenate([[0], np.flatnonzero(new) + 1])
    return a[at], b[at], np.diff(np.append(at, n)).astype(np.int32), pos.astype(np.int32)


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers by byte significance: small numbers leave runs of zeros to the compressor."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def pack(counts: np.ndarray, pos: np.ndarray) -> bytes:
    gaps = np.diff(pos, prepend=np.int32(0))
    at = np.cumsum(counts) - counts
    gaps[at] = pos[at]
    return planes(gaps)


def unpack(counts: np.ndarray, blob: bytes) -> np.ndarray:
    gaps = unplanes(blob).astype(np.int64)
    total = np.cumsum(gaps)
    at = np.cumsum(counts) - counts
    return total - np.repeat(total[at] - gaps[at], counts)


def _index(batches):
    for rb in batches:
        ids = rb.column(0)
        data, offs = vec.text_buffer(rb.column(1))
        for i, j in vec.chunks(offs, SEGMENT_BYTES):
            h1, h2, first = words_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            terms, checks, counts, pos = invert(h1, h2)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids.slice(i, j - i).to_pylist()], pa.list_(pa.int64())), pa.array([first.astype(np.int32)], pa.list_(pa.int32())), *(pa.array([x], pa.binary()) for x in (terms.tobytes(), checks.tobytes(), planes(counts), pack(counts, pos)))],
                names=["ids", "first", "terms", "checks", "counts", "gaps"],
            )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index segments of all texts, stored in the shared folder."""
    return keep(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(vec.tidy(_index), SEGMENT_SCHEMA), "postings")[0]


@dataclass
class Phrases:
    """A block of the benchmark: distinct terms, and distinct windows as term numbers (-1: none)."""

    h1: np.ndarray
    h2: np.ndarray
    windows: np.ndarray
    length: np.ndarray
    items: list[np.ndarray]


def phrases(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> Phrases:
    data, offs = vec.text_buffer(pa.array([t or "" for _, t in rows], pa.large_string()))
    h1, h2, first = words_of(data, offs)
    terms, number = {}, np.zeros(len(h1), np.int64)
    for k, w in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
        number[k] = terms.setdefault(w, len(terms))
    owners: dict[tuple[int, ...], set] = {}
    for (item, _), a, b in zip(rows, first[:-1].tolist(), first[1:].tolist(), strict=True):
        w = number[a:b].tolist()
        for k in range(max(min(1, len(w)), len(w) - window + 1)):
            owners.setdefault(tuple(w[k : k + window]), set()).update(() if item is None else (item,))
    keys = list(owners)
    table = np.full((len(keys), window), -1, np.int64)
    for k, w in enumerate(keys):
        table[k, : len(w)] = w
    both = np.array(list(terms), np.uint64).reshape(-1, 2)
    return Phrases(both[:, 0].copy(), both[:, 1].copy(), table, np.array([len(w) for w in keys], np.int64), [np.array(sorted(owners[w]), np.int64) for w in keys])


def has(sorted_list: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, x)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == x if len(sorted_list) else np.zeros(len(x), bool)


def near(terms: tuple[int, ...], of, most: int, first: np.ndarray, known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the smallest intervals of at most ``most`` words of a document that hold a position of
    every term; the rarest comes first, ``of`` gives a term's positions. A match lies around a position of the rarest
    term that has all others near it; ``known`` keeps those positions by the first terms, since windows that overlap
    share them."""
    none = np.zeros(0, np.int64)
    for k in range(len(terms)):
        key = most, terms[: k + 1]
        if key not in known:
            q = of(terms[k])
            if not k:
                known[key] = q, np.searchsorted(first, q, "right") - 1
            else:
                p, doc = known[most, terms[:k]]
                at = np.searchsorted(q, p, "right")
                left, right = q[np.maximum(at - 1, 0)], q[np.minimum(at, len(q) - 1)]
                ok = ((at > 0) & (left > p - most) & (left >= first[doc])) | ((at < len(q)) & (right < p + most) & (right < first[doc + 1]))
                known[key] = p[ok], doc[ok]
        p, doc = known[key]
        if not len(p):
            return none, none, none
    lists = [of(k) for k in terms]
    low, high = np.maximum(p - most + 1, first[doc]), np.minimum(p + most, first[doc + 1])
    ends = np.unique(np.concatenate([q[vec.gather(np.searchsorted(q, low), np.searchsorted(q, high))] for q in lists]))
    # for every place where an interval may end: the latest position of each word up to there
    home, begin = np.searchsorted(first, ends, "right") - 1, ends.copy()
    whole = np.ones(len(ends), bool)
    for q in lists:
        at = np.searchsorted(q, ends, "right") - 1
        whole &= at >= 0
        begin = np.minimum(begin, q[np.maximum(at, 0)])
    whole &= (begin >= first[home]) & (ends - begin < most)
    begin, ends, home = begin[whole], ends[whole], home[whole]
    smallest = np.concatenate([[True], begin[1:] != begin[:-1]]) if len(begin) else np.zeros(0, bool)  # a start's first end
    return home[smallest], begin[smallest], ends[smallest] + 1


def match(q: Phrases, terms, checks, counts, pos, first, slop: int | None):
    """(window, start) of the phrase matches in a segment, and (window, document, start, end) of the proximity ones."""
    begin = np.concatenate([[0], np.cumsum(counts)])
    at = np.searchsorted(terms, q.h1)
    at[at == len(terms)] = 0
    there = (terms[at] == q.h1) & (checks[at] == q.h2) if len(terms) else np.zeros(len(q.h1), bool)
    df = np.append(np.where(there, counts[at] if len(counts) else 0, 0), np.iinfo(np.int64).max)  # the last: no term
    per = df[q.windows]
    win, start, close, known = [], [], [np.zeros((0, 4), np.int64)], {}
    for w in np.flatnonzero(per.min(axis=1) > 0).tolist() if len(per) else ():
        n = int(q.length[w])
        order = np.argsort(per[w, :n], kind="stable")
        lists = [pos[begin[k] : begin[k + 1]] for k in at[q.windows[w, order]]]
        if slop is not None:
            found = near(tuple(dict.fromkeys(at[q.windows[w, order]].tolist())), lambda k: pos[begin[k] : begin[k + 1]], n + slop, first, known)
            close.append(np.stack([np.full(len(found[0]), w), *found], axis=1))
        cand = lists[0] - order[0]
        for off, p in zip(order[1:], lists[1:], strict=True):
            if not len(cand):
                break
            cand = cand[has(p, cand + off)]
        if len(cand):
            cand = cand[cand >= 0]
            cand = cand[np.searchsorted(first, cand, "right") == np.searchsorted(first, cand + n - 1, "right")]
            win.append(np.full(len(cand), w))
            start.append(cand)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *win]), np.concatenate([none, *start]), np.concatenate(close)


def union(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint intervals covering the given ones (documents don't overlap)."""
    order = np.argsort(s, kind="stable")
    s, reach, doc = s[order], np.maximum.accumulate(e[order]), doc[order]
    new = np.concatenate([[True], (s[1:] > reach[:-1]) | (doc[1:] != doc[:-1])])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return doc[new], s[new], reach[last]


def lists(n: int, row: np.ndarray, *cols: np.ndarray) -> list[pa.Array]:
    """Columns of lists for rows 0..n-1 from values sorted by row."""
    off = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(off, pa.array(c)) for c in cols]


def near_rows(q: Phrases, close: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(document, no item, item, start, end) of proximity matches; a window of null items alone has no item."""
    own = np.array([len(x) for x in q.items], np.int64)
    size = np.maximum(own, 1)[close[:, 0]]
    row = np.repeat(np.arange(len(close)), size)
    item = np.concatenate([np.zeros(0, np.int64), *(q.items[w] if own[w] else np.zeros(1, np.int64) for w in close[:, 0].tolist())])
    win, doc, s, e = close[row].T
    return np.stack([doc, own[win] == 0, item, s - first[doc], e - first[doc]], axis=1) if len(row) else np.zeros((0, 5), np.int64)


def near_column(n: int, rows: np.ndarray) -> pa.Array:
    """Lists of (item, start, end) for documents 0..n-1."""
    doc, null, item, s, e = np.unique(rows, axis=0).T
    off = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
    fields = [pa.array(item, mask=null.astype(bool)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))]
    return pa.ListArray.from_arrays(off, pa.StructArray.from_arrays(fields, names=["item", "start", "end"]))


def _search(shared: list, slop: int | None):
    """Rows of index segments -> one row a document, all blocks of the benchmark taken together."""

    def block(k: int) -> Phrases:
        q = shared[k].value
        if len(shared) > 1:
            shared[k].__dict__.pop("_value", None)  # a worker holds one block at a time
        return q

    def run(batches):
        for rb in batches:
            for r in range(rb.num_rows):
                ids, first, terms, checks, counts, gaps = (rb.column(c) for c in range(6))
                first = first[r].values.to_numpy().astype(np.int64)
                counts = unplanes(counts[r].as_py()).astype(np.int64)
                pos = unpack(counts, gaps[r].as_py())
                terms, checks = (np.frombuffer(c[r].as_py(), np.uint64) for c in (terms, checks))
                n, spans, pairs, near_ = len(first) - 1, [np.zeros((0, 3), np.int64)], [np.zeros((0, 2), np.int64)], [np.zeros((0, 5), np.int64)]
                for k in range(len(shared)):
                    q = block(k)
                    win, start, close = match(q, terms, checks, counts, pos, first, slop)
                    doc = np.searchsorted(first, start, "right") - 1
                    spans.append(np.stack([doc, start, start + q.length[win]], axis=1))
                    pairs.append(np.array([(a, i) for a, w in {*zip(doc.tolist(), win.tolist(), strict=True)} for i in q.items[w].tolist()], np.int64).reshape(-1, 2))
                    near_.append(near_rows(q, close, first))
                d, s, e = np.concatenate(spans).T
                d, s, e = union(d, s, e) if len(d) else (d, s, e)
                s, e = s - first[d], e - first[d]
                every = np.unique(np.concatenate(pairs), axis=0)
                starts, ends = lists(n, d, s.astype(np.int32), e.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids[r].values, pa.array(np.diff(first)), starts, ends, *lists(n, every[:, 0], every[:, 1]), near_column(n, np.concatenate(near_))],
                    names=["doc_id", "n_words", "starts", "ends", "items", "near"],
                )

    return vec.tidy(run)


def blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark's rows in blocks of bounded bytes."""
    rows, size = [], 0
    for item, text in benchmark.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).toLocalIterator():
        rows.append((item, text))
        size += len((text or "").encode())
        if size >= BLOCK_BYTES:
            yield rows
            rows, size = [], 0
    yield rows


def search(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """One row per indexed document: hit intervals in words, item ids, and proximity matches.

    ``near`` (with ``slop``): the distinct (item, start, end) of the smallest intervals of a document that hold all
    words of a window, in any order, within ``slop`` words more than the window has (a word that the window has twice
    is asked for once). ``n_near``: the distinct intervals.
    """
    sc = index.sparkSession.sparkContext
    shared = [sc.broadcast(phrases(rows, window)) for rows in blocks(benchmark, item_col, text_col)]
    out = index.mapInArrow(_search(shared, slop), HIT_SCHEMA)
    places = F.array_distinct(F.transform("near", lambda x: F.struct(x["start"], x["end"])))
    return out.withColumn("n_near", F.size(places).cast("bigint"))


def covered() -> F.Column:
    """Words inside the union of the intervals of ``starts`` and ``ends``."""
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["ends"] - F.greatest(x["starts"], a["reach"]))).alias("n"), F.greatest(a["reach"], x["ends"]).alias("reach"))
    return F.aggregate(F.array_sort(F.arrays_zip("starts", "ends")), F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), step, lambda a: a["n"].cast("bigint"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", slop: int | None = None) -> DataFrame:
    """Per document: words, words inside matched windows, matched items, verdict; with ``slop`` also the number of
    proximity matches and, in ``near``, their item:start:end, in words."""
    hits = search(build_index(docs, id_col, text_col), benchmark, window=window, slop=slop)
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = covered()
    spelled = F.array_join(F.transform(F.array_sort("near"), lambda x: F.concat_ws(":", F.coalesce(x["item"].cast("string"), F.lit("")), x["start"], x["end"])), ",")
    return hits.select(F.col("doc_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *([] if slop is None else ["n_near", spelled.alias("near")]))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a benchmark passage."""
    key = row_key(id_col, text_col)
    found = decontaminate(docs.select(key.alias("row"), text_col), benchmark, window, "row", text_col)
    return without(docs, found.where("contaminated"), key)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOUND = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_FOUND} AS w FROM documents),
b AS (SELECT item_id, {_FOUND} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (
  SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS k FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS t FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, dw.n, k FROM dw JOIN win ON dw.n = win.n AND dw.t = win.t),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1),
-- proximity: windows all of whose words a document has, then the smallest intervals around each place where one may end
winno AS (SELECT row_number() OVER () AS win, item_id, n, t FROM win),
ww AS (SELECT DISTINCT win, n, unnest(string_split(t, ' ')) AS word FROM winno),
need AS (SELECT win, n, count(*) AS k FROM ww GROUP BY 1, 2),
place AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) - 1 AS p FROM d),
known AS (SELECT * FROM place WHERE word IN (SELECT word FROM ww)),
cand AS (SELECT doc_id, win FROM (SELECT DISTINCT doc_id, word FROM known) JOIN ww USING (word) JOIN need USING (win) GROUP BY 1, 2 HAVING count(*) = any_value(k)),
spot AS (SELECT b.doc_id, b.win, ww.n, ww.word, p FROM cand b JOIN ww ON ww.win = b.win JOIN known k ON k.doc_id = b.doc_id AND k.word = ww.word),
latest AS (SELECT e.doc_id, e.win, e.n, e.p AS e, s.word, max(s.p) AS p FROM spot e JOIN spot s ON s.doc_id = e.doc_id AND s.win = e.win AND s.p <= e.p AND s.p > e.p - e.n - {SLOP} GROUP BY 1, 2, 3, 4, 5),
span AS (SELECT doc_id, win, e, min(p) AS s FROM latest JOIN need USING (win) GROUP BY 1, 2, 3 HAVING count(*) = any_value(k)),
small AS (SELECT DISTINCT doc_id, item_id, s, e + 1 AS e FROM (SELECT doc_id, win, s, min(e) AS e FROM span GROUP BY 1, 2, 3) JOIN winno USING (win)),
prox AS (SELECT doc_id, count(DISTINCT (s, e)) AS n_near, string_agg(item_id || ':' || s || ':' || e, ',' ORDER BY item_id, s, e) AS near FROM small GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, coalesce(near, '') AS near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN who USING (doc_id) LEFT JOIN prox USING (doc_id)"""
