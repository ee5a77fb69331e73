"""Exact removal of repeated strings with a distributed, common-prefix-aware merge sort of sampled suffixes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brevia.llm.common import table
from brevia.llm.shingles import mixed

#: Bytes of a beginning by which suffixes are sampled and dealt out.
BEGIN = 16
#: Buckets of suffixes for each shuffle partition.
BUCKETS = 2
#: Bytes of texts that are sampled together.
CHUNK = 1 << 20


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over each window of ``width`` values, by doubling."""
    have, out = 1, values
    while 2 * have <= width:
        out, have = best(out[:-have], out[have:]), 2 * have
    return best(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of runs of texts with CHUNK bytes or one text each."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= CHUNK:
            size, end = size + len(texts[end]), end + 1
        yield at, texts[at:end]
        at = end


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, positions in all texts joined, hashes) of sampled beginnings: those least in some window of ``length`` bytes of a text.

    Last come the least hash of each window, 0 where it isn't in one text, and where the texts begin. Each window holds
    one anchor at least, and equal windows hold the same, so two equal strings of ``length`` bytes are always met at a
    common anchor. On average one in 18 positions is an anchor at 50 bytes.
    """
    width = length - BEGIN + 1
    b = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    if len(b) < length:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64), none, none, ends - sizes
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, 8)).view("<u8").ravel()
    with np.errstate(over="ignore"):
        h = mixed(mixed(eight[: -BEGIN + 8]) * np.uint64(0x9E3779B97F4A7C15) + eight[BEGIN - 8 :])
    least = _sliding(h, width, np.minimum)
    least[np.repeat(ends, sizes)[: len(least)] - np.arange(len(least)) < length] = 0
    pad = np.zeros(width - 1, dtype=np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero(most == h)
    return np.searchsorted(ends, at, "right"), at, h[at], least, ends - sizes


def reach(at: np.ndarray, h: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and from each anchor on that windows reach in which it is the least; these windows follow each other."""
    before, nearest = np.zeros(len(at), np.int64), np.full(len(at), length, np.int64)
    for back in range(length - BEGIN, -1, -1):
        s = at - back
        ok = (s >= 0) & (s < len(least))
        ok[ok] = least[s[ok]] == h[ok]
        before = np.where(ok & (before == 0), back, before)
        nearest = np.where(ok, back, nearest)
    return before, length - nearest


def _rows_at(b: np.ndarray, at: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the bytes before it, last first, and from it on; zeros beyond the text."""
    padded = np.concatenate([np.zeros(left, np.uint8), b, np.zeros(right, np.uint8)])
    around = padded[at[:, None] + np.arange(left + right)]
    return around[:, :left][:, ::-1], around[:, left:]


def _order(columns: np.ndarray, lengths: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Sorts rows of bytes as strings of the given lengths."""
    wide = np.zeros((len(columns), -(-columns.shape[1] // 8) * 8), np.uint8)
    wide[:, : columns.shape[1]] = columns
    keys = [lengths, *wide.view(">u8").T[::-1].astype(np.uint64)]
    return np.lexsort(keys if first is None else [*keys, first])


def _common(columns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before; 0 for the first."""
    if not len(columns):
        return np.zeros(0, dtype=np.int64)
    differ = columns[1:] != columns[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), columns.shape[1])
    return np.r_[0, np.minimum(shared, np.minimum(lengths[1:], lengths[:-1]))]


def front_coded(rows: np.ndarray, lengths: np.ndarray, common: np.ndarray) -> bytes:
    """What each row of a sorted run adds to the prefix shared with the row before."""
    at = np.arange(rows.shape[1])
    return rows[(at >= common[:, None]) & (at < lengths[:, None])].tobytes()


def from_front_coded(tails: bytes, lengths: np.ndarray, common: np.ndarray, width: int) -> np.ndarray:
    """Rows of a run again: each byte comes from the last row whose own part reaches it."""
    at, n = np.arange(width), len(lengths)
    own = (at >= common[:, None]) & (at < lengths[:, None])
    out = np.zeros((n, width), np.uint8)
    out[own] = np.frombuffer(tails, np.uint8)
    source = np.maximum.accumulate(np.where(at >= common[:, None], np.arange(n)[:, None], 0), axis=0)
    return np.where(at < lengths[:, None], np.take_along_axis(out, source, axis=0), 0).astype(np.uint8)


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs, each (strings, common prefix with the string before); returns runs, indexes, common prefixes.

    A loser tree whose nodes know how long a prefix their loser shares with the last winner. Of two strings compared
    with that same winner, the one that shares more with it is smaller, and bytes are looked at only from where both
    are known to agree, so no byte of a known prefix is compared again. Equal strings come out in order of runs.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    heads: list[bytes | None] = [r[0][0] if i < len(runs) and (r := runs[i])[0] else None for i in range(k)]
    at, shares = [0] * k, [0] * k
    losers = [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether a's head goes first; the loser's share becomes the prefix it has in common with the winner."""
        x, y = heads[a], heads[b]
        if y is None or x is None:
            return y is None and (x is not None or a < b)
        p, q = shares[a], shares[b]
        if p != q:
            if p > q:
                return True
            return False
        n = min(len(x), len(y))
        while p < n and x[p] == y[p]:
            p += 1
        if p == n:
            first = (len(x), a) < (len(y), b)
        else:
            first = x[p] < y[p]
        shares[b if first else a] = p
        return first

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        won = a if beats(a, b) else b
        losers[node] = b if won == a else a
        return won

    winner = play(1)
    out_run, out_at, out_common = [], [], []
    while heads[winner] is not None:
        out_run.append(winner)
        out_at.append(at[winner])
        out_common.append(shares[winner])
        strings, common = runs[winner]
        at[winner] = i = at[winner] + 1
        if i < len(strings):
            heads[winner], shares[winner] = strings[i], common[i]
        else:
            heads[winner] = None
        node = (winner + k) >> 1
        while node:
            other = losers[node]
            if not beats(winner, other):
                losers[node], winner = winner, other
            node >>= 1
    return out_run, out_at, out_common


_RUN = (
    "bucket int, lengths binary, common binary, tails binary, counts binary, doc binary, pos binary, left_len binary, lefts binary, ids binary, tids binary, "
    "span_ids binary, span_tids binary, span_starts binary, span_sizes binary"
)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers that aren't negative, in as few bytes each as the largest needs."""
    kind = next(k for k in "1248" if not len(numbers) or int(numbers.max()) < 1 << 8 * int(k))
    return kind.encode() + zlib.compress(numbers.astype(f"<u{kind}").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{chr(data[0])}").astype(np.int64)


def _tid(data: bytes, rows: int) -> int:
    """Tells the texts of an id on several rows apart."""
    return xxhash.xxh3_64_intdigest(data) & 0x7FFFFFFFFFFFFFFF if rows > 1 else 0


def _ids_packed(ids: np.ndarray) -> bytes:
    """Sorted ids as the first and the steps from each to the next."""
    return int(ids[0]).to_bytes(8, "little", signed=True) + packed(np.diff(ids).astype(np.uint64))


def _ids_unpacked(data: bytes) -> np.ndarray:
    return np.r_[0, np.cumsum(unpacked(data[8:]))] + int.from_bytes(data[:8], "little", signed=True)


def _doubles(key: np.ndarray, ids: np.ndarray, same=None) -> np.ndarray:
    """Which rows have an equal key, and then are the ``same`` too, on a row with a smaller id."""
    order = np.lexsort([ids, key])
    alike = key[order[1:]] == key[order[:-1]]
    if same is not None:
        alike[alike] = same(order[1:][alike], order[:-1][alike])
    first = np.maximum.accumulate(np.where(np.r_[False, alike], 0, np.arange(len(order))))
    out = np.zeros(len(order), dtype=bool)
    out[order] = ids[order] > ids[order][first]
    return out


def _hashed(rows: np.ndarray, seed: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    out = mixed(seed)
    with np.errstate(over="ignore"):
        for column in wide.view("<u8").T:
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def sorted_runs(batch: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    """A front-coded sorted run for each bucket of the batch's shared anchors; equal suffixes are one entry with several occurrences.

    An occurrence whose bytes on both sides, as far as they matter, also are in a document of the batch with a smaller id is known to be
    a repeat and isn't sent, only the span that it covers.
    """
    left = length - BEGIN
    docs, places, befores, afters, lens, lefts, hashes = [], [], [], [], [], [], []
    ids, tids = batch["id"].to_numpy(np.int64), np.zeros(len(batch), np.int64)
    texts = [t.encode() for t in batch["text"]]
    keys, rows = batch["keys"].tolist(), batch["rows"].tolist()
    for i, (data, count) in enumerate(zip(texts, rows, strict=True)):
        tids[i] = _tid(data, count)
    named = lambda h, doc: mixed(h ^ mixed(doc.astype(np.uint64) + np.uint64(1)))
    for start, some in chunks(texts):
        doc, at, h, least, begins = anchors(some, length)
        sought = [np.asarray(keys[start + i], dtype=np.int64) for i in range(len(some))]
        sought = named(np.concatenate(sought).view(np.uint64), np.repeat(np.arange(len(some)), [len(x) for x in sought]))
        keep = np.isin(named(h, doc), sought)
        doc, at, h = doc[keep], at[keep], h[keep]
        n_before, n_after = reach(at, h, least, length)
        before, after = _rows_at(np.frombuffer(b"".join(some), np.uint8), at, left, length)
        docs.append(doc + start)
        places.append(at - begins[doc])
        befores.append(np.where(np.arange(left) < n_before[:, None], before, 0).astype(np.uint8))
        afters.append(np.where(np.arange(length) < n_after[:, None], after, 0).astype(np.uint8))
        lens.append(n_after)
        lefts.append(n_before)
        hashes.append(h)
    columns = _RUN.replace(" int", "").replace(" binary", "").split(", ")
    if not docs or not sum(map(len, docs)):
        return pd.DataFrame({c: pd.Series([], dtype="int32" if c == "bucket" else object) for c in columns})
    doc, pos, before, after, size, n_left, h = (np.concatenate(x) for x in (docs, places, befores, afters, lens, lefts, hashes))
    key = _hashed(before, _hashed(after, h ^ (size * 64 + n_left).astype(np.uint64)))
    alike = lambda x, y: (before[x] == before[y]).all(1) & (after[x] == after[y]).all(1) & (size[x] == size[y]) & (n_left[x] == n_left[y])
    known = _doubles(key, ids[doc], alike)
    spans = merged_spans(ids[doc[known]], tids[doc[known]], pos[known] - n_left[known], pos[known] + size[known])
    doc, pos, before, after, size, n_left, h = (x[~known] for x in (doc, pos, before, after, size, n_left, h))
    bucket = (h >> np.uint64(20)) % np.uint64(buckets)
    order = _order(after, size, bucket)
    doc, pos, before, after, size, n_left, bucket = (x[order] for x in (doc, pos, before, after, size, n_left, bucket))
    own = np.arange(left) < n_left[:, None]
    common = _common(after, size)
    fresh_bucket = np.r_[True, bucket[1:] != bucket[:-1]]
    same = ~fresh_bucket & (common == size) & np.r_[False, size[1:] == size[:-1]]
    common[fresh_bucket] = 0
    heads = np.flatnonzero(~same)
    counts = np.diff(np.r_[heads, len(doc)])
    out = []
    starts = np.flatnonzero(fresh_bucket)
    for s, e in zip(starts, np.r_[starts[1:], len(doc)], strict=True):
        mine = (heads >= s) & (heads < e)
        hs = heads[mine]
        used, index = np.unique(doc[s:e], return_inverse=True)
        order = np.argsort(ids[used], kind="stable")
        index = np.argsort(order, kind="stable")[index]
        out.append((
            int(bucket[s]), packed(size[hs]), packed(common[hs]), zlib.compress(front_coded(after[hs], size[hs], common[hs]), 1),
            packed(counts[mine]), packed(index), packed(pos[s:e]), packed(n_left[s:e]),
            zlib.compress(before[s:e][own[s:e]].tobytes(), 1), _ids_packed(ids[used][order]), packed(tids[used][order]), b"", b"", b"", b"",
        ))
    if len(spans):  # travels with any of the runs
        some = int(ids[0]) % len(out)
        size = (spans["end"] - spans["start"]).to_numpy()
        out[some] = (*out[some][:-4], _ids_packed(spans["id"].to_numpy()), packed(spans["tid"].to_numpy()), packed(spans["start"].to_numpy()), packed(size))
    return pd.DataFrame(out, columns=columns)


def repeats_in_bucket(runs: pd.DataFrame, length: int) -> pd.DataFrame:
    """Merge a bucket's runs and report (id, tid, start, end) of strings that also start in a document with a smaller id."""
    left = length - BEGIN
    lists, offsets, occurrence, total, ready = [], [], [], 0, []
    parts: dict[str, list[np.ndarray]] = {c: [] for c in ("id", "tid", "pos", "left_len", "lefts")}
    for r in runs.itertuples():
        size, common = unpacked(r.lengths), unpacked(r.common)
        rows = from_front_coded(zlib.decompress(r.tails), size, common, length)
        if r.span_ids:
            start = unpacked(r.span_starts)
            ready.append((_ids_unpacked(r.span_ids), unpacked(r.span_tids), start, start + unpacked(r.span_sizes)))
        lists.append(([rows[i, : size[i]].tobytes() for i in range(len(size))], common.tolist()))
        counts = unpacked(r.counts)
        offsets.append(total + np.r_[0, np.cumsum(counts)])
        total += int(counts.sum())
        doc, n_left = unpacked(r.doc), unpacked(r.left_len)
        lefts = np.zeros((len(doc), left), np.uint8)
        lefts[np.arange(left) < n_left[:, None]] = np.frombuffer(zlib.decompress(r.lefts), np.uint8)
        for c, x in zip(parts, (_ids_unpacked(r.ids)[doc], unpacked(r.tids)[doc], unpacked(r.pos), n_left, lefts), strict=True):
            parts[c].append(x)
    run, at, common = merge_runs(lists)
    spans = [(offsets[r][i], offsets[r][i + 1]) for r, i in zip(run, at, strict=True)]
    occurrence = np.concatenate([np.arange(s, e) for s, e in spans]) if spans else np.zeros(0, np.int64)
    n_each = np.array([e - s for s, e in spans], dtype=np.int64)
    size = np.repeat([len(lists[r][0][i]) for r, i in zip(run, at, strict=True)], n_each).astype(np.int64)
    # occurrences of one entry share the whole suffix; the first of an entry shares what the merge found
    shared = size.copy()
    if len(n_each):
        shared[np.r_[0, np.cumsum(n_each)[:-1]]] = common
    ids, tid, pos, n_left, lefts = (np.concatenate(parts[c])[occurrence] for c in ("id", "tid", "pos", "left_len", "lefts"))
    by_left = _order(lefts, n_left)
    shared_left = _common(lefts[by_left], n_left[by_left])
    # an occurrence with the same bytes on both sides as one with a smaller id is a repeat as far as they reach
    suffix = np.cumsum((shared < size) | np.r_[True, size[1:] != size[:-1]])
    prefix = np.empty(len(ids), np.int64)
    prefix[by_left] = np.cumsum((shared_left < n_left[by_left]) | np.r_[True, n_left[by_left][1:] != n_left[by_left][:-1]])
    known = _doubles(suffix * (len(ids) + 1) + prefix, ids)
    spans = [(ids[known], tid[known], pos[known] - n_left[known], pos[known] + size[known]), *ready]
    for back in range(left + 1):
        ahead = length - back
        ok = np.flatnonzero((n_left >= back) & (size >= ahead) & ~known)
        if len(ok) < 2:
            continue
        right_class = np.cumsum(shared < ahead)
        left_class = np.empty(len(ids), np.int64)
        left_class[by_left] = np.cumsum(shared_left < back)
        key = right_class[ok] * (len(ids) + 1) + left_class[ok]
        order = np.argsort(key)
        key, mine = key[order], ok[order]
        first = np.r_[True, key[1:] != key[:-1]]
        least = np.minimum.reduceat(ids[mine], np.flatnonzero(first))[np.cumsum(first) - 1]
        hit = mine[ids[mine] > least]
        spans.append((ids[hit], tid[hit], pos[hit] - back, pos[hit] - back + length))
    return merged_spans(*(np.concatenate(x) for x in zip(*spans, strict=True)))


def merged_spans(ids: np.ndarray, tid: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Unions of overlapping or touching spans of each text."""
    order = np.lexsort([start, tid, ids])
    ids, tid, start, end = ids[order], tid[order], start[order], end[order]
    if not len(ids):
        return pd.DataFrame({"id": ids, "tid": tid, "start": start, "end": end})
    new_doc = np.r_[True, (ids[1:] != ids[:-1]) | (tid[1:] != tid[:-1])]
    shift = np.cumsum(new_doc) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    fresh = np.r_[True, (start + shift)[1:] > reach[:-1]]
    at = np.flatnonzero(fresh)
    last = np.r_[at[1:] - 1, len(ids) - 1]
    return pd.DataFrame({"id": ids[at], "tid": tid[at], "start": start[at], "end": (reach - shift)[last]})


def repeated_spans(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", out: str = "spans") -> DataFrame:
    """Rows (id, text, ``out``): per document the sorted disjoint byte spans that repeated strings cover.

    A byte is covered if it lies in a string of ``length`` bytes of the UTF-8 text that also starts in a document with a
    smaller id; strings lie in one document and are judged on the input. Touching spans are one.

    Only suffixes at anchors are sorted, one in 18 or so, and of these only such whose first BEGIN bytes occur in two
    documents; any two equal strings share an anchor, and how far the match reaches to its left is settled by sorting
    what lies there. Tasks send each other front-coded sorted runs, dealt by a hash of those first bytes, as only
    suffixes that agree in them matter to each other; each receiver merges its runs with a loser tree. Of occurrences with the
    same bytes on both sides a task sends those of the least id only, so that a passage of many documents is one occurrence a task.

    A null text is empty. Rows with a null id neither lose bytes nor cause it. An id on several rows stands for
    documents of equal rank, which lose nothing to each other. Other columns aren't looked at; an empty table
    gives an empty result. Ids are integers.
    """
    if length < BEGIN + 8:
        raise ValueError(f"length must be {BEGIN + 8} or more")
    spark = docs.sparkSession
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # by id once; both joins below read the same exchange
    counted = d.filter("id is not null").withColumn("rows", F.count("*").over(Window.partitionBy("id")))

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, texts = [], [t.encode() for t in b["text"]]
            for _, some in chunks(texts):
                doc, _, h, _, _ = anchors(some, length)
                order = np.lexsort([h, doc])
                doc, h = doc[order], h[order]
                fresh = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
                found += np.split(h[fresh].view(np.int64), np.searchsorted(doc[fresh], np.arange(1, len(some))))
            yield pd.DataFrame({"id": b["id"].to_numpy(), "keys": pd.Series(found, dtype=object)})

    keyed = d.filter("id is not null").mapInPandas(sample, "id long, keys array<long>").select("id", F.explode("keys").alias("key"))
    same = Window.partitionBy("key")
    keyed = keyed.withColumns({"low": F.min("id").over(same), "high": F.max("id").over(same)}).filter("low < high")
    wanted = keyed.groupBy("id").agg(F.collect_set("key").alias("keys"))

    def runs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield sorted_runs(b, length, buckets)

    runs = counted.join(wanted, "id").select("id", "text", "rows", "keys").mapInPandas(runs_of, _RUN)
    found = runs.groupBy("bucket").applyInPandas(lambda r: repeats_in_bucket(r, length), 'id long, tid long, start long, `end` long')
    spans = found.groupBy("id").agg(F.collect_list(F.struct("tid", "start", "end")).alias("found"))

    kind = "array<struct<start:long,`end`:long>>"

    @F.pandas_udf(kind)
    def own(texts: pd.Series, founds: pd.Series) -> pd.Series:
        rows = []
        for text, found in zip(texts, founds, strict=True):
            tid, mine = _tid(text.encode(), 2) if text is not None else 0, []
            for start, end in sorted((x["start"], x["end"]) for x in found if x["tid"] == tid) if found is not None else ():
                if mine and start <= mine[-1]["end"]:
                    mine[-1]["end"] = max(end, mine[-1]["end"])
                else:
                    mine.append({"start": start, "end": end})
            rows.append(mine)
        return pd.Series(rows, dtype=object)

    done = counted.join(spans, "id", "left").select("id", "text", own(F.when(F.col("rows") > 1, F.col("text")), "found").alias(out))
    # rows without an id don't meet on their null
    return done.union(d.filter("id is null").select("id", "text", F.array().cast(kind).alias(out)))


def cut_spans(data: bytes, spans) -> bytes:
    """The bytes outside of sorted disjoint spans."""
    out, at = [], 0
    for x in spans:
        out.append(data[at : x["start"]])
        at = x["end"]
    return b"".join([*out, data[at:]])


def span_digest(text: str, spans: str) -> Column:
    """Struct (n_bytes, n_removed, n_spans, kept_sha256) of a text column and its spans."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def of(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for t, x in zip(texts, found, strict=True):
            data = t.encode()
            kept = cut_spans(data, x)
            rows.append((len(data), len(data) - len(kept), len(x), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return of(text, spans)


def without_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text) with covered bytes cut out; a character cut in part becomes U+FFFD."""

    @F.pandas_udf("string")
    def rest(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_spans(t.encode(), x).decode("utf-8", "replace") if len(x) else t for t, x in zip(texts, spans, strict=True)], dtype=object)

    return repeated_spans(docs, length, id_col, text_col).select("id", rest("text", "spans").alias("text"))


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row; a null text is empty, a row with a null id loses nothing, and rows of one id are no smaller ids to each other."""
    d = repeated_spans(table(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), span_digest("text", "spans").alias("x")).select("doc_id", "x.*")
