"""Bigram language-model scoring of whole texts with sharded Elias-Fano tries.

Tokens are words with A-Z lowered and one end after each text; the end is also the context of
a first word.  With c the counts in the training texts, N all of them and V distinct ones:

    p1(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | v)  = (c(v, w) + m p1(w)) / (c(v) + m)          (c(v) of the end: training texts)

so a pair never seen falls back to p1 times the context's weight m / (c(v) + m).

No table of words or pairs passes through one task or the driver:

1. Texts become segments of bounded size: their distinct words (64-bit hashes) and the tokens
   as places in that list.
2. Each segment sends its words to vocabulary shards (ranges of the hash), which add up the
   counts and send every word's number and count back to the segments.
3. With those, a segment knows p1 and c(v) of all its tokens.  It sends its distinct pairs,
   with training counts and the texts that hold them, to pair shards.  A shard goes by context,
   and a context with more than ``PAIR_TOKENS`` tokens is split by its successors.
4. A pair shard adds up the pairs, builds its trie of quantised log-probabilities, looks up all
   pairs by successor search, and returns partial sums by text to the segments.

Words are told apart by their 64-bit hash (two of 10^9 words collide with probability 0.03).

Defined results: a null text is empty and scores its end alone; null ids are kept; repeated rows are
scored (and learned) each; without training texts every score is 0; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomgrid.llm import words as W
from roomgrid.llm.ngram_trie import Trie

PRIOR = 1000.0              # m
SEGMENT_BYTES = 9 << 20
WORD_ENTRIES = 2_000_000    # words of all segments that a vocabulary shard gets, about
PAIR_TOKENS = 2_000_000     # tokens that a pair shard gets, about
END = np.uint64(0x454E44)   # hash of the end token


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers, each in its smallest type, compressed."""
    import zstandard
    c = zstandard.ZstdCompressor(level=3)
    out = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        kind = "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8"
        body = a.astype(kind)
        # bytes of one place value together: the high ones are nearly constant
        body = body.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
        body = c.compress(body)
        out.append(np.array([len(a), int(kind[2]), len(body)], "<u8").tobytes() + body)
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard
    d = zstandard.ZstdDecompressor()
    out, at = [], 0
    while at < len(blob):
        n, size, length = (int(x) for x in np.frombuffer(blob, "<u8", 3, at))
        body = d.decompress(blob[at + 24:at + 24 + length], max_output_size=n * size or 1)
        a = np.frombuffer(body, np.uint8).reshape(size, n).T.copy().view(f"<u{size}").ravel() if n else np.zeros(0, "<u1")
        out.append(a)
        at += 24 + length
    return out


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, end to end."""
    stop = np.cumsum(lengths)
    return np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - lengths, lengths)


def segments(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()

    def one(ids, train, text, seg) -> pa.RecordBatch:
        parts = [W.Words(text.slice(a, b - a), lower=True) for a, b in W.slices(text)]
        n = np.concatenate([w.count for w in parts]) + 1
        own = np.concatenate([w.hash for w in parts])
        hashes = np.full(int(n.sum()), END, np.uint64)
        word = np.ones(len(hashes), bool)
        word[np.cumsum(n) - 1] = False
        hashes[word] = np.where(own == END, END + np.uint64(1), own)
        vocab, place = np.unique(hashes, return_inverse=True)
        learn = np.repeat(train, n)
        count = np.bincount(place[learn], minlength=len(vocab))
        return pa.RecordBatch.from_arrays(
            [pa.array([seg]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
             pa.array([len(vocab)], pa.int64()), pa.array([len(place)], pa.int64()),
             pa.array([pack(np.diff(vocab, prepend=np.uint64(0)), count)], pa.binary()),
             pa.array([pack(n, train.astype(np.uint8), place)], pa.binary())],
            names=["seg", "ids", "n_words", "n_tokens", "words", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        seg = (context.partitionId() if context else 0) << 32
        held, size = [], 0

        def flush():
            nonlocal seg, held, size
            cols = [pa.concat_arrays([h[k] for h in held]) for k in range(3)]
            held, size = [], 0
            seg += 1
            return one(cols[0], cols[1].to_numpy(zero_copy_only=False).astype(bool), cols[2], seg - 1)

        for batch in batches:
            text = W.as_large_strings(batch.column(2))
            for a, b in W.slices(text, SEGMENT_BYTES):
                part = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), text.slice(a, b - a)]
                part_size = int(np.diff(W.buffers(part[2])[1][[0, -1]])[0])
                if held and size + part_size > SEGMENT_BYTES:
                    yield flush()
                held.append(part)
                size += part_size
        if held:
            yield flush()

    return rows.mapInArrow(run, f"seg long, ids array<{kind}>, n_words long, n_tokens long, words binary, tokens binary")


def vocabulary(segs: DataFrame, shards: int) -> DataFrame:
    """(seg, shard, known): the number and count of each word of each segment, by hash; and one
    row (seg -1) for each shard with its distinct words and their counts' sum."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                gaps, count = unpack(blob)
                h = np.cumsum(gaps.astype(np.uint64))
                shard = shard_of(h, shards)
                cut = np.searchsorted(shard, np.arange(shards + 1))
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array(np.full(len(some), seg)),
                     pa.array([pack(np.diff(h[cut[s]:cut[s + 1]], prepend=np.uint64(0)), count[cut[s]:cut[s + 1]])
                               for s in some], pa.binary())], names=["shard", "seg", "words"])

    def add(key, t):
        shard = key[0].as_py()
        seg = t.column("seg").to_numpy()
        parts = [unpack(b) for b in t.column("words").to_pylist()]
        hashes = [np.cumsum(p[0].astype(np.uint64)) for p in parts]
        sizes = np.array([len(h) for h in hashes])
        distinct, back = np.unique(np.concatenate(hashes), return_inverse=True)
        count = np.bincount(back, weights=np.concatenate([p[1] for p in parts]).astype(np.float64),
                            minlength=len(distinct)).astype(np.int64)
        number = np.zeros(len(distinct), np.int64)     # 0: not in the training texts
        seen = count > 0
        number[seen] = np.arange(seen.sum()) * shards + shard + 1
        stop = np.cumsum(sizes)
        blobs = [pack(number[back[a:b]], count[back[a:b]]) for a, b in zip(stop - sizes, stop)]
        return pa.table({"seg": np.append(seg, -1), "shard": np.full(len(seg) + 1, shard, np.int32),
                         "known": pa.array(blobs + [None], pa.binary()),
                         "distinct": np.append(np.zeros(len(seg), np.int64), seen.sum()),
                         "total": np.append(np.zeros(len(seg), np.int64), count.sum())})

    sent = segs.select("seg", "words").mapInArrow(send, "shard int, seg long, words binary")
    return sent.groupBy("shard").applyInArrow(add, "seg long, shard int, known binary, distinct long, total long")


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Range of the hash, ascending with it."""
    return (((h >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)).astype(np.int64)


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
          prior: float = PRIOR) -> DataFrame:
    """One row for each document: id, train, n_tokens, n_known, train_tokens, base_score, score."""
    kind = docs.schema[id_col].dataType.simpleString()
    segs = segments(docs, id_col, text_col, train).checkpoint()
    size = segs.agg(F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens")).first()
    w_shards = max(1, -(-(size["words"] or 0) // WORD_ENTRIES))
    p_shards = max(1, -(-(size["tokens"] or 0) // PAIR_TOKENS))
    known = vocabulary(segs, w_shards).checkpoint()
    total = known.filter("seg = -1").agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
    n_train, n_distinct = int(total["n"] or 0), int(total["v"] or 0)
    norm = n_train + 0.5 * (n_distinct + 1)

    def pairs(key, s: pa.Table, k: pa.Table) -> pa.Table:
        if s.num_rows == 0:
            return pa.table({"shard": pa.array([], pa.int32()), "seg": pa.array([], pa.int64()),
                             "blob": pa.array([], pa.binary()), "ids": pa.array([], s.schema.field("ids").type)})
        seg = key[0].as_py()
        order = np.argsort(k.column("shard").to_numpy())
        got = [unpack(b) for b in k.column("known").to_pylist()]
        number = np.concatenate([got[i][0] for i in order]).astype(np.int64)
        count = np.concatenate([got[i][1] for i in order]).astype(np.int64)
        n, learn, place = unpack(s.column("tokens")[0].as_py())
        n, learn, place = n.astype(np.int64), learn.astype(bool), place.astype(np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        p1 = np.log10((count + 0.5) / norm)
        end = place[-1]
        before = np.concatenate([[end], place[:-1]])     # each text ends with the end token
        rest = np.log10(prior / (count[before] + prior)) + p1[place]
        ask = (number[before] > 0) & (number[place] > 0)
        base = np.bincount(doc, weights=p1[place], minlength=len(n))
        told = np.bincount(doc[~ask], weights=rest[~ask], minlength=len(n))
        has = np.bincount(doc, weights=count[place] > 0, minlength=len(n))
        shards, blobs = [-1 - seg % p_shards], [pack(n, learn.astype(np.uint8), has.astype(np.int64))
                                                 + base.astype("<f8").tobytes() + told.astype("<f8").tobytes()]
        v, w, d = before[ask], place[ask], doc[ask]
        order = np.lexsort((d, number[w], number[v]))
        v, w, d = v[order], w[order], d[order]
        if len(v):
            first = np.flatnonzero((np.diff(v, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0))
            uses = np.diff(np.append(first, len(v)))
            trained = np.add.reduceat(learn[d].astype(np.int64), first)
            pv, pw = v[first], w[first]
            salts = -(-count[pv] // PAIR_TOKENS)
            salt = (W.mix(number[pw].astype(np.uint64)) % salts.astype(np.uint64)).astype(np.uint64)
            shard = (W.chain(number[pv].astype(np.uint64), salt) % np.uint64(p_shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[by], np.arange(p_shards + 1))
            for s_ in np.flatnonzero(np.diff(cut)):
                at = by[cut[s_]:cut[s_ + 1]]       # still in order of (context, word)
                a, b = number[pv[at]], number[pw[at]]
                head = np.flatnonzero(np.diff(a, prepend=-1))
                texts = d[np.repeat(first[at], uses[at]) + ranges(uses[at])]
                shards.append(int(s_))
                blobs.append(pack(np.diff(a[head], prepend=0), np.diff(np.append(head, len(a))), count[pv[at]][head],
                                  b, count[pw[at]], trained[at], uses[at], texts))
        return pa.table({"shard": pa.array(shards, pa.int32()), "seg": pa.array([seg] * len(shards), pa.int64()),
                         "blob": pa.array(blobs, pa.binary()),
                         "ids": pa.array([s.column("ids")[0].as_py()] + [None] * (len(shards) - 1), s.schema.field("ids").type)})

    def look_up(key, t):
        if key[0].as_py() < 0:       # what a segment sends to itself
            return t.select(["seg", "blob", "ids"])
        seg = t.column("seg").to_numpy()
        parts = [unpack(b) for b in t.column("blob").to_pylist()]
        a, b, cv, cw, c2 = [], [], [], [], []
        for gap, run, n_ctx, word, n_word, trained, _, _ in parts:
            run = run.astype(np.int64)
            a.append(np.repeat(np.cumsum(gap.astype(np.int64)), run))
            cv.append(np.repeat(n_ctx.astype(np.int64), run))
            b.append(word.astype(np.int64))
            cw.append(n_word.astype(np.int64))
            c2.append(trained.astype(np.int64))
        a, b, cv, cw, c2 = (np.concatenate(x) for x in (a, b, cv, cw, c2))
        order = np.lexsort((b, a))
        first = np.flatnonzero((np.diff(a[order], prepend=-1) != 0) | (np.diff(b[order], prepend=-1) != 0))
        both = np.add.reduceat(c2[order], first)
        at, both = order[first][both > 0], both[both > 0]     # pairs of the training texts
        logp = np.log10((both + prior * (cw[at] + 0.5) / norm) / (cv[at] + prior))
        trie = Trie.mapped(Trie.levels(a[at], b[at], logp))
        found = trie.find(a, b)
        rest = np.log10(prior / (cv + prior)) + np.log10((cw + 0.5) / norm)
        value = np.where(np.isnan(found), rest, found)
        blobs, x = [], 0
        for p in parts:
            uses, texts = p[6].astype(np.int64), p[7].astype(np.int64)
            sums = np.bincount(texts, weights=np.repeat(value[x:x + len(uses)], uses))
            has = np.flatnonzero(sums)
            blobs.append(pack(np.diff(has, prepend=0)) + sums[has].astype("<f4").tobytes())
            x += len(uses)
        return pa.table({"seg": seg, "blob": pa.array(blobs, pa.binary()), "ids": pa.nulls(len(seg), t.schema.field("ids").type)})

    def finish(key, t):
        known_ids = t.column("ids").is_valid().to_numpy()
        own = int(np.flatnonzero(known_ids)[0])
        blobs = t.column("blob").to_pylist()
        ids = t.column("ids").combine_chunks()[own].values
        m = len(ids)
        n, learn, has = (x.astype(np.int64) for x in unpack(blobs[own][:-16 * m]))
        base, total = np.frombuffer(blobs[own][-16 * m:], "<f8").reshape(2, m).copy()
        # a fixed order of addition
        for blob in sorted(b for i, b in enumerate(blobs) if i != own):
            n_has = int(np.frombuffer(blob, "<u8", 1)[0])
            at = np.cumsum(unpack(blob[:len(blob) - 4 * n_has])[0].astype(np.int64))
            total[at] += np.frombuffer(blob[len(blob) - 4 * n_has:], "<f4")
        return pa.table({"id": ids, "train": pa.array(learn.astype(bool)), "n_tokens": n, "n_known": has,
                         "train_tokens": np.full(m, n_train), "base_score": base, "score": total})

    sent = segs.select("seg", "ids", "tokens").groupBy("seg").cogroup(
        known.filter("seg >= 0").select("seg", "shard", "known").groupBy("seg")).applyInArrow(
        pairs, f"shard int, seg long, blob binary, ids array<{kind}>")
    back = sent.groupBy("shard").applyInArrow(look_up, f"seg long, blob binary, ids array<{kind}>")
    out = back.groupBy("seg").applyInArrow(
        finish, f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
