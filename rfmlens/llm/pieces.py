"""SentencePiece BPE: encoding by vectorised merge rounds, and decoding.

A text is cut into runs that no merge crosses: a run is some word-start marks and the characters up to the next
one, and a line feed stands alone where the model never joins it to a neighbour. The distinct runs of a block of
text are encoded together: all their symbols lie in one flat array, each round takes the smallest pair
rank of every run (leftmost on a tie) by a segmented minimum, replaces these pairs all at once, compacts
the array and drops the runs in which no pair is left. This is the library's order of merges, as each run sees
its own best pair in each round. Runs of over ``LONG`` characters merge from a heap instead, since they would need as
many rounds as merges. Encoded runs are kept in a bounded cache per task.

Models: BPE with byte fallback, identity normalisation and a dummy prefix, without user-defined or unused pieces;
others raise ``ValueError``.

Cases: a null or empty text has the begin and end ids alone and decodes to nothing; null or repeated ids are
kept, a row each; long texts are hashed piece by piece; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
LONG = 512
BLOCK_CHARS = 1 << 20
CACHE_RUNS = 250_000
NONE = np.int64(1) << 62
PLACE = np.int64((1 << 32) - 1)
NOTHING = 1 << 30


def model_bytes(path: str | None = None) -> bytes:
    """The model file; without a path, the 32k BPE model of the installed public tokenizers."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


class Pieces:
    """The tables of one model."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2
        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(model)
        norm, train = m.normalizer_spec, m.trainer_spec
        kinds = {p.type for p in m.pieces}
        if (train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix
                or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not kinds <= {1, 2, 3, 6}
                or train.treat_whitespace_as_suffix):
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix")
        self.n = len(m.pieces)
        self.bos, self.eos, self.unk = train.bos_id, train.eos_id, train.unk_id
        self.kind = np.array([p.type for p in m.pieces], np.int8)
        ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        self.byte_ids = np.zeros(256, np.int32)
        self.raw: list[bytes] = []
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.raw.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.raw.append({1: p.piece.replace(MARK, " "), 2: train.unk_surface}.get(p.type, "").encode())
        self.raw_size = np.array([len(x) for x in self.raw], np.int64)
        chars = {c for p in ids for c in p}
        if any(c not in ids for c in chars) or any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a character of the pieces isn't a piece, or a word-start mark is inside one")
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.n
        for c in chars:
            self.symbol[ord(c)] = ids[c]
        self.symbol[ord(" ")] = ids[MARK]
        ranks = {s: r for r, s in enumerate(sorted({m.pieces[i].score for i in ids.values()}, reverse=True))}
        pairs = sorted((ids[p[:k]] * self.n + ids[p[k:]], ranks[m.pieces[i].score], i)
                       for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.pair, self.rank, self.merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.lines = not any("\n" in p and len(p) > 1 for p in ids)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair, -1 where it doesn't merge."""
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (left < self.n) & (right < self.n), at, -1)

    def runs(self, text: str) -> list[str]:
        """The runs of a marked text (spaces stand for the mark)."""
        if "  " in text or "\x01" in text:
            return re.findall(r" +[^ \n]*|\n|[^ \n]+" if self.lines else r" +[^ ]*|[^ ]+", text)
        text = text.replace(" ", "\x01 ")
        if self.lines:
            text = text.replace("\n", "\x01\n\x01")
        return text.split("\x01")

    def merge(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all runs after all merges, one after the other, and how many each run has.

        Symbols from ``n`` on are characters outside the model.
        """
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        sym = self.symbol[np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)].astype(np.int64)
        run = np.repeat(np.arange(len(runs)), size)
        alive = np.ones(len(sym), bool)
        own = np.flatnonzero(size[run] <= LONG)  # places in sym of the symbols at work
        begins = np.cumsum(size) - size
        for k in np.flatnonzero(size > LONG).tolist():
            at, n = int(begins[k]), int(size[k])
            got = self._long(runs[k])
            sym[at:at + len(got)], alive[at + len(got):at + n] = got, False
        s, r, key, into = sym[own], run[own], None, None
        while len(own):
            n = len(own)
            place = np.arange(n)
            starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            first, last = np.zeros(n, bool), np.zeros(n, bool)
            first[starts], last[np.append(starts[1:], n) - 1] = True, True
            after, before = np.append(np.where(last, n, place + 1), n), np.append(np.where(first, n, place - 1), n)
            s, live = np.append(s, NOTHING), np.append(np.ones(n, bool), False)
            if key is None:
                key, into = np.full(n + 1, NONE), np.zeros(n + 1, np.int64)
                self._fill(place, s, after, key, into)
            else:
                key = np.append(np.where(key < NONE, (key & ~PLACE) | place, NONE), NONE)
                into = np.append(into, 0)
            words = len(starts)
            while True:
                best = np.minimum.reduceat(key[:n], starts)
                pos = best[best < NONE] & PLACE
                if 2 * len(pos) < words or not words:
                    break
                s[pos] = into[pos]
                gone = after[pos]
                after[pos] = then = after[gone]
                before[then] = pos
                live[gone], key[gone] = False, NONE
                self._fill(pos, s, after, key, into)
                prior = before[pos]
                self._fill(prior[prior < n], s, after, key, into)
            sym[own], alive[own] = s[:n], live[:n]
            open_runs = np.repeat(best < NONE, np.diff(np.append(starts, n))) & live[:n]
            own, s, r, key, into = own[open_runs], s[:n][open_runs], r[open_runs], key[:n][open_runs], into[:n][open_runs]
        return sym[alive], np.bincount(run[alive], minlength=len(runs))

    def _fill(self, at: np.ndarray, s: np.ndarray, after: np.ndarray, key: np.ndarray, into: np.ndarray) -> None:
        """The pair that begins at each place: its rank above the place, and what it merges into."""
        x = self.look(s[at], s[after[at]])
        key[at] = np.where(x >= 0, self.rank[x] << 32 | at, NONE)
        into[at] = self.merged[x]

    def _long(self, text: str) -> np.ndarray:
        """One long run, merged from a heap of its pairs."""
        sym = self.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
        n = len(sym)
        at = self.look(sym[:-1], sym[1:])
        heap = [(int(self.rank[a]), i, int(sym[i]), int(sym[i + 1]), int(self.merged[a]))
                for i, a in zip(np.flatnonzero(at >= 0).tolist(), at[at >= 0].tolist(), strict=True)]
        heapq.heapify(heap)
        s, after, before = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        table = self._table()
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i] if s[i] == a else n
            if j >= n or s[j] != b:
                continue
            s[i], s[j] = m, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := table.get((m, s[k]))) is not None:
                    heapq.heappush(heap, (x[0], i, m, s[k], x[1]))
            if (p := before[i]) >= 0 and (x := table.get((s[p], m))) is not None:
                heapq.heappush(heap, (x[0], p, s[p], m, x[1]))
        return np.array([x for x in s if x >= 0], np.int32)

    @functools.cache  # noqa: B019 -- one object per model and task
    def _table(self) -> dict[tuple[int, int], tuple[int, int]]:
        return {divmod(k, self.n): (r, m) for k, r, m in
                zip(self.pair.tolist(), self.rank.tolist(), self.merged.tolist(), strict=True)}

    def spell(self, ids: Iterable[int]) -> bytes:
        """Pieces of ids put together; byte pieces that aren't UTF-8 become U+FFFD, one for each byte."""
        ids = list(ids)
        out = b"".join([self.raw[i] for i in ids])
        try:
            out.decode()
            return out
        except UnicodeDecodeError:
            parts, k = [], 0
            while k < len(ids):
                if self.kind[ids[k]] != 6:
                    parts.append(self.raw[ids[k]])
                    k += 1
                    continue
                e = k
                while e < len(ids) and self.kind[ids[e]] == 6:
                    e += 1
                data = b"".join(self.raw[i] for i in ids[k:e])
                k, b = e, 0
                while b < len(data):
                    for w in (1, 2, 3, 4):
                        try:
                            parts.append(data[b:b + w].decode().encode())
                            b += w
                            break
                        except UnicodeDecodeError:
                            continue
                    else:
                        parts.append("�".encode())
                        b += 1
            return b"".join(parts)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: control ids vanish and the dummy prefix goes."""
        ids = [i for i in ids if self.kind[i] != 3]
        out = self.spell(ids)
        first = ids[0] if ids else None
        return (out[1:] if first is not None and self.raw[first][:1] == b" " and self.kind[first] == 1 else out).decode()


@functools.lru_cache(1)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)


def _cut(text: str) -> Iterator[str]:
    """The text in blocks that end before a word start."""
    at = 0
    while len(text) - at > 2 * BLOCK_CHARS:
        end = at + BLOCK_CHARS
        m = re.compile(r"(?<! ) ").search(text, end)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


class Coder:
    """Encodes and decodes texts with a cache of runs: run -> (ids as bytes, decoded bytes)."""

    def __init__(self, model: bytes):
        self.p = pieces(model)
        self.cache: dict[str, tuple[bytes, bytes]] = {"": (b"", b"")}

    def learn(self, blocks: list[list[str]]) -> None:
        if len(self.cache) > CACHE_RUNS:
            self.cache = {"": (b"", b"")}
        cache, p = self.cache, self.p
        new = list({r for b in blocks for r in b if r not in cache})
        if not new:
            return
        sym, count = p.merge(new)
        odd = np.flatnonzero(sym >= p.n)
        if len(odd):  # characters outside the model become the ids of their bytes
            raw = [chr(x).encode() for x in (sym[odd] - p.n).tolist()]
            more = np.ones(len(sym), np.int64)
            more[odd] = [len(x) for x in raw]
            of = np.repeat(np.arange(len(new)), count)
            is_byte = np.repeat(sym >= p.n, more)
            sym, of = np.repeat(sym, more), np.repeat(of, more)
            sym[is_byte] = p.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            count = np.bincount(of, minlength=len(new))
        ids = sym.astype("<u4").tobytes()
        text = b"".join([p.raw[i] for i in sym.tolist()])
        ends = np.cumsum(count)
        text_ends = np.append(0, np.cumsum(p.raw_size[sym]))[ends]
        a = x = 0
        for r, b, y in zip(new, (4 * ends).tolist(), text_ends.tolist(), strict=True):
            cache[r] = ids[a:b], text[x:y]  # a run has whole characters, so its byte pieces are UTF-8
            a, x = b, y

    def code(self, texts: list[str | None]) -> Iterator[tuple[int, str, str, bytes, bytes]]:
        """For each text: number of ids, digests of ids and decoded text, the ids and the decoded text."""
        begin, end = (np.array([x], "<u4").tobytes() for x in (self.p.bos, self.p.eos))
        group: list[list[str]] = []
        blocks = [(k, b) for k, t in enumerate(texts) for b in _cut(" " + t.replace(MARK, " ") if t else "")]
        got: dict[int, list[tuple[bytes, bytes]]] = {}
        size, held = 0, []
        for j, (k, b) in enumerate(blocks):
            group.append(self.p.runs(b))
            held.append(k)
            size += len(b)
            if size > BLOCK_CHARS or j == len(blocks) - 1:
                self.learn(group)
                c = self.cache
                for d, runs in zip(held, group, strict=True):
                    found = [c[r] for r in runs]
                    got.setdefault(d, []).append((b"".join([x[0] for x in found]), b"".join([x[1] for x in found])))
                group, held, size = [], [], 0
        for k in range(len(texts)):
            ids = begin + b"".join([x[0] for x in got.get(k, ())]) + end
            text = b"".join([x[1] for x in got.pop(k, ())])[1:]
            yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest(), ids, text


@functools.lru_cache(1)
def _coder(model: bytes) -> Coder:
    """One cache for the tasks that a Python worker runs one after the other."""
    return Coder(model)


def code_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text",
                   more: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and of ``ids`` and ``decoded`` (the text) those that ``more`` names."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(told.value)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 256)
                at += 256
                n, ids, text, raw, out = zip(*coder.code(part.column("text").to_pylist()), strict=True)
                cols = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids),
                        "decoded_sha256": pa.array(text)}
                if "ids" in more:
                    ends = np.cumsum([0, *n]).astype(np.int32)
                    cols["ids"] = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(raw), "<i4"))
                if "decoded" in more:
                    cols["decoded"] = pa.array([x.decode() for x in out], pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    kinds = {"ids": "array<int>", "decoded": "string"}
    return rows.mapInArrow(run, schema + "".join(f", {c} {t}" for c, t in kinds.items() if c in more))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    return code_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_bytes())
