"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to its frequencies.

Every task splits whole texts into pre-tokens, and turns a chunk of documents into one row per bucket of distinct pre-tokens, with the
documents of the chunk that hold each one and how often.  The rows are dealt by bucket; there each distinct pre-token is
counted once by the tokenizers library, joined to its entries, and the products are summed per document.  Pre-tokens that fill a good part
of a chunk are dealt over several salts, so that no frequent word lands in one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Documents of a chunk at most, and entries after which one ends early.
CHUNK, PAIRS = 8192, 2_000_000
#: Entries of a pre-token in a chunk from which it is salted, the salts, and the buckets that pre-tokens are hashed into (tasks that can share the work).
FREQUENT, SALTS, BUCKETS = 256, 16, 2048
#: Words whose pre-tokens, and pre-tokens whose pieces, are remembered at once.
MEMORY = 500_000
# The pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRE = regex.compile(PATTERN)
#: Texts with other white space than single blanks and single line ends go through the pattern as a whole.
_ODD = regex.compile(r"\s\s|[^\S \n]|^\s|\s$|[\x1c-\x1f]|[^\x00-ԯ]")


class PreTokenizer:
    """Turns texts into numbers of pre-tokens; words seen before are not matched again."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.library = tokenizer.pre_tokenizer
        self.forget()

    def forget(self) -> None:
        self.tokens: list[str] = []
        self.bucket: list[int] = []
        self.number: dict[str, int] = {}
        self.words: dict[str, list[int]] = {}

    def _of(self, token: str) -> int:
        n = self.number.get(token)
        if n is None:
            n = self.number[token] = len(self.tokens)
            self.tokens.append(token)
            self.bucket.append(zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS)
        return n

    def _pieces(self, word: str) -> list[int]:
        got = self.words.get(word)
        if got is None:
            got = self.words[word] = [self._of(p) for p in _PRE.findall(word)]
        return got

    def add(self, text: str, tokens: list[int], counts: list[int]) -> None:
        """Append the pre-tokens of a text and how often each is there; one may come more than once."""
        for part in self.cut.split(text) if self.cut and any([x in text for x in self.special]) else [text]:
            if part in self.special:
                tokens.append(self._of(part))
                counts.append(1)
            elif _ODD.search(part) is None:
                lines = part.split("\n")
                if len(lines) > 1:
                    tokens.append(self._of("\n"))
                    counts.append(len(lines) - 1)
                words: Counter = Counter()
                for line in lines:
                    first, *rest = line.split(" ")
                    found = self._pieces(first)
                    tokens += found
                    counts += [1] * len(found)
                    words.update(rest)
                known = self.words.get
                for w, n in words.items():
                    w = " " + w
                    found = known(w)
                    if found is None:
                        found = self._pieces(w)
                    tokens += found
                    counts += [n] * len(found)
            else:  # the library's own matcher, with its Unicode tables
                for p, n in Counter([part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)]).items():
                    tokens.append(self._of(p))
                    counts.append(n)


_tokenizers: dict[str, Tokenizer] = {}


def _tokenizer(path) -> Tokenizer:
    """Loaded once in each Python worker."""
    path = path() if callable(path) else path
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _name(ids: list) -> int:
    """A chunk's name: its partition and its documents decide, so a task that runs again gives the same."""
    return int.from_bytes(hashlib.blake2b(repr(ids).encode(), digest_size=7).digest(), "big")


def _posts(tokens: list[int], counts: list[int], lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens, where each one's entries end, and the entries: thirteen bits say where, three how often; more often takes more entries."""
    key = np.array(tokens, np.int64) << 13 | np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.add.reduceat(np.array(counts, np.int64)[order], first) if len(first) else np.zeros(0, np.int64)
    key = key[first]
    entries = -(-n // 7)
    which = np.repeat(np.arange(len(key)), entries)
    often = np.full(len(which), 7)
    often[np.cumsum(entries) - 1] = n - 7 * (entries - 1)
    flat = ((key[which] & 8191) << 3 | often).astype(np.uint16).view(np.int16)
    token = key[which] >> 13
    start = np.flatnonzero(np.diff(token, prepend=-1))
    return token[start], np.append(start, len(token)), flat


def _frequencies(path):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = PreTokenizer(_tokenizer(path))
        names = ["bucket", "chunk", "tokens", "sizes", "posts", "ids", "bytes"]
        longs, texts, ints = pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32())
        tokens: list[int] = []
        counts: list[int] = []
        lengths: list[int] = []
        ids: list = []
        sizes: list[int] = []

        def chunk(serial: int) -> Iterator[pa.RecordBatch]:
            """A row with the chunk's documents, then one per bucket: its pre-tokens, how many entries each has, and the entries."""
            name = _name([TaskContext.get().partitionId(), serial, ids, sizes])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name % BUCKETS], pa.int32()), pa.array([name], pa.int64()), pa.array([[]], texts), pa.array([[]], ints), pa.array([b""], pa.binary()), pa.array([ids], longs), pa.array([sizes], longs)],
                names=names,
            )
            token, ends, flat = _posts(tokens, counts, lengths)
            n = np.diff(ends)
            bucket = np.array(pre.bucket, np.int64)[token] if len(token) else np.zeros(0, np.int64)
            bucket = np.where(n > FREQUENT, (bucket + name % SALTS * 131) % BUCKETS, bucket)
            order = np.argsort(bucket, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
            rows: list[tuple] = []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = order[i:j]
                posts = np.concatenate([flat[ends[k] : ends[k + 1]] for k in own.tolist()]).tobytes()
                rows.append((int(bucket[own[0]]), name, [pre.tokens[t] for t in token[own].tolist()], n[own].astype(np.int32), posts))
            for i in range(0, len(rows), 256):
                columns = list(zip(*rows[i : i + 256], strict=True))
                none = pa.nulls(len(columns[0]), longs)
                yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), texts, ints, pa.binary()), strict=True)], none, none], names=names)

        serial = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids.append(i)
                sizes.append(len(text) if text.isascii() else len(text.encode("utf-8")))
                before = len(tokens)
                pre.add(text, tokens, counts)
                lengths.append(len(tokens) - before)
                if len(ids) >= CHUNK or len(tokens) >= PAIRS:
                    yield from chunk(serial)
                    tokens, counts, lengths, ids, sizes, serial = [], [], [], [], [], serial + 1
                    if len(pre.words) > MEMORY:
                        pre.forget()
        if ids:
            yield from chunk(serial)

    return run


class _Sums:
    """Pieces by chunk and document."""

    def __init__(self) -> None:
        self.of: dict[int, np.ndarray] = {}

    def add(self, chunk: int, at: np.ndarray, pieces: np.ndarray) -> None:
        n = np.bincount(at, pieces, CHUNK).astype(np.int64)
        if chunk in self.of:
            self.of[chunk] += n
        else:
            self.of[chunk] = n

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Sparse rows; the sums start anew."""
        for c, v in self.of.items():
            at = np.flatnonzero(v)
            yield _partial(c, at, v[at])
        self.of = {}


def _partial(chunk: int, at, pieces, ids: list | None = None, sizes: list | None = None) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), pa.array([at], pa.list_(pa.int32())), pa.array([pieces], longs), pa.array([ids], longs), pa.array([sizes], longs)], names=["chunk", "at", "pieces", "ids", "bytes"]
    )


def _joined(path):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        known: dict[str, int] = {}
        sums = _Sums()
        for batch in batches:
            for chunk, found, sizes, posts, ids, lengths in zip(*[batch.column(i) for i in range(6)], strict=True):
                name = chunk.as_py()
                if ids.is_valid:
                    yield _partial(name, [], [], ids.as_py(), lengths.as_py())
                    continue
                tokens = found.as_py()
                new = [t for t in tokens if t not in known]
                if new:
                    if len(known) + len(new) > MEMORY:
                        known, new = {}, tokens
                    known.update(zip(new, [len(e) for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)], strict=True))
                n = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
                flat = np.frombuffer(posts.as_py(), np.uint16).astype(np.int64)
                sums.add(name, flat >> 3, (flat & 7) * np.repeat(n, sizes.values.to_numpy()))
                if len(sums.of) > 400:
                    yield from sums.batches()
        yield from sums.batches()

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the partial sums of the chunks of a task, and name their documents."""
    held: dict[int, tuple[list, list]] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        ids, sizes = batch.column(3), batch.column(4)
        for k, c in enumerate(batch.column(0).to_pylist()):
            if ids[k].is_valid:
                held[c] = (ids[k].as_py(), sizes[k].as_py())
            else:
                total = sums.setdefault(c, np.zeros(CHUNK, np.int64))
                total[batch.column(1)[k].values.to_numpy()] += batch.column(2)[k].values.to_numpy()
    # A task that ran again on other rows has named its chunks anew; sums under the old names must not be lost in silence.
    if lost := sums.keys() - held.keys():
        raise RuntimeError(f"{len(lost)} chunks of token counts have no documents: the input changed between attempts of a task")
    for c, (ids, sizes) in held.items():
        n = sums.get(c, np.zeros(CHUNK, np.int64))[: len(ids)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str | Callable[[], str], *, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than limit tokens) of every row's whole text.

    Counts are those of the tokenizers library with the vocabulary at path (or at what path() gives on an executor), without added special tokens;
    a special token's string inside a text is that token.  A null text is an empty one and has no tokens.  Repeated rows
    are counted each; columns other than doc_id and text are ignored; an empty table gives no rows.  docs must give a task the same rows whenever it
    runs, as a table or a scan does.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _frequencies(path), "bucket int, chunk long, tokens array<string>, sizes array<int>, posts binary, ids array<long>, bytes array<long>"
    )
    partial = rows.repartition("bucket").select("chunk", "tokens", "sizes", "posts", "ids", "bytes").mapInArrow(
        _joined(path), "chunk long, at array<int>, pieces array<long>, ids array<long>, bytes array<long>"
    )
    return partial.repartition("chunk").mapInArrow(_documents, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
