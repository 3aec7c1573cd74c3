"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

A merge list determines how far to the right of a token one has to read before no continuation can change it
(`lookahead`).  The transducer buffers that many symbols and a little more, merges within the buffer, emits the tokens that
end at least the lookahead before the buffer's end, and starts again behind them.  A word that fits the buffer is its one
buffer.  Texts are encoded, decoded and hashed in pieces cut at white space, so memory is that of a piece, or of the longest run without white
space.  Decoding is a state machine on the ids: `JoinedDecoder` for files that name no decoder, `TextDecoder` to bytes and text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

#: Runs and words whose encoding is remembered at once, and the longest of them.
MEMORY, REMEMBERED = 300_000, 64
#: From this code point on, letters and their cases follow the library's own Unicode tables.
COMMON = chr(0x530)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


_NUMBER, _IDS, _TEXT = map(itemgetter, range(3))
_SPACE = regex.compile(r"[^\S\x1c-\x1f]+")
_BLANK = regex.compile(r"[ \t\n]")
#: Characters of a text that are encoded at once.
PIECE = 1 << 16


def _remembered(memory: dict, key: str, make: Callable) -> tuple[int, str, str]:
    got = memory.get(key)
    if got is None:
        got = make(key)
        if len(key) <= REMEMBERED:
            if len(memory) >= MEMORY:
                memory.clear()
            memory[key] = got
    return got


class BpeModel:
    """A byte-level BPE vocabulary from a tokenizers file: merges, special tokens, normalizer and word pattern."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.bytes = byte_alphabet()
        self.shown = dict(enumerate(self.bytes))
        self.byte_of = {c: b for b, c in enumerate(self.bytes)}
        self.lookahead = self._lookahead(merges)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.steps = [s["type"] for s in steps]
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = next((p["pattern"]["Regex"] for p in parts if p["type"] == "Split"), None)
        self.words = regex.compile(pattern) if pattern else None
        self.rare_words = pre_tokenizers.Split(Regex(pattern), "removed", invert=True) if pattern else None
        self.rare_steps = normalizers.Sequence([getattr(normalizers, x)() for x in self.steps if x in ("NFC", "Lowercase")])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._runs: dict[str, tuple[int, str, str]] = {}
        self._words: dict[str, tuple[int, str, str]] = {}
        # The whole texts of special tokens may lie in one cut only if none holds white space.
        self.whole = any(c.isspace() for x in self.special for c in x)

    def _length(self, token: str) -> int:
        return len(token.removesuffix(self.suffix)) if self.suffix and token != self.suffix else len(token)

    def _lookahead(self, merges: list) -> int:
        """Symbols to the right of a token that can decide whether it stays.

        In the order of the merges, ahead[t] is how far past its end one must read to know whether t exists at that
        stage: t may be lost to its right neighbour z by an earlier merge (t, z), which needs z and what z needs; a
        token made of (t, z) needs what z needs.
        """
        ahead: dict[str, int] = {}
        for a, b in merges:
            need = ahead.get(b, 0)
            ahead[a] = max(ahead.get(a, 0), self._length(b) + need)
            ahead[a + b] = max(ahead.get(a + b, 0), need)
        return max(ahead.values(), default=0) + 1

    def _merge(self, symbols: list[str]) -> list[str]:
        """The tokens of a sequence: always the lowest-ranked pair, leftmost first."""
        rank, n = self.rank, len(symbols)
        if n < 2:
            return symbols
        if n <= 48:
            s, none = list(symbols), len(rank)
            ranks = [rank.get(x, none) for x in zip(s, s[1:], strict=False)]
            while ranks and (least := min(ranks)) < none:
                i = ranks.index(least)
                s[i] += s.pop(i + 1)
                del ranks[i]
                if i:
                    ranks[i - 1] = rank.get((s[i - 1], s[i]), none)
                if i < len(ranks):
                    ranks[i] = rank.get((s[i], s[i + 1]), none)
            return s
        s, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := rank.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j] = a + b, ""
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := rank.get((s[i], s[nxt[i]]))) is not None:
                    heapq.heappush(heap, (r, i, s[i], s[nxt[i]]))
            if (p := prv[i]) >= 0 and (r := rank.get((s[p], s[i]))) is not None:
                heapq.heappush(heap, (r, p, s[p], s[i]))
        return [x for x in s if x]

    def transduce(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of a stream of symbols, each emitted as soon as no later symbol can change it."""
        keep, most, buffer = self.lookahead, 2 * self.lookahead + 512, []
        for x in symbols:
            buffer.append(x)
            if len(buffer) >= most:
                stable, used = len(buffer) - keep, 0
                for t in self._merge(buffer):
                    n = self._length(t)
                    if used + n > stable:
                        break
                    yield t
                    used += n
                if used:
                    del buffer[:used]
                else:  # a token longer than the buffer
                    most *= 2
        yield from self._merge(buffer)

    def encode_word(self, word: str) -> list[str]:
        """The tokens of a word; one that fits the transducer's buffer is its one buffer."""
        symbols = word.encode("utf-8").decode("latin-1").translate(self.shown)
        if not symbols or len(symbols) > self.lookahead:
            last = len(symbols) - 1
            return list(self.transduce(x + self.suffix if i == last else x for i, x in enumerate(symbols)))
        return self._merge([*symbols[:-1], symbols[-1] + self.suffix])

    def normalized(self, text: str) -> str:
        """As the file's normalizer for common letters; white space is not merged, as words never hold any."""
        for step in self.steps:
            if step == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif step == "Lowercase":
                # Character by character: a final sigma is like any other.
                text = text.lower() if "Σ" not in text else "σ".join(x.lower() for x in text.split("Σ"))
        return text

    def _word(self, word: str) -> tuple[int, str, str]:
        ids = [self.vocab[t] for t in self.encode_word(word)]
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids as the file's own rule gives it (`JoinedDecoder`)."""
        return "".join(map(JoinedDecoder(self).feed, ids))

    def _run(self, run: str) -> tuple[int, str, str]:
        """Of a run without white space: number of tokens, the ids joined by a space, and what these ids decode to."""
        if max(run) < COMMON:
            words = self.words.findall(self.normalized(run))
        else:
            words = [w for w, _ in self.rare_words.pre_tokenize_str(self.rare_steps.normalize_str(run))]
        parts = [_remembered(self._words, w, self._word) for w in words]
        if len(parts) == 1:
            return parts[0]
        return sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])

    def _pieces(self, text: str) -> Iterator[str]:
        """A text in pieces of about PIECE characters, cut behind white space."""
        at = 0
        while len(text) - at > PIECE and not self.whole:
            blank = _BLANK.search(text, at + PIECE)
            if blank is None:
                break
            yield text[at : blank.end()]
            at = blank.end()
        yield text[at:] if at else text

    def encode_runs(self, text: str) -> Iterator[list[tuple[int, str, str]]]:
        """(number, ids, decoded) of the runs of a text, piece by piece; a special token's string is that token."""
        memory = self._runs
        for piece in self._pieces(text):
            out = []
            for part in self.cut.split(piece) if self.cut and any([x in piece for x in self.special]) else [piece]:
                if part in self.special:
                    out.append((1, str(self.special[part]), self.decode([self.special[part]])))
                    continue
                # str.split takes four control characters for white space that the pattern does not.
                runs = part.split() if not any([c in part for c in "\x1c\x1d\x1e\x1f"]) else [x for x in _SPACE.split(part) if x]
                got = list(map(memory.get, runs))
                if None in got:
                    got = [_remembered(memory, run, self._run) if g is None else g for run, g in zip(runs, got, strict=True)]
                out += got
            if out:
                yield out

    def encode(self, text: str) -> list[int]:
        return [int(i) for piece in self.encode_runs(text) for _, ids, _ in piece for i in ids.split(" ")]


class JoinedDecoder:
    """The state machine of a file that names no decoder: ids become tokens, one space before each but the first.

    Its only state is whether a token came before, so texts decoded apart and joined by a space are the text decoded at once.
    """

    def __init__(self, model: BpeModel) -> None:
        self.token, self.before = model.token, False

    def feed(self, i: int) -> str:
        out = " " + self.token[i] if self.before else self.token[i]
        self.before = True
        return out


class TextDecoder:
    """Feeds on ids and gives text as soon as its bytes are complete; a word end becomes a space."""

    def __init__(self, model: BpeModel) -> None:
        self.model, self.utf8 = model, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, i: int) -> str:
        token = self.model.token[i]
        if token in self.model.special:
            return self.utf8.decode(b"", True) + token
        suffix = self.model.suffix
        ends = bool(suffix) and token.endswith(suffix)
        data = bytes(self.model.byte_of[c] for c in (token.removesuffix(suffix) if ends else token))
        return self.utf8.decode(data, ends) + " " * ends

    def close(self) -> str:
        return self.utf8.decode(b"", True)


_models: dict[str, BpeModel] = {}


def model_at(path: str) -> BpeModel:
    """The model of a file, loaded once in each Python worker."""
    if path not in _models:
        _models[path] = BpeModel(path)
    return _models[path]


def _vocabulary(path: str | Callable[[], str]) -> str:
    return path() if callable(path) else path


def _digests(path, ids_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(_vocabulary(path))
        for batch in batches:
            number, ids, text, raw = [], [], [], []
            for x in batch.column(1):
                n, joined, digests, gap = 0, [], (hashlib.sha256(), hashlib.sha256()), ""
                for piece in model.encode_runs(x.as_py() or ""):
                    n += sum(map(_NUMBER, piece))
                    these = gap + " ".join(map(_IDS, piece))
                    digests[0].update(these.encode())
                    digests[1].update((gap + " ".join(map(_TEXT, piece))).encode("utf-8"))
                    gap = " "
                    if ids_too:
                        joined += map(int, these.split())
                number.append(n)
                ids.append(digests[0].hexdigest())
                text.append(digests[1].hexdigest())
                if ids_too:
                    raw.append(joined)
            columns = [batch.column(0), pa.array(number, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids_too:
                columns.append(pa.array(raw, pa.list_(pa.int32())))
                names.append("ids")
            columns += batch.columns[2:]
            names += batch.schema.names[2:]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_decode(docs: DataFrame, path: str | Callable[[], str], *, ids: bool = False, rows: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    path: the vocabulary's file, or a function that gives it on an executor.  Returns a row per input row: doc_id,
    n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of what the ids decode to: tokens joined by one space, as
    the file names no decoder), with ids the ids themselves, and with rows the input row as a struct.  A null text is an empty one: no tokens, the digests of nothing.  Columns other
    than doc_id and text are ignored; equal rows give equal rows.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else []
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return d.mapInArrow(_digests(path, ids), schema + (f", row {d.schema['row'].dataType.simpleString()}" if rows else ""))
