"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

The merge list fixes how far a symbol not yet read can reach back: a merge can be undone only by a chain of merges of
ever later rank, each taking away the right-hand part of the one before. `sufficient_lookahead` follows these chains
through the list once. The transducer holds back that many symbols, tokenises what it holds, and emits every token that
ends before the held-back symbols: such tokens are final, and what follows a token border does not depend on what
precedes it. The end of a word ends all its tokens, so a word that is shorter than the lookahead leaves the window there;
such words recur, and their results are kept in a bounded table. Texts pass in segments that end at white space, and ids
leave in pieces that are hashed, counted and fed to the decoder one by one: beside the text itself memory is constant.
Decoding is an incremental state machine from ids to text.

The model is word_bpe_49k.json: special tokens are found in the raw text; the rest is normalised (NFC, white space,
lower case), split into words, mapped to bytes and merged. Null texts count as empty; null doc_ids and repeated rows
are encoded like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgraph.llm.common import arrow_schema, gathered, text_column, tokenizer_path

CACHE_WORDS = 400_000
#: Characters of a segment, which goes on to the next white space, and ids of a piece.
SEGMENT, PIECE = 1 << 16, 1 << 14
#: White space by the Unicode property, as the model's patterns mean it.
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Transducer:
    """Encodes the symbols of one word with a window of the sufficient lookahead."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges)

    def merged(self, symbols: list[str]) -> list[str]:
        """All merges in order of rank, the leftmost first among equals."""
        if len(symbols) > 48:
            return self._merged_by_heap(symbols)
        rank = self.rank.get
        while len(symbols) > 1:
            ranks = [rank(p, 1 << 30) for p in zip(symbols, symbols[1:], strict=False)]
            low = min(ranks)
            if low == 1 << 30:
                break
            i = ranks.index(low)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _merged_by_heap(self, symbols: list[str]) -> list[str]:
        parts: list[str | None] = list(symbols)
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := self.rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := self.rank.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p is not None]

    def encode(self, symbols: Iterable[str], suffix: str = "", block: int | None = None) -> Iterator[str]:
        """Tokens of a word, each as soon as it is final; the last symbol gets the suffix.

        Beside the lookahead the window takes `block` symbols, by default as many again, so that tokenising anew what is
        held back costs each symbol twice.
        """
        held: list[str] = []
        size = self.lookahead + (self.lookahead if block is None else block)
        for s in symbols:
            held.append(s)
            if len(held) > size + 1:
                end, used = len(held) - 1 - self.lookahead, 0  # the last symbol may still get the suffix
                for token in self.merged(held[:-1]):
                    if used + len(token) > end:
                        break
                    yield token
                    used += len(token)
                held = held[used:]
        if held:
            held[-1] += suffix
            yield from self.merged(held)


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols beyond a border that can still change the tokens before it.

    From the last merge to the first: a merge's reach to the left is its left part plus the longest reach among later
    merges whose right part begins with that left part, since only those lose or win it when the merge fires or not.
    The longest token is added for the symbol that starts the chain.
    """
    reach_of: dict[str, int] = {}
    most, longest = 0, 1
    for left, right in reversed(merges):
        reach = len(left) + reach_of.get(left, 0)
        most, longest = max(most, reach), max(longest, len(left) + len(right))
        for k in range(1, len(right) + 1):
            if reach_of.get(right[:k], 0) < reach:
                reach_of[right[:k]] = reach
    return most + longest


class Decoder:
    """Ids to text, piece by piece, in constant memory.

    As the library does without a decoder, tokens are joined by a space. With readable=True bytes are put together
    again: word ends become spaces and incomplete UTF-8 sequences wait in the state for their rest.
    """

    def __init__(self, tokens: list[str | None], readable: bool = False, suffix: str = "</w>"):
        self.tokens, self.readable, self.suffix = tokens, readable, suffix
        self.begun = False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.bytes = {c: b for b, c in enumerate(byte_symbols())} if readable else {}

    def feed(self, ids: Iterable[int]) -> str:
        table, size = self.tokens, len(self.tokens)
        known = [t for i in ids if 0 <= i < size and (t := table[i]) is not None]
        if not known:
            return ""
        if not self.readable:
            before, self.begun = " " if self.begun else "", True
            return before + " ".join(known)
        out = []
        for token in known:
            end = token.endswith(self.suffix)
            body = token.removesuffix(self.suffix) if end else token
            out.append(self.state.decode(bytes(self.bytes[c] for c in body)))
            if end:
                out.append(self.state.decode(b"", True) + " ")
                self.state.reset()
        return "".join(out)


class WordBpe:
    """The model of a tokenizer file of this kind."""

    _made: dict[str, WordBpe] = {}

    @classmethod
    def get(cls, path: str) -> WordBpe:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ids = self.vocabulary | self.special
        self.tokens: list[str | None] = [None] * (max(ids.values()) + 1)
        for t, i in ids.items():
            self.tokens[i] = t
        self.transducer = Transducer([tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]])
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.symbols = byte_symbols()
        self.known: dict[str, bytes] = {}
        self.id_bytes = {t: i.to_bytes(4, "little") for t, i in self.vocabulary.items()}

    def word(self, w: str) -> Iterator[bytes]:
        """The ids of one word as little-endian 32-bit integers, as soon as they are final."""
        return map(self.id_bytes.__getitem__, self.transducer.encode((self.symbols[b] for b in w.encode()), self.suffix))

    def short(self, w: str) -> bytes:
        made = b"".join(self.word(w))
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        self.known[w] = made
        return made

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # characters are lower-cased one by one, without a final form
        return text.lower()  # words never hold white space, so its runs need no replacing

    def stream(self, text: str, segment: int = SEGMENT) -> Iterator[bytes]:
        """The ids of a text in pieces."""
        get, out = self.known.get, []
        for part in segments(text, segment):
            for x in self.split.split(part) if "<|" in part else (part,):
                if x in self.special:
                    out.append(self.special[x].to_bytes(4, "little"))
                    continue
                for w in self.words.findall(self.normal(x)):
                    if len(w) <= 64:
                        out.append(get(w) or self.short(w))
                        continue
                    for i in self.word(w):
                        out.append(i)
                        if len(out) >= PIECE:
                            yield b"".join(out)
                            out = []
            if out:
                yield b"".join(out)
                out = []

    def decoder(self) -> Decoder:
        return Decoder(self.tokens)

    def encode(self, text: str, segment: int = SEGMENT) -> tuple[bytes, bytes]:
        """Ids as bytes, and the decoded text as UTF-8, of a whole text."""
        pieces, decoder = list(self.stream(text, segment)), self.decoder()
        return b"".join(pieces), "".join(decoder.feed(np.frombuffer(x, "<u4").tolist()) for x in pieces).encode()


_WHITE = regex.compile(r"[\t\n\r ]")


def segments(text: str, size: int) -> Iterator[str]:
    """A text in parts that end at white space of ASCII: normal forms, special tokens and words do not reach across it."""
    at = 0
    while len(text) - at > size:
        found = _WHITE.search(text, at + size)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema = arrow_schema(ddl)

    def run(batches):
        model = WordBpe.get(path or tokenizer_path("word_bpe_49k.json"))
        for t in gathered(batches, 4 << 20, 4000):
            n, ids, decoded = [], [], []
            for x in t.column("text"):
                count, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), model.decoder()
                for piece in model.stream(x.as_py()):
                    count += len(piece) // 4
                    of_ids.update(piece)
                    of_text.update(decoder.feed(np.frombuffer(piece, "<u4").tolist()).encode())
                n.append(count)
                ids.append(of_ids.hexdigest())
                decoded.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()).mapInArrow(run, ddl)
