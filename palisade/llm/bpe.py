"""Byte-level BPE by a bounded-lookahead streaming transducer, and its decoder.

For a merge list under which neighbouring tokens are either compatible (their bytes
together encode to just them) or not, the encoding of a prefix ends in one certain
token: the one whose predecessor, the last token of the prefix before it, is compatible
with it. The transducer keeps that last token for each position. A token of a longer
text can begin no further back than the longest token is long, so that length is the
sufficient lookahead: tokens on which the chains from all positions within it agree are
stable, and are emitted. State is one window of positions, whatever the text's length.

Texts are first cut into pretokens by the byte-level pattern. Encodings of pretokens and
compatible pairs are remembered in tables of fixed size.

Results for special rows: a null text is an empty one, with no tokens and the digests of
the empty string. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Entries of each table of remembered encodings or pairs.
REMEMBERED = 600_000
#: Longer pretokens are not remembered.
LONGEST_REMEMBERED = 64
#: Tokens decoded, or pretokens encoded, at once.
CHUNK = 8192

# White space of Unicode (fixed values).
SPACE = r"\t-\r \x85\xa0  -     　"
# The byte-level pattern (fixed value), once for any text and once for texts whose only
# letters beyond ASCII are Latin ones, where the faster engine of `re` suffices.
ANY_TEXT = regex.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
LATIN = "A-Za-zÀ-ÖØ-öø-ſ"
LATIN_SPACE = r"\t-\r "
LATIN_TEXT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LATIN}]+| ?[0-9]+| ?[^{LATIN_SPACE}{LATIN}0-9]+|[{LATIN_SPACE}]+(?![^{LATIN_SPACE}])|[{LATIN_SPACE}]+")
NOT_LATIN_TEXT = re.compile(rf"[^\x00-\x7f{LATIN}¡-©«-±´¶-¸»¿×÷‐-‧‰-⁞€]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens' bytes, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        alphabet = byte_alphabet()
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {token: i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.bytes = {i: to_bytes(token) for token, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.ids = {to_bytes(token): i for token, i in ids.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.lookahead = max(map(len, self.ids))
        self.parts = {out: (a, b, rank) for (a, b), (rank, out) in reversed(self.merges.items())}
        self.matcher = ahocorasick.Automaton()  # of all tokens that end at a position, the longest first
        for token, i in self.ids.items():
            self.matcher.add_word(token.decode("latin-1"), (i, len(token)))
        self.matcher.make_automaton()
        self.special_pattern = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that border on the right (1) or left (0) end while this one is built, each with the rank that uses it up."""
        out, used = [], 1 << 60
        while True:
            out.append((token, used))
            if token not in self.parts:
                return out
            used, token = self.parts[token][2], self.parts[token][side]


class Encoder(dict):
    """Pretokens to token ids; one per Python worker. As a mapping it holds what it remembers."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.fits: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        found = self.edges[side].get(token)
        if found is None:
            found = self.edges[side][token] = self.v.edge(token, side)
        return found

    def compatible(self, a: int, b: int) -> bool:
        """No merge across the border comes before the merges that use up its two sides.

        Of equal merges the left one comes first: it wins against the right side's own
        merge and loses against the left side's.
        """
        key = a << 32 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            merges, found = self.v.merges, True
            for x, x_used in self.edge(a, 1):
                for y, y_used in self.edge(b, 0):
                    rank = merges.get((x, y))
                    if rank is not None and rank[0] < x_used and rank[0] <= y_used:
                        found = False
            self.fits[key] = found
        return found

    def advance(self, data: bytes, to: int, last: list[int], start: int, previous: int) -> None:
        """Finds the last token of each prefix up to `to`; `last` has those that end after `start`, a border behind the token `previous`."""
        fits, done = self.fits, start + len(last) - 1
        base = max(start, done + 1 - self.v.lookahead)
        for end, (token, size) in self.v.matcher.iter(data[base:to].decode("latin-1")):
            end += base
            if end <= done:  # has its token
                continue
            before = last[-size] if size <= end - start else previous
            if before >= 0:
                fit = fits.get(before << 32 | token)
                if not (fit if fit is not None else self.compatible(before, token)):
                    continue
            last.append(token)
            done = end

    def transduce(self, data: bytes) -> Iterator[list[int]]:
        """Lists of tokens, each emitted when no further byte can change it."""
        ahead = self.v.lookahead
        last: list[int] = []  # last[i]: token that ends prefix start + i + 1
        start, previous, n = 0, -1, len(data)  # tokens before `start` are out, `previous` the last of them
        at = 0
        while at < n:
            # short texts end before anything is stable; long ones are taken on by the lookahead
            at = min(n, max(at + ahead, start + 4 * ahead))
            self.advance(data, at, last, start, previous)
            tokens = self.chain(last, start, at)
            if at < n:  # keep what every position within the lookahead agrees on
                ends = set(self.ends(tokens, start))
                for j in range(at - ahead, at):
                    ends &= set(self.ends(self.chain(last, start, j), start)) | set(range(j + 1, at + 1))
                stable, end, out = max((e for e in ends if e <= at - ahead), default=start), start, []
                for token in tokens:
                    if end >= stable:
                        break
                    out.append(token)
                    end += len(self.v.bytes[token])
                if not out:
                    continue
                tokens, previous = out, out[-1]
                del last[: end - start]
                start = end
            yield tokens

    def chain(self, last: list[int], start: int, end: int) -> list[int]:
        """The tokens of the prefix that ends at `end`, from `start` on."""
        out, sizes, at = [], self.v.bytes, end - start
        while at > 0:
            out.append(last[at - 1])
            at -= len(sizes[out[-1]])
        return out[::-1]

    def ends(self, tokens: list[int], start: int) -> Iterator[int]:
        for token in tokens:
            start += len(self.v.bytes[token])
            yield start

    def pretoken(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8", "surrogatepass")
        if len(data) <= 4 * self.v.lookahead:  # ends before anything could be emitted
            last: list[int] = []
            self.advance(data, len(data), last, 0, -1)
            out = tuple(self.chain(last, 0, len(data)))
        else:
            out = tuple(chain.from_iterable(self.transduce(data)))
        if len(text) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = out
        return out

    __missing__ = pretoken

    def _plain(self, text: str) -> Iterator[list[int]]:
        pattern = ANY_TEXT if NOT_LATIN_TEXT.search(text) else LATIN_TEXT
        pieces = iter(pattern.findall(text) if len(text) < 1 << 20 else (m.group() for m in pattern.finditer(text)))
        while some := list(islice(pieces, CHUNK)):
            yield list(chain.from_iterable(map(self.__getitem__, some)))

    def encode(self, text: str) -> Iterator[list[int]]:
        """Token ids in chunks; special tokens' strings become those tokens."""
        at = 0
        for m in self.v.special_pattern.finditer(text) if self.v.special_pattern else ():
            yield from self._plain(text[at : m.start()])
            yield [self.v.special[m.group()]]
            at = m.end()
        yield from self._plain(text[at:] if at else text)


class Decoder:
    """Token ids to text, a chunk at a time; an unfinished character waits for its rest."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes = vocabulary.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join([self.bytes[i] for i in ids]))

    def finish(self) -> str:
        return self.state.decode(b"", True)


RESULT_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest_rows(vocabulary_text):
    """mapInArrow function: (doc_id, text) to token counts and digests of ids and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(vocabulary_text.value)
        encoder = Encoder(vocabulary)
        shown = {i: str(i) for i in vocabulary.bytes}
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for text in batch.column("text"):
                decoder, n, of_ids, of_text = Decoder(vocabulary), 0, hashlib.sha256(), hashlib.sha256()
                for ids in encoder.encode(text.as_py() or ""):
                    if not ids:
                        continue
                    joined = ",".join([shown[i] for i in ids])
                    of_ids.update((joined if n == 0 else f",{joined}").encode())
                    n += len(ids)
                    of_text.update(decoder.feed(ids).encode())
                of_text.update(decoder.finish().encode())
                counts.append(n)
                id_digests.append(of_ids.hexdigest())
                text_digests.append(of_text.hexdigest())
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def token_rows(vocabulary_text):
    """mapInArrow function: (doc_id, text) to ids and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(vocabulary_text.value)
        encoder = Encoder(vocabulary)
        for batch in batches:
            ids, texts = [], []
            for text in batch.column("text"):
                ids.append([i for part in encoder.encode(text.as_py() or "") for i in part])
                decoder = Decoder(vocabulary)
                texts.append(decoder.feed(ids[-1]) + decoder.finish())
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def vocabulary_path() -> str:
    """The public byte-level vocabulary of this machine; any such file may be passed instead."""
    try:
        import public_tokenizers

        return public_tokenizers.path(VOCABULARY)
    except ImportError:
        return f"/opt/tokenizers/{VOCABULARY}"


def _sent(spark: SparkSession, path: str | None):
    # a vocabulary file is a few MB whatever the corpus
    with open(path or vocabulary_path(), encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(token_rows(_sent(documents.sparkSession, path)), "doc_id long, ids array<int>, decoded string")


def token_digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(digest_rows(_sent(documents.sparkSession, path)), RESULT_SCHEMA)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
